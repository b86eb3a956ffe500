"""Ensembles of random-projection trees.

A rulebook row is (tree, tag, split, vec, gini, props): the root has tag 1, the children of tag t have 2t (projection <=
split) and 2t + 1; a leaf's split is infinite. Trees grow one per task from bounded balanced samples; scoring walks the
rulebook in batches and decides in SQL aggregates.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.sampling import disjoint_balanced

SCHEMA = "tree int, tag long, split double, vec array<double>, gini double, props array<double>"
#: Rows that a tree grows from at most, unless fit is told another number.
TREE_ROWS = 200_000


def gini(counts: np.ndarray) -> tuple[float, np.ndarray]:
    props = counts / max(1, counts.sum())
    return float(1 - (props**2).sum()), props


def grow(x: np.ndarray, y: np.ndarray, labels: int, impurity: float, min_obs: int, seed: int) -> list[tuple]:
    """Rules of one tree: split at the jittered median of the projection on a random unit vector until pure or small."""
    rng = np.random.default_rng(seed)
    rules, todo = [], [(1, np.arange(len(y)))]
    while todo:
        tag, rows = todo.pop()
        g, props = gini(np.bincount(y[rows], minlength=labels))
        if g > impurity and len(rows) > min_obs and tag < 1 << 60:
            vec = rng.random(x.shape[1])
            vec /= np.linalg.norm(vec)
            at = x[rows] @ vec
            spread = np.linalg.norm(x[rows] - x[rows[0]], axis=1).max()
            split = float(np.median(at) + rng.uniform(-6, 6) * spread / np.sqrt(x.shape[1]) / 10)
            left = at <= split
            if left.all() or not left.any():
                split = float(np.median(at))
                left = at <= split
            if not left.all() and left.any():
                rules.append((tag, split, vec.tolist(), g, props.tolist()))
                todo += [(2 * tag, rows[left]), (2 * tag + 1, rows[~left])]
                continue
        rules.append((tag, float("inf"), [0.0] * x.shape[1], g, props.tolist()))
    return rules


def fit(df: DataFrame, trees: int = 10, impurity: float = 0.2, min_obs: int = 20, seed: int = 1, rows: int = TREE_ROWS) -> DataFrame:
    """df(id, label, feats) -> rulebook. Each tree gets its own balanced, disjoint sample; no labels: no rules.

    rows: what a tree grows from at most, as one task holds it in memory: the sample has min(rarest // trees, rows //
    labels) rows of each label, chosen by the seeded order of sample_key before any row reaches a tree.
    """
    top = df.agg(F.max("label").alias("m")).first()["m"]
    labels = 0 if top is None else int(top) + 1

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        tree = int(pdf["tree"].iloc[0])
        rules = grow(np.stack(pdf["feats"].to_numpy()).astype(float), pdf["label"].to_numpy(int), labels, impurity, min_obs, seed + tree)
        return pd.DataFrame([(tree, *r) for r in rules], columns=["tree", "tag", "split", "vec", "gini", "props"])

    return disjoint_balanced(df, trees, seed, rows).select("id", "label", "feats", "tree").groupBy("tree").applyInPandas(one, SCHEMA)


def walk(df: DataFrame, rulebook: DataFrame) -> DataFrame:
    """df(id, feats) -> (id, tree, gini, props): the leaf of each row in each tree; a missing branch means its parent.

    The rulebook is a model of bounded size (trees x nodes), collected and broadcast.
    """
    book: dict[int, dict[int, tuple]] = {}
    for r in rulebook.collect():
        book.setdefault(r["tree"], {})[r["tag"]] = (r["split"], np.array(r["vec"]), r["gini"], r["props"])
    shared = df.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["feats"].to_numpy()).astype(float)
            for tree, rules in sorted(shared.value.items()):
                number = {tag: i for i, tag in enumerate(rules)}
                leaf, todo = np.zeros(len(x), int), [(1, np.arange(len(x)))]
                while todo:
                    tag, rows = todo.pop()
                    split, vec = rules[tag][:2]
                    left = x[rows] @ vec <= split if np.isfinite(split) else None
                    for child, mine in [(None, rows)] if left is None else [(2 * tag, rows[left]), (2 * tag + 1, rows[~left])]:
                        if child in rules:
                            if len(mine):
                                todo.append((child, mine))
                        else:
                            leaf[mine] = number[tag]
                gini, props = np.array([r[2] for r in rules.values()]), np.array([r[3] for r in rules.values()])
                yield pd.DataFrame({"id": pdf["id"], "tree": tree, "gini": gini[leaf], "props": list(props[leaf])})

    return df.select("id", "feats").mapInPandas(run, "id long, tree int, gini double, props array<double>")


def decide(leaves: DataFrame, how: str = "wmean") -> DataFrame:
    """(id, tree, gini, props) -> (id, label, p): decision values and the label of the largest, ties to the smallest.

    wmean: mean of the trees' proportions weighted by 1 - gini; wmax: largest (1 - gini) * proportion.
    """
    w = leaves.withColumn("w", 1.0 - F.col("gini")).select("id", "w", F.posexplode("props").alias("label", "p"))
    if how == "wmean":
        value = F.sum(F.col("w") * F.col("p")) / (F.sum("w") + F.lit(float(np.spacing(32))))
    elif how == "wmax":
        value = F.max(F.col("w") * F.col("p"))
    else:
        raise ValueError(f"unknown decision function: {how}")
    return w.groupBy("id", "label").agg(value.alias("p"))


def predict(leaves: DataFrame, how: str = "wmean") -> DataFrame:
    """(id, label, p) of the winning label; values within 1e-12 count as ties."""
    p = decide(leaves, how).withColumn("p", F.round("p", 12))
    best = p.groupBy("id").agg(F.max(F.struct(F.col("p"), (-F.col("label")).alias("l"))).alias("b"))
    return best.select("id", (-F.col("b.l")).cast("int").alias("label"), F.col("b.p").alias("p"))
