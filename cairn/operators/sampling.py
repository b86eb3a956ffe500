"""Seeded samples that depend only on ids: reruns and other partitionings give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.plans.materialize import ranked

PRIME = 2147483647


def sample_key(seed: int, id: str = "id") -> Column:
    """A pseudo-random order of ids that any SQL engine can compute."""
    return F.pmod(F.pmod(F.col(id), F.lit(PRIME)) * 48271 + seed, F.lit(PRIME))


def _ranks(df: DataFrame, seed: int) -> DataFrame:
    return ranked(df.withColumn("_k", sample_key(seed)), ["label"], ["_k", "id"], "_r").drop("_k")


def _sizes(df: DataFrame) -> dict:
    return {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}


def balanced_split(df: DataFrame, seed: int, folds: int = 2, rows: int | None = None) -> DataFrame:
    """(id, label, ...) with fold 0 .. folds - 1: as many rows of each label in each fold, folds disjoint, as large as the
    rarest label allows. Rows without a label, and rows beyond the folds, are left out. rows: a fold has so many at most,
    the same quota of each label (at least one row), taken in sample order."""
    known = df.where("label is not null")
    sizes = _sizes(known)
    n = min(sizes.values(), default=0) // folds
    if rows is not None and sizes:
        n = min(n, max(1, rows // len(sizes)))
    fold = F.floor(F.col("_r") / max(1, n)).cast("int")
    return _ranks(known, seed).withColumn("fold", fold).where(F.col("_r") < n * folds).drop("_r")


def sized_split(df: DataFrame, sizes: dict[int, tuple[int, int]], seed: int) -> DataFrame:
    """fold 0: the first sizes[label][0] rows of each label in sample order, fold 1: the next sizes[label][1]."""
    rows = _ranks(df.where(F.col("label").isin(list(sizes))), seed)
    fold = F.lit(None).cast("int")
    for label, (a, b) in sizes.items():
        own = F.col("label") == label
        fold = F.when(own & (F.col("_r") < a), 0).when(own & (F.col("_r") < a + b), 1).otherwise(fold)
    return rows.withColumn("fold", fold).where("fold is not null").drop("_r")


def one_vs_rest(df: DataFrame, positive: int) -> DataFrame:
    return df.withColumn("label", F.when(F.col("label") == positive, 1).when(F.col("label").isNotNull(), 0))


def skip_sample(df: DataFrame, skip: int, seed: int) -> DataFrame:
    """All labelled rows and floor(u / skip) of the u unlabelled ones; skip 1: all of these, skip 0: none."""
    if skip == 1:
        return df
    known = df.where("label is not null")
    if skip < 1:
        return known
    free = df.where("label is null")
    n = free.count() // skip
    picked = ranked(free.withColumn("_k", sample_key(seed)), [], ["_k", "id"], "_r").where(F.col("_r") < n).drop("_k", "_r")
    return known.unionByName(picked)


def disjoint_balanced(df: DataFrame, estimators: int, seed: int, rows: int | None = None) -> DataFrame:
    """Rows for each of several estimators (column tree): disjoint, floor(rarest / estimators) of each label, and at most
    floor(rows / labels) if rows is given."""
    return balanced_split(df, seed, estimators, rows).withColumnRenamed("fold", "tree")
