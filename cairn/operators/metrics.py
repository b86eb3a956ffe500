"""Confusion matrices in long form (assigned, known, n) and what derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_matrix(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """df(assigned, known) -> (assigned, known, n) for all pairs of labels from 0 to the largest, zeros included."""
    by = by or []
    pairs = df.where("assigned is not null and known is not null").select(*by, F.col("assigned").cast("int").alias("assigned"), F.col("known").cast("int").alias("known"))
    counts = pairs.groupBy(*by, "assigned", "known").agg(F.count("*").alias("n"))
    top = counts.groupBy(*by).agg(F.max(F.greatest("assigned", "known")).alias("m")).where("m is not null")
    grid = top.withColumn("assigned", F.explode(F.sequence(F.lit(0), "m"))).withColumn("known", F.explode(F.sequence(F.lit(0), "m"))).drop("m")
    return grid.join(counts, [*by, "assigned", "known"], "left").select(*by, "assigned", "known", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _sides(conf: DataFrame) -> DataFrame:
    """(label, hit, predicted, real) sums."""
    cells = conf.select(F.explode(F.array(F.struct(F.col("assigned").alias("label"), F.col("n").alias("p"), F.lit(0).cast("long").alias("r"), F.when(F.col("assigned") == F.col("known"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("known").alias("label"), F.lit(0).cast("long").alias("p"), F.col("n").alias("r"), F.lit(0).cast("long").alias("h")))).alias("c"))
    return cells.groupBy("c.label").agg(F.sum("c.h").alias("hit"), F.sum("c.p").alias("predicted"), F.sum("c.r").alias("real"))


def user_producer(conf: DataFrame) -> DataFrame:
    """(label, user, producer) in percent; null where the label was never assigned, or never occurs."""
    s = _sides(conf)
    return s.select("label", (100.0 * F.col("hit") / F.nullif("predicted", F.lit(0))).alias("user"), (100.0 * F.col("hit") / F.nullif("real", F.lit(0))).alias("producer"))


def three_metrics(conf: DataFrame) -> DataFrame:
    """(label, tp, miss_rate, false_discovery): shares of the class size for balanced classes, whose size is that of
    class 0, and of the rows assigned to the label."""
    s = _sides(conf)
    size = conf.where("known = 0").agg(F.sum("n").alias("size"))
    s = s.crossJoin(F.broadcast(size))  # one row
    real, pred = F.nullif("size", F.lit(0)), F.nullif("predicted", F.lit(0))
    return s.select("label", (F.col("hit") / real).alias("tp"), ((F.col("size") - F.col("hit")) / real).alias("miss_rate"), ((F.col("predicted") - F.col("hit")) / pred).alias("false_discovery"))


def binary_quality(df: DataFrame) -> DataFrame:
    """df(assigned, known) of 0 (a) and 1 (b) -> one row of completeness, correctness, quality of both, in percent."""
    hit = lambda a, k: F.count_if((F.col("assigned") == a) & (F.col("known") == k))
    c = df.agg(hit(0, 0).alias("aa"), hit(0, 1).alias("ab"), hit(1, 0).alias("ba"), hit(1, 1).alias("bb"))
    share = lambda n, *d: 100.0 * F.col(n) / F.nullif(sum(F.col(x) for x in d), F.lit(0))
    return c.select(
        share("aa", "aa", "ba").alias("a_comp"), share("aa", "aa", "ab").alias("a_corr"), share("aa", "aa", "ab", "ba").alias("a_qual"),
        share("bb", "bb", "ab").alias("b_comp"), share("bb", "bb", "ba").alias("b_corr"), share("bb", "bb", "ab", "ba").alias("b_qual"),
    )


def dilate(conf: DataFrame, factor: int) -> DataFrame:
    """(row, col, value): the matrix over its largest cell, each cell repeated factor x factor."""
    top = conf.agg(F.max("n").alias("top"))
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    cells = conf.crossJoin(F.broadcast(top)).withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))  # one row
    return cells.select((F.col("assigned") * factor + F.col("i")).alias("row"), (F.col("known") * factor + F.col("j")).alias("col"), (F.col("n") / F.nullif("top", F.lit(0))).alias("value"))


def resampled_confusion(trials: DataFrame) -> DataFrame:
    """trials(trial, assigned, known) -> (assigned, known, mean, std): over the trials' matrices, population deviation."""
    return confusion_matrix(trials, ["trial"]).groupBy("assigned", "known").agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"))


def format_confusion(conf: DataFrame) -> str:
    """A printable matrix; small by nature, so it is collected."""
    cells = {(r["assigned"], r["known"]): r["n"] for r in conf.collect()}
    size = 1 + max((a for a, _ in cells), default=-1)
    return "\n".join(" ".join(f"{cells.get((a, k), 0):>8}" for k in range(size)) for a in range(size))


def format_three(metrics: DataFrame) -> str:
    """three_metrics as printable lines, in percent with two decimals; a row a label, so it is collected."""
    rows = sorted(metrics.collect(), key=lambda r: r["label"])
    share = lambda v: "-" if v is None else f"{100 * v:.2f}"
    return "\n".join(f"{r['label']:>4} {share(r['tp']):>8} {share(r['miss_rate']):>8} {share(r['false_discovery']):>8}" for r in rows)
