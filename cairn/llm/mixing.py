"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import common as C

#: A source's target never exceeds this many times its size.
MOST = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, size) -> (source, source_size, weight, target), one row for each source, null last.

    All sizes together are shared by weight; a source above MOST times its size stops there and the excess is shared
    again by weight until none is above. Each round is one aggregate over the sources, so they may be many.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = C.global_positions(totals.withColumn("last", F.col("source").isNull()), ["last", "source"], name="place")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    ranked = C.stash(ranked.select("source", "source_size", weight.cast("long").alias("weight")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    left, weights, capped = total, None, None
    cap = MOST * F.col("source_size")
    while True:
        over = F.lit(False) if weights is None else cap * weights < F.lit(left) * F.col("weight")
        row = ranked.agg(
            F.sum(F.when(over, cap)).alias("caps"), F.sum(F.when(~over, F.col("weight"))).alias("w"), F.count(F.when(over, 1)).alias("n")
        ).first()
        if row["n"] == capped or not row["w"]:
            break
        left, weights, capped = total - (row["caps"] or 0), row["w"], row["n"]
    share = F.lit(float(0)) if not weights else (F.lit(left) * F.col("weight")).cast("double") / F.lit(weights)
    target = F.when(over, cap.cast("double")).otherwise(share) if weights else F.lit(0.0)
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def uniform(*cols: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends only on the seed and the columns' values."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("null")) for c in cols))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def copies(source_size: Column, target: Column, draw: Column) -> Column:
    """floor(rate) copies, plus one if the draw is below the fraction; rate = target / source_size."""
    rate = F.when(source_size > 0, target / source_size).otherwise(0.0)
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("long")


def mix_counts(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text, source, ...) -> (doc_id, size, source_size, target, copies, taken), one row for each input row.

    size counts the words between ASCII white space; the rate of a source is its target over its size, at most MOST.
    A document is taken floor(rate) times and once more if a hash of seed and doc_id falls below the fraction, so
    reruns agree. Null text: size 0, taken 0. Null source: a source of its own, the last. Rows that repeat a doc_id
    share its draw. Empty tables give no rows; other columns are ignored.
    """
    sizes = C.stash(docs.select("doc_id", "source", word_count().alias("size")))
    plan = targets(sizes)
    joined = sizes.join(C.small(plan.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
    n = copies(F.col("source_size"), F.col("target"), uniform(F.col("doc_id"), seed=seed))
    return joined.select("doc_id", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with each row as many times as mix_counts says; same columns. Sources without words keep none of their rows."""
    plan = targets(docs.select("source", word_count().alias("size"))).select(F.col("source").alias("_cairn_s"), F.col("source_size").alias("_cairn_n"), F.col("target").alias("_cairn_t"))
    times = copies(F.col("_cairn_n"), F.col("_cairn_t"), uniform(F.col("doc_id"), seed=seed))
    joined = docs.join(C.small(plan), F.col("source").eqNullSafe(F.col("_cairn_s")))
    return joined.withColumn("_cairn_copy", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)
