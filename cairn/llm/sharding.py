"""Shards of near-equal bytes: minimax contiguous partition of ordered atomic groups (equal texts)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import common as C

#: Group ends that the driver may hold to finish the search; beyond it the bracket is narrowed by cluster passes.
DRIVER_ENDS = 200_000
PROBES = 16


def text_size() -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def text_group() -> Column:
    """The same 128-bit digest for equal texts; null is a group of its own."""
    return F.coalesce(F.substring(F.sha2("text", 256), 1, 32), F.lit("null"))


def greedy(reach: Callable[[int], int], capacity: int, shards: int) -> list[int]:
    """Ends of the shards if each takes whole groups as long as they fit."""
    ends = [0]
    for _ in range(shards):
        ends.append(reach(ends[-1] + capacity))
    return ends[1:]


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """ends(end long): running sums of ordered group sizes. The cuts of the smallest feasible shard capacity.

    Binary search over capacities, each checked greedily. What the driver holds of the ends is only those between the
    cuts of the bracket's two capacities, and only if they are few; else passes over the table check PROBES capacities
    at a time and narrow the bracket first.
    """

    def reach_all(targets: list[int]) -> list[int]:
        row = ends.agg(*(F.max(F.when(F.col("end") <= t, F.col("end"))).alias(f"t{i}") for i, t in enumerate(targets))).first()
        return [x or 0 for x in row]

    def cuts_of(capacities: list[int]) -> list[list[int]]:
        at, out = [0] * len(capacities), [[] for _ in capacities]
        for _ in range(shards):
            at = reach_all([a + c for a, c in zip(at, capacities)])
            for o, a in zip(out, at):
                o.append(a)
        return out

    good = max(-(-total // shards), largest)  # at best
    bad, good = good - 1, good + largest
    low, high = cuts_of([bad, good])
    while True:
        spans = [(F.col("end") >= a) & (F.col("end") <= b) for a, b in zip(low, high)]
        inside = spans[0]
        for s in spans[1:]:
            inside = inside | s
        near = ends.where(inside)
        if near.limit(DRIVER_ENDS + 1).count() <= DRIVER_ENDS:
            known = np.unique(np.array([r[0] for r in near.select("end").collect()] + [0], np.int64))
            reach = lambda t: int(known[np.searchsorted(known, t, side="right") - 1])
            while good - bad > 1:
                mid = (bad + good) // 2
                if greedy(reach, mid, shards)[-1] == total:
                    good = mid
                else:
                    bad = mid
            return greedy(reach, good, shards)
        if good - bad <= 1:
            return cuts_of([good])[0]
        tries = sorted({bad + (good - bad) * i // (PROBES + 1) for i in range(1, PROBES + 1)} - {bad, good}) or [(bad + good) // 2]
        for c, cut in zip(tries, cuts_of(tries)):
            if cut[-1] == total:
                good, high = c, cut
                break
            bad, low = c, cut


def group_shards(groups: DataFrame, shards: int) -> DataFrame:
    """groups(g, bytes, first_id) -> (g, shard): contiguous in the order of first_id, then g."""
    placed = C.stash(C.global_positions(groups, ["first_id", "g"], value="bytes", name="before").withColumn("end", F.col("before") + F.col("bytes")))
    total = placed.agg(F.max("end").alias("t"), F.max("bytes").alias("m")).first()
    if total["t"] is None:
        return placed.select("g", F.lit(0).alias("shard"))
    cuts = minimax_cuts(placed.select("end"), total["t"], total["m"], shards)
    shard = F.lit(0)
    for cut in cuts[:-1]:
        shard = shard + F.when(F.col("end") > cut, 1).otherwise(0)
    return placed.select("g", shard.cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 8, keep: list[str] | None = None) -> DataFrame:
    """docs -> its columns (or only those in keep) plus size, text_crc32, law, shard, slot, grown_shard (columns of these names are replaced).

    Equal texts form an atomic group and share a shard; groups stand in the order of their smallest doc_id, shards are
    contiguous runs of groups, and the largest shard is as small as any such cut allows (law `bytes`). slot numbers the
    rows of a shard from 0 in the order of doc_id, crc, size and row key. grown_shard is null under this law.

    Null text counts as no bytes and is a group of its own; null doc_ids come first. Repeated rows are separate rows of
    one group. A group larger than an even share makes its shard as large as itself. Empty tables give no rows.
    """
    docs = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard", "_cairn_g", "_cairn_r")
    keep = list(docs.columns) if keep is None else keep
    rows = docs.withColumns(
        {"size": text_size(), "text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")), "_cairn_g": text_group(), "_cairn_r": F.monotonically_increasing_id()}
    )
    rows = C.stash(rows.select(*dict.fromkeys([*keep, "doc_id"]), "size", "text_crc32", "_cairn_g", "_cairn_r"))  # written, so that a row keeps its number
    thin = rows.select("_cairn_r", "doc_id", "text_crc32", "size", "_cairn_g")
    groups = thin.select(F.col("_cairn_g").alias("g"), "size", "doc_id").groupBy("g").agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("first_id"))
    dealt = group_shards(groups, shards).withColumnRenamed("g", "_cairn_g")
    placed = C.global_positions(thin.join(dealt, "_cairn_g"), ["doc_id", "text_crc32", "size", "_cairn_g"], within="shard", name="slot")
    if set(keep) <= {"doc_id"}:
        out = placed
    else:
        out = rows.join(C.small(C.stash(placed.select("_cairn_r", "shard", "slot"))), "_cairn_r")  # texts move once, to their places
    return out.select(*keep, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
