"""Exact top-k inner-product search by columnar branch and bound."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm import common as C

#: Queries searched in one pass over the candidates; what is broadcast is bounded by this.
QUERY_BLOCK = 4096
#: Candidates laid out vertically at a time.
CANDIDATES = 4096
#: Candidates whose scores give every query of a block its first bound.
FIRST = 4096
#: Dimensions accumulated before candidates are compacted again.
DIMENSIONS = 16


class Best:
    """The k best (score, id) of one query so far: larger score first, ties to the smaller id. floor: what a candidate must
    reach, the k-th score here or among some other candidates."""

    def __init__(self, k: int, floor: int | None = None):
        self.k, self.score, self.ids, self.floor = k, np.empty(0, np.int64), np.empty(0, np.int64), floor

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        keep = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[keep], ids[keep]
        if len(keep) == self.k:
            self.floor = max(int(self.score[-1]), self.score[-1] if self.floor is None else self.floor)


def _scale(x: np.ndarray, factor: float) -> np.ndarray:
    return np.floor(factor * x)


def _safe(q: np.ndarray, c: np.ndarray) -> bool:
    """Whether double arithmetic gives every partial sum exactly."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1]) < 2**53


def search_chunk(best: list[Best], q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, cuts: list[int]) -> None:
    """Raises best by the candidates in the rows of c.

    Dimension blocks (cuts) are accumulated one after another over the vertical layout of c. After each, a candidate
    survives for a query only if its partial sum plus the largest product of the masses that remain on both sides
    (Cauchy-Schwarz) reaches the query's k-th score; survivors are compacted before the next block.
    """
    if not _safe(q, c):  # beyond double: exact integers, limited to long at the end
        big = np.clip((q.astype(object) @ c.T.astype(object)), -(2**63) + 1, 2**63 - 1).astype(np.int64)
        for i, b in enumerate(best):
            other = c_ids != q_ids[i]
            b.add(big[i][other], c_ids[other])
        return
    tall = np.ascontiguousarray(c.T)
    mass = lambda x: [np.sqrt((x[:, a:] ** 2).sum(1)) * (1 + 1e-9) for a in cuts[1:]]
    q_mass, c_mass = mass(q), mass(c)
    for lo in range(0, len(q), 512):
        part = q[lo : lo + 512, : cuts[1]] @ tall[: cuts[1]]
        for i in range(lo, min(lo + 512, len(q))):
            b, acc = best[i], part[i - lo]
            live = np.flatnonzero(acc + q_mass[0][i] * c_mass[0] + 1e-6 >= b.floor) if b.floor is not None else np.arange(len(c))
            acc = acc[live]
            for step in range(1, len(cuts) - 1):
                if not len(live):
                    break
                acc = acc + q[i, cuts[step] : cuts[step + 1]] @ tall[cuts[step] : cuts[step + 1], live]
                if b.floor is not None:
                    stay = acc + q_mass[step][i] * c_mass[step][live] + 1e-6 >= b.floor
                    live, acc = live[stay], acc[stay]
            if len(live):
                other = c_ids[live] != q_ids[i]
                if other.any():
                    b.add(acc[other].astype(np.int64), c_ids[live][other])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _search(batches, queries, k: int, factor: float, base: int):
    q_ids, q, floors = queries.value
    width = q.shape[1]
    order = np.argsort(-(q**2).mean(0), kind="stable")  # dimensions with the most mass first: bounds tighten sooner
    q = np.ascontiguousarray(q[:, order])
    cuts = [*range(0, width, DIMENSIONS), width]
    best = [Best(k, f) for f in floors]
    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATES):
            piece = batch.slice(at, CANDIDATES)
            c = _scale(_matrix(piece.column("v"), width), factor)[:, order]
            search_chunk(best, q_ids, q, piece.column("id").to_numpy(zero_copy_only=False), c, cuts)
    n = [len(b.ids) for b in best]
    if sum(n):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(base + np.arange(len(best)), n)), pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate([b.ids for b in best])), pa.array(np.concatenate([b.score for b in best]))],
            names=["qx", "query_id", "vec_id", "score"],
        )


def first_floors(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[int | None]:
    """For each query its k-th score among a few candidates; None where they are fewer or too large for doubles."""
    if len(c) <= k or not _safe(q, c):
        return [None] * len(q)
    out: list[int | None] = []
    for lo in range(0, len(q), 512):
        score = q[lo : lo + 512] @ c.T
        score[q_ids[lo : lo + 512, None] == c_ids[None, :]] = -np.inf
        kth = np.partition(score, len(c) - k, axis=1)[:, len(c) - k]
        out += [int(x) if np.isfinite(x) else None for x in kth]
    return out


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, factor: float = 64.0) -> DataFrame:
    """candidates, queries (vec_id, embedding) -> (query_id, rank, vec_id, score): each query's k highest scores.

    A component x counts as floor(factor * x), x as double; the score is the integer inner product. Every candidate but
    those with the query's own vec_id is ranked, ties to the smaller vec_id; fewer than k: all. Queries are searched in
    blocks of about QUERY_BLOCK, one after another: what is broadcast is bounded, and released when the block's best k
    of every query are written. FIRST candidates give a block its first bounds; every partition returns at most k rows a
    query.

    Null ids, null vectors, empty vectors and vectors with null or non-finite components take no part. Vectors of
    different lengths are not compared. Repeated rows are ranked each; a repeated query row is answered each time.
    Scores beyond a long are limited to it. Empty tables give no rows; other columns are ignored.
    """
    spark = candidates.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & fine)

    def arrays(df: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
        rows = df.toArrow()
        return rows.column("id").to_numpy(), _scale(_matrix(rows.column("v").combine_chunks(), width), factor)

    cands, asked = clean(candidates), clean(queries)
    found, base = None, 0
    by_rank = Window.partitionBy("qx").orderBy(F.desc("score"), "vec_id")
    for width, n in sorted((r["w"], r["n"]) for r in asked.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).collect()):
        blocks = -(-n // QUERY_BLOCK)
        own = cands.where(F.size("v") == width)
        few = arrays(own.limit(FIRST), width)
        for b in range(blocks):
            ids, q = arrays(asked.where((F.size("v") == width) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)), width)
            if not len(ids):
                continue
            shared = spark.sparkContext.broadcast((ids, q, first_floors(ids, q, *few, k)))
            best = own.mapInArrow(partial(_search, queries=shared, k=k, factor=factor, base=base), "qx long, query_id long, vec_id long, score long")
            best = C.stash(best.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
            shared.unpersist()
            found = best if found is None else found.union(best)
            base += len(ids)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if found is None else found
