"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact verification."""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import common as C

#: Hamming radius on 64-bit fingerprints and number of blocks; with RADIUS < 2 * BLOCKS, two fingerprints within the
#: radius differ by at most one bit in some block.
RADIUS, BLOCKS = 23, 12
#: Benchmark items held by a task at a time, by number and by characters; a larger benchmark is searched in turns.
ITEMS, ITEM_CHARS = 20_000, 20_000_000
#: Bits of the table that tells quickly whether a shingle may be in an item.
TABLE_BITS = 20

_EDGES = [64 * b // BLOCKS for b in range(BLOCKS + 1)]


def blocks_of(prints: np.ndarray) -> list[np.ndarray]:
    return [(prints >> np.uint64(a) & np.uint64((1 << (b - a)) - 1)).astype(np.int64) for a, b in zip(_EDGES, _EDGES[1:])]


def running_bits(shingles: np.ndarray) -> np.ndarray:
    """Running sums over shingles of +1 or -1 for each of the 64 bits."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(bits.astype(np.int32) * 2 - 1, axis=0, out=out[1:])
    return out


def prints_of(running: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """SimHash of the windows of `length` shingles: every occurrence of a shingle adds its bits once."""
    on = (running[start + length] - running[start]) > 0
    return np.packbits(on, axis=1, bitorder="little").view("<u8").reshape(-1)


class MultiIndex:
    """Fingerprints by block value, each entered under all values within one bit: a lookup of the query's own block
    values finds every fingerprint within the radius."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.tables = []
        for value, a, b in zip(blocks_of(prints), _EDGES, _EDGES[1:]):
            table = np.zeros((1 << (b - a), len(prints)), bool)
            for flip in [0, *(1 << i for i in range(b - a))]:
                table[value ^ flip, np.arange(len(prints))] = True
            self.tables.append(table)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, fingerprint) index pairs within the radius."""
        may = np.zeros((len(queries), len(self.prints)), bool)
        for value, table in zip(blocks_of(queries), self.tables):
            may |= table[value]
        q, p = np.nonzero(may)
        close = np.bitwise_count(queries[q] ^ self.prints[p]) <= RADIUS
        return q[close], p[close]


def weighted_similarity(a: Counter, b: Counter) -> tuple[int, int]:
    """Sum of the smaller and of the larger weights; a shingle's weight is how often it occurs."""
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both, sum(a.values()) + sum(b.values()) - both


class Items:
    """Benchmark items by size class (words, shingle width) with their fingerprints and shingles."""

    def __init__(self, ids: list[int], texts: list[str], width: int):
        memo = C.WordHash()
        groups: dict[tuple[int, int], list] = defaultdict(list)
        for i, t in zip(ids, texts):
            h = memo.of(C.plain_words(t))
            if len(h):
                k = min(width, len(h))
                groups[len(h), k].append((i, C.shingle_hashes(h, k)))
        self.classes = []
        self.table: dict[int, np.ndarray] = {}
        for (n, k), members in sorted(groups.items()):
            prints = np.array([prints_of(running_bits(s), np.array([0]), len(s))[0] for _, s in members], np.uint64)
            shingles = np.unique(np.concatenate([s for _, s in members]))
            self.classes.append((n, k, [i for i, _ in members], MultiIndex(prints), [Counter(s.tolist()) for _, s in members], shingles))
            table = self.table.setdefault(k, np.zeros(1 << TABLE_BITS, bool))
            table[shingles >> np.uint64(64 - TABLE_BITS)] = True
        self.known = {k: np.unique(np.concatenate([c[5] for c in self.classes if c[1] == k])) for k in self.table}

    def hits(self, k: int, s: np.ndarray) -> np.ndarray:
        """Places of the shingles of width k that some item holds."""
        maybe = np.flatnonzero(self.table[k][s >> np.uint64(64 - TABLE_BITS)])
        known, values = self.known[k], s[maybe]
        return maybe[known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values]


def find(h: np.ndarray, items: Items, percent: int) -> list[tuple]:
    """(item id, similarity, first word, words) of the best window for each item that reaches the threshold."""
    best: dict[int, tuple] = {}
    shingles: dict[int, tuple] = {}
    for n, k, ids, index, counts, own in items.classes:
        if len(h) < k:
            continue
        if k not in shingles:
            s = C.shingle_hashes(h, k)
            shingles[k] = s, items.hits(k, s)
        s, maybe = shingles[k]
        m = n - k + 1
        need = -(-percent * m // 100)
        size = min(m, len(s))
        if len(maybe) < need:
            continue
        hits = maybe[np.isin(s[maybe], own)]
        if len(hits) < need:
            continue
        # Windows whose shingles are in items of this size often enough; others can't reach the threshold.
        mark = np.zeros(len(s) + 1, np.int64)
        mark[hits + 1] = 1
        mark = np.cumsum(mark)
        starts = np.flatnonzero(mark[size:] - mark[: len(mark) - size] >= need)
        if not len(starts):
            continue
        lo, hi = starts[0], starts[-1] + size
        for a in range(0, len(starts), 4096):
            some = starts[a : a + 4096]
            lo, hi = some[0], some[-1] + size
            prints = prints_of(running_bits(s[lo:hi]), some - lo, size)
            for q, p in zip(*index.near(prints)):
                at = int(some[q])
                both, either = weighted_similarity(Counter(s[at : at + size].tolist()), counts[p])
                if 100 * both >= percent * either:
                    old = best.get(ids[p])
                    if old is None or both / either > old[1]:
                        best[ids[p]] = (ids[p], both / either, at, size + k - 1)
    return list(best.values())


def _search(batches, shared, width: int, percent: int):
    ids, texts = shared.value
    items, memo = Items(ids, texts, width), C.WordHash()
    kinds = pa.schema([("rk", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])
    for batch in C.chunks(batches):
        rows = []
        hashes = [memo.of(C.plain_words(t)) for t in batch.column("text").to_pylist()]
        ends = np.cumsum([len(h) for h in hashes])
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        live: set[int] = set()
        for k in items.table:
            least = min(-(-percent * (n - k + 1) // 100) for n, width_, *_ in items.classes if width_ == k)
            held = np.bincount(np.searchsorted(ends, items.hits(k, C.shingle_hashes(flat, k)), side="right"), minlength=len(hashes))
            live.update(np.flatnonzero(held >= max(1, least)).tolist())
        rk, doc_id = batch.column("rk").to_pylist(), batch.column("doc_id").to_pylist()
        for d in sorted(live):
            rows += [(rk[d], doc_id[d], *found) for found in find(hashes[d], items, percent)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (rk, doc_id, item_id, similarity, first_word, n_words).

    One row for each document and item such that some window of as many words as the item has (or the whole document,
    if that is shorter) reaches percent in weighted shingle similarity: sum of smaller over sum of larger counts of
    `width`-word shingles, words being lower-case runs of letters, digits and non-ASCII characters; items of fewer words
    are one shingle. The row tells the most similar window, the first of equals. Windows are fingerprinted by SimHash;
    the index returns all within RADIUS bits; similarity is then exact. Windows that hold too few shingles of items of
    their size to reach the threshold are not fingerprinted. A pair just at the threshold is beyond the radius with a
    probability of about one in a hundred thousand, a copy never.

    Items are searched in turns of at most ITEMS rows and ITEM_CHARS characters, so what is broadcast is bounded
    whatever the benchmark's size; a longer single item makes a turn of its own. Null texts and texts without words
    match nothing. Null ids are allowed and returned; repeated items count once for an id; repeated documents give
    their rows each. Empty tables give no rows.
    """
    size = items.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).first()
    turns = max(1, -(-2 * size["n"] // ITEMS), -(-2 * (size["c"] or 0) // ITEM_CHARS))
    rows = docs.select(C.row_key("doc_id", "text").alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for turn in range(turns):
        own = items.where((F.pmod(C.row_key("item_id", "text"), F.lit(turns)) == turn) & F.col("text").isNotNull())
        got = own.select("item_id", "text").orderBy("item_id", "text").collect()
        shared = docs.sparkSession.sparkContext.broadcast(([r[0] for r in got], [r[1] for r in got]))
        found = rows.mapInArrow(partial(_search, shared=shared, width=width, percent=percent), "rk long, doc_id long, item_id long, similarity double, first_word long, n_words long")
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that hold a passage of an item; the same columns, repeated rows kept or dropped together."""
    bad = C.stash(contaminated(docs, items, width, percent).select(F.col("rk").alias("_cairn_rk")).distinct())
    return docs.withColumn("_cairn_rk", C.row_key("doc_id", "text")).join(C.small(bad), "_cairn_rk", "left_anti").drop("_cairn_rk")
