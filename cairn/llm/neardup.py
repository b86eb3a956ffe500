"""Near-duplicate groups by min-max hashing.

Every hash function keeps both its smallest and its largest value over a document's shingles, so one evaluation gives
two signature entries; each agrees between two documents with probability equal to their Jaccard similarity. Entries
are banded; what shares a band is a candidate and is confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import common as C
from cairn.llm.graph import components

ROWS_PER_BAND = 6
#: A pair exactly at the threshold shares no band with at most this probability.
MISS = 1e-5
#: Bucket members are first compared with these members of their bucket: smallest ids after an xor with each.
PIVOTS = (0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: Members of a small bucket at most, and members that hold a shingle at most for it to count as rare in large ones.
RARE = 32
SEED = 20240229


def bands_for(threshold: float, rows: int = ROWS_PER_BAND, miss: float = MISS) -> int:
    """Bands that keep the probability of missing a pair at the threshold under miss."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def doc_shingles(text: str | None, k: int, memo: C.WordHash) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer than k words: the whole sequence as one; none: empty."""
    h = memo.of(C.lower_space_words(text))
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(C.shingle_hashes(h, min(k, len(h))))


def _signatures(batches, k: int, bands: int, rows: int):
    rng = np.random.default_rng(SEED)
    n_perm = (bands * rows + 1) // 2
    mul = rng.integers(0, 2**63, n_perm, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, n_perm, dtype=np.uint64)
    memo = C.WordHash()
    for batch in C.chunks(batches):
        sets = [doc_shingles(t, k, memo) for t in batch.column("text").to_pylist()]
        n = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(n)
        fa, fb = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
        keys = np.empty((0, bands), np.uint64)
        if len(full):
            flat = np.concatenate([sets[i] for i in full])
            starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
            fa[full] = np.add.reduceat(C.mix(flat), starts)
            fb[full] = np.bitwise_xor.reduceat(C.mix(flat ^ C.GOLDEN), starts)
            sig = np.empty((len(full), 2 * n_perm), np.uint64)
            for p in range(n_perm):
                y = flat * mul[p] + add[p]
                sig[:, 2 * p] = np.minimum.reduceat(y, starts)
                sig[:, 2 * p + 1] = np.maximum.reduceat(y, starts)
            keys = np.empty((len(full), bands), np.uint64)
            for b in range(bands):
                acc = np.full(len(full), b + 1, np.uint64)
                for r in range(b * rows, (b + 1) * rows):
                    acc = C.mix(acc * C.GOLDEN + sig[:, r])
                keys[:, b] = acc
        yield pa.RecordBatch.from_arrays(
            [batch.column("rk"), batch.column("doc_id"), pa.array(n), pa.array(C.signed(fa)), pa.array(C.signed(fb)), C.ragged(C.signed(keys.reshape(-1)), np.where(n > 0, bands, 0))],
            names=["rk", "doc_id", "n", "fa", "fb", "bands"],
        )


def _full_sets(batches, k: int):
    memo = C.WordHash()
    for batch in C.chunks(batches):
        sets = [doc_shingles(t, k, memo) for t in batch.column("text").to_pylist()]
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("node"), C.ragged(C.signed(flat), [len(s) for s in sets])], names=["node", "s"])


def _sets_of(ids: DataFrame, reps: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, s): the full sets of the nodes in ids(node), from the text of the row that each node is."""
    need = C.stash(reps.select("node").join(ids, "node", "left_semi"))
    texts = docs.withColumnRenamed("rk", "node").join(C.small(need), "node", "left_semi").select("node", "text")
    sets = C.stash(texts.mapInArrow(partial(_full_sets, k=k), "node long, s array<long>"))
    C.discard(need)
    return sets


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _across(member: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket members with their component's label, of the buckets that hold several components."""
    tagged = member.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = tagged.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return tagged.join(mixed, "key", "left_semi")


def _possible(percent: int) -> Column:
    """Whether members x (n, own) and y (m, other) of a bucket that share no rare shingle can be similar enough: of x's n
    shingles `own` are rare, so the intersection is at most the smaller rest."""
    most = F.least(F.col("n") - F.col("own"), F.col("m") - F.col("other"))
    return 100 * most >= percent * (F.col("n") + F.col("m") - most)


def _remaining_links(member: DataFrame, labels: DataFrame, edges: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Labels after all links between different components of a bucket have been found.

    Buckets of at most RARE members are compared pair by pair. In larger ones, a shingle is rare if at most RARE of their
    members hold it. Members first meet the member of their bucket with the fewest rare shingles, the one nearest to what
    the bucket has in common. What then is still apart either shares a rare shingle, and meets there, RARE partners at
    most for each; or it does not, and then rare shingles bound what the two can share: only members outside the pivot's
    component are held against their bucket, where the bound allows a link. Copies with edits of their own thus never
    meet pair by pair, however many they are.
    """
    rest = C.stash(_across(member, labels).select("key", "node", "n"))
    if rest.isEmpty():
        return labels
    sets = _sets_of(rest.select("node").distinct(), reps, docs, k)
    large = rest.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > RARE).select("key")
    big = C.stash(rest.join(large, "key", "left_semi"))
    nodes = C.stash(big.groupBy("node").agg(F.first("n").alias("n")))
    held = sets.join(nodes, "node", "left_semi").select("node", F.explode("s").alias("x"))
    few = held.groupBy("x").agg(F.count("*").alias("c")).where(F.col("c") <= RARE)
    rare = C.stash(held.join(few, "x"))
    own = rare.groupBy("node").agg(F.count("*").alias("own"))
    live = big.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    live = C.stash(live.where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")))

    def check(near: DataFrame, edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        pairs = C.stash(near.select(F.least("node", "with").alias("a"), F.greatest("node", "with").alias("b")).distinct())
        found = C.stash(_verify(pairs, sets, percent))
        C.discard(pairs)
        if found.isEmpty():
            return edges, labels
        edges = edges.union(found)
        return edges, components(edges)

    def meet(rows: DataFrame, on: str) -> DataFrame:
        """Pairs of rows(on, node, n) with the same value of on, of different components and near in size."""
        rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        x, y = rows.select(on, "node", "n", "label"), rows.select(on, F.col("node").alias("with"), F.col("n").alias("m"), F.col("label").alias("far"))
        fit = (F.col("label") != F.col("far")) & (F.col("node") < F.col("with")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
        return x.join(y, on).where(fit).select("node", "with")

    if not big.isEmpty():
        tagged = C.stash(_across(live, labels))
        pivot = tagged.groupBy("key").agg(F.min(F.struct("own", "node", "label")).alias("p"))
        pivot = pivot.select("key", F.col("p.node").alias("with"), F.col("p.label").alias("far"))
        edges, labels = check(tagged.join(pivot, "key").where(F.col("label") != F.col("far")), edges, labels)
        C.discard(tagged)
    tagged = C.stash(_across(live, labels))
    pivot = tagged.groupBy("key").agg(F.min(F.struct("own", "node", "label")).alias("p")).select("key", F.col("p.label").alias("main"))
    x = tagged.join(pivot, "key").where("label <> main").select("key", "node", "n", "own", "label")
    y = tagged.select("key", F.col("node").alias("with"), F.col("n").alias("m"), F.col("own").alias("other"), F.col("label").alias("far"))
    near = x.join(y, "key").where((F.col("label") != F.col("far")) & _possible(percent)).select("node", "with")
    near = near.union(meet(rare.where("c > 1").join(nodes, "node").select("x", "node", "n"), "x"))
    near = near.union(meet(rest.join(large, "key", "left_anti"), "key"))
    labels = check(near, edges, labels)[1]
    C.discard(rest, big, rare, live, nodes, tagged, sets)
    return labels


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a unique number rk for each row; written, so that a row keeps its number."""
    return C.stash(docs.drop("rk").withColumn("rk", F.monotonically_increasing_id()))


def _classes(docs: DataFrame, k: int, percent: int, rows: int, bands: int | None) -> DataFrame:
    """docs(rk, doc_id, text), rk being unique -> (rk, doc_id, n, label, component_id): label is the smallest rk of the
    component, null for rows that take no part."""
    bands = bands or bands_for(percent / 100, rows)
    docs = docs.select("rk", F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = C.stash(docs.mapInArrow(partial(_signatures, k=k, bands=bands, rows=rows), "rk long, doc_id long, n long, fa long, fb long, bands array<long>"))
    live = sig.where("n > 0 and doc_id is not null")
    same = ["fa", "fb", "n"]  # 128 bits of a set and its size
    reps = C.stash(live.groupBy(*same).agg(F.min("rk").alias("node"), F.min("doc_id").alias("first_id"), F.first("bands").alias("bands")))
    every = reps.select("node", "n", F.explode("bands").alias("key"))
    shared = every.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    member = C.stash(every.join(shared, "key"))  # most keys occur once; all that follows reads the others alone
    pivots = member.groupBy("key").agg(*(F.min(F.col("node").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x)).alias(f"p{i}") for i, x in enumerate(PIVOTS)))
    pairs = (
        member.join(pivots, "key")
        .select("node", F.explode(F.array_distinct(F.array(*(f"p{i}" for i in range(len(PIVOTS)))))).alias("p"))
        .where("node <> p")
        .select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"))
        .distinct()
    )
    pairs = C.stash(pairs)
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), reps, docs, k)
    edges = C.stash(_verify(pairs, sets, percent))
    C.discard(sets, pairs)
    labels = components(edges)
    labels = _remaining_links(member, labels, edges, reps, docs, k, percent)
    node = reps.select(*same, "node", "first_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = node.groupBy("label").agg(F.min("first_id").alias("component_id"))
    node = node.join(smallest, "label").select(*same, "label", "component_id")
    out = sig.select("rk", "doc_id", *same).where("n > 0 and doc_id is not null").join(node, same).select("rk", "doc_id", "n", "label", "component_id")
    none = F.lit(None).cast("long")
    out = C.stash(out.union(sig.where("n = 0 or doc_id is null").select("rk", "doc_id", "n", none, F.when(F.col("n") == 0, F.col("doc_id")))))
    C.discard(sig, reps, member, edges, labels)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS_PER_BAND, bands: int | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id, kept), one row for each input row.

    Words are separated by ASCII white space, A-Z lower-cased; a document's set is its distinct k-word shingles. Two
    documents are linked if 100 * intersection >= percent * union. component_id is the smallest doc_id reachable, kept
    says that it is the row's own. Equal sets meet by a fingerprint first, so a group of copies is one node however
    large. Nodes of a bucket are compared with a few pivots; in buckets that still hold several components, all pairs
    across components that exact bounds allow are compared, so no candidate link between components is lost.

    Null text and text without words: n_shingles 0, linked with nothing. Null doc_id: the row takes no part, its
    component_id is null and kept is true. Rows that repeat a doc_id each count as a document. Texts of any length are
    read whole; other columns are ignored; empty tables give no rows. Sets are held equal by 128 bits and their size.
    """
    each = numbered(docs.select("doc_id", "text"))
    found = _classes(each, k, percent, rows, bands)
    C.discard(each)
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept)


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose group has a smaller doc_id; of rows that repeat a doc_id within a group one stays, and
    all rows without words or doc_id do. The same columns.

    Survivors are decided on numbers alone; texts are only read again.
    """
    mark = "_cairn_rk"
    rows = C.stash(docs.withColumn(mark, F.monotonically_increasing_id()))
    found = _classes(rows.select(F.col(mark).alias("rk"), "doc_id", "text"), k, percent, ROWS_PER_BAND, None)
    group = found.where("label is not null and doc_id = component_id").groupBy("label").agg(F.min("rk").alias(mark)).select(mark)
    alone = found.where("label is null").select(F.col("rk").alias(mark))
    stay = C.stash(group.union(alone))
    C.discard(found)
    return rows.join(C.small(stay), mark, "left_semi").drop(mark)
