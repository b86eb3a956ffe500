"""Removal of word passages that occur more than once, located by sharded repeated-phrase automata.

1. Every window of `window` words is assigned to its minimiser, the smallest-hashed phrase of q words in it. Windows in
   a row with the same minimiser form a unit; equal windows always have equal minimisers, so only units whose minimiser
   recurs can hold a recurring window. Units are a fifteenth of the words.
2. Candidate passages are told by counting: a unit seen twice recurs as a whole; where different units share a
   minimiser, their windows are counted. Each recurring window gets a home, a place in one of the texts that hold it.
3. Homes are dealt into pattern shards of bounded size. A shard's phrases, the first and last windows of each run of
   candidates (runs are shorter than a window, so the two cover the run), are compiled into an Aho-Corasick automaton.
4. The documents are streamed past the automata: of each document, the passages that can hold a phrase of a shard go to
   that shard; shards that many documents go to are split, each part with the same automaton.
5. Equality of words decides: a phrase is confirmed by an occurrence at a place other than the one it was read off; the
   words that confirmed occurrences cover are removed.
"""

from __future__ import annotations

import hashlib
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import common as C

#: Candidate runs whose phrases a shard compiles, about, and bytes of passages streamed past one compiled shard, about.
SHARD_RUNS, STREAM_BYTES = 10_000, 32_000_000
#: Words hashed at a time; longer texts are cut into pieces that overlap by a window less one word.
PIECE_WORDS = 1 << 20
#: Words of a text that have their home together.
HOME_WORDS = 1 << 16
#: Code points that stand for words in an automaton; a shard with more distinct words compiles several automata.
CODES = 1_000_000
#: Partitions that the passages are dealt into at most.
PARTITIONS = 200_000
INVERSE = np.uint64(pow(int(C.GOLDEN), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class RangeHash:
    """Hash of any run of entries from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, h: np.ndarray):
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * _powers(C.GOLDEN, len(h)), out=self.sums[1:])
        self.back = _powers(INVERSE, len(h) + 1)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return C.mix((self.sums[start + length] - self.sums[start]) * self.back[start] + np.asarray(length).astype(np.uint64))


def _sliding_min(x: np.ndarray, m: int) -> np.ndarray:
    """Minimum of every m entries in a row."""
    width, out = 1, x
    while 2 * width <= m:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(x) - m + 1], out[m - width :][: len(x) - m + 1])


def units_of(h: np.ndarray, ends: np.ndarray, window: int, q: int) -> tuple[np.ndarray, ...]:
    """Units of documents laid end to end in h (ends: where each stops): seed, unit hash, document, start, windows."""
    none = np.empty(0, np.int64)
    if len(h) < window:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    grams = C.shingle_hashes(h, q)
    place = np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min(((grams >> np.uint64(28)) << np.uint64(28)) | place, window - q + 1)
    at = (least & np.uint64((1 << 28) - 1)).astype(np.int64)
    start = np.arange(len(least))
    doc = np.searchsorted(ends, start, side="right")
    valid = start + window <= ends[doc]
    start, at, doc = start[valid], at[valid], doc[valid]
    if not len(start):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    n_win = np.diff(np.r_[new, len(start)])
    first, doc = start[new], doc[new]
    unit = RangeHash(h).of(first, n_win + (window - 1))
    return grams[at[new]], unit, doc, first - np.r_[0, ends][doc], n_win


def _pieces(batches, window: int, memo: C.WordHash):
    """(rk, first word, hashes of words) of whole texts or of overlapping pieces, in lists of about PIECE_WORDS."""
    held, size = [], 0
    for batch in C.chunks(batches):
        for rk, text in zip(batch.column("rk").to_pylist(), batch.column("text").to_pylist()):
            h = memo.of(C.space_words(text))
            for at in range(0, max(1, len(h) - window + 1), PIECE_WORDS):
                piece = h[at : at + PIECE_WORDS + window - 1]
                held.append((rk, at, piece))
                size += len(piece)
                if size >= PIECE_WORDS:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _units(batches, window: int, q: int):
    for held in _pieces(batches, window, C.WordHash()):
        ends = np.cumsum([len(h) for _, _, h in held], dtype=np.int64)
        seed, unit, doc, start, n_win = units_of(np.concatenate([h for _, _, h in held]), ends, window, q)
        rk, at = (np.array([x[i] for x in held], np.int64)[doc] for i in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(C.signed(seed)), pa.array(C.signed(unit)), pa.array(rk), pa.array((start + at).astype(np.int32)), pa.array(n_win.astype(np.int32))],
            names=["seed", "unit", "rk", "start", "n_win"],
        )


def _windows(batches, window: int):
    """The windows of the units that a document stands for."""
    memo = C.WordHash()
    for batch in C.chunks(batches):
        for rk, text, units in zip(batch.column("rk").to_pylist(), batch.column("text"), batch.column("units")):
            rows = units.values
            start, n_win, seed, unit, c = (rows.field(k).to_numpy(zero_copy_only=False) for k in ("start", "n_win", "seed", "unit", "c"))
            which = np.repeat(np.arange(len(start)), n_win)
            idx = np.arange(len(which)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
            h = memo.of(C.space_words(text.as_py()))
            first, wh = start[which].astype(np.int64) + idx, np.empty(len(which), np.uint64)
            for at in range(0, len(h), PIECE_WORDS):
                inside = np.flatnonzero((first >= at) & (first < at + PIECE_WORDS))
                if len(inside):
                    wh[inside] = RangeHash(h[at : at + PIECE_WORDS + window - 1]).of(first[inside] - at, window)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (seed[which], unit[which], np.full(len(which), rk), (start[which] // HOME_WORDS).astype(np.int32), idx.astype(np.int32), C.signed(wh), c[which])],
                names=["seed", "unit", "rk", "chunk", "idx", "wh", "c"],
            )


def runs_of(mask: int, n_win: int) -> list[tuple[int, int]]:
    """(first, last) of each run of set bits below n_win."""
    out, i = [], 0
    while i < n_win:
        if mask >> i & 1:
            j = i
            while j + 1 < n_win and mask >> (j + 1) & 1:
                j += 1
            out.append((i, j))
            i = j
        i += 1
    return out


CUT = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("rk", pa.int64()), ("start", pa.int32()), ("text", pa.binary())])


def _cut(batches, window: int):
    """Of each document: the phrases that are read off it (kind 0) and the passages to stream past each shard (kind 1)."""
    for batch in C.chunks(batches):
        rows: list[tuple] = []
        for rk, text, units in zip(batch.column("rk").to_pylist(), batch.column("text").to_pylist(), batch.column("units").to_pylist()):
            words = C.space_words(text)
            reach: dict[int, list] = {}
            for u in units:
                for i, j in runs_of(u["mask"], u["n_win"]):
                    a, b = u["start"] + i, u["start"] + j
                    reach.setdefault(u["shard"], []).append((a, b + window))
                    if u["stands"]:
                        rows += [(u["shard"], 0, rk, x, b" ".join(words[x : x + window])) for x in {a, b}]
            for shard, spans in reach.items():
                spans.sort()
                lo, hi = spans[0]
                for a, b in spans[1:]:
                    if a > hi:
                        rows.append((shard, 1, rk, lo, b" ".join(words[lo:hi])))
                        lo = a
                    hi = max(hi, b)
                rows.append((shard, 1, rk, lo, b" ".join(words[lo:hi])))
            if len(rows) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(CUT)], schema=CUT)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(CUT)], schema=CUT)


class PhraseAutomata:
    """Aho-Corasick automata whose letters are words; words outside the phrases share one letter. Each phrase is known
    by the place (document, first word) that it was read off."""

    def __init__(self, window: int):
        self.window, self.done, self.places = window, [], []
        self._open()

    def _open(self) -> None:
        self.codes: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)

    def add(self, words: list[bytes], place: tuple[int, int]) -> None:
        for w in words:
            if w not in self.codes:
                code = len(self.codes) + 1
                self.codes[w] = chr(code if code < 0xD800 else code + 0x800)
        if self.automaton.add_word("".join([self.codes[w] for w in words]), len(self.places)):
            self.places.append(place)
        if len(self.codes) > CODES:
            self.compile()

    def compile(self) -> None:
        if len(self.automaton):
            self.automaton.make_automaton()
            self.done.append((self.automaton, self.codes))
            self._open()

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(last word, phrase) of every occurrence of a phrase."""
        out = []
        for automaton, codes in self.done:
            get = codes.get
            out += automaton.iter("".join([get(w, "\0") for w in words]))
        return out


class Shard:
    """One shard's automata, and which of its phrases have been met away from the place they were read off."""

    def __init__(self, window: int):
        self.window, self.automata, self.compiled = window, PhraseAutomata(window), False
        self.met: set[int] = set()

    def stream(self, rk: int, start: int, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(document, from, to) of the words that phrases met here cover."""
        if not self.compiled:
            self.automata.compile()
            self.compiled = True
        out, lo, hi, places, window = [], 0, -1, self.automata.places, self.window
        for last, phrase in sorted(self.automata.find(words)):
            first = start + last - (window - 1)
            if places[phrase] != (rk, first):
                self.met.add(phrase)
                if first > hi:
                    if hi >= 0:
                        out.append((rk, lo, hi))
                    lo = first
                hi = first + window
        if hi >= 0:
            out.append((rk, lo, hi))
        return out

    def origins(self) -> list[tuple[int, int, int]]:
        """The places that the phrases met elsewhere were read off."""
        return [(rk, at, at + self.window) for rk, at in map(self.automata.places.__getitem__, self.met)]


def _stream(batches, window: int):
    """Rows sorted by (shard, part, kind): a shard's phrases, then the passages of documents. Yields covered words."""
    types = pa.schema([("rk", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
    shard, current, rows = None, None, []
    for batch in batches:
        names = ("shard", "part", "kind", "rk", "start", "text")
        for s, part, kind, rk, start, text in zip(*(batch.column(n).to_pylist() for n in names)):
            if (s, part) != shard:
                rows += current.origins() if current else []
                shard, current = (s, part), Shard(window)
            if kind == 0:
                current.automata.add(tuple(text.split()), (rk, start))
            else:
                rows += current.stream(rk, start, text.split())
            if len(rows) > 8192:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(types)], schema=types)
                rows = []
    rows += current.origins() if current else []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(types)], schema=types)


def _kept(batches):
    """Each document without its covered words."""
    for batch in C.chunks(batches):
        n_words, n_removed, digests, texts = [], [], [], []
        for text, cover in zip(batch.column("text").to_pylist(), batch.column("cover").to_pylist()):
            words = kept = C.space_words(text)
            if cover:
                kept, at = [], 0
                for a, b in sorted((c["a"], c["b"]) for c in cover):
                    kept += words[at:a]
                    at = max(at, b)
                kept += words[at:]
            raw = b" ".join(kept)
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(raw).hexdigest())
            texts.append(raw)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def candidates(docs: DataFrame, window: int, q: int) -> tuple[DataFrame, DataFrame]:
    """docs(rk, text) -> spots(seed, unit, rk, start, n_win), all places of units that may recur, and
    runs(seed, unit, home, mask, o_rk, o_start): their windows that recur, by home, and the place that stands for a unit.

    Seeds and hashes of units or windows are held together, so that what is equal by chance needs 128 equal bits.
    """
    every = C.stash(docs.select("rk", "text").mapInArrow(partial(_units, window=window, q=q), "seed long, unit long, rk long, start int, n_win int"))
    twice = C.stash(every.groupBy("seed").agg(F.count("*").alias("t")).where("t > 1").select("seed"))  # written, so that a hot seed's side of the join can be split
    spots = C.stash(every.join(twice, "seed"))
    C.discard(every, twice)
    once = C.stash(spots.groupBy("seed", "unit").agg(F.count("*").alias("c"), F.first("n_win").alias("n_win"), F.min("rk").alias("rk"), F.min_by("start", "rk").alias("start")))
    seeds = C.stash(once.groupBy("seed").agg(F.count("*").alias("u")))
    home = F.xxhash64("rk", "chunk").alias("home")  # the first of the documents that hold it, so that copies share their homes
    units = C.stash(once.join(seeds, "seed").withColumn("chunk", (F.col("start") / HOME_WORDS).cast("int")))
    C.discard(once, seeds)
    stand = C.stash(units.where("u > 1").groupBy("rk").agg(F.collect_list(F.struct("seed", "unit", "start", "n_win", "c")).alias("units")))
    texts = docs.select("rk", "text").join(C.small(stand.select("rk")), "rk", "left_semi").join(stand, "rk")
    seen = C.stash(texts.mapInArrow(partial(_windows, window=window), "seed long, unit long, rk long, chunk int, idx int, wh long, c long"))
    C.discard(stand)
    several = seen.groupBy("seed", "wh").agg(F.sum("c").alias("t"), F.min("rk").alias("rk"), F.min_by("chunk", "rk").alias("chunk")).where("t > 1")
    several = several.select("seed", "wh", home)
    bits = seen.select("seed", "unit", "idx", "wh").join(several, ["seed", "wh"]).groupBy("seed", "unit", "home").agg(F.bit_or(F.expr("shiftleft(1L, idx)")).alias("mask"))
    stands = units.select("seed", "unit", F.col("rk").alias("o_rk"), F.col("start").alias("o_start"))
    whole = units.where("u = 1").select("seed", "unit", home, F.lit(-1).cast("long").alias("mask"))  # the one unit of a recurring seed recurs itself
    runs = C.stash(bits.union(whole).join(stands, ["seed", "unit"]))
    C.discard(units, seen)
    return spots, runs


def confirmed(docs: DataFrame, spots: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """(rk, a, b): the words from a up to b of document rk that confirmed phrases cover."""
    spark = docs.sparkSession
    n_shards = runs.count() // SHARD_RUNS + 1
    stands = (F.col("rk") == F.col("o_rk")) & (F.col("start") == F.col("o_start"))
    shard = F.pmod("home", F.lit(n_shards)).cast("int").alias("shard")
    routes = C.stash(spots.join(runs, ["seed", "unit"]).groupBy("rk").agg(F.collect_list(F.struct("start", "n_win", "mask", shard, stands.alias("stands"))).alias("units")))
    texts = docs.select("rk", "text").join(C.small(routes.select("rk")), "rk", "left_semi").join(routes, "rk")
    cut = C.stash(texts.mapInArrow(partial(_cut, window=window), "shard int, kind int, rk long, start int, text binary"))
    C.discard(routes)
    phrases = cut.where("kind = 0").groupBy("shard", "text").agg(F.first("rk").alias("rk"), F.first("start").alias("start"))
    parts = C.stash(cut.where("kind = 1").groupBy("shard").agg((F.sum(F.octet_length("text")) / STREAM_BYTES + 1).cast("int").alias("parts")))
    total = parts.agg(F.sum("parts")).first()[0] or 1
    sizes = C.small(parts)
    columns = ["shard", "part", "kind", "rk", "start", "text"]
    passages = cut.where("kind = 1").join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("rk", "start"), "parts").cast("int"))
    phrases = phrases.join(sizes, "shard").withColumns({"kind": F.lit(0), "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    n = min(PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total))
    rows = phrases.select(columns).union(passages.select(columns)).repartition(n, "shard", "part").sortWithinPartitions("shard", "part", "kind")
    cover = C.stash(rows.mapInArrow(partial(_stream, window=window), "rk long, a int, b int"))
    C.discard(cut, parts)
    return cover


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_words, n_removed, kept_sha256, kept_text), one row for each input row.

    Words are the runs between ASCII white space, unchanged. A word goes if some window of `window` words that covers it
    also starts anywhere else, in the same or another document; all windows are judged on the input. kept_text joins
    the words that stay by one space. Null text counts as empty: no words, nothing removed, the digest of an empty
    string. Rows that repeat doc_id and text are one document each time they occur; null ids are allowed. Texts of less
    than a window stay whole; texts of any length are read whole. Other columns are ignored. window: 2 to 80.
    """
    if not 2 <= window <= 80:
        raise ValueError("window must be 2 to 80 words")
    rows = docs.select(F.monotonically_increasing_id().alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = C.stash(rows)  # written, so that a row keeps its number
    spots, runs = candidates(rows, window, max(1, window // 4))
    found = confirmed(rows, spots, runs, window)
    C.discard(spots, runs)
    cover = C.stash(found.groupBy("rk").agg(F.collect_set(F.struct("a", "b")).alias("cover")))
    C.discard(found)
    return rows.join(cover, "rk", "left").select("doc_id", "text", "cover").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
