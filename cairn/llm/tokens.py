"""Token ids as flat unsigned integer files with 64-bit document offsets, read back by memory mapping.

A data set is a folder of parts `<name>.ids` (unsigned little-endian integers, 16 or 32 bits), `<name>.off` (n + 1
unsigned 64-bit token offsets from the part's start) and `<name>.doc` (n signed 64-bit document ids), plus a manifest
table with one row a part: its order, counts, and its base, the number of ids in all parts before it. Documents of null
id come first in a part; the manifest tells their number.

Files are written and read with pyarrow's file systems: `file`, `hdfs`, `s3` and `gs` addresses, `s3a` being taken as `s3`;
what is not local is read instead of mapped.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm import common as C

#: Pieces whose ids a worker remembers; twice as many are held at most.
MEMO_PIECES = 400_000
#: Bytes of text in a part, about, once there are more of them than shuffle partitions.
PART_BYTES = 256_000_000
#: The pre-tokenizer's pattern by which texts are known to part at white space, letters from other characters.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: A full stop or comma between a small letter and white space; tokenizers that split letters from the rest part it too.
_STOP = re.compile(rb"(?<=[a-z])[.,](?=[ \n])")


def splits(path: str) -> tuple[bool, bool]:
    """Whether a tokenizer's file proves that a text's ids are those of its pieces between white space, and whether it
    lower-cases. All its steps must be known; any other tokenizer gets whole texts."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre = ((spec[k] or {}).get(many) or [spec[k] or {}] for k, many in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    words = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
    known = all(n in ({}, {"type": "NFC"}, {"type": "Lowercase"}, spaces) for n in norm)
    known = known and pre[0] == words and all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in pre[1:])
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].startswith("<|") or " " in t["content"] for t in spec["added_tokens"])
    known = known and plain and spec["post_processor"] is None
    return known, known and {"type": "Lowercase"} in norm


class PieceEncoder:
    """Encodes texts by the tokenizer, piece by piece between ASCII white space, and remembers the pieces' ids.

    Where the tokenizer lower-cases, A-Z is lowered first so that more pieces are alike, and stops are parted from words,
    but not in texts that may hold a special token's string. Tokenizers that may join across white space (see splits) get
    whole texts.
    """

    def __init__(self, path: str, width: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), np.dtype(f"<u{width}")
        self.split, self.lower = splits(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, pieces: set[bytes]) -> None:
        if len(self.young) > MEMO_PIECES:
            self.old, self.young = self.young, {}
        ask = []
        for p in pieces.difference(self.young):
            known = self.old.get(p)
            if known is None:
                ask.append(p)
            else:
                self.young[p] = known
        if ask:
            coded = self.tokenizer.encode_batch_fast([p.decode() for p in ask], add_special_tokens=False)
            for p, e in zip(ask, coded):
                self.young[p] = np.array(e.ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        if not self.split:
            return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        raw = [t.encode() for t in texts]
        split = [(_STOP.sub(rb" \g<0>", r.lower()) if self.lower and b"<|" not in r else r).split() for r in raw]
        self.learn(set().union(*split) if split else set())
        get = self.young.__getitem__
        return [b"".join(map(get, s)) for s in split]


@cache
def _encoder(path: str, width: int) -> PieceEncoder:
    """One for each worker process, so that what it remembers serves all tasks that run there."""
    return PieceEncoder(path, width)


def _filesystem(uri: str):
    uri = uri.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _write(batches, folder: str, tokenizer: str, width: int, end_id: int):
    """Writes one part from the partition's rows, in their order, under a name of its own; a rerun writes another."""
    encoder, end = None, np.array([end_id], f"<u{width}").tobytes()
    where, root = _filesystem(folder)
    name, files, counts, total, pid, nulls = uuid.uuid4().hex, None, 0, 0, 0, 0
    for batch in C.chunks(batches):
        if encoder is None:
            encoder = _encoder(tokenizer, width)
            where.create_dir(root, recursive=True)
            files = [where.open_output_stream(f"{root}/{name}.{kind}") for kind in ("ids", "off", "doc")]
            files[1].write(np.zeros(1, "<u8").tobytes())
            pid = batch.column("_pid")[0].as_py()
        coded = encoder.encode(batch.column("text").fill_null("").to_pylist())
        ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        nulls += batch.column("doc_id").null_count
        files[0].write(b"".join([x for c in coded for x in (c, end)]))
        sizes = np.array([len(c) // width + 1 for c in coded], np.uint64)
        files[1].write((np.cumsum(sizes) + np.uint64(total)).astype("<u8").tobytes())
        files[2].write(ids.astype("<i8").tobytes())
        counts, total = counts + len(coded), total + int(sizes.sum())
    if files:
        for f in files:
            f.close()
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((pid, pa.int32()), (name, pa.string()), (counts, pa.int64()), (total, pa.int64()), (nulls, pa.int64()))], names=["part", "name", "n_docs", "n_ids", "n_null"])


def id_width(tokenizer: str) -> int:
    """Bytes that hold every id of a tokenizer: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int = 4) -> DataFrame:
    """Encodes docs(doc_id, text, ...) into files below folder, in ascending doc_id order; returns the manifest.

    manifest: part, name, n_docs, n_ids, n_null (documents of null id), base (ids of all parts before it, a prefix sum over parts). Each document's ids
    are followed by end_id. Range partitions on (doc_id, row key) become parts; a task that runs again writes files of
    another name and only the manifest's count. Null text counts as empty (just end_id); null doc_ids come first;
    repeated doc_ids are all written. An empty table gives an empty manifest. Other columns are ignored. Texts of any
    length are encoded whole. There are as many parts as shuffle partitions, or more so that one holds about PART_BYTES.
    folder must be seen by all executors; width: bytes of an id, 2 or 4.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", C.row_key("doc_id", "text").alias("rk"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "rk").withColumn("_pid", F.spark_partition_id())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "rk").select("doc_id", "text", "_pid")
    write = partial(_write, folder=folder, tokenizer=tokenizer, width=width, end_id=end_id)
    parts = C.stash(rows.mapInArrow(write, "part int, name string, n_docs long, n_ids long, n_null long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def _open(uri: str, kind: str, count: int) -> np.ndarray:
    """A memory-mapped view if the file is local, else its bytes."""
    where, path = _filesystem(uri)
    if not count:
        return np.empty(0, kind)
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(path, kind, "r", shape=(count,))
    with where.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def _read(batches, folder: str, width: int):
    for batch in batches:
        for part in batch.to_pylist():
            n, at = part["n_docs"], f"{folder}/{part['name']}"
            ids, off, doc = _open(f"{at}.ids", f"<u{width}", part["n_ids"]), _open(f"{at}.off", "<u8", n + 1), _open(f"{at}.doc", "<i8", n)
            for lo in range(0, n, 5000):
                o, d = off[lo : min(lo + 5000, n) + 1].astype(np.int64), np.array(doc[lo : lo + 5000])
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(o[:-1], o[1:])]
                null = np.arange(lo, lo + len(d)) < part["n_null"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, mask=null), pa.array(o[:-1] + part["base"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )


def read_tokens(manifest: DataFrame, folder: str, width: int = 4) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens (with the end id), ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers). An empty manifest gives no rows."""
    spread = manifest.repartitionByRange(max(1, manifest.count()), "part")  # a task for each part
    return spread.mapInArrow(partial(_read, folder=folder, width=width), "doc_id long, start long, n_tokens long, ids_crc32 long")
