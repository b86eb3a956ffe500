"""Shared pieces of the training-data operators: scratch tables, size-checked broadcasts, word hashing."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest number of (long, long) rows that is ever broadcast; beyond it the shuffled join is used.
BROADCAST_ROWS = 400_000
#: Bytes of text that the vectorised kernels hold at a time.
CHUNK_BYTES = 2_000_000
#: Seconds between collections on a single machine at least.
COLLECT_SECONDS = 10.0
#: Distinct words whose hashes a worker remembers before it starts afresh.
MEMO_WORDS = 300_000

_collected = float("-inf")

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2, _S33 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)

#: Lower-cases A-Z and turns every byte that is no digit, letter or part of a non-ASCII character into a space.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def scratch(spark: SparkSession) -> str:
    """A new folder name below the session's shared checkpoint folder. Where that is unset, a temporary one on a single
    machine; on a cluster, whose machines would not see it, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/cairn-{uuid.uuid4().hex}"


def stash(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and returns a reader of it: lineage ends there and lost executors lose nothing.

    What earlier steps shuffled is garbage from then on. Spark's cleaner deletes those files only once the driver's JVM has
    collected their handles, which Python's may still hold, and a driver with memory to spare would not for hours. On a
    single machine, where small steps follow each other quickly, that happens every COLLECT_SECONDS at most.
    """
    global _collected
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    if not spark.sparkContext.master.startswith("local[") or time.monotonic() - _collected >= COLLECT_SECONDS:
        gc.collect()
        spark._jvm.System.gc()
        _collected = time.monotonic()
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stashed tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few enough rows (counted), else unchanged for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: str) -> Column:
    """One long that identifies a row by content, for tables whose id may be null or repeated."""
    return F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in cols))


def labelled_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs(doc_id, text), known(doc_id, y), doc_ids of known being distinct -> (doc_id, y, text): one row for each
    labelled doc_id that occurs. Where a doc_id has several texts, the one of the smallest row key stands for it."""
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").withColumn("_key", row_key("doc_id", "text"))
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", "_key").alias("text"))


def global_positions(df: DataFrame, order: list[str], within: str | None = None, value: str | None = None, name: str = "pos") -> DataFrame:
    """Adds gapless positions from 0 in the given order, or the sum of `value` before each row if that is named.

    within: start again for each value of this column, which must have few values. Rows are range-partitioned on the
    order columns and written; the sums of partitions, one row each, are summed up again, and a window finishes inside
    each partition. No task sees more than its own range, nothing is collected, and all of it is DataFrame code.
    """
    group = [within] if within else []
    keys = [F.col(k).asc_nulls_first() for k in group + order]
    amount = F.col(value) if value else F.lit(1)
    parts = stash(df.repartitionByRange(*keys).withColumn("_cairn_pid", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_cairn_pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.groupBy("_cairn_pid", *group).agg(F.sum(amount).cast("long").alias("_cairn_n"))
    bases = bases.select("_cairn_pid", *group, F.coalesce(F.sum("_cairn_n").over(before), F.lit(0)).alias("_cairn_base"))
    inside = Window.partitionBy("_cairn_pid", *group).orderBy(*[F.col(k).asc_nulls_first() for k in order]).rowsBetween(Window.unboundedPreceding, -1)
    run = parts.withColumn("_cairn_run", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    out = run.join(F.broadcast(bases), ["_cairn_pid", *group]) if not group else run.join(F.broadcast(bases), (run["_cairn_pid"] == bases["_cairn_pid"]) & run[within].eqNullSafe(bases[within])).drop(bases["_cairn_pid"]).drop(bases[within])
    return out.withColumn(name, (F.col("_cairn_base") + F.col("_cairn_run")).cast("long")).drop("_cairn_pid", "_cairn_base", "_cairn_run")


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def space_words(text: str | None) -> list[bytes]:
    r"""Words [^\x20\x09-\x0D]+ unchanged (bytes.split knows just these six as white space)."""
    return encode(text).split()


def space_words_of(raw: bytes) -> list[bytes]:
    return raw.split()


def lower_space_words(text: str | None) -> list[bytes]:
    return encode(text).lower().split()


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case runs of letters, digits and non-ASCII characters."""
    return encode(text).translate(WORD_TABLE).split()


class WordHash(dict):
    """word -> 64-bit hash, computed once for each word that a worker meets."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x = x * _M2
    x ^= x >> _S33
    return x


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k entries of h (ordered)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = h[:n].copy()
    for i in range(1, k):
        acc = acc * GOLDEN + h[i : n + i]
    return mix(acc + np.uint64(k))


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each piece holds about CHUNK_BYTES of text (a longer text stands alone)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, s in enumerate(sizes):
            if held and held + s > CHUNK_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(s)
        if start < batch.num_rows:
            yield batch.slice(start)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ragged(values: np.ndarray, lengths) -> pa.Array:
    """A list array of int64 from concatenated values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))
