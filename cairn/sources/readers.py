"""Readers by suffix, labelled clouds from several files, coloured export."""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.cloud import XYZ
from cairn.operators.assets import label_from_file

TEXT = {"txt": " ", "pts": " ", "ascii": " ", "csv": ",", "tsv": "\t"}


def read_text(spark: SparkSession, path: str, delimiter: str | None = None, columns: int = 3, header: bool = False) -> DataFrame:
    """Delimited numbers -> (id, x, y, z, feats): the first three columns are coordinates, the others features.

    id hashes the row's content and file, so it does not depend on how the file is split; equal rows of a file share it.
    """
    suffix = path.rsplit(".", 1)[-1].lower()
    names = [f"c{i}" for i in range(max(3, columns))]
    schema = ", ".join(f"{n} double" for n in names)
    raw = spark.read.schema(schema).option("sep", delimiter or TEXT.get(suffix, ",")).option("header", header).option("ignoreLeadingWhiteSpace", True).csv(path)
    raw = raw.withColumn("_file", F.input_file_name())
    feats = F.array(*names[3:]) if len(names) > 3 else F.array().cast("array<double>")
    return raw.select(F.xxhash64("_file", *names).alias("id"), *(F.col(n).alias(c) for n, c in zip(names, XYZ)), feats.alias("feats"))


def _open(name: str):
    where, path = fs.FileSystem.from_uri(name)
    return where.open_input_file(path)


def _npy_ranges(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The runs of rows that each file is read in, from its header."""
    for pdf in batches:
        for name in pdf["path"]:
            with _open(name) as f:
                read = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(f)[0] == 1 else np.lib.format.read_array_header_2_0
                shape, fortran, dtype = read(f)
                data = f.tell()
            if len(shape) != 2 or shape[1] < 3 or dtype.hasobject:
                raise ValueError(f"{name}: a matrix of at least three columns of numbers is needed")
            first = np.arange(0, shape[0], rows)
            yield pd.DataFrame({"path": name, "first": first, "n": np.minimum(rows, shape[0] - first), "height": shape[0], "width": shape[1], "fortran": fortran, "dtype": dtype.str, "data": data})


def _npy_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            dtype = np.dtype(r.dtype)
            with _open(r.path) as f:
                if r.fortran:  # columns lie end to end
                    m = np.stack([np.frombuffer(f.read_at(r.n * dtype.itemsize, r.data + (c * r.height + r.first) * dtype.itemsize), dtype) for c in range(r.width)], axis=1)
                else:
                    m = np.frombuffer(f.read_at(r.n * r.width * dtype.itemsize, r.data + r.first * r.width * dtype.itemsize), dtype).reshape(r.n, r.width)
            m = m.astype(float)
            yield pd.DataFrame({"path": r.path, "row": np.arange(r.first, r.first + r.n), "x": m[:, 0], "y": m[:, 1], "z": m[:, 2], "feats": list(m[:, 3:])})


def read_npy(spark: SparkSession, path: str, rows: int = 100_000) -> DataFrame:
    """Matrices in .npy files of any size -> (id, x, y, z, feats); id hashes the file and the row number.

    Headers tell the runs of rows; runs are dealt over tasks, each of which reads its own bytes (local, hdfs, s3 and gs
    addresses). No file is held in one piece."""
    files = spark.read.format("binaryFile").load(path).select("path")
    schema = "path string, first long, n long, height long, width long, fortran boolean, dtype string, data long"
    runs = files.mapInPandas(partial(_npy_ranges, rows=rows), schema)
    dealt = runs.repartition(spark.sparkContext.defaultParallelism * 4, "path", "first")
    out = dealt.mapInPandas(_npy_rows, "path string, row long, x double, y double, z double, feats array<double>")
    return out.select(F.xxhash64("path", "row").alias("id"), *XYZ, "feats")


def read_cloud(spark: SparkSession, source, **options) -> DataFrame:
    """A cloud from a DataFrame (as it is), Parquet, .npy or delimited text; unknown suffixes: ValueError."""
    if isinstance(source, DataFrame):
        return source
    suffix = source.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "npy":
        return read_npy(spark, source)
    if suffix == "parquet":
        return spark.read.parquet(source)
    if suffix in TEXT:
        return read_text(spark, source, **options)
    raise ValueError(f"cannot read {source}")


def labelled_cloud(spark: SparkSession, parts: list[tuple[int, list[str], list[str]]], **options) -> DataFrame:
    """(label, query files, search files) triples -> one cloud; rows of search files have a null label."""
    out = None
    for label, query, search in parts:
        for value, paths in ((label, query), (None, search)):
            for path in paths:
                one = read_cloud(spark, path, **options).withColumn("label", F.lit(value).cast("int"))
                out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no files given")
    return out


def from_labelled_file(df: DataFrame) -> DataFrame:
    """The file's mark for unlabelled points becomes null."""
    return df.withColumn("label", label_from_file())


def export_colored(df: DataFrame, path: str, precision: int = 3) -> None:
    """df(x, y, z, r, g, b) as comma-separated text with the given number of decimals."""
    text = [F.format_string(f"%.{precision}f", F.col(c).cast("double")).alias(c) for c in (*XYZ, "r", "g", "b")]
    df.select(*text).write.mode("overwrite").csv(path)
