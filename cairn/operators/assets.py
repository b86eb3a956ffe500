"""Named attributes of points: rows (id, value), and set operations on their ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for "no label" in files; null everywhere else.
UNLABELLED = 999


def unique_first(asset: DataFrame) -> DataFrame:
    """asset(pos, id, value) -> (id, value): for each id the value of the smallest position."""
    return asset.groupBy("id").agg(F.min_by("value", "pos").alias("value"))


def as_vector(df: DataFrame, column: str = "value") -> Column:
    """A column as an array: scalars become arrays of one."""
    is_array = df.schema[column].dataType.typeName() == "array"
    return F.col(column).cast("array<double>") if is_array else F.array(F.col(column).cast("double"))


def intersection(assets: list[DataFrame]) -> DataFrame:
    """assets (id, value) -> (id, value): ids that all have, their values laid end to end in the given order."""
    if not assets:
        raise ValueError("no assets given")
    parts = [a.select("id", as_vector(a).alias(f"v{i}")) for i, a in enumerate(assets)]
    joined = reduce(lambda a, b: a.join(b, "id"), parts)
    return joined.select("id", F.concat(*(F.col(f"v{i}") for i in range(len(assets)))).alias("value"))


def merge_features(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, label, feats) of the ids in both; labels come from the first, features are laid end to end."""
    b = second.select("id", F.col("feats").alias("_f"))
    return first.join(b, "id").select("id", "label", F.concat("feats", "_f").alias("feats"))


def restrict(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_semi")


def label_from_file(column: str = "label") -> Column:
    return F.when(F.col(column) != UNLABELLED, F.col(column).cast("int"))


def label_to_file(column: str = "label") -> Column:
    return F.coalesce(F.col(column), F.lit(UNLABELLED))


def split_labelled(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("label is not null"), df.where("label is null")


def collapse_labels(df: DataFrame, labels: list[int]) -> DataFrame:
    """The listed labels all become the first of them."""
    return df.withColumn("label", F.when(F.col("label").isin(labels[1:]), F.lit(labels[0])).otherwise(F.col("label")))


def scatter_labels(points: DataFrame, labelled: DataFrame) -> DataFrame:
    """points with a label column: that of the same id in labelled(id, label), null where there is none."""
    return points.drop("label").join(labelled.select("id", "label"), "id", "left")


def label_population(df: DataFrame) -> DataFrame:
    """(label, n) for every label from 0 to the largest, zeros included."""
    counts = df.where("label is not null").groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))
    grid = counts.agg(F.max("label").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(0), "m")).alias("label"))
    return grid.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def feature_std(df: DataFrame, column: str = "feats") -> DataFrame:
    """(feature, std): population standard deviation of each array position, combined before the shuffle."""
    return df.select(F.posexplode(column).alias("feature", "v")).groupBy("feature").agg(F.stddev_pop("v").alias("std"))


def drop_features(df: DataFrame, drop: list[int], column: str = "feats") -> DataFrame:
    """Arrays without the positions in drop."""
    return df.withColumn(column, F.filter(column, lambda x, i: ~i.isin(drop)) if drop else F.col(column))
