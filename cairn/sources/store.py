"""Clouds on disk: a folder of Parquet tables points/, sets/<tag>/ and meta/."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.cloud import PointCloud
from cairn.functions.geometry import clean
from cairn.operators.assets import unique_first
from cairn.operators.voxel import first_points


class CloudStore:
    """Points and named sets (id, label, cluster, feats) below one folder, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _tag(self, tag: str) -> str:
        if not re.fullmatch(r"[\w .-]+", tag) or tag.startswith("."):
            raise ValueError(f"not a set name: {tag!r}")
        return tag

    def ingest(self, points: DataFrame, voxel_edge: float | None = None, keep_features: bool = True, far: float | None = None) -> tuple[float, float, float]:
        """Writes the points, thinned to the first point of each voxel if an edge is given. far: the centroid is taken off
        the coordinates if it lies farther from the origin. Returns what was taken off (zeros: nothing)."""
        corner = (0.0, 0.0, 0.0)
        if far is not None:
            cloud = PointCloud(points).recenter("centroid", far)
            points, corner = cloud.df, cloud.corner
        if voxel_edge:
            points = points.join(first_points(points, voxel_edge).select("id"), "id", "left_semi")
        if not keep_features:
            points = points.select("id", "x", "y", "z")
        points.write.mode("overwrite").parquet(f"{self.root}/points")
        return corner

    def points(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/points")

    def add_set(self, tag: str, df: DataFrame) -> None:
        """A set with an id column; the row of the smallest pos stays if ids repeat.

        ValueError: a tag that exists; ids that are null or, once points are stored, not among theirs; ids that repeat
        without a pos; feats of different lengths.
        """
        if tag in self.tags():
            raise ValueError(f"set {tag} exists")
        path = f"{self.root}/sets/{self._tag(tag)}"
        if "pos" in df.columns:
            rest = [c for c in df.columns if c not in ("id", "pos")]
            df = unique_first(df.select("id", "pos", F.struct(*rest).alias("value"))).select("id", "value.*")
        elif not df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise ValueError("ids repeat; a column pos tells which row stays")
        if not df.where("id is null").isEmpty():
            raise ValueError("ids are null")
        if self._fs().exists(self._path("points")) and not df.join(self.points().select("id"), "id", "left_anti").isEmpty():
            raise ValueError("ids lie outside the stored cloud")
        if "feats" in df.columns:
            row = df.agg(F.min(F.size("feats")).alias("a"), F.max(F.size("feats")).alias("b")).first()
            if row["a"] != row["b"]:
                raise ValueError("feats differ in length")
        df.write.parquet(path)

    def add_labelled(self, cloud: DataFrame, tag: str = "hand labeled") -> None:
        """Stores a labelled cloud (see readers.labelled_cloud): its points, and its rows of known label as a set."""
        self.ingest(cloud.drop("label"))
        self.add_set(tag, cloud.where("label is not null").select("id", "label", *(c for c in ("feats",) if c in cloud.columns)))

    def tags(self) -> list[str]:
        path = self._path("sets")
        return sorted(s.getPath().getName() for s in self._fs().listStatus(path)) if self._fs().exists(path) else []

    def index(self, tag: str) -> DataFrame:
        if tag not in self.tags():
            raise KeyError(f"no set {tag}")
        return self.spark.read.parquet(f"{self.root}/sets/{self._tag(tag)}")

    def feats(self, tag: str) -> DataFrame:
        """The set with NaN in feats as 0 and infinities as the largest double."""
        return self.index(tag).withColumn("feats", F.transform("feats", clean))

    def drop_set(self, tag: str | None) -> None:
        """Deletes one set, or all (None); an unknown tag changes nothing."""
        for t in self.tags() if tag is None else [tag]:
            if t in self.tags():
                self._fs().delete(self._path("sets", self._tag(t)), True)

    def drop_cloud(self, confirm: bool = False) -> None:
        if not confirm:
            raise ValueError("deleting a cloud needs confirm=True")
        self._fs().delete(self._path(), True)

    def describe_sets(self) -> DataFrame:
        """(tag, n, has_labels, has_clusters, n_features) of every set."""
        out = None
        for tag in self.tags():
            df = self.index(tag)
            some = lambda c: F.count(c) > 0 if c in df.columns else F.lit(False)
            width = F.max(F.size("feats")) if "feats" in df.columns else F.lit(0)
            one = df.agg(F.count("*").alias("n"), some("label").alias("has_labels"), some("cluster").alias("has_clusters"), width.alias("n_features"))
            one = one.select(F.lit(tag).alias("tag"), "n", "has_labels", "has_clusters", F.col("n_features").cast("int").alias("n_features"))
            out = one if out is None else out.union(one)
        return out if out is not None else self.spark.createDataFrame([], "tag string, n long, has_labels boolean, has_clusters boolean, n_features int")
