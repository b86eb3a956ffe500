"""Tables in the shared checkpoint folder, and exact ranks without a global sort in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir. Where that is unset, below a temporary folder on a single machine; on
    a cluster, whose machines would not see it, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/cairn-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df below spark.checkpoint.dir and returns its reader."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, groups: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Adds the rank (from 0) of each row in its group by the order columns, however large a group is.

    Rows are range-partitioned by group and order; the counts of (partition, group) pairs, which are few, turn ranks
    inside a partition into ranks inside the group.
    """
    keys = [F.col(c) for c in groups + order]
    parts = materialize(df.repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id()))
    counts = parts.groupBy("_pid", *groups).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_pid", *groups, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_pid", *groups).orderBy(*order)
    run = parts.withColumn("_run", F.row_number().over(inside) - 1)
    for c in groups:
        bases = bases.withColumnRenamed(c, f"_g_{c}")
    on = run["_pid"] == bases["_pid"]
    for c in groups:
        on = on & run[c].eqNullSafe(bases[f"_g_{c}"])
    out = run.join(bases, on).drop(bases["_pid"]).drop(*(f"_g_{c}" for c in groups))
    return out.withColumn(name, (F.col("_base") + F.col("_run")).cast("long")).drop("_pid", "_base", "_run")
