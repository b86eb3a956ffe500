"""Features of query points as they arrive, against a search cloud at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cairn.plans.multiscale import one_scale


def stream_features(arriving: DataFrame, search: DataFrame, edge: float, radius: float, path: str, checkpoint: str) -> StreamingQuery:
    """Appends one_scale of each micro-batch of query points to a Parquet folder, one subfolder a batch, so that a batch
    that runs again replaces its own output."""

    def write(batch: DataFrame, epoch: int) -> None:
        one_scale(batch, search, edge, radius).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
