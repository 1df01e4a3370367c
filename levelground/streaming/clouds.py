"""Clouds that arrive over time: the grouped operators run on streams as they are; what is added is the way out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from levelground.operators.cloud import bounds, valid, voxel_downsample


def voxels(points: DataFrame, leaf: float, time_col: str | None = None, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Centroids of a stream's voxels: over all that has come, or for each window of time, closed once nothing earlier
    than `late` is waited for."""
    if time_col is None:
        return voxel_downsample(valid(points), leaf)
    timed = valid(points).withWatermark(time_col, late).withColumn("window", F.window(time_col, window))
    return voxel_downsample(timed, leaf, ("window",))


def running_bounds(points: DataFrame, by: tuple[str, ...] = ("cloud_id",)) -> DataFrame:
    return bounds(valid(points), by)


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows to Parquet, each exactly once; offsets and state live in the checkpoint folder."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
