"""Edit logs and arriving points as streams, with watermarks and bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_values(log: DataFrame, target: str = "tree_id") -> DataFrame:
    """The newest value of each point from a stream of edits (seq, target, point_id, new); for update or complete output."""
    return log.filter(F.col("target") == target).groupBy("point_id").agg(F.max_by("new", "seq").alias("new"), F.max("seq").alias("seq"))


def arriving_counts(points: DataFrame, time: str = "ts", late: str = "1 hour", window: str = "1 day", label: str = "tree_id") -> DataFrame:
    """Distinct arriving points for each label and window of event time: repeats within the watermark count once; state older than it is dropped."""
    once = points.withWatermark(time, late).dropDuplicatesWithinWatermark(["point_id"])
    return once.groupBy(F.window(time, window).alias("window"), label).agg(F.count("*").alias("n"))


def publish(log: DataFrame, folder: str, checkpoint: str, name: str = "edits"):
    """Append a stream of edits to a Parquet log, exactly once; stops when all that is there has been read."""
    return log.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()
