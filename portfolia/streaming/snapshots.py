"""The latest successful snapshot of each project, kept up to date over an append-only stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(snapshots: DataFrame) -> DataFrame:
    """project_id, authority_revision and snapshot_id of the highest revision; batch or stream (complete or update mode)."""
    newest = F.max(F.struct("authority_revision", "id")).alias("newest")
    return snapshots.where("status = 'success'").groupBy("project_id").agg(newest).select("project_id", "newest.authority_revision", F.col("newest.id").alias("snapshot_id"))


def keep_latest(snapshots: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Start a query that holds the latest snapshots in an in-memory table; ends when all that is there is read."""
    return latest(snapshots).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
