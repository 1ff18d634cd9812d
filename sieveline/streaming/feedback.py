"""Feedback as a stream: the latest movement of every posting, and an idempotent sink into the history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveline.operators.history import History

EVENT = "event_id string, posting_key string, recommendation_id string, verdict string, reason string, movement string, created_at string"


def latest_movements(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Per posting the movement of its last event; state holds one row a posting. An event repeated within ``late`` counts once."""
    timed = events.withColumn("at", F.try_to_timestamp("created_at")).filter("at IS NOT NULL").withWatermark("at", late)
    return timed.dropDuplicatesWithinWatermark(["event_id"]).groupBy("posting_key").agg(F.max_by("movement", F.struct("created_at", "event_id")).alias("movement"), F.count(F.lit(1)).alias("events"))


def into_history(events: DataFrame, history: History, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append arriving events to the history; a batch that runs again adds nothing, as events are known by their content."""

    def add(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            history.add_feedback(batch.select("recommendation_id", "verdict", "reason", "movement", "created_at"))

    writer = events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
