"""Judged cases against the first score: verdict and movement of every case, feedback counting over the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators import history, scoring
from sieveline.operators.profile import Settings


def case_failures(cases: DataFrame, settings: Settings, feedback: DataFrame | None = None) -> DataFrame:
    """Cases whose verdict or movement is not the expected one.

    ``cases`` are snapshots with case_id, expected_verdict and expected_movement;
    ``feedback`` rows of (key, movement, created_at, event_id), the last of a key
    counts over what the verdict says.
    """
    scored = scoring.first_score(cases, settings).withColumn("key", history.legacy_key(F.col("source_id"), F.col("source_url"), F.col("source_posting_id")))
    said = scoring.movement(F.col("verdict"))
    if feedback is not None:
        last = feedback.groupBy("key").agg(F.max_by("movement", F.struct("created_at", "event_id")).alias("moved"))
        scored, said = scored.join(last, "key", "left"), F.coalesce("moved", said)
    judged = scored.withColumn("movement", said)
    return judged.filter((F.col("verdict") != F.col("expected_verdict")) | (F.col("movement") != F.col("expected_movement"))).select("case_id", "expected_verdict", "verdict", "expected_movement", "movement")
