"""Grouping operators: best of a group, latest of a key, metrics, reason counts, count checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns evaluated once, as they stand: filters and projections above are not pushed into it, where they would repeat long expressions. The row number is what keeps the optimizer out."""
    return df.withColumn("__row", F.monotonically_increasing_id()).filter(F.col("__row") >= 0).drop("__row")


def best_of_group(df: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """The least row of each group under the order; the whole row travels through one partial aggregation."""
    row = F.struct(*df.columns)
    return df.groupBy(key.alias("__key")).agg(F.min_by(row, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("__best"), F.count(F.lit(1)).alias("group_size")).select("__best.*", "group_size")


def latest(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """The value of the last row of each key."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def reason_counts(df: DataFrame, reasons: Column) -> DataFrame:
    """Occurrences of each reason."""
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def count_mismatches(parents: DataFrame, children: DataFrame, key: str, claimed: str) -> DataFrame:
    """Every parent with its claimed and actual number of children, where they differ."""
    actual = children.groupBy(key).agg(F.count(F.lit(1)).alias("actual"))
    return parents.select(key, F.col(claimed).alias("claimed")).join(actual, key, "full_outer").select(key, "claimed", F.coalesce("actual", F.lit(0)).alias("actual")).filter(~F.col("claimed").eqNullSafe(F.col("actual")))
