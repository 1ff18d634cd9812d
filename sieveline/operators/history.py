"""Runs, recommendations and feedback as Parquet tables under one folder: idempotent writes, exports in fixed order, checks, a cache with expiry.

A run is written to ``run_id=...`` partitions first and counts once its marker
exists, so a lost driver leaves nothing half visible; writing the same run again
changes nothing, and other content under the same id is refused.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import groups, issues
from sieveline.shared import checkpointed

#: Tables of a run, order of exports, form of a stored time, verdicts and movements.
RUN_TABLES = ("runs", "source_attempts", "recommendations", "quality_gates", "source_outcomes")
CANONICAL_TIME = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{6})?\+00:00\z"
VERDICTS = ("applied", "ignored", "hidden", "false_positive", "false_negative", "interesting", "not_relevant")
MOVEMENTS = ("up", "same", "down")


class History:
    """Tables of finished runs and feedback under ``root``, a folder of any of Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def state(self, run_id: str) -> str:
        """committed, pending (written without its marker) or absent."""
        for name, part in (("committed", "_committed"), ("pending", "_pending")):
            fs, at = self._path(part, run_id)
            if fs.exists(at):
                return name
        return "absent"

    def _mark(self, folder: str, run_id: str) -> None:
        fs, at = self._path(folder, run_id)
        fs.create(at, True).close()

    def _unmark(self, folder: str, run_id: str) -> None:
        fs, at = self._path(folder, run_id)
        fs.delete(at, False)

    def _run_files(self, table: str, run_id: str) -> str:
        return f"{self.root}/{table}/run_id={run_id}"

    def stage(self, run_id: str, tables: dict[str, DataFrame]) -> str:
        """Write a run's tables without showing them; a committed run must hold the same rows (durations aside)."""
        if self.state(run_id) == "committed":
            for name, df in tables.items():
                stored = self.spark.read.parquet(self._run_files(name, run_id))
                compared = [c for c in df.columns if c not in ("run_id", "duration_ms")]
                a, b = df.select(compared), stored.select(compared)
                if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
                    raise ValueError(f"run {run_id} is stored with other {name}")
            return "replayed"
        self._mark("_pending", run_id)
        for name, df in tables.items():
            df.drop("run_id").write.mode("overwrite").parquet(self._run_files(name, run_id))
        return "pending"

    def finalize(self, run_id: str) -> None:
        if self.state(run_id) == "pending":
            self._mark("_committed", run_id)
            self._unmark("_pending", run_id)

    def discard(self, run_id: str) -> None:
        """Forget a run that was not finished."""
        if self.state(run_id) != "pending":
            raise ValueError(f"run {run_id} is not pending")
        for name in RUN_TABLES:
            fs, at = self._path(name, f"run_id={run_id}")
            fs.delete(at, True)
        self._unmark("_pending", run_id)

    def committed(self) -> list[str]:
        fs, at = self._path("_committed")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def table(self, name: str, run_id: str | None = None) -> DataFrame | None:
        """Rows of finished runs, or of one; partitions of other runs are not read."""
        ids = [r for r in self.committed() if run_id in (None, r)]
        if not ids:
            return None
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*[self._run_files(name, r) for r in ids]).withColumn("run_id", F.col("run_id").cast("string"))

    def add_feedback(self, events: DataFrame) -> DataFrame:
        """Append events that are not stored yet; gives the new ones. Events are (recommendation_id, verdict, reason, movement, created_at) of known recommendations."""
        known = self.table("recommendations")
        if known is None:
            raise ValueError("there are no recommendations")
        checked = feedback_events(events, known)
        if not checked.filter("problem IS NOT NULL").isEmpty():
            raise ValueError("feedback with an unknown recommendation, verdict, movement or time")
        fs, at = self._path("feedback_events")
        new = checked.drop("problem").dropDuplicates(["event_id"])
        if fs.exists(at):
            new = new.join(self.spark.read.parquet(f"{self.root}/feedback_events").select("event_id"), "event_id", "left_anti")
        new = checkpointed(new)  # the write would otherwise change what it is made from
        new.write.mode("append").parquet(f"{self.root}/feedback_events")
        return new

    def feedback(self) -> DataFrame | None:
        """Stored events by time, as text, and id."""
        fs, at = self._path("feedback_events")
        return self.spark.read.parquet(f"{self.root}/feedback_events").orderBy("created_at", "event_id") if fs.exists(at) else None


def event_id(recommendation: Column, verdict: Column, reason: Column, movement: Column, created: Column) -> Column:
    """Key of a feedback event: the first 32 hex digits of its canonical JSON's SHA-256."""
    body = F.to_json(F.struct(recommendation.alias("recommendation_id"), verdict.alias("verdict"), reason.alias("reason"), movement.alias("movement"), created.alias("created_at")), {"ignoreNullFields": "false"})
    return F.left(F.sha2(body, 256), F.lit(32))


def canonical_time(value: Column) -> Column:
    """Whether a text is a time as it is stored: ISO, microseconds or none, UTC, and one that exists."""
    return value.rlike(CANONICAL_TIME) & F.try_to_timestamp(value).isNotNull()


def feedback_events(events: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Events with id, run and posting, and ``problem`` where they must not be stored."""
    keyed = events.select("*", event_id(*[F.col(c) for c in ("recommendation_id", "verdict", "reason", "movement", "created_at")]).alias("event_id"))
    known = recommendations.select("recommendation_id", "run_id", "posting_key", "source_id", "source_posting_id", F.lit(True).alias("__known"))
    joined = keyed.join(known, "recommendation_id", "left")
    problem = (
        F.when(F.col("__known").isNull(), "unknown recommendation").when(~F.col("verdict").isin(*VERDICTS), "unknown verdict")
        .when(~F.col("movement").isin(*MOVEMENTS), "unknown movement").when(~canonical_time(F.col("created_at")), "time is not canonical")
    )
    return joined.withColumn("problem", problem).drop("__known")


def order_recommendations(df: DataFrame) -> DataFrame:
    return df.orderBy("run_id", F.desc("score"), "recommendation_id")


def order_runs(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("run_date"), F.desc("updated_at"))


def order_outcomes(df: DataFrame, run_id: str | None = None) -> DataFrame:
    return (df if run_id is None else df.filter(F.col("run_id") == run_id)).orderBy("run_id", "source_id")


def without_pending(df: DataFrame, pending: DataFrame) -> DataFrame:
    """Rows of runs that are not pending."""
    return df.join(pending.select("run_id").distinct(), "run_id", "left_anti")


def one_sided(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of either side without the other, with ``side`` (a or b); must be empty where both sides match."""
    return a.select(key).distinct().withColumn("__a", F.lit(True)).join(b.select(key).distinct().withColumn("__b", F.lit(True)), key, "full_outer").filter("__a IS NULL OR __b IS NULL").select(key, F.when(F.col("__b").isNull(), "a").otherwise("b").alias("side"))


def invalid_outcomes(df: DataFrame) -> DataFrame:
    """Outcome rows that contradict themselves or have a negative duration."""
    good = issues.consistent(F.col("status"), F.col("error_code"), F.col("attempted"), F.col("completed")) & (F.col("duration_ms") >= 0) & (F.col("source_id") != "")
    return df.filter(~F.coalesce(good, F.lit(False)))


def run_count_mismatches(runs: DataFrame, recommendations: DataFrame) -> DataFrame:
    return groups.count_mismatches(runs, recommendations, "run_id", "ranked_count")


def latest_feedback(events: DataFrame) -> DataFrame:
    """The last movement and verdict of every posting."""
    return events.groupBy("posting_key").agg(*[F.max_by(c, F.struct("created_at", "event_id")).alias(c) for c in ("movement", "verdict")])


def legacy_key(source: Column, url: Column, posting_id: Column) -> Column:
    """Posting key of the older relevance records: key-sorted JSON of the fields as given, no prefix; non-ASCII characters are escaped in it, which is done here by code unit."""
    body = F.to_json(F.struct(source.alias("source_id"), posting_id.alias("source_posting_id"), url.alias("source_url")), {"ignoreNullFields": "false"})
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(body, "UTF-16BE")), F.lit("(.{4})"), F.lit(1)), lambda h: F.when(h < "0080", F.decode(F.unhex(F.substr(h, F.lit(3))), "UTF-8")).otherwise(F.concat(F.lit("\\u"), F.lower(h))))
    escaped = F.when(body.rlike(r"^[\x00-\x7F]*$"), body).otherwise(F.array_join(units, ""))
    return F.left(F.sha2(escaped, 256), F.lit(32))


class Cache:
    """Values by key with an expiry, as appended Parquet; the latest write of a key counts."""

    def __init__(self, spark: SparkSession, path: str, ttl_seconds: int = 86_400):
        self.spark, self.path, self.ttl = spark, path, ttl_seconds

    def put(self, rows: DataFrame, now: dt.datetime) -> None:
        """Rows of (key, value)."""
        rows.select("key", "value", F.lit(now).alias("stored_at"), F.lit(now + dt.timedelta(seconds=self.ttl)).alias("expires_at")).write.mode("append").parquet(self.path)

    def live(self, now: dt.datetime) -> DataFrame:
        every = self.spark.read.parquet(self.path)
        last = every.groupBy("key").agg(F.max_by(F.struct("value", "stored_at", "expires_at"), F.struct("stored_at", "value")).alias("x")).select("key", "x.*")
        return last.filter(F.col("expires_at") > F.lit(now))

    def prune(self, now: dt.datetime, into: str) -> Cache:
        """The live rows as a new cache; the old one may go when nothing reads it any more."""
        self.live(now).write.mode("errorifexists").parquet(into)
        return Cache(self.spark, into, self.ttl)


def normalized_feedback(records: DataFrame) -> DataFrame:
    """Records under one key: the posting's, else the recommendation's, else the posting id; without any they fall out."""
    key = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("posting_key", "recommendation_id", "posting_id") if c in records.columns])
    return records.select(key.alias("key"), *[c for c in records.columns if c not in ("posting_key", "recommendation_id", "posting_id")]).filter("key IS NOT NULL")
