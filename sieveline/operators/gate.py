"""The quality gate: findings of fixed rules over sources, outcomes and counts, folded into one status."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes that warn, and what findings say.
DETAIL_WARNINGS = ("detail_url_invalid", "detail_fetch_failed", "detail_unverified", "detail_issue_invalid")
COLLECTION_WARNINGS = ("collection_error", "collection_failed")
MESSAGES = {
    "context": "required user context is missing", "source_identity": "source identity rejected", "source_not_attempted": "enabled source was not attempted", "source_zero_accepted": "enabled source accepted zero candidates",
    "capture_zero_accepted": "capture source accepted zero candidates", "source_outcome_failed": "enabled source execution did not complete successfully", "source_outcome_inconsistent": "source execution outcome was internally inconsistent",
    "source_outcome_missing": "enabled source execution outcome was not recorded", "source_detail_warning": "source detail warning recorded", "source_collection_warning": "source collection warning recorded",
    "scheduled_policy": "scheduled source policy failed", "scheduled_db": "scheduled database operation failed", "scheduled_network": "scheduled network preflight failed", "preflight": "scheduled preflight failed", "runtime": "scheduled runtime failure",
}


def _findings(df: DataFrame, code: Column | str, severity: str = "fail", source: bool = True) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    said = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])[code]
    return df.select(F.lit(severity).alias("severity"), (F.col("source_id") if source else F.lit(None).cast("string")).alias("source_id"), code.alias("code"), said.alias("message"))


def source_findings(enabled: DataFrame, metrics: DataFrame, capture: bool = False) -> DataFrame:
    """Enabled sources that were not attempted or gave nothing, and warnings that sources recorded. ``metrics`` has source_id, attempted, accepted, error_codes."""
    both = enabled.select("source_id").distinct().join(metrics.select("source_id", "attempted", "accepted"), "source_id", "left")
    idle = ~F.coalesce("attempted", F.lit(False))
    out = _findings(both.filter(idle), "source_not_attempted")
    out = out.union(_findings(both.filter(~idle & (F.col("accepted") == 0)), "capture_zero_accepted" if capture else "source_zero_accepted", "warning" if capture else "fail"))
    out = out.union(_findings(metrics.filter(F.arrays_overlap("error_codes", F.array(*map(F.lit, DETAIL_WARNINGS)))), "source_detail_warning", "warning"))
    return out.union(_findings(metrics.filter(F.arrays_overlap("error_codes", F.array(*map(F.lit, COLLECTION_WARNINGS)))), "source_collection_warning", "warning"))


def outcome_findings(enabled: DataFrame, metrics: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Enabled sources, outcomes and metrics against each other: outcomes that are missing, failed, or of sources that nothing else knows."""
    known = enabled.select("source_id").distinct().withColumn("enabled", F.lit(True)).join(metrics.select("source_id", F.lit(True).alias("measured")), "source_id", "full_outer").join(outcomes.select("source_id", "status", "error_code"), "source_id", "full_outer")
    missing, failed = F.col("status").isNull() & F.col("enabled"), F.col("enabled") & (F.col("status") != "success")
    odd = F.col("status").isNotNull() & (F.col("enabled").isNull() | F.col("measured").isNull()) | ((F.col("status") == "success") & F.col("error_code").isNotNull())
    out = _findings(known.filter(missing), "source_outcome_missing")
    return out.union(_findings(known.filter(failed), "source_outcome_failed")).union(_findings(known.filter(odd), "source_outcome_inconsistent"))


def runtime_findings(spark, codes: Iterable[str], context_complete: bool = True) -> DataFrame:
    """Findings of the run itself; an unknown code is a failure of the run."""
    known = sorted({c if c in MESSAGES else "runtime" for c in codes} | (set() if context_complete else {"context"}))
    return _findings(spark.createDataFrame([(c,) for c in known], "code string").withColumn("source_id", F.lit(None).cast("string")), F.col("code"))


def gate(findings: DataFrame) -> DataFrame:
    """One row: the status (a failure outranks a warning) and all findings in their order. Findings are as many as sources and rules."""
    one = F.struct("severity", F.coalesce("source_id", F.lit("")).alias("source"), "message", "code")
    return findings.agg(F.array_sort(F.collect_list(one)).alias("findings")).select(F.when(F.exists("findings", lambda f: f["severity"] == "fail"), "fail").when(F.size("findings") > 0, "warning").otherwise("pass").alias("status"), "findings")


def count_differences(assessed: DataFrame, metrics: DataFrame) -> DataFrame:
    """Sources whose surviving assessments by quality are not what the metrics say; must be empty."""
    counted = assessed.groupBy("source_id").agg(F.count_if(F.col("detail_quality") == "verified").alias("n_verified"), F.count_if(F.col("detail_quality") == "manual_only").alias("n_manual"))
    joined = metrics.select("source_id", "verified", "manual_only").join(counted, "source_id", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.filter((zero("verified") != zero("n_verified")) | (zero("manual_only") != zero("n_manual")))


def gate_sources(metrics: DataFrame, public_codes: Iterable[str]) -> DataFrame:
    """The public row of every source, in order."""
    codes = F.array_sort(F.array_distinct(F.filter("error_codes", lambda c: c.isin(*public_codes))))
    return metrics.select(
        "source_id", "attempted", F.col("accepted").alias("candidate_count"), F.col("rejected").alias("source_rejected_count"), F.col("duplicates").alias("duplicate_count"), F.col("changed").alias("normalized_changed_field_count"),
        F.col("emptied").alias("normalized_emptied_field_count"), "verified", "manual_only", F.size(codes).alias("error_count"), codes.alias("error_codes"),
    ).orderBy("source_id")


def eligibility_reasons(assessed: DataFrame) -> DataFrame:
    """Counts of reasons as eligibility gave them."""
    return assessed.select(F.explode("eligibility.reason_code").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
