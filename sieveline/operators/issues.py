"""Issues of details and outcomes of sources beside the candidates: what they change, and what must agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import matching, scalars, text
from sieveline.operators import candidates

#: Codes of detail issues, states of a source's execution, codes that may be shown.
ISSUE_CODES = ("detail_url_invalid", "detail_fetch_failed", "detail_unverified")
FAILURES = ("collection_error", "collection_failed", "source_timeout", "aggregate_budget_exhausted")
STATUSES = ("success", *FAILURES)
NO_CANDIDATES, FAILED, SOME_SOURCE = "수집 결과 없음", "수집 실패", "일부 소스"


def normalized_issues(issues: DataFrame) -> DataFrame:
    """Issues of known codes as (source_id, code, key): the identity of the posting they speak of, null if they name none."""
    source, posting, url = scalars.source_id(F.col("source_id")), scalars.identifier(F.col("source_posting_id")), matching.canonical_url(F.col("source_url"))
    triple = lambda kind, value: F.struct(F.lit(kind).alias("kind"), source.alias("source_id"), value.alias("value"))
    key = F.when(source.isNull(), None).when(posting.isNotNull(), triple("source_posting_id", text.fold(posting))).when(url.isNotNull(), triple("canonical_url", url))
    return issues.filter(F.col("code").isin(*ISSUE_CODES)).select(F.coalesce(source, F.lit("unknown-source")).alias("source_id"), "code", key.alias("key"))


def match_issues(issues: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posting keys that an issue speaks of, and (source_id, error_code) of issues that no accepted candidate answers.

    One join on the identity; each side is unique by it, so no key is hot.
    """
    known = accepted.select(candidates.own_basis().alias("key")).select("key", candidates.posting_key(F.col("key")).alias("posting_key")).distinct()
    each = normalized_issues(issues).distinct()
    hit = each.join(known, each["key"] == known["key"], "left").select(each["source_id"], "code", "posting_key")
    return hit.filter("posting_key IS NOT NULL").select("posting_key").distinct(), hit.filter("posting_key IS NULL").select("source_id", F.col("code").alias("error_code")).distinct()


def lowered(kept: DataFrame, keys: DataFrame) -> DataFrame:
    """Survivors, those that an issue speaks of for manual review only."""
    marked = kept.join(keys.select("posting_key", F.lit(True).alias("__issue")), "posting_key", "left")
    return marked.withColumn("detail_quality", F.when(F.col("__issue"), "manual_only").otherwise(F.col("detail_quality"))).drop("__issue")


def closed_outcomes(outcomes: DataFrame) -> DataFrame:
    """Outcomes in the closed vocabulary: unknown states are errors, a success has no code, a failure one; missing flags are false, times not negative."""
    status = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("collection_error")
    code = F.when(status == "success", None).when(F.col("error_code").isin(*FAILURES), F.col("error_code")).otherwise(status)
    no = F.lit(False)
    return outcomes.select(
        F.coalesce(scalars.source_id(F.col("source_id")), F.lit("unknown-source")).alias("source_id"), F.coalesce("attempted", no).alias("attempted"), F.coalesce("completed", no).alias("completed"), status.alias("status"), code.alias("error_code"),
        F.greatest(F.coalesce("elapsed_ms", F.lit(0)), F.lit(0)).cast("long").alias("elapsed_ms"),
    )


def consistent(status: Column, code: Column, attempted: Column, completed: Column) -> Column:
    """A success was attempted and completed without a code; a failure was attempted, not completed, and its code is its state."""
    return F.when(status == "success", attempted & completed & code.isNull()).when(status.isin(*FAILURES), attempted & ~completed & code.eqNullSafe(status)).otherwise(False)


def with_outcomes(metrics: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metrics with status, duration and the code of a failure; and (source_id, side) of sources that only one of the two knows, which must be none."""
    joined = metrics.join(closed_outcomes(outcomes).select("source_id", "status", F.col("error_code").alias("__code"), F.col("elapsed_ms").alias("duration_ms")), "source_id", "full_outer")
    odd = joined.filter(F.col("status").isNull() | F.col("error_codes").isNull()).select("source_id", F.when(F.col("status").isNull(), "metrics").otherwise("outcomes").alias("side"))
    both = joined.filter(F.col("status").isNotNull() & F.col("error_codes").isNotNull())
    codes = F.array_sort(F.array_union("error_codes", F.array_compact(F.array("__code"))))
    return both.withColumn("error_codes", codes).drop("__code"), odd


def notices(metrics: DataFrame) -> DataFrame:
    """(source, code) of sources that failed, recorded a public code, or gave nothing, as the report's notices say it; ``metrics`` as from ``with_outcomes``."""
    public = F.filter("error_codes", lambda c: c.isin(*FAILURES))
    none = F.col("accepted") == 0
    token = F.when(F.col("source_id").rlike(r"\A[\p{L}\p{N}_-]{1,64}\z"), F.col("source_id")).otherwise(SOME_SOURCE)
    said = F.when(F.size(public) > 0, F.array_min(public)).when(none, NO_CANDIDATES).otherwise(FAILED)
    return metrics.filter((F.col("status") != "success") | (F.size(public) > 0) | none).select("source_id", token.alias("source"), said.alias("code"))


def inconsistent_totals(totals: DataFrame, metrics: DataFrame) -> DataFrame:
    """The row of totals if it does not add up, or not to what the sources say; must be empty."""
    sums = metrics.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"s_{c}") for c in ("accepted", "rejected", "duplicates", "verified", "manual_only")])
    both = totals.crossJoin(F.broadcast(sums))  # two frames of one row
    c = F.col
    rules = [
        c("source_accepted") == c("s_accepted"), c("source_rejected") == c("s_rejected"), c("collected") == c("s_accepted") + c("s_rejected"), c("duplicates_removed") == c("s_duplicates"),
        c("deduplicated") == F.greatest(F.lit(0), c("s_accepted") - c("s_duplicates")), c("s_accepted") - c("s_duplicates") == c("s_verified") + c("s_manual_only"), c("actionable_total") == c("apply_total") + c("hold_total"),
        c("displayed_apply") + c("suppressed_apply") == c("apply_total"), c("displayed_hold") + c("suppressed_hold") == c("hold_total"), c("displayed_manual") + c("suppressed_manual") == c("manual_review_total"),
    ]
    return both.filter(~reduce(lambda x, y: x & y, rules))
