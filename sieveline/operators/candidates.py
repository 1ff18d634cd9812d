"""Candidates to snapshots: normalization with rejects, identity keys, duplicates.

A candidate has source_id, source_url, source_posting_id, title, company,
location, deadline_raw, collected_at and raw_jd, a struct of the six list
fields (null: none given). Every step is one projection; only duplicates are
grouped, by partial aggregation on the posting key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions import matching, scalars, text
from sieveline.operators.groups import settled
from sieveline.shared import checkpointed

#: List fields in the order of their names, policies and codes.
RAW_FIELDS = ("company_info", "experience_tags", "manual_review_flags", "preferred_qualifications", "required_qualifications", "responsibilities")
SCALARS = ("source_id", "source_url", "source_posting_id", "title", "company", "location", "deadline_raw")
DETAIL_RANK = {"verified": 0, "manual_only": 1, "rejected": 2}
COUNTED_FIELDS = ("required_qualifications", "preferred_qualifications", "responsibilities", "company_info", "experience_tags")
SOURCE_ERRORS = ("collection_error", "collection_failed", "invalid_candidate", "detail_issue_invalid", "detail_url_invalid", "detail_fetch_failed", "detail_unverified", "source_timeout", "aggregate_budget_exhausted")

CANDIDATE = T.StructType([
    *(T.StructField(c, T.StringType()) for c in SCALARS), T.StructField("collected_at", T.TimestampType()),
    T.StructField("raw_jd", T.StructType([T.StructField(f, T.ArrayType(T.StringType())) for f in RAW_FIELDS])),
])


def normalized(candidates: DataFrame) -> DataFrame:
    """Candidates with normalized fields, ``reject_code`` (null: accepted), and the numbers of ``changed`` and ``emptied`` fields.

    A field counts as changed if its value differs from the given one, and as
    emptied if something was given and nothing is left; list fields count if given.
    """
    raw = lambda f: F.col(f"raw_jd.{f}")
    new = {
        "source_id": scalars.source_id(F.col("source_id")), "source_url": matching.canonical_url(F.col("source_url")),
        "source_posting_id": scalars.identifier(F.col("source_posting_id")), "title": text.scalar_or_empty(F.col("title")),
        "company": text.scalar_or_empty(F.col("company")), "location": text.scalar_or_empty(F.col("location")), "deadline_raw": text.scalar(F.col("deadline_raw")),
    }
    done = settled(candidates.withColumns({f"__new_{k}": v for k, v in new.items()} | {f"__list_{f}": F.when(raw(f).isNotNull(), text.items(raw(f))) for f in RAW_FIELDS}))
    reject = (
        F.when(F.col("__new_source_id").isNull(), "invalid_source_id").when(F.col("__new_source_url").isNull(), "invalid_source_url")
        .when((F.col("__new_title") == "") | (F.col("__new_company") == ""), "invalid_candidate")
        .when(F.col("raw_jd").isNull(), "invalid_raw_structured").when(F.col("collected_at").isNull(), "invalid_candidate")
    )
    gone = lambda c: F.col(c).isNull() | (F.col(c) == "")
    changed = [~F.col(k).eqNullSafe(F.col(f"__new_{k}")) for k in SCALARS] + [F.col(f"__list_{f}").isNotNull() & ~raw(f).eqNullSafe(F.col(f"__list_{f}")) for f in RAW_FIELDS]
    emptied = [~gone(k) & gone(f"__new_{k}") for k in SCALARS] + [F.coalesce((F.size(raw(f)) > 0) & (F.size(f"__list_{f}") == 0), F.lit(False)) for f in RAW_FIELDS]
    total = lambda flags: reduce(lambda x, y: x + y, [f.cast("int") for f in flags])
    rest = [c for c in candidates.columns if c not in (*SCALARS, "raw_jd")]
    return done.select(
        *[F.col(f"__new_{k}").alias(k) for k in SCALARS], *rest, F.struct(*[F.col(f"__list_{f}").alias(f) for f in RAW_FIELDS]).alias("raw_jd"),
        reject.alias("reject_code"), total(changed).alias("changed"), total(emptied).alias("emptied"),
    )


def detail_quality(hint: Column, manual_source: Column) -> Column:
    """What a source's policy says of details, else the given hint, else verified."""
    return F.when(manual_source, "manual_only").when(hint.isin(*DETAIL_RANK), hint).otherwise("verified")


def source_error(message: Column) -> Column:
    """The known code after the first colon of a source's error, else a general one."""
    code = F.when(message.contains(":"), text.strip(F.regexp_replace(message, r"(?s)^[^:]*:", ""))).otherwise(text.strip(message))
    return F.when(code.isin(*SOURCE_ERRORS), code).otherwise("collection_error")


def snapshots(accepted: DataFrame, quality: Column | None = None) -> DataFrame:
    """Normalized candidates with typed deadline and list columns; absent lists are empty."""
    quality = F.lit("verified") if quality is None else quality
    lists = [F.coalesce(F.col(f"raw_jd.{f}"), F.array().cast("array<string>")).alias(f) for f in RAW_FIELDS]
    return accepted.select("*", scalars.deadline(F.col("deadline_raw")).alias("deadline"), scalars.deadline_uncertain(F.col("deadline_raw")).alias("deadline_uncertain"), *lists, quality.alias("detail_quality"))


def minimum_experience(tags: Column) -> Column:
    """Years that the first telling tag asks: its number before the unit, else one; tags for newcomers or any experience tell nothing."""

    def years(tag: Column) -> Column:
        n = F.nullif(F.regexp_extract(tag, r"(?U)경력\s*([0-9]+)\s*년", 1), F.lit("")).cast("int")
        return F.when(tag.contains("경력무관") | tag.contains("신입"), F.lit(None).cast("int")).when(n.isNotNull(), n).when(tag.contains("경력"), 1)

    return F.get(F.array_compact(F.transform(tags, years)), 0)


def identity_basis(posting_id: Column, source: Column, url: Column, title: Column, company: Column) -> Column:
    """What a posting is known by: its id at the source, else its URL, else the words of title and company."""
    bare = text.fold(F.regexp_replace(F.concat_ws(" ", title, company), r"[\p{P}\p{S}\p{C}]", " "))
    held = lambda c: c.isNotNull() & (c != "")
    kind = F.when(held(posting_id), "source_posting_id").when(held(url), "canonical_url").otherwise("title_company")
    value = F.when(held(posting_id), text.fold(posting_id)).when(held(url), url).otherwise(bare)
    return F.struct(kind.alias("kind"), source.alias("source_id"), value.alias("value"))


def own_basis() -> Column:
    """``identity_basis`` over a snapshot's columns."""
    return identity_basis(*[F.col(c) for c in ("source_posting_id", "source_id", "source_url", "title", "company")])


def posting_key(basis: Column) -> Column:
    return matching.hashed_key("posting-v3", basis)


def recommendation_id(basis: Column, run_id: str) -> Column:
    """Key of a posting within one run."""
    if not run_id:
        raise ValueError("a run id is needed")
    return matching.hashed_key("recommendation-v3", basis, run_id)


def candidate_json() -> Column:
    """Canonical JSON of a normalized candidate: fields in order, list fields by name, absent ones left out."""
    given = F.array_compact(F.array(*[F.when(F.col(f"raw_jd.{f}").isNotNull(), F.concat(F.lit(f'["{f}",'), F.to_json(F.col(f"raw_jd.{f}")), F.lit("]"))) for f in RAW_FIELDS]))
    at = F.concat(F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format("collected_at", "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format("collected_at", "SSSSSS"))).otherwise(""), F.lit("+00:00"))
    head = F.to_json(F.struct(*SCALARS, at.alias("collected_at")), {"ignoreNullFields": "false"})
    return F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"raw_structured":['), F.array_join(given, ","), F.lit("]}"))


def tie_breaker() -> Column:
    """Order among snapshots of one posting: better detail, no manual flags, a sure deadline, more items, then by content."""
    rank = F.coalesce(F.create_map(*[x for k, v in DETAIL_RANK.items() for x in (F.lit(k), F.lit(v))])[F.col("detail_quality")], F.lit(2))
    sizes = reduce(lambda x, y: x + y, [F.size(f) for f in COUNTED_FIELDS])
    body = candidate_json()
    return F.struct(rank.alias("detail"), (F.size("manual_review_flags") > 0).cast("int").alias("manual"), F.col("deadline").isNull().cast("int").alias("unknown"), (-sizes).alias("sizes"), F.sha2(body, 256).alias("digest"), body.alias("body"))


def survivors(found: DataFrame) -> DataFrame:
    """The best snapshot of each posting key, with the number of snapshots it stands for (``group_size``)."""
    keyed = settled(found).withColumn("posting_key", posting_key(own_basis())).withColumn("__tie", tie_breaker())
    row = F.struct(*[c for c in keyed.columns if c not in ("posting_key", "__tie")])
    return keyed.groupBy("posting_key").agg(F.min_by(row, F.col("__tie")).alias("__best"), F.count(F.lit(1)).alias("group_size")).select("posting_key", "__best.*", "group_size")


def source_metrics(attempted: DataFrame, done: DataFrame, kept: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per source, whether attempted or only seen: accepted, rejected, duplicates, changed and emptied fields, surviving details by quality, and error codes.

    ``done`` are normalized candidates, ``kept`` the survivors, ``errors`` rows of (source_id, error_code). A rejected candidate counts for its source if that is known.
    """
    ok = F.col("reject_code").isNull()
    of_done = done.groupBy("source_id").agg(
        F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.sum(F.when(ok, F.col("changed")).otherwise(0)).alias("changed"),
        F.sum(F.when(ok, F.col("emptied")).otherwise(0)).alias("emptied"), F.collect_set(F.when(~ok, F.lit("invalid_candidate"))).alias("codes"),
    )
    of_kept = kept.groupBy("source_id").agg(F.sum(F.col("group_size") - 1).alias("duplicates"), F.count_if(F.col("detail_quality") == "verified").alias("verified"), F.count_if(F.col("detail_quality") == "manual_only").alias("manual_only"))
    found = attempted.select("source_id").distinct().withColumn("attempted", F.lit(True)).join(of_done, "source_id", "full_outer").join(of_kept, "source_id", "left")
    none = F.array().cast("array<string>")
    if errors is not None:
        found = found.join(errors.groupBy("source_id").agg(F.collect_set("error_code").alias("more")), "source_id", "left")
    else:
        found = found.withColumn("more", none)
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("accepted", "rejected", "duplicates", "changed", "emptied", "verified", "manual_only")]
    return found.select("source_id", F.coalesce("attempted", F.lit(False)).alias("attempted"), *counts, F.array_sort(F.array_union(F.coalesce("codes", none), F.coalesce("more", none))).alias("error_codes"))


def first_wins(found: DataFrame, order: str) -> DataFrame:
    """The first scorer's duplicates: in the given order a row goes if an earlier kept row has its URL or its title and company.

    Whether an earlier row was kept depends on those before it, so rows that share
    a URL or a name, directly or through others, are resolved in rounds: each round
    keeps the rows that come first under both keys and drops what they meet. A
    round is two joins on keys; chains of n rows that alternate between the keys
    take n / 2 rounds, others one or two.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    left = found.withColumns({"__url": F.lower(text.strip(F.col("source_url"))), "__name": F.struct(plain(F.col("title")), plain(F.col("company")))})
    kept = None
    while True:
        by_url, by_name = (left.groupBy(k).agg(F.min(order).alias(f"{k}_first")) for k in ("__url", "__name"))
        new = checkpointed(left.join(by_url, "__url").join(by_name, "__name").filter((F.col(order) == F.col("__url_first")) & (F.col(order) == F.col("__name_first"))).select(*left.columns))
        kept = new if kept is None else kept.unionByName(new)
        left = checkpointed(left.join(new.select("__url").distinct(), "__url", "left_anti").join(new.select("__name").distinct(), "__name", "left_anti"))
        if left.isEmpty():
            return kept.drop("__url", "__name")
