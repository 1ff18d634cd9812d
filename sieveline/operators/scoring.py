"""Scores and dispositions of snapshots: matches, both scores, reasons, evidence, report order. Projections only, but for the order."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import matching, text
from sieveline.functions.text import fold, fold_word
from sieveline.operators import requirements
from sieveline.operators.groups import settled
from sieveline.operators.profile import Profile, Settings, missing_context

#: Words that must not be shown, labels of evidence, reasons in order.
MILITARY_WORDS = r"(?iuU)(?:군\s*(?:필|미필|복무|면제)|군대|군사|병역|대체복무|보충역|산업기능요원|전문연구요원|현역|예비역|military|army|veteran)"
EVIDENCE_LABELS = {"required_qualifications": "필수 요건", "responsibilities": "담당 업무", "preferred_qualifications": "우대 요건"}
ROLE_LABEL, LOCATION_LABEL = "선호 직무", "근무지"
REVIEW_CODES = ("education_ambiguous", "experience_ambiguous", "military_program_review", "education_unknown", "experience_unknown")
MANUAL_CODES = ("manual_flag", "manual_source", *REVIEW_CODES)
LOCATION_ALIASES = {"seoul": "서울", "remote": "재택"}
SEARCHED = ("title", "company", "location", "required_qualifications", "preferred_qualifications", "responsibilities", "company_info", "experience_tags")

def any_of(conditions) -> Column:
    found = F.lit(False)
    for c in conditions:
        found = found | c
    return found


def skill_matches(items: Column, excluded: Column, skills: tuple[str, ...]) -> tuple[Column, Column]:
    """Items without evidence that hold a skill, and the number of items without evidence."""
    usable = F.filter(items, lambda x, i: ~F.array_contains(excluded, i))
    words = [w for w in map(fold_word, skills) if w]
    return F.filter(usable, lambda x: any_of(F.contains(fold(x), F.lit(w)) for w in words)), F.size(usable)


def role_match(title: Column, roles: tuple[str, ...]) -> Column:
    """Whether the title holds a role, or all of its parts between slashes; blank roles match nothing."""
    return matching.role_match(title, roles)


def location_match(location: Column, wanted: tuple[str, ...]) -> Column:
    """Whether the location holds a wanted one, or its alias as it is written."""
    low = fold(location)
    names = [w for w in map(fold_word, wanted) if w]
    return any_of([low.contains(w) for w in names] + [location.contains(LOCATION_ALIASES[w]) for w in names if w in LOCATION_ALIASES])


def breakdown(profile: Profile) -> Column:
    """Numerators, denominators and points of the components, raw and final score, for a snapshot with ``eligibility``."""
    parts, fields = {}, []
    judged = F.col("eligibility")
    for name, field in (("required", "required_qualifications"), ("responsibilities", "responsibilities"), ("preferred", "preferred_qualifications")):
        found, n = skill_matches(F.col(field), requirements.excluded_items(judged, field), profile.skills)
        parts[name] = (F.size(found), n)
    parts["role"] = (role_match(F.col("title"), profile.desired_roles).cast("int"), F.lit(1 if profile.desired_roles else 0))
    parts["location"] = (location_match(F.col("location"), profile.preferred_locations).cast("int"), F.lit(1 if profile.preferred_locations else 0))
    for name, (num, den) in parts.items():
        fields += [F.when(den > 0, num).otherwise(0).alias(f"{name}_numerator"), den.alias(f"{name}_denominator"), matching.component(matching.WEIGHTS[name], num, den).alias(f"{name}_score")]
    ordered = {k: parts[k] for k in matching.WEIGHTS}
    return F.struct(*fields, matching.total_score(ordered, F.lit(0)).alias("raw_score"), matching.total_score(ordered, F.col("experience_gap")).alias("score"))


def public_item(item: Column, profile: Profile) -> Column:
    """Whether an item may be shown: not blank, no military words, none of the private marks."""
    low = fold(item)
    marks = [w for w in map(fold_word, profile.private_canaries) if w]
    return (low != "") & ~item.rlike(MILITARY_WORDS) & ~any_of(low.contains(w) for w in marks)


def matched_evidence(profile: Profile) -> Column:
    """Up to three matches a section, labelled, those that may be shown; then role and location."""
    shown = []
    for field, label in EVIDENCE_LABELS.items():
        found, _ = skill_matches(F.col(field), requirements.excluded_items(F.col("eligibility"), field), profile.skills)
        shown.append(F.transform(F.filter(F.slice(found, 1, 3), lambda x: public_item(x, profile)), lambda x: F.concat(F.lit(label + ": "), x)))
    one = lambda test, column, label: F.when(test & public_item(F.col(column), profile), F.array(F.concat(F.lit(label + ": "), F.col(column)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*shown, one(role_match(F.col("title"), profile.desired_roles), "title", ROLE_LABEL), one(location_match(F.col("location"), profile.preferred_locations), "location", LOCATION_LABEL))


def reason_codes(profile: Profile, run_date: dt.date) -> Column:
    """Reasons in their fixed order, each once."""
    invalid = (F.col("detail_quality") == "rejected") | (text.strip(F.col("title")) == "") | (text.strip(F.col("source_id")) == "")
    all_text = fold(F.concat_ws(" ", *SEARCHED))
    breakers = any_of(all_text.contains(w) for w in map(fold_word, profile.exclusions) if w)
    judged = F.col("eligibility")
    mismatches = F.transform(F.filter(judged, lambda r: (r["state"] == "mismatch") & (r["evidence"]["modality"] != "preferred")), lambda r: r["reason_code"])
    reasons = F.transform(judged, lambda r: r["reason_code"])
    head = F.array(F.when(invalid, "invalid_candidate"), F.when(F.col("deadline") < F.lit(run_date), "expired"), F.when(breakers, "dealbreaker"))
    tail = F.array(F.when(F.size("manual_review_flags") > 0, "manual_flag"), F.when(F.col("detail_quality") == "manual_only", "manual_source"), *[F.when(F.array_contains(reasons, c), c) for c in REVIEW_CODES])
    return F.array_distinct(F.array_compact(F.concat(head, mismatches, tail)))


def assess(snapshots: DataFrame, settings: Settings, run_date: dt.date) -> DataFrame:
    """Snapshots with evidence, eligibility, experience gap, breakdown, score, reasons, disposition and matched evidence."""
    p = settings.profile
    fields = {f: F.array(F.col(f)) if f == "title" else F.col(f) for f in requirements.SCAN_FIELDS}
    found = settled(snapshots.withColumn("evidence", requirements.evidence(fields)))
    found = settled(found.withColumn("eligibility", requirements.eligibility(F.col("evidence"), p)))
    found = settled(found.withColumn("experience_gap", requirements.experience_gap(F.col("eligibility"), p)))
    found = settled(found.withColumn("breakdown", breakdown(p)).withColumn("reason_codes", reason_codes(p, run_date))).withColumn("score", F.col("breakdown.score"))
    said = lambda *codes: any_of(F.array_contains("reason_codes", c) for c in codes)
    label = matching.disposition(said("invalid_candidate"), F.col("experience_gap"), said("expired"), said("dealbreaker"), said(*MANUAL_CODES), F.col("score"), settings.apply, settings.hold)
    return settled(found.withColumn("disposition", label).withColumn("matched_evidence", matched_evidence(p)))


def first_score(snapshots: DataFrame, settings: Settings) -> DataFrame:
    """The first score with its recommendation and verdict: ratios of matched items (an empty list counts half), halves to even."""
    p, w = settings.profile, settings.weights
    skills = [s.lower() for s in p.skills]

    def ratio(field: str) -> Column:
        hits = F.size(F.filter(field, lambda x: any_of(F.contains(F.lower(x), F.lit(s)) for s in skills)))
        return F.when(F.size(field) == 0, F.lit(0.5)).otherwise(hits.cast("double") / F.size(field))

    role, place = first_role_match(F.col("title"), p.desired_roles), first_location_match(F.col("location"), p.preferred_locations)
    raw = w.required * ratio("required_qualifications") + w.preferred * ratio("preferred_qualifications") + w.responsibilities * ratio("responsibilities") + w.company * ratio("company_info")
    raw = raw + F.when(place, w.location).otherwise(0) + F.when(role, 5).otherwise(0)
    if p.desired_roles:
        raw = raw - F.when(role, 0).otherwise(10)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(raw, 0).cast("int")))
    hits = deal_breakers(p)
    found = settled(snapshots.withColumns({"score": score, "deal_breaker_hits": hits}))
    advice = F.when(F.col("score") >= settings.apply, "apply").when(F.col("score") >= settings.hold, "hold").otherwise("low_priority")
    if missing_context(p):
        advice = F.when(advice == "low_priority", "hold").otherwise(advice)
    broken = F.size("deal_breaker_hits") > 0
    advice = F.when(broken, "low_priority").otherwise(advice)
    return found.withColumn("recommendation", advice).withColumn("verdict", F.when(broken, "exclude").otherwise(verdict(F.col("recommendation"))))


def verdict(recommendation: Column) -> Column:
    return F.when(recommendation == "apply", "include").when(recommendation == "hold", "hold").otherwise("exclude")


def movement(verdict_: Column) -> Column:
    """Which way a verdict moves a posting."""
    return F.when(verdict_ == "include", "up").when(verdict_ == "exclude", "down").otherwise("same")


def first_role_match(title: Column, roles: tuple[str, ...]) -> Column:
    """Whether the title holds a role, or all of its words."""
    low = F.lower(title)
    found = F.lit(False)
    for role in (r.lower().strip() for r in roles):
        words = role.replace("/", " ").split()
        if role:
            every = F.lit(bool(words))
            for x in words:
                every = every & low.contains(x)
            found = found | low.contains(role) | every
    return found


def first_location_match(location: Column, wanted: tuple[str, ...]) -> Column:
    names = [w.lower() for w in wanted]
    return any_of([F.lower(location).contains(w) for w in names] + [location.contains(LOCATION_ALIASES[w]) for w in names if w in LOCATION_ALIASES])


def snapshot_text() -> Column:
    """All text of a snapshot, in lower case."""
    return F.lower(F.concat_ws(" ", "title", "company", "location", "required_qualifications", "preferred_qualifications", "responsibilities", "company_info", "manual_review_flags"))


def deal_breakers(profile: Profile) -> Column:
    """The profile's exclusions that a snapshot's text holds, in their order."""
    words = [w for w in profile.exclusions if w]
    if not words:
        return F.array().cast("array<string>")
    whole = snapshot_text()
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(whole, F.lower(w)))


def expired(deadline: Column, run_date: dt.date) -> Column:
    return F.coalesce(deadline < F.lit(run_date), F.lit(False))


def beyond_limit(minimum: Column, profile: Profile) -> Column:
    return F.coalesce(minimum > profile.max_experience_years, F.lit(False))


def report_order(df: DataFrame, label: str = "disposition") -> list[Column]:
    """Report order: label, score, known deadlines first and early ones before, ids."""
    return [matching.label_priority(F.col(label)), F.desc("score"), F.asc_nulls_last("deadline"), F.col("recommendation_id"), F.col("posting_key")]


def queue_order() -> list[Column]:
    """The older queues' order: score, sure deadlines first, source, then what names the posting."""
    named = F.coalesce(F.nullif("source_posting_id", F.lit("")), F.nullif("source_url", F.lit("")), F.concat("title", F.lit("\0"), "company"))
    return [F.desc("score"), (F.col("deadline").isNull() | F.col("deadline_uncertain")).cast("int"), F.coalesce(F.col("deadline").cast("string"), F.lit("")), F.col("source_id"), named]


def identity_order() -> list[Column]:
    return [F.col("source_id"), F.coalesce(F.nullif("source_posting_id", F.lit("")), F.nullif("source_url", F.lit("")), F.concat("title", F.lit("\0"), "company"))]


def first_rank_order() -> list[Column]:
    """The first scorer's order: score, unsure deadlines first, title from the end."""
    return [F.desc("score"), F.desc("deadline_uncertain"), F.desc("title")]


def first_of_class(df: DataFrame, class_: Column, order: list[Column], most: Column) -> DataFrame:
    """Rows at places up to ``most`` of their class, with ``place``; the limit applies before the shuffle where it is a literal."""
    return df.withColumn("__class", class_).filter(F.col("__class").isNotNull()).withColumn("place", F.row_number().over(Window.partitionBy("__class").orderBy(*order))).filter(F.col("place") <= most).drop("__class")
