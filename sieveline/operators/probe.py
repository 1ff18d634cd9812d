"""Evidence about a source: whether its outer pages say what its detail pages say, what its postings can be filtered by, and what of a page may be kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import text

#: Names that are no company, marks that must not be kept, words that no code may hold, lengths.
NO_COMPANIES = ("", "회사명 확인 필요", "saramin", "사람인", "사람인 채용")
PRIVATE_MARKS = ("PRIVATE_", "RAW_JD_CANARY", "Ignore previous instructions", "session=", "access_token=")
FORBIDDEN = ("private", "canary", "secret", "raw", "opaque", "identity", "path", "full", "military")
SAFE_CODE = r"\A[a-z0-9][a-z0-9_.-]{0,63}\z"
TITLE_LIMIT, KEPT_LIMIT = 120, 500
SECTIONS = ("responsibilities", "required", "preferred")


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text.fold(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def section_agrees(a: Column, b: Column) -> Column:
    return F.coalesce((text.fold(a) != "") & (text.fold(b) != "") & F.arrays_overlap(tokens(a), tokens(b)), F.lit(False))


def compare_pages(outer: DataFrame, detail: DataFrame) -> DataFrame:
    """Per posting asked for, what of the outer page does not agree with the detail page. Frames have id, title, company and the sections; a page that was not there has no row."""
    fields = ("title", "company", *SECTIONS)
    side = lambda df, p: df.select("id", *[F.col(f).alias(f"{p}_{f}") for f in fields], F.lit(True).alias(p))
    both = side(outer, "o").join(side(detail, "d"), "id", "full_outer")
    met = F.col("o").isNotNull() & F.col("d").isNotNull()
    same = lambda f: F.coalesce((text.fold(F.col(f"o_{f}")) != "") & (text.fold(F.col(f"o_{f}")) == text.fold(F.col(f"d_{f}"))), F.lit(False))
    title = same("title") & (F.length(text.fold(F.col("o_title"))) <= TITLE_LIMIT)
    company = same("company") & ~text.fold(F.col("o_company")).isin(*NO_COMPANIES)
    agree = {"title_mismatch": title, "company_missing_or_placeholder_or_mismatch": company} | {f"{s}_mismatch": section_agrees(F.col(f"o_{s}"), F.col(f"d_{s}")) for s in SECTIONS}
    good = met
    for a in agree.values():
        good = good & a
    return both.select("id", F.col("o").isNull().alias("outer_fetch_failed"), F.col("d").isNull().alias("detail_fetch_failed"), *[(met & ~a).alias(k) for k, a in agree.items()], good.alias("pairs_outer_sufficient"))


def decide(compared: DataFrame, asked: int) -> DataFrame:
    """Counters over all pairs, and the decision: outer pages suffice only if all that were asked for agree in everything."""
    flags = [c for c in compared.columns if c != "id"]
    counted = compared.agg(*[F.count_if(c).alias(c) for c in flags])
    every = F.col("pairs_outer_sufficient") == asked
    for c in flags:
        if c != "pairs_outer_sufficient":
            every = every & (F.col(c) == 0)
    return counted.select(F.lit(asked).alias("pairs_requested"), *flags, F.when(every, "outer_only").otherwise("detail_only").alias("decision"))


def filterability(candidates: DataFrame) -> DataFrame:
    """One row: which kinds of fields any candidate has."""
    some = lambda f: F.coalesce(F.size(f"raw_jd.{f}") > 0, F.lit(False))
    held = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    any_of = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    return candidates.agg(
        any_of(held("title"), "role_title"), any_of(some("required_qualifications") | some("preferred_qualifications"), "skills_requirements"), any_of(some("responsibilities"), "responsibilities"),
        any_of(some("experience_tags"), "seniority_experience"), any_of(held("location"), "location"), any_of(F.col("source_url").startswith("http"), "stable_posting_url"),
    )


def redacted(c: Column) -> Column:
    """Without private marks, in any case, and at most ``KEPT_LIMIT`` characters."""
    for mark in PRIVATE_MARKS:
        c = F.regexp_replace(c, "(?iu)" + "".join(f"\\{x}" if not x.isalnum() and x != " " and x != "_" else x for x in mark), "[REDACTED]")
    return F.left(c, F.lit(KEPT_LIMIT))


def safe_code(c: Column) -> Column:
    """A code that may be shown, else null."""
    low = F.lower(c)
    bad = F.lit(False)
    for word in FORBIDDEN:
        bad = bad | low.contains(word)
    return F.when(c.rlike(SAFE_CODE) & ~bad, c)


def holds_mark(df: DataFrame, marks: tuple[str, ...]) -> DataFrame:
    """Rows that hold one of the private marks anywhere, nested or not; must be empty before anything is stored."""
    whole = text.fold(F.to_json(F.struct(*df.columns)))
    found = F.lit(False)
    for m in marks:
        if text.fold_word(m):
            found = found | whole.contains(text.fold_word(m))
    return df.filter(found)
