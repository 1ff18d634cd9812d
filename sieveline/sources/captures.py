"""Browser captures as candidates: spool partitions, documents with isolated errors, repairs, duplicates, the quality gate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.functions import matching, text
from sieveline.sources.records import elements, field, raw_struct, whole_files

#: Fields and values that must not come in, terms, headings, cut marks, known sources, messages.
SENSITIVE_KEY = r"(?i)(cookie|token|secret|password|authorization|credential|session|email|phone|resume|personal)"
CREDENTIAL = r"(?i)(bearer\s+[a-z0-9._-]+|li_at=|csrf|session[_-]?id|auth[_-]?token)"
CONTACT = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|\b0\d{1,2}[-.\s]?\d{3,4}[-.\s]?\d{4}\b"
LOCATION_TAIL = r"(?U)\s*(?:마감일|마감|D[-+]?\d+|~\s*\d{1,2}/\d{1,2}).*$"
ADDRESS_END = "지도보기|함께하면|이 기간동안|합류 여정|지원 시"
TERMS = ("Python", "PyTorch", "TensorFlow", "JAX", "LLM", "RAG", "FastAPI", "SQL", "Redis", "Elasticsearch", "Docker", "Kubernetes", "AWS", "GCP", "Azure", "Pandas", "NumPy", "Machine Learning", "Deep Learning", "Reinforcement Learning", "MLOps")
HEADINGS = {"preferred": ("우대사항", "이런 분이면 더 좋아요", "Preferred"), "duties": ("주요업무", "이런 업무", "General Summary", "Responsibilities"), "company": ("회사 소개", "서비스 소개", "Company", "회사정보")}
KNOWN_SOURCES = ("saramin", "jobkorea", "wanted", "jumpit", "rallit", "rocketpunch")
OCR_FLAG = "본문 OCR 필요: 사람인 이미지형 JD 또는 DOM 텍스트 없음"
ERRORS = ("invalid JSON", "capture root must be an object", "capture postings must be a list", "must be an object", "sensitive field is not importable", "credential-like value is not importable", "posting requires source_id/source_url/title/company")


def spool(spark: SparkSession, root: str, day: dt.date | None = None) -> DataFrame:
    """(file, body) of the captures of a day's folder, or of the latest day that has one."""
    files = whole_files(spark, root, "*.json").withColumn("__day", F.try_to_date(F.regexp_extract("file", r"/(\d{4}-\d{2}-\d{2})/", 1), "yyyy-MM-dd")) if day is None else None
    if files is None:
        return whole_files(spark, f"{root.rstrip('/')}/{day.isoformat()}", "*.json")
    last = files.agg(F.max("__day")).scalar()
    return files.filter(F.col("__day") == last).drop("__day")


def location(value: Column, source: Column, requirements: Column) -> Column:
    """Without what follows a deadline mark; one source states its address among the requirements."""
    plain = text.strip(F.regexp_replace(value, LOCATION_TAIL, ""))
    stated = text.collapse(F.get(F.split(F.regexp_extract(requirements, r"(?U)근무지(?:\s*주소)?\s*[:：]\s*([^\nㆍ]+)", 1), ADDRESS_END), 0))
    return F.when((source == "jobkorea") & (stated != ""), stated).otherwise(plain)


def date_in(value: Column, year: int) -> Column:
    """The first full date of a text, else a month and day after a tilde in the given year."""
    part = lambda pattern, k: F.lpad(F.regexp_extract(value, pattern, k), 2, "0")
    full, short = r"(?U)(20\d{2})[.\-/년\s]+(\d{1,2})[.\-/월\s]+(\d{1,2})", r"(?U)~\s*(\d{1,2})/(\d{1,2})"
    whole = F.concat_ws("-", F.regexp_extract(value, full, 1), part(full, 2), part(full, 3))
    near = F.concat_ws("-", F.lit(str(year)), part(short, 1), part(short, 2))
    return F.when(value.rlike(full), F.try_to_date(whole, "yyyy-MM-dd")).when(value.rlike(short), F.try_to_date(near, "yyyy-MM-dd"))


def deadline(value: Column, requirements: Column, year: int) -> Column:
    """A date of the deadline or of the requirements, else the deadline as given."""
    found = F.coalesce(date_in(value, year), date_in(requirements, year))
    return F.coalesce(F.date_format(found, "yyyy-MM-dd"), F.nullif(value, F.lit("")))


def moment(value: Column, fallback: Column) -> Column:
    """An ISO time, without a zone in UTC, else the fallback."""
    return F.coalesce(F.try_to_timestamp(F.nullif(text.collapse(value), F.lit(""))), fallback)


def source_of(url: Column) -> Column:
    """A known source in the URL's host, or the host's first label."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.coalesce(*[F.when(host.contains(s), s) for s in KNOWN_SOURCES], F.substring_index(host, ".", 1))


def id_of(url: Column) -> Column:
    """The last step of the URL's path."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def _documents(files: DataFrame) -> DataFrame:
    """Files with ``error`` or the list of their postings."""
    body, good = F.col("body"), F.try_parse_json(F.col("body"))
    listed = elements(F.get_json_object(body, "$.postings"))
    error = F.when(good.isNull(), ERRORS[0]).when(~F.ltrim(body).startswith("{"), ERRORS[1]).when(listed.isNull(), ERRORS[2])
    return files.select("file", "body", listed.alias("postings"), error.alias("error"))


def import_captures(files: DataFrame, year: int, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Candidates in order of file and place, first of each source and id; and (file, message, blocking) of what was left out.

    An error anywhere in a file leaves out the file, no other.
    """
    documents = _documents(files)
    scalar = lambda record, name: F.coalesce(text.collapse(field(record, name)), F.lit(""))
    rows = documents.filter("error IS NULL").select("file", scalar(F.col("body"), "source_id").alias("of"), field(F.col("body"), "captured_at").alias("when"), F.posexplode("postings").alias("at", "record"))
    r = F.col("record")
    url = scalar(r, "source_url")
    source = F.coalesce(F.nullif(scalar(r, "source_id"), F.lit("")), F.nullif(F.col("of"), F.lit("")), source_of(url))
    keys = F.filter(F.json_object_keys(r), lambda k: k.rlike(SENSITIVE_KEY))
    wrong = (
        F.when(~r.startswith("{"), ERRORS[3]).when(F.size(keys) > 0, ERRORS[4]).when(r.rlike(CREDENTIAL), ERRORS[5])
        .when((source == "") | (url == "") | (scalar(r, "title") == "") | (scalar(r, "company") == ""), ERRORS[6])
    )
    req = scalar(r, "requirements")
    skills = F.coalesce(F.filter(F.transform(elements(field(r, "skills")), lambda x: text.collapse(F.coalesce(F.try_variant_get(F.try_parse_json(x), "$", "string"), x))), lambda x: x != ""), F.array().cast("array<string>"))
    lines = matching.requirement_lines(req)
    unique = matching.ordered_distinct
    about = unique(F.slice(matching.section_lines(req, HEADINGS["company"]), 1, 3))
    raw = raw_struct(
        required_qualifications=unique(F.concat(skills, matching.known_terms(req, TERMS), lines)), preferred_qualifications=unique(matching.section_lines(req, HEADINGS["preferred"])),
        responsibilities=unique(matching.section_lines(req, HEADINGS["duties"])), company_info=F.when(F.size(about) > 0, about).otherwise(F.array(scalar(r, "company"))),
        experience_tags=unique(F.filter(F.concat(skills, lines), lambda x: x.contains("경력") | x.contains("신입"))), manual_review_flags=F.when((source == "saramin") & (req == ""), F.array(F.lit(OCR_FLAG))).otherwise(F.array().cast("array<string>")),
    )
    made = rows.select(
        "file", "at", wrong.alias("error"), source.alias("source_id"), url.alias("source_url"), F.coalesce(F.nullif(scalar(r, "source_posting_id"), F.lit("")), id_of(url)).alias("source_posting_id"), scalar(r, "title").alias("title"),
        scalar(r, "company").alias("company"), location(scalar(r, "location"), source, req).alias("location"), deadline(scalar(r, "deadline"), req, year).alias("deadline_raw"),
        moment(field(r, "captured_at"), moment(F.col("when"), F.lit(now))).alias("collected_at"), raw.alias("raw_jd"),
    )
    bad = made.groupBy("file").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("at"))).alias("error")).filter("error IS NOT NULL")
    clean = made.join(bad.select("file"), "file", "left_anti").drop("error")
    key = F.struct("source_id", F.coalesce(F.nullif("source_posting_id", F.lit("")), "source_url"))
    placed = clean.withColumn("__first", F.row_number().over(Window.partitionBy(key).orderBy("file", "at")))
    candidates = placed.filter("__first = 1").drop("__first")
    twice = placed.filter("__first > 1").select("file", F.concat(F.lit("duplicate posting "), "source_id", F.lit(":"), F.coalesce(F.nullif("source_posting_id", F.lit("")), "source_url")).alias("message"), F.lit(False).alias("blocking"))
    empty = documents.filter("error IS NULL AND size(postings) = 0").select("file", F.lit("empty postings").alias("message"), F.lit(False).alias("blocking"))
    errors = documents.filter("error IS NOT NULL").select("file", F.col("error").alias("message"), F.lit(True).alias("blocking")).union(bad.select("file", F.col("error"), F.lit(True)))
    return candidates, errors.union(empty).union(twice)


def privacy_findings(candidates: DataFrame) -> DataFrame:
    """(category, source_id, source_posting_id, message): credentials fail, contacts warn."""
    whole = F.concat_ws(" ", "title", "company", "location", "raw_jd.required_qualifications", "raw_jd.preferred_qualifications", "raw_jd.responsibilities", "raw_jd.company_info")
    one = lambda test, category, message: candidates.filter(test).select(F.lit(category).alias("category"), "source_id", "source_posting_id", F.lit(message).alias("message"))
    return one(whole.rlike(CREDENTIAL), "fail", "credential/session/auth-like value detected in imported posting text").union(one(whole.rlike(CONTACT), "warning", "public JD contact email/phone detected; keep as warning/manual review or redact by policy"))


def quality_gate(candidates: DataFrame, problems: DataFrame) -> DataFrame:
    """One row: status, candidates, sources, counts of findings; failures outrank manual review, that outranks warnings."""
    found = problems.agg(F.count_if("blocking").alias("failures"), F.count_if(~F.col("blocking")).alias("warnings"))
    private = privacy_findings(candidates).agg(F.count_if(F.col("category") == "fail").alias("private_failures"), F.count_if(F.col("category") == "warning").alias("private_warnings"))
    counts = candidates.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.size("raw_jd.manual_review_flags") > 0).alias("manual_items"), F.array_sort(F.collect_set("source_id")).alias("sources_attempted"))
    one = counts.crossJoin(F.broadcast(found)).crossJoin(F.broadcast(private))  # three frames of one row
    status = (
        F.when((F.col("failures") > 0) | (F.col("private_failures") > 0), "fail").when(F.col("manual_items") > 0, "manual_review_required")
        .when((F.col("warnings") > 0) | (F.col("private_warnings") > 0), "pass_with_warnings").otherwise("pass")
    )
    return one.select(status.alias("status"), "*")


def without_links(assessed: DataFrame) -> DataFrame:
    """Captured pages are never linked."""
    return assessed.withColumn("source_url", F.lit(""))
