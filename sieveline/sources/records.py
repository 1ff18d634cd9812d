"""Record files as candidates: posting arrays, manual records with field aliases, relevance cases; and the registry of readers.

Readers only declare scans; what a record holds is read as JSON text and taken
apart by built-in functions, so a scalar where a list is usual is no error.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text
from sieveline.operators.candidates import RAW_FIELDS

#: Names under which fields of manual records come, and of the lists that wrap records.
ALIASES = {
    "url": ("source_url", "url", "job_url", "apply_url", "link"), "title": ("title", "job_title", "position", "name"), "company": ("company", "company_name", "organization", "employer"),
    "location": ("location", "address", "workplace"), "deadline": ("deadline", "deadline_raw", "validThrough", "expires_at"), "id": ("source_posting_id", "id", "job_id"), "other_id": ("id", "job_id", "source_posting_id"),
    "required": ("required_qualifications", "requirements", "description", "summary"), "preferred": ("preferred_qualifications", "preferred", "nice_to_have"), "duties": ("responsibilities", "duties", "tasks"),
    "skills": ("skills", "tech_stacks", "tags"), "experience": ("experience_tags", "experience", "career"), "about": ("company_info", "company_description"),
}
WRAPPERS = ("postings", "jobs", "elements", "data", "included")


def whole_files(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """(file, body) of every file under the paths, each as one text."""
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
    found = (reader.option("pathGlobFilter", pattern) if pattern else reader).text(paths)
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))


def elements(value: Column) -> Column:
    """Items of a JSON array as JSON texts; null if it is none."""
    return F.transform(F.try_variant_get(F.try_parse_json(value), "$", "array<variant>"), lambda x: F.to_json(x))


def field(record: Column, name: str) -> Column:
    """A field of a JSON object as text: strings as they are, other values as JSON; null if absent or null."""
    got = F.get_json_object(record, f"$['{name}']")
    return F.when(got != "null", got)


def present(record: Column, names: tuple[str, ...]) -> Column:
    """The first of the fields that is neither absent nor empty."""
    return F.coalesce(*[F.nullif(field(record, n), F.lit("")) for n in names])


def texts(value: Column) -> Column:
    """A value as a list of texts: items of an array, names of objects, a scalar alone; nothing for null."""
    name = lambda x: F.when(x.startswith("{"), F.coalesce(*[F.nullif(F.get_json_object(x, f"$.{n}"), F.lit("")) for n in ("name", "title", "value")])).otherwise(F.coalesce(F.try_variant_get(F.try_parse_json(x), "$", "string"), x))
    listed = F.when(value.startswith("["), elements(value))
    some = F.when(value.isNull() | (value == ""), F.array().cast("array<string>")).when(listed.isNotNull(), F.transform(listed, name)).when(value.startswith("{"), F.array(name(value))).otherwise(F.array(value))
    return F.array_compact(some)


def date_prefix(value: Column) -> Column:
    """The date at the beginning of a text, or else the text; empty is null."""
    return F.when(value != "", F.coalesce(F.nullif(F.regexp_extract(value, r"\A(\d{4}-\d{2}-\d{2})", 1), F.lit("")), value))


def raw_struct(**lists: Column) -> Column:
    """The struct of list fields; those not given are null."""
    return F.struct(*[(lists[f] if f in lists else F.lit(None)).cast("array<string>").alias(f) for f in RAW_FIELDS])


def posting_files(spark: SparkSession, paths: str | list[str], collected_at: dt.datetime) -> DataFrame:
    """Candidates of files that hold an array of postings, in order (``file``, ``at``); a missing location is empty."""
    rows = whole_files(spark, paths).select("file", F.posexplode(elements(F.col("body"))).alias("at", "record"))
    r = F.col("record")
    raw = F.get_json_object(r, "$.raw_jd")
    lists = {f: F.when(field(raw, f).isNotNull(), texts(field(raw, f))) for f in RAW_FIELDS}
    top = {f: F.when(field(r, f).isNotNull(), texts(field(r, f))) for f in ("experience_tags", "manual_review_flags")}
    lists = {f: F.coalesce(c, top[f]) if f in top else c for f, c in lists.items()}
    return rows.select(
        "file", "at", *[field(r, f).alias(f) for f in ("source_id", "source_url", "source_posting_id", "title", "company")], F.coalesce(field(r, "location"), F.lit("")).alias("location"),
        field(r, "deadline").alias("deadline_raw"), F.lit(collected_at).alias("collected_at"), F.when(raw.startswith("{"), raw_struct(**lists)).alias("raw_jd"),
    )


def manual_rows(spark: SparkSession, path: str) -> DataFrame:
    """(at, record) of a CSV file with a header, or a JSON file: an array, an object that wraps one, or one object."""
    if path.lower().endswith(".csv"):
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        return rows.select(F.monotonically_increasing_id().alias("at"), F.to_json(F.struct("*")).alias("record"))
    body = F.col("body")
    wrapped = F.coalesce(elements(body), *[elements(F.get_json_object(body, f"$.{w}")) for w in WRAPPERS], F.array(body))
    return whole_files(spark, path).select(F.posexplode(wrapped).alias("at", "record")).filter(F.col("record").startswith("{"))


def manual_candidates(rows: DataFrame, source_id: str, collected_at: dt.datetime) -> DataFrame:
    """Candidates of manual records: each field by the first of its names that holds something."""
    r = F.col("record")
    get = {k: present(r, names) for k, names in ALIASES.items()}
    lists = {k: texts(get[k]) for k in ("required", "preferred", "duties", "skills", "experience", "about")}
    url = F.coalesce(get["url"], F.concat(F.lit(f"manual://{source_id}/"), F.coalesce(get["other_id"], F.lit("unknown"))))
    raw = raw_struct(
        required_qualifications=F.concat(lists["required"], lists["skills"]), preferred_qualifications=lists["preferred"], responsibilities=F.when(F.size(lists["duties"]) > 0, lists["duties"]).otherwise(lists["required"]),
        company_info=lists["about"], experience_tags=lists["experience"],
    )
    empty = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "at", F.lit(source_id).alias("source_id"), url.alias("source_url"), empty(get["id"]).alias("source_posting_id"), empty(get["title"]).alias("title"), F.coalesce(get["company"], F.lit(source_id)).alias("company"),
        empty(get["location"]).alias("location"), date_prefix(get["deadline"]).alias("deadline_raw"), F.lit(collected_at).alias("collected_at"), raw.alias("raw_jd"),
    )


def context_sections(body: Column, keys: Mapping[str, tuple[str, ...]], slashed: tuple[str, ...]) -> Column:
    """Values of a context document's ``key: a, b`` lines, by field; of several lines of one field the last counts, and slashes separate values of some fields only."""
    lines = F.split(body, r"\r\n|\r|\n")
    out = []
    for name, names in keys.items():
        own = F.filter(lines, lambda x: F.lower(text.strip(F.substring_index(x, ":", 1))).isin(*[n.lower() for n in names]) & x.contains(":"))
        value = F.regexp_replace(F.try_element_at(own, F.lit(-1)), r"(?s)^[^:]*:", "")
        parts = F.split(value, "[,/]" if name in slashed else ",")
        out.append(F.coalesce(F.filter(F.transform(parts, text.strip), lambda x: x != ""), F.array().cast("array<string>")).alias(name))
    return F.struct(*out)


Reader = Callable[[SparkSession, Mapping], DataFrame]


class Registry:
    """Readers by access mode, then by source id, then a general one."""

    def __init__(self, general: Reader | None = None):
        self.by_mode: dict[str, Reader] = {}
        self.by_source: dict[str, Reader] = {}
        self.general = general

    def reader(self, manifest: Mapping) -> Reader:
        found = self.by_mode.get(manifest.get("access_mode", "")) or self.by_source.get(manifest["source_id"]) or self.general
        if found is None:
            raise LookupError(f"no reader for source {manifest['source_id']}")
        return found

    def candidates(self, spark: SparkSession, manifests: list[Mapping]) -> DataFrame:
        """All sources' candidates in the order of the manifests, with ``source_ord``."""
        frames = [self.reader(m)(spark, m).withColumn("source_ord", F.lit(i)) for i, m in enumerate(manifests)]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out
