"""Queries of the matching, scoring, ordering and set operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sieveline.functions import matching as m

INCLUDE, EXCLUDE, ROLES = ["data", "license", "the"], ["lorem", "copyright"], ["a/e", "data engineer"]


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def p07_canonical_url(spark, d):
    return _t(spark, d, "pages").select("page_id", m.canonical_url(F.col("url")).alias("canonical"))


def p06_section(spark, d):
    return _t(spark, d, "documents").select("doc_id", m.section(F.col("text"), [". ", "! "], ["? ", "\n"]).alias("section"))


def p31_known_terms(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(m.known_terms(F.col("text"), ["License", "password", "the", "und"]), ",").alias("terms"))


def p32_requirement_lines(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(m.requirement_lines(F.col("text")), "|").alias("lines"))


def p34_ordered_distinct(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(m.ordered_distinct(F.split("text", "\n")), "|").alias("items"))


def p35_truncate(spark, d):
    return _t(spark, d, "documents").select("doc_id", m.truncate(F.col("text"), 120).alias("short"))


def f01_keyword_filter(spark, d):
    return _t(spark, d, "documents").filter(m.keyword_filter(F.col("text"), INCLUDE, EXCLUDE)).select("doc_id")


def f09_role_match(spark, d):
    return _t(spark, d, "documents").select("doc_id", m.role_match(F.col("text"), ROLES).alias("matches"))


def d17_posting_key(spark, d):
    basis = F.struct(F.lit("source_posting_id").alias("kind"), F.coalesce("source", F.lit("")).alias("source_id"), F.col("doc_id").cast("string").alias("value"))
    return _t(spark, d, "documents").select("doc_id", m.hashed_key("posting-v3", basis).alias("posting_key"))


def d09_component_score(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", m.component(40, F.col("l_linenumber") % 4, F.col("l_orderkey") % 4).alias("points"))


def u02_symmetric_difference(spark, d):
    """Sources of documents and a list of sources, those on one side alone."""
    c, o = _t(spark, d, "documents").select(F.col("source").alias("k")).distinct(), _t(spark, d, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("k"))
    return c.join(o, "k", "left_anti").withColumn("side", F.lit("documents")).union(o.join(c, "k", "left_anti").withColumn("side", F.lit("list")))


def j07_orphans(spark, d):
    """Labels and documents against each other: rows of either without the other, which must be none for labels."""
    labels, docs = _t(spark, d, "labels").select("doc_id"), _t(spark, d, "documents").select("doc_id")
    return labels.join(docs, "doc_id", "left_anti").withColumn("side", F.lit("label")).union(docs.join(labels, "doc_id", "left_anti").withColumn("side", F.lit("document")))


def a19_gate_status(spark, d):
    lang, n = F.col("lang"), F.col("n_chars")
    status = F.when(F.bool_or(lang.isNull()), "fail").when(F.bool_or(n < 200), "warning").otherwise("pass")
    return _t(spark, d, "documents").groupBy("source").agg(status.alias("status"))


QUERIES = {f.__name__: f for f in (p07_canonical_url, p06_section, p31_known_terms, p32_requirement_lines, p34_ordered_distinct, p35_truncate, f01_keyword_filter, f09_role_match, d17_posting_key, d09_component_score, u02_symmetric_difference, j07_orphans, a19_gate_status)}

_LOW = "lower(coalesce(text, ''))"
_WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
_FOLD = f"trim(regexp_replace(replace(replace({_LOW}, 'ß', 'ss'), 'ς', 'σ'), '{_WS}', ' ', 'g'), ' ')"
_FLAT = f"trim(regexp_replace(x, '{_WS}', ' ', 'g'), ' ')"


def _cut(x, n):
    return f"CASE WHEN length({x}) > {n} THEN regexp_replace({x}[1:{n} - 1], '{_WS}$', '') || '…' ELSE {x} END"


ORACLES = {
    "p07_canonical_url": rf"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '{m._URL}', 1)) AS host, regexp_extract(url, '{m._URL}', 2) AS port, regexp_extract(url, '{m._URL}', 3) AS path FROM pages),
v AS (SELECT *, coalesce(CAST(nullif(port, '') AS INTEGER), 443) AS n, rtrim(array_to_string(list_transform(string_split(regexp_replace(path, '/+', '/', 'g'), '%'), lambda x, i: CASE WHEN i > 1 THEN upper(x[1:2]) || x[3:] ELSE x END), '%'), '/') AS p FROM u)
SELECT page_id, CASE WHEN length(url) <= 2048 AND NOT regexp_matches(url, '[\s\x0B\x{{85}}\p{{Z}}\x00-\x1f\x7f]') AND NOT contains(regexp_replace(url, '%[0-9a-fA-F]{{2}}', '', 'g'), '%') AND regexp_matches(url, '{m._URL}')
AND regexp_matches(host, '^[\x21-\x7e]{{1,253}}$') AND NOT regexp_matches(host, '(^|\.)(\.|-|$)|-(\.|$)|[^.]{{64}}') AND (NOT regexp_matches(host, '^[0-9]+(\.[0-9]+){{3}}$') OR regexp_matches(host, '{m._OCTETS}'))
AND n BETWEEN 1 AND 65535 AND regexp_matches(path, '^[A-Za-z0-9._~/!$&''()*+,;=:@%-]*$') THEN 'https://' || host || CASE WHEN n = 443 THEN '' ELSE ':' || n END || CASE WHEN p = '' THEN '/' ELSE p END END AS canonical FROM v""",
    "p06_section": f"""WITH a AS (SELECT doc_id, text, least(nullif(instr(text, '. '), 0), nullif(instr(text, '! '), 0)) AS s FROM documents), b AS (SELECT doc_id, text[s + 2:] AS rest FROM a WHERE s IS NOT NULL),
c AS (SELECT doc_id, rest, least(nullif(instr(rest, '? '), 0), nullif(instr(rest, chr(10)), 0)) AS e FROM b)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN rest IS NULL THEN '' ELSE regexp_replace(regexp_replace(CASE WHEN e IS NOT NULL THEN rest[:e - 1] ELSE rest END, '^{_WS}', ''), '{_WS}$', '') END AS section FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id""",
    "p31_known_terms": f"SELECT doc_id, array_to_string(list_filter(['License', 'password', 'the', 'und'], lambda t: contains({_LOW}, lower(t))), ',') AS terms FROM documents",
    "p32_requirement_lines": f"""SELECT doc_id, array_to_string(CASE WHEN len(found) = 0 AND text <> '' THEN [{_cut("text", 240)}] ELSE found END, '|') AS lines FROM (SELECT doc_id, text, list_transform(list_filter(list_transform(regexp_split_to_array(text, '[\\n•ㆍ]+'), lambda x: {_FLAT}), lambda x: x <> '')[1:8], lambda x: {_cut("x", 180)}) AS found FROM documents)""",
    "p34_ordered_distinct": f"SELECT doc_id, array_to_string(list_filter(list_transform(items, lambda x, i: CASE WHEN list_position(items, x) = i THEN x END), lambda x: x IS NOT NULL), '|') AS items FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_FLAT}), lambda x: x <> '') AS items FROM documents)",
    "p35_truncate": f"SELECT doc_id, {_cut("text", 120)} AS short FROM documents",
    "f01_keyword_filter": f"SELECT doc_id FROM documents WHERE NOT ({' OR '.join(f'contains({_LOW}, {w!r})' for w in EXCLUDE)}) AND ({' OR '.join(f'contains({_LOW}, {w!r})' for w in INCLUDE)})",
    "f09_role_match": f"SELECT doc_id, (contains({_FOLD}, 'a/e') OR (contains({_FOLD}, 'a') AND contains({_FOLD}, 'e')) OR contains({_FOLD}, 'data engineer')) AS matches FROM documents",
    "d17_posting_key": "SELECT doc_id, sha256('posting-v3\\x00'::BLOB || encode('{\"kind\":\"source_posting_id\",\"source_id\":\"' || coalesce(source, '') || '\",\"value\":\"' || doc_id || '\"}'))[1:32] AS posting_key FROM documents",
    "d09_component_score": "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_orderkey % 4 > 0 THEN floor((2 * 40 * (l_linenumber % 4) + l_orderkey % 4) / (2.0 * (l_orderkey % 4))) ELSE 0 END AS BIGINT) AS points FROM lineitem",
    "u02_symmetric_difference": "WITH c AS (SELECT DISTINCT source AS k FROM documents), o AS (SELECT 'src' || n_nationkey AS k FROM nation) SELECT k, 'documents' AS side FROM c WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT k, 'list' FROM o WHERE k NOT IN (SELECT k FROM c WHERE k IS NOT NULL)",
    "j07_orphans": "SELECT doc_id, 'label' AS side FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'document' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "a19_gate_status": "SELECT source, CASE WHEN bool_or(lang IS NULL) THEN 'fail' WHEN bool_or(n_chars < 200) THEN 'warning' ELSE 'pass' END AS status FROM documents GROUP BY source",
}
