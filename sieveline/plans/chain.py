"""Queries of the whole chain from documents to judged postings, with SQL that states the same rules again.

A document is a posting: its first line the title, later lines the list fields,
a hash of its text the source's posting id, so exact copies are duplicates; its
length chooses one of a few requirement phrases.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from sieveline.functions import matching, scalars, text
from sieveline.operators import candidates, groups, projection, scoring
from sieveline.operators.profile import Profile, Settings

PHRASES = (
    "경력 3년 이상 필수", "학사 이상", "병역 특례 우대", "5년 ~ 7년. 석사 또는 박사", "Bachelor's or higher preferred", "2 years of work, must have", "신입",
    "4 years or more required; preferred", "박사 우대", "1년 ~ 2년", "75년. 6 years", "고등학교 졸업 이상", "",
)
SETTINGS = Settings(Profile(("of the", "in/en"), ("tion", "und der", "la"), ("en", "FR"), 3, ("lorem", "stupid"), ("canary",), "bachelor"), apply=60, hold=40, top_n=50, manual_review_n=20)
RUN_DATE = dt.date(2025, 1, 1)
RUN_ID = "run-1"


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def postings(spark, d):
    """Documents as candidates, with doc_id."""
    lines, n = F.split("text", "\n"), F.coalesce("n_chars", F.lit(0))
    phrase = F.get(F.array(*map(F.lit, PHRASES)), (n % len(PHRASES)).cast("int"))
    day = F.date_format(F.date_add(F.lit(dt.date(2024, 1, 1)), (n % 900).cast("int")), "yyyy-MM-dd")
    raw = {
        "company_info": F.array("source"), "experience_tags": F.array(phrase), "manual_review_flags": F.when(n < 300, F.array(F.lit("short"))),
        "preferred_qualifications": F.slice(lines, 5, 2), "required_qualifications": F.slice(lines, 2, 3), "responsibilities": lines,
    }
    return _t(spark, d, "documents").select(
        "doc_id", F.col("source").alias("source_id"), F.concat(F.lit("https://"), "source", F.lit(".example.com/jobs/"), F.col("doc_id").cast("string")).alias("source_url"),
        F.left(F.sha2("text", 256), F.lit(16)).alias("source_posting_id"), F.get(lines, 0).alias("title"), F.col("source").alias("company"), F.col("lang").alias("location"),
        F.when(F.col("lang").isNull(), "not listed").otherwise(day).alias("deadline_raw"), F.lit(dt.datetime(2025, 1, 1)).cast("timestamp").alias("collected_at"),
        F.struct(*[v.alias(k) for k, v in raw.items()]).alias("raw_jd"),
    )


def _accepted(spark, d):
    done = candidates.normalized(postings(spark, d))
    return candidates.snapshots(done.filter("reject_code IS NULL"))


def _assessed(spark, d):
    return scoring.assess(_accepted(spark, d), SETTINGS, RUN_DATE)


def _judged(spark, d):
    """Survivors, assessed, with keys."""
    kept = candidates.survivors(_accepted(spark, d))
    return scoring.assess(kept, SETTINGS, RUN_DATE).withColumn("recommendation_id", candidates.recommendation_id(candidates.own_basis(), RUN_ID))


def p01_decode(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.decode(F.col("text")).alias("decoded"))


def p03_normalize_list(spark, d):
    found = _t(spark, d, "documents").select("doc_id", scalars.normalize_list(F.split("text", "\n")).alias("items"))
    return found.select("doc_id", F.size("items").alias("n"), F.array_join("items", "|").alias("items"))


def p09_normalized(spark, d):
    """Rejects and the counts of changed and emptied fields."""
    return candidates.normalized(postings(spark, d)).select("doc_id", "title", "source_url", "reject_code", "changed", "emptied")


def p12_snapshots(spark, d):
    return _accepted(spark, d).select("doc_id", F.col("deadline").cast("string").alias("deadline"), "deadline_uncertain", "detail_quality", F.size("responsibilities").alias("n_responsibilities"), F.size("manual_review_flags").alias("n_flags"))


def p15_minimum_experience(spark, d):
    return _accepted(spark, d).select("doc_id", candidates.minimum_experience(F.col("experience_tags")).alias("years"))


def p59_snapshot_text(spark, d):
    return _accepted(spark, d).select("doc_id", F.length(scoring.snapshot_text()).alias("n"), F.sha2(scoring.snapshot_text(), 256).alias("digest"))


def d01_evidence(spark, d):
    """Every piece of evidence in scan order."""
    found = _assessed(spark, d).select("doc_id", F.posexplode("evidence").alias("requirement_index", "e"))
    return found.select("doc_id", "requirement_index", "e.*")


def d07_eligibility(spark, d):
    found = _assessed(spark, d).select("doc_id", F.explode("eligibility").alias("r"))
    return found.select("doc_id", "r.requirement_index", "r.state", "r.reason_code", "r.claim_provenance")


def d08_experience_gap(spark, d):
    return _assessed(spark, d).select("doc_id", "experience_gap")


def d10_score(spark, d):
    """All numerators, denominators and points, raw and final score."""
    return _assessed(spark, d).select("doc_id", "breakdown.*")


def d11_reason_codes(spark, d):
    return _assessed(spark, d).select("doc_id", F.array_join("reason_codes", ",").alias("reasons"))


def d12_disposition(spark, d):
    return _assessed(spark, d).select("doc_id", "disposition")


def d13_matched_evidence(spark, d):
    return _assessed(spark, d).select("doc_id", F.array_join("matched_evidence", "|").alias("shown"))


def d14_first_score(spark, d):
    return scoring.first_score(_accepted(spark, d), SETTINGS).select("doc_id", "score", "recommendation", "verdict", scoring.movement(F.col("verdict")).alias("movement"), F.array_join("deal_breaker_hits", ",").alias("breakers"))


def d18_keys(spark, d):
    basis = candidates.own_basis()
    return _accepted(spark, d).select("doc_id", basis["kind"].alias("kind"), basis["value"].alias("value"), candidates.posting_key(basis).alias("posting_key"), candidates.recommendation_id(basis, RUN_ID).alias("recommendation_id"))


def a06_survivors(spark, d):
    """How many postings each key has, and the detail of the one kept; copies differ in what the tie-breaker sees of them."""
    return candidates.survivors(_accepted(spark, d)).select("posting_key", "doc_id", "group_size")


def a01_source_metrics(spark, d):
    done = candidates.normalized(postings(spark, d))
    kept = candidates.survivors(candidates.snapshots(done.filter("reject_code IS NULL")))
    attempted = _t(spark, d, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source_id"))
    return candidates.source_metrics(attempted, done, kept).withColumn("error_codes", F.array_join("error_codes", ","))


def a02_disposition_counts(spark, d):
    return projection.summary(_judged(spark, d))


def a04_manual_reasons(spark, d):
    manual = _judged(spark, d).filter("disposition = 'manual_review'")
    return groups.reason_counts(manual, projection.public_reasons(F.col("reason_codes")))


def o01_report(spark, d):
    """The whole queue in report order; its ranks come from counts of the sorted partitions, not from one task."""
    return projection.report_queue(_judged(spark, d), "scheduled-run").select("rank", "posting_key", "final_disposition", "score", "deadline", "title", "company", "location", F.array_join("reason_codes", ",").alias("reasons"), F.array_join("matched_evidence", ",").alias("shown"))


def o02_queues(spark, d):
    """The action and manual queues, each cut at its size."""
    found = projection.queues(_judged(spark, d), SETTINGS)
    return found.select("queue", F.col("place").cast("long").alias("place"), "posting_key", "score")


def o05_top(spark, d):
    """The best 100 by the first scorer's order."""
    found = scoring.first_score(_accepted(spark, d), SETTINGS)
    return found.orderBy(*scoring.first_rank_order(), "doc_id").limit(100).select("doc_id", "score", "title")


def w01_ranks(spark, d):
    found = scoring.first_score(_accepted(spark, d), SETTINGS)
    return found.select("source_id", "doc_id", F.row_number().over(Window.partitionBy("source_id").orderBy(*scoring.first_rank_order(), "doc_id")).cast("long").alias("rank"))


QUERIES = {f.__name__: f for f in (
    p01_decode, p03_normalize_list, p09_normalized, p12_snapshots, p15_minimum_experience, p59_snapshot_text, d01_evidence, d07_eligibility, d08_experience_gap, d10_score,
    d11_reason_codes, d12_disposition, d13_matched_evidence, d14_first_score, d18_keys, a06_survivors, a01_source_metrics, a02_disposition_counts, a04_manual_reasons, o01_report, o02_queues, o05_top, w01_ranks,
)}

# --- SQL ---------------------------------------------------------------------------------------------------------
_WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
_WORD = "[0-9A-Za-z_À-ɏ가-힣]"
_NOT_WORD = "($|[^0-9A-Za-z_À-ɏ가-힣])"
_EDU = {
    "high_school": r"(?:고등학교|high\s*school)(?:\s*(?:졸업|graduate))?", "associate": r"(?:전문(?:학사|대)|associate(?:''s)?|2\s*-?\s*year\s+college)",
    "bachelor": r"(?:학사|대학교(?:\s*졸업)?|bachelor(?:''s)?)", "master": r"(?:석사|master(?:''s)?)", "doctorate": r"(?:박사|ph\.?\s*d\.?|doctorate)",
}
_ANY = "|".join(_EDU.values())
_RANGE = r"(?i)(?:^|[^0-9])([0-9]{1,2})\s*(?:년|years?)\s*(?:~|–|-|to)\s*([0-9]{1,2})\s*(?:년|years?)" + _NOT_WORD
_FROM = r"(?i)(?:^|[^0-9])([0-9]{1,2})\s*(?:년|years?)(?:\s*(?:이상|or\s+more|\+|↑))?" + _NOT_WORD


def _c(x):
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'), ' ')"


def _f(x):
    return _c(f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')")


def _items(x):
    return f"list_filter(list_transform(coalesce({x}, []), lambda x: {_c('nfc_normalize(x)')}), lambda x: x IS NOT NULL AND x <> '')"


_PHRASES = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "]"
_BASE = f"""WITH p0 AS (SELECT *, string_split(text, chr(10)) AS lines, coalesce(n_chars, 0) AS n FROM documents),
p AS (SELECT doc_id, source AS source_id, 'https://' || source || '.example.com/jobs/' || doc_id AS source_url, sha256(text)[1:16] AS source_posting_id, lines[1] AS title0, source AS company0, lang AS location0,
 CASE WHEN lang IS NULL THEN 'not listed' ELSE strftime(DATE '2024-01-01' + CAST(n % 900 AS INTEGER), '%Y-%m-%d') END AS deadline_raw,
 [source] AS info0, [{_PHRASES}[n % {len(PHRASES)} + 1]] AS tags0, CASE WHEN n < 300 THEN ['short'] END AS flags0, lines[5:6] AS pref0, lines[2:4] AS req0, lines AS resp0 FROM p0),
q AS (SELECT *, coalesce({_c("nfc_normalize(title0)")}, '') AS title, coalesce({_c("company0")}, '') AS company, coalesce({_c("location0")}, '') AS location,
 {_items("info0")} AS info, {_items("tags0")} AS tags, coalesce(flags0, []) AS flags, {_items("pref0")} AS pref, {_items("req0")} AS req, {_items("resp0")} AS resp FROM p),
r AS (SELECT *, CASE WHEN source_id IS NULL THEN 'invalid_source_id' WHEN source_url IS NULL THEN 'invalid_source_url' WHEN title = '' OR company = '' THEN 'invalid_candidate' END AS reject_code,
 CAST(title0 IS DISTINCT FROM title AS INT) + CAST(company0 IS DISTINCT FROM company AS INT) + CAST(location0 IS DISTINCT FROM location AS INT) + CAST(tags0 IS DISTINCT FROM tags AS INT)
 + CAST(info0 IS DISTINCT FROM info AS INT) + CAST(pref0 IS NOT NULL AND pref0 IS DISTINCT FROM pref AS INT) + CAST(req0 IS NOT NULL AND req0 IS DISTINCT FROM req AS INT) + CAST(resp0 IS NOT NULL AND resp0 IS DISTINCT FROM resp AS INT) AS changed,
 CAST(coalesce(title0, '') <> '' AND title = '' AS INT) + CAST(len(tags0) > 0 AND len(tags) = 0 AS INT) + CAST(coalesce(len(pref0) > 0 AND len(pref) = 0, false) AS INT) + CAST(coalesce(len(req0) > 0 AND len(req) = 0, false) AS INT)
 + CAST(coalesce(len(resp0) > 0 AND len(resp) = 0, false) AS INT) AS emptied FROM q),
s AS (SELECT *, CASE WHEN regexp_full_match(deadline_raw, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN CAST(deadline_raw AS DATE) END AS deadline FROM r WHERE reject_code IS NULL)"""
_EVIDENCE = f""",
f AS (SELECT doc_id, 0 AS fo, 'title' AS field, [title] AS items FROM s UNION ALL SELECT doc_id, 1, 'required_qualifications', req FROM s UNION ALL SELECT doc_id, 2, 'preferred_qualifications', pref FROM s
 UNION ALL SELECT doc_id, 3, 'responsibilities', resp FROM s UNION ALL SELECT doc_id, 4, 'company_info', info FROM s UNION ALL SELECT doc_id, 5, 'experience_tags', tags FROM s),
i AS (SELECT doc_id, fo, field, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS item_index FROM f),
n AS (SELECT *, regexp_split_to_array(regexp_replace(item, '([.!?。！？]){_WS}', '\\1' || chr(10), 'g'), '[\\r\\n]+') AS parts FROM i),
t AS (SELECT doc_id, fo, field, item_index, {_c("unnest(parts)")} AS text, generate_subscripts(parts, 1) - 1 AS sentence_index FROM n),
u AS (SELECT *, CASE WHEN (field = 'preferred_qualifications' OR regexp_matches(text, '(?i)(우대|preferred|nice\\s+to\\s+have|plus)')) AND regexp_matches(text, '(?i)(필수|required|must|mandatory)') THEN 'ambiguous'
 WHEN field = 'preferred_qualifications' OR regexp_matches(text, '(?i)(우대|preferred|nice\\s+to\\s+have|plus)') THEN 'preferred' ELSE 'mandatory' END AS how,
 len(regexp_extract_all(text, '(?i)(?:{_ANY})')) AS degrees, nullif(regexp_extract(text, '{_RANGE}', 1), '') AS lo, nullif(regexp_extract(text, '{_RANGE}', 2), '') AS hi,
 list_filter(list_transform(regexp_extract_all(text, '{_FROM}', 1), lambda x: CAST(x AS INT)), lambda x: x <= 50) AS ys FROM t WHERE text <> ''),
e AS (SELECT doc_id, fo, item_index, sentence_index, 0 AS ko, 'education' AS kind, CASE WHEN degrees = 1 AND regexp_matches(regexp_extract(text, '(?is)^(.*?)(?:{_ANY})(.*)$', 2), '(?i)^\\s*(이상|또는\\s*이상|or\\s+higher|or\\s+above|minimum){_NOT_WORD}') THEN 'at_least' ELSE 'none' END AS operator,
  CASE WHEN degrees > 1 THEN 'ambiguous' ELSE how END AS modality, field, text FROM u WHERE degrees > 0
 UNION ALL SELECT doc_id, fo, item_index, sentence_index, 1, 'experience', CASE WHEN lo IS NOT NULL THEN 'range' ELSE 'at_least' END, how, field, text FROM u WHERE CASE WHEN lo IS NOT NULL THEN CAST(lo AS INT) <= CAST(hi AS INT) AND CAST(hi AS INT) <= 50 ELSE len(ys) > 0 END
 UNION ALL SELECT doc_id, fo, item_index, sentence_index, 2, 'military_program', 'none', how, field, text FROM u WHERE regexp_matches(text, '(?i)(군필|군\\s*미필|병역\\s*(?:특례|사항|이행|필)|보충역|산업기능요원|전문연구요원|military\\s+(?:service|exemption))')),
ev AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fo, item_index, sentence_index, ko) - 1 AS idx, CASE WHEN kind <> 'military_program' AND modality = 'ambiguous' THEN 'uncertain' ELSE 'high' END AS confidence,
 CAST(coalesce(nullif(regexp_extract(text, '{_RANGE}', 1), ''), nullif(regexp_extract(text, '{_FROM}', 1), '')) AS INT) AS years, lower(regexp_extract(text, '(?i)({_ANY})', 1)) AS alias FROM e),
el AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(alias, '^(?:{v})$') THEN {k}" for k, v in enumerate(_EDU.values(), 1))} END AS lv FROM ev),
ju AS (SELECT *, CASE WHEN kind = 'military_program' THEN 'military_program_review' WHEN modality = 'ambiguous' THEN kind || '_ambiguous' WHEN kind = 'education' THEN CASE WHEN lv <= 3 THEN 'education_match' ELSE 'education_mismatch' END
 WHEN years <= 3 THEN 'experience_match' ELSE 'experience_mismatch' END AS reason FROM el),
jd AS (SELECT *, CASE WHEN ends_with(reason, '_match') THEN 'match' WHEN ends_with(reason, '_mismatch') THEN 'mismatch' ELSE 'review_required' END AS state, CASE WHEN reason LIKE '%match' THEN 'config' ELSE 'none' END AS provenance FROM ju),
g AS (SELECT s.doc_id, coalesce(max(CASE WHEN j.state = 'mismatch' AND j.kind = 'experience' AND j.modality = 'mandatory' AND j.confidence = 'high' THEN greatest(0, j.years - 3) END), 0) AS experience_gap FROM s LEFT JOIN jd j USING (doc_id) GROUP BY s.doc_id),
x AS (SELECT s.doc_id, {", ".join(f"list(DISTINCT j.item_index) FILTER (WHERE j.field = '{n}') AS x_{k}" for k, n in (("req", "required_qualifications"), ("resp", "responsibilities"), ("pref", "preferred_qualifications")))},
 list(j.reason ORDER BY j.idx) FILTER (WHERE j.state = 'mismatch' AND j.modality <> 'preferred') AS mismatches, coalesce(list(DISTINCT j.reason), []) AS reasons FROM s LEFT JOIN jd j USING (doc_id) GROUP BY s.doc_id)"""


def _usable(k):
    return f"list_filter(list_transform(s.{k}, lambda v, i: CASE WHEN list_contains(coalesce(x.x_{k}, []), i - 1) THEN NULL ELSE v END), lambda v: v IS NOT NULL)"


def _hit(v):
    return "(" + " OR ".join(f"contains({_f(v)}, '{w.lower()}')" for w in SETTINGS.profile.skills) + ")"


_ROLE = f"(contains({_f('title')}, 'of the') OR (contains({_f('title')}, 'in') AND contains({_f('title')}, 'en')))"
_PLACE = f"(contains({_f('location')}, 'en') OR contains({_f('location')}, 'fr'))"
_SEARCH = "concat_ws(' ', title, company, location, array_to_string(req, ' '), array_to_string(pref, ' '), array_to_string(resp, ' '), array_to_string(info, ' '), array_to_string(tags, ' '))"
_SCORE = f""",
m AS (SELECT s.*, g.experience_gap, x.mismatches, x.reasons, {", ".join(f"len({_usable(k)}) AS d_{k}, list_filter({_usable(k)}, lambda v: {_hit('v')}) AS m_{k}" for k in ("req", "resp", "pref"))}, CAST({_ROLE} AS INT) AS role, CAST({_PLACE} AS INT) AS place FROM s JOIN g USING (doc_id) JOIN x USING (doc_id)),
w AS (SELECT *, {", ".join(f"CASE WHEN d_{k} > 0 THEN {w}.0 * len(m_{k}) / d_{k} ELSE 0 END AS e_{k}" for k, w in (("req", 40), ("resp", 20), ("pref", 10)))} FROM m),
v AS (SELECT *, CAST(floor(round(e_req + e_resp + 20 * role + e_pref + 10 * place, 9) + 0.5) AS BIGINT) AS raw_score FROM w),
z AS (SELECT *, greatest(0, least(100, raw_score - CASE WHEN experience_gap = 1 THEN 10 ELSE 0 END)) AS score,
 list_distinct(list_filter(list_concat([CASE WHEN deadline < DATE '2025-01-01' THEN 'expired' END, CASE WHEN contains({_f(_SEARCH)}, 'lorem') OR contains({_f(_SEARCH)}, 'stupid') THEN 'dealbreaker' END], coalesce(mismatches, []),
 [CASE WHEN len(flags) > 0 THEN 'manual_flag' END, CASE WHEN list_contains(reasons, 'education_ambiguous') THEN 'education_ambiguous' END, CASE WHEN list_contains(reasons, 'experience_ambiguous') THEN 'experience_ambiguous' END, CASE WHEN list_contains(reasons, 'military_program_review') THEN 'military_program_review' END]), lambda c: c IS NOT NULL)) AS codes FROM v),
l AS (SELECT *, CASE WHEN experience_gap > 0 THEN 'hold' WHEN list_contains(codes, 'expired') THEN 'expired' WHEN list_contains(codes, 'dealbreaker') THEN 'exclude' WHEN list_has_any(codes, ['manual_flag', 'education_ambiguous', 'experience_ambiguous', 'military_program_review']) THEN 'manual_review'
 WHEN score >= 60 THEN 'apply' WHEN score >= 40 THEN 'hold' ELSE 'low_priority' END AS disposition FROM z)"""
_CODE_ORDER = ["expired", "dealbreaker", "MISMATCH", "manual_flag", "education_ambiguous", "experience_ambiguous", "military_program_review"]


def _ordered_codes(codes="codes"):
    """list_distinct loses the order, so it is restored: fixed codes around the mismatches, which keep their first places."""
    fixed = lambda names: ", ".join(f"CASE WHEN list_contains({codes}, '{c}') THEN '{c}' END" for c in names)
    first = "list_filter(list_transform(coalesce(mismatches, []), lambda v, i: CASE WHEN list_position(mismatches, v) = i THEN v END), lambda v: v IS NOT NULL)"
    return f"list_filter(list_concat([{fixed(_CODE_ORDER[:2])}], {first}, [{fixed(_CODE_ORDER[3:])}]), lambda c: c IS NOT NULL)"


def _shown(k, label):
    return f"list_transform(list_filter(m_{k}[1:3], lambda v: NOT regexp_matches(v, '(?i)(군\\s*(?:필|미필|복무|면제)|군대|군사|병역|대체복무|보충역|산업기능요원|전문연구요원|현역|예비역|military|army|veteran)') AND NOT contains({_f('v')}, 'canary')), lambda v: '{label}: ' || v)"


_RATIO = "CASE WHEN len({k}) = 0 THEN 0.5 ELSE CAST(len(list_filter({k}, lambda v: " + " OR ".join(f"contains(lower(v), '{x}')" for x in SETTINGS.profile.skills) + ")) AS DOUBLE) / len({k}) END"
_OLD_ROLE = "(contains(lower(title), 'of the') OR (contains(lower(title), 'of') AND contains(lower(title), 'the')) OR contains(lower(title), 'in/en') OR (contains(lower(title), 'in') AND contains(lower(title), 'en')))"
_OLD_TEXT = "lower(concat_ws(' ', title, company, location, array_to_string(req, ' '), array_to_string(pref, ' '), array_to_string(resp, ' '), array_to_string(info, ' '), array_to_string(flags, ' ')))"
_OLD_TEXT = "lower(array_to_string(list_concat([title, company, location], req, pref, resp, info, flags), ' '))"
_OLD = f""", a AS (SELECT *, 45 * {_RATIO.format(k="req")} + 20 * {_RATIO.format(k="pref")} + 15 * {_RATIO.format(k="resp")} + 10 * {_RATIO.format(k="info")}
 + CASE WHEN contains(lower(location), 'en') OR contains(lower(location), 'fr') THEN 10 ELSE 0 END + CASE WHEN {_OLD_ROLE} THEN 5 ELSE -10 END AS raw, list_filter(['lorem', 'stupid'], lambda b: contains({_OLD_TEXT}, b)) AS breakers FROM s),
b AS (SELECT *, CAST(greatest(0, least(100, round_even(raw, 0))) AS INT) AS score FROM a),
o AS (SELECT *, CASE WHEN len(breakers) > 0 THEN 'low_priority' WHEN score >= 60 THEN 'apply' WHEN score >= 40 THEN 'hold' ELSE 'low_priority' END AS recommendation, CASE WHEN len(breakers) > 0 THEN 'exclude' WHEN score >= 60 THEN 'include' WHEN score >= 40 THEN 'hold' ELSE 'exclude' END AS verdict FROM b) """
_OLD_ORDER = "score DESC, CAST(deadline IS NULL AS INT) DESC, title DESC, doc_id"
_JSON = """'{"kind":"source_posting_id","source_id":"' || source_id || '","value":"' || source_posting_id || '"}'"""
_KEY = f"sha256('posting-v3\\x00'::BLOB || encode({_JSON}))[1:32]"
_SIZES = "(len(req) + len(pref) + len(resp) + len(info) + len(tags))"
_STR = lambda x: f"'\"' || replace(replace({x}, '\\', '\\\\'), '\"', '\\\"') || '\"'"
_LIST = lambda k: f"'[' || array_to_string(list_transform({k}, lambda y: {_STR('y')}), ',') || ']'"
# the canonical candidate, field by field, with the six list fields by name
_BODY = (
    "'{' || " + " || ',' || ".join(f"'\"{n}\":' || coalesce({_STR(c)}, 'null')" for n, c in (("source_id", "source_id"), ("source_url", "source_url"), ("source_posting_id", "source_posting_id"), ("title", "title"), ("company", "company"), ("location", "location"), ("deadline_raw", "deadline_raw")))
    + " || ',\"collected_at\":\"2025-01-01T00:00:00+00:00\",\"raw_structured\":[' || array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {given} IS NOT NULL THEN '[\"{n}\",' || {_LIST(k)} || ']' END" for n, given, k in (("company_info", "info0", "info"), ("experience_tags", "tags0", "tags"), ("manual_review_flags", "flags0", "flags"), ("preferred_qualifications", "pref0", "pref"), ("required_qualifications", "req0", "req"), ("responsibilities", "resp0", "resp")))
    + "], lambda y: y IS NOT NULL), ',') || ']}'"
)
_KEPT = f""", sb AS (SELECT *, {_KEY} AS posting_key, {_BODY} AS body FROM s),
kept AS (SELECT *, count(*) OVER (PARTITION BY posting_key) AS group_size, row_number() OVER (PARTITION BY posting_key ORDER BY CAST(len(flags) > 0 AS INT), CAST(deadline IS NULL AS INT), -{_SIZES}, sha256(body), body) AS place FROM sb) """
_ONLY = ", j AS (SELECT l.*, k.posting_key, k.group_size FROM l JOIN kept k ON k.doc_id = l.doc_id AND k.place = 1) "
_PUBLIC = f"list_transform({{codes}}, lambda c: CASE WHEN c = 'military_program_review' THEN 'manual_flag' ELSE c END)"
_UNSAFE = r"(?i)(\bprivate\b|\bcanary\b|\braw[\s_-]+(?:jd|profile|resume|cv|data|text|source)|\bpersonal\b|ignore\s+previous\s+instructions|system\s+prompt|developer\s+message|access[_ -]?token|session[_ -]?token|military|army|veteran|병역)"


def _safe(c, most, fallback):
    return f"CASE WHEN {c} <> '' AND length({c}) <= {most} AND NOT regexp_matches({c}, '{_UNSAFE}') THEN {c} ELSE '{fallback}' END"


_PUBLIC_ORDERED = f"list_filter(list_concat(list_filter({_ordered_codes()}, lambda c: c IN ('expired', 'dealbreaker')), list_filter({_ordered_codes()}, lambda c: c LIKE '%mismatch'), [CASE WHEN list_contains(codes, 'manual_flag') THEN 'manual_flag' END, CASE WHEN list_contains(codes, 'education_ambiguous') THEN 'education_ambiguous' END, CASE WHEN list_contains(codes, 'experience_ambiguous') THEN 'experience_ambiguous' END, CASE WHEN list_contains(codes, 'military_program_review') AND NOT list_contains(codes, 'manual_flag') THEN 'manual_flag' END]), lambda c: c IS NOT NULL)"
_some = lambda k, label: f"CASE WHEN len(list_filter({_shown(k, label)}, lambda y: length(y) <= 320 AND NOT regexp_matches(y, '{_UNSAFE}'))) > 0"
_CATEGORIES = f"{_some('req', '필수 요건')} THEN '필수 요건 일치' END, {_some('resp', '담당 업무')} THEN '담당 업무 관련성' END, {_some('pref', '우대 요건')} THEN '우대 요건 일치' END, CASE WHEN role = 1 AND length(title) <= 313 AND NOT regexp_matches(title, '{_UNSAFE}') THEN '선호 직무 일치' END, CASE WHEN place = 1 THEN '근무지 조건 일치' END"
_QUEUE_ORDER = "score DESC, CAST(deadline IS NULL AS INT), coalesce(CAST(deadline AS VARCHAR), ''), source_id, source_posting_id"

ORACLES = {
    "p01_decode": "SELECT doc_id, nfc_normalize(text) AS decoded FROM documents",
    "p03_normalize_list": f"SELECT doc_id, len(items) AS n, array_to_string(items, '|') AS items FROM (SELECT doc_id, {_items('string_split(text, chr(10))')} AS items FROM documents)",
    "p09_normalized": _BASE + " SELECT doc_id, title, source_url, reject_code, changed, emptied FROM r",
    "p12_snapshots": _BASE + " SELECT doc_id, CAST(deadline AS VARCHAR) AS deadline, deadline IS NULL AS deadline_uncertain, 'verified' AS detail_quality, len(resp) AS n_responsibilities, len(flags) AS n_flags FROM s",
    "p15_minimum_experience": _BASE + " SELECT doc_id, CASE WHEN len(tags) = 0 OR contains(tags[1], '신입') THEN NULL WHEN regexp_matches(tags[1], '경력\\s*[0-9]+\\s*년') THEN CAST(regexp_extract(tags[1], '경력\\s*([0-9]+)\\s*년', 1) AS INT) WHEN contains(tags[1], '경력') THEN 1 END AS years FROM s",
    "p59_snapshot_text": _BASE + f" SELECT doc_id, length({_OLD_TEXT}) AS n, sha256({_OLD_TEXT}) AS digest FROM s",
    "d01_evidence": _BASE + _EVIDENCE + " SELECT doc_id, idx AS requirement_index, kind, operator, modality, field AS source_field, item_index, sentence_index, text, confidence FROM ev",
    "d07_eligibility": _BASE + _EVIDENCE + " SELECT doc_id, idx AS requirement_index, state, reason AS reason_code, provenance AS claim_provenance FROM jd",
    "d08_experience_gap": _BASE + _EVIDENCE + " SELECT doc_id, experience_gap FROM g",
    "d10_score": _BASE + _EVIDENCE + _SCORE + " SELECT doc_id, " + ", ".join(f"len(m_{k}) AS {n}_numerator, d_{k} AS {n}_denominator, CAST(floor(round(e_{k}, 9) + 0.5) AS BIGINT) AS {n}_score" for k, n in (("req", "required"), ("resp", "responsibilities"), ("pref", "preferred")))
    + ", role AS role_numerator, 1 AS role_denominator, 20 * role AS role_score, place AS location_numerator, 1 AS location_denominator, 10 * place AS location_score, raw_score, score FROM z",
    "d11_reason_codes": _BASE + _EVIDENCE + _SCORE + f" SELECT doc_id, array_to_string({_ordered_codes()}, ',') AS reasons FROM l",
    "d12_disposition": _BASE + _EVIDENCE + _SCORE + " SELECT doc_id, disposition FROM l",
    "d13_matched_evidence": _BASE + _EVIDENCE + _SCORE + f" SELECT doc_id, array_to_string(list_concat({_shown('req', '필수 요건')}, {_shown('resp', '담당 업무')}, {_shown('pref', '우대 요건')}, CASE WHEN role = 1 AND NOT regexp_matches(title, '(?i)(military|army|veteran)') THEN ['선호 직무: ' || title] ELSE [] END, CASE WHEN place = 1 THEN ['근무지: ' || location] ELSE [] END), '|') AS shown FROM l",
    "d14_first_score": _BASE + _OLD + "SELECT doc_id, score, recommendation, verdict, CASE verdict WHEN 'include' THEN 'up' WHEN 'exclude' THEN 'down' ELSE 'same' END AS movement, array_to_string(breakers, ',') AS breakers FROM o",
    "d18_keys": _BASE + f" SELECT doc_id, 'source_posting_id' AS kind, source_posting_id AS value, {_KEY} AS posting_key, sha256('recommendation-v3\\x00'::BLOB || encode('{RUN_ID}') || '\\x00'::BLOB || encode({_JSON}))[1:32] AS recommendation_id FROM s",
    "a06_survivors": _BASE + _KEPT + "SELECT posting_key, doc_id, group_size FROM kept WHERE place = 1",
    "a01_source_metrics": _BASE + _KEPT + """SELECT coalesce(a.source_id, m.source_id) AS source_id, a.source_id IS NOT NULL AS attempted, coalesce(accepted, 0) AS accepted, coalesce(rejected, 0) AS rejected, coalesce(duplicates, 0) AS duplicates, coalesce(changed, 0) AS changed, coalesce(emptied, 0) AS emptied,
 coalesce(verified, 0) AS verified, 0 AS manual_only, CASE WHEN rejected > 0 THEN 'invalid_candidate' ELSE '' END AS error_codes FROM (SELECT 'src' || n_nationkey AS source_id FROM nation) a FULL JOIN (SELECT source_id, count(*) FILTER (WHERE reject_code IS NULL) AS accepted, count(*) FILTER (WHERE reject_code IS NOT NULL) AS rejected,
 sum(changed) FILTER (WHERE reject_code IS NULL) AS changed, sum(emptied) FILTER (WHERE reject_code IS NULL) AS emptied FROM r GROUP BY source_id) m ON a.source_id = m.source_id
 LEFT JOIN (SELECT source_id, sum(group_size - 1) AS duplicates, count(*) AS verified FROM kept WHERE place = 1 GROUP BY source_id) k ON k.source_id = m.source_id""",
    "a02_disposition_counts": _BASE + _EVIDENCE + _SCORE + _KEPT + _ONLY + """SELECT sum(group_size) AS collected, 0 AS source_rejected, sum(group_size) AS source_accepted, sum(group_size - 1) AS duplicates_removed, count(*) AS deduplicated, """
    + ", ".join(f"count(*) FILTER (WHERE disposition = '{k}') AS {n}" for n, k in (("expired", "expired"), ("exclude", "exclude"), ("manual_review_total", "manual_review"), ("apply_total", "apply"), ("hold_total", "hold"), ("low_priority_total", "low_priority"), ("displayed_apply", "apply"), ("displayed_hold", "hold"), ("displayed_manual", "manual_review")))
    + ", count(*) FILTER (WHERE disposition IN ('apply', 'hold')) AS actionable_total, 0 AS suppressed_apply, 0 AS suppressed_hold, 0 AS suppressed_manual FROM j",
    "a04_manual_reasons": _BASE + _EVIDENCE + _SCORE + _KEPT + _ONLY + f"SELECT reason, count(*) AS n FROM (SELECT unnest(list_distinct({_PUBLIC.format(codes='codes')})) AS reason FROM j WHERE disposition = 'manual_review') GROUP BY reason",
    "o01_report": _BASE + _EVIDENCE + _SCORE + _KEPT + _ONLY + f""", pj AS (SELECT *, sha256('recommendation-v3\\x00'::BLOB || encode('{RUN_ID}') || '\\x00'::BLOB || encode({_JSON}))[1:32] AS recommendation_id, CAST(deadline AS VARCHAR) AS day, {_safe("title", 120, "검토 필요 공고")} AS title1, {_safe("company", 80, "확인 필요")} AS company1, {_safe("location", 80, "확인 필요")} AS location1 FROM j)
SELECT row_number() OVER (ORDER BY CASE disposition WHEN 'apply' THEN 0 WHEN 'hold' THEN 1 WHEN 'manual_review' THEN 2 WHEN 'low_priority' THEN 3 WHEN 'exclude' THEN 4 ELSE 5 END, score DESC, day NULLS LAST, recommendation_id, posting_key) AS rank, posting_key, disposition AS final_disposition, score, day AS deadline,
 title1 AS title, company1 AS company, location1 AS location, array_to_string({_PUBLIC_ORDERED}, ',') AS reasons, array_to_string(list_filter([{_CATEGORIES}], lambda y: y IS NOT NULL), ',') AS shown FROM pj""",
    "o02_queues": _BASE + _EVIDENCE + _SCORE + _KEPT + _ONLY + f"""SELECT queue, pos AS place, posting_key, score FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY {_QUEUE_ORDER}) AS pos FROM (SELECT *, CASE WHEN disposition IN ('apply', 'hold') THEN 'action' WHEN disposition = 'manual_review' THEN 'manual' END AS queue FROM j) WHERE queue IS NOT NULL)
 WHERE pos <= CASE WHEN queue = 'action' THEN {SETTINGS.top_n} ELSE {SETTINGS.manual_review_n} END""",
    "o05_top": _BASE + _OLD + f"SELECT doc_id, score, title FROM o ORDER BY {_OLD_ORDER} LIMIT 100",
    "w01_ranks": _BASE + _OLD + f"SELECT source_id, doc_id, row_number() OVER (PARTITION BY source_id ORDER BY {_OLD_ORDER}) AS rank FROM o",
}
