"""Pages of two further job sites as candidates. What a page says in nested data of unknown shape is found breadth first by an Arrow UDF; all else is built in."""

from __future__ import annotations

import datetime as dt
import html as html_module
import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions import matching, scalars, text
from sieveline.sources import pages
from sieveline.sources.platforms import _candidate, _or, first, is_place, some
from sieveline.sources.records import raw_struct

#: Addresses, headings, patterns and words of the sites.
SARAMIN = "https://www.saramin.co.kr"
DETAIL, OUTER = "/zf_user/jobs/relay/view-detail", "/zf_user/jobs/relay/view"
SARAMIN_SECTIONS = {
    "responsibilities": (("주요업무", "담당업무"), ("자격요건", "지원자격", "우대사항", "마감일 및 근무지", "복지 및 혜택")), "required": (("자격요건", "지원자격"), ("우대사항", "마감일 및 근무지", "복지 및 혜택", "채용절차")),
    "preferred": (("우대사항",), ("마감일 및 근무지", "복지 및 혜택", "채용절차")),
}
SARAMIN_TERMS = ("Python", "FastAPI", "RAG", "LLM", "Redis", "Elasticsearch", "AWS", "Docker", "PyTorch", "TensorFlow")
UNKNOWN_COMPANY, NO_TITLE = "회사명 확인 필요", "채용 공고"
OWN_NAMES = ("saramin", "사람인", "사람인 채용")
NO_COMPANIES = ("", "empty", UNKNOWN_COMPANY, *OWN_NAMES)
TITLE_ENDS = ("서비스 소개", "모집부문 / 상세내용", "사용 기술", "주요업무")
TITLE_LIMIT, SNIPPET_LIMIT, SLUG_LIMIT = 120, 600, 80
COMPANY_KEYS, COMPANY_NAMES, COMPANY_META = ("hiringOrganization", "employer", "organization", "company"), ("companyName", "company_name"), ("og:company", "company", "company_name", "author", "og:site_name")
SARAMIN_EXPERIENCE = r"(신입|경력\s*\d+년\s*이상|경력\s*\d+~\d+년|경력무관)"
ROCKETPUNCH = "https://www.rocketpunch.com"
CARD = r'(?i)(?=<(?:article|li|div)\b(?:[^>]*class="[^"]*(?:listing-card|job-card|job-item|company-list)[^"]*"[^>]*|[^>]*data-index="\d+"[^>]*)>)'
ROCKETPUNCH_TERMS = ("Python", "SQL", "PyTorch", "TensorFlow", "LLM", "RAG", "Kubernetes", "AWS", "FastAPI", "Django", "React", "Node.js", "DataOps", "Fintech", "AI", "Machine Learning", "Backend", "인공지능", "머신러닝", "딥러닝", "데이터", "백엔드")
ROCKETPUNCH_EXPERIENCE = r"(신입|경력\s*\d+년\s*이상|경력\s*\d+~\d+년|경력무관|[0-9]+\+?\s*years?)"
CARD_TITLES = (r'(?s)<p[^>]*class="[^"]*BodyM_Bold[^"]*"[^>]*>(.*?)</p>', r'(?s)<(?:h1|h2|h3|strong)[^>]*class="[^"]*(?:title|job)[^"]*"[^>]*>(.*?)</(?:h1|h2|h3|strong)>', r"(?s)<(?:h1|h2|h3)[^>]*>(.*?)</(?:h1|h2|h3)>", r'(?s)data-title="([^"]+)"')
CARD_COMPANIES = (r'(?s)<p[^>]*class="[^"]*BodyS[^"]*secondary[^"]*"[^>]*>(.*?)</p>', r'(?s)<[^>]*class="[^"]*(?:company|organization|name)[^"]*"[^>]*>(.*?)</[^>]+>', r'(?s)data-company="([^"]+)"')
NOISE = ("job", "jobs", "company", "companies", "apply", "quick apply", "view")
NOISE_START = "we prohibit and reject"
DETAIL_SECTIONS = {
    "responsibilities": (("Responsibilities",), ("Qualifications", "Preferred Qualifications", "Benefits", "Process", "Notes")), "required": (("Qualifications",), ("Preferred Qualifications", "Benefits", "Process", "Notes")),
    "preferred": (("Preferred Qualifications",), ("Benefits", "Process", "Notes")), "team": (("Team Introduction",), ("Responsibilities", "Qualifications", "Preferred Qualifications")),
}


def posting_number(url: Column, listing: bool = False) -> Column:
    """The posting's number in a trusted address: one positive rec_idx, rec_seq absent or 0; a listing's address may hold other fields. Else null."""
    parts = lambda k: F.regexp_extract(url, r"\Ahttps://([^/?#]*)([^?#]*)\?([^#]*)\z", k)
    trusted = (F.lower(parts(1)) == "www.saramin.co.kr") & parts(2).isin(DETAIL, OUTER) & ~url.rlike(r"(?U)\s")
    if not listing:
        good = parts(3).rlike(r"\A(?:rec_idx=[1-9]\d*(?:&rec_seq=0)?|rec_seq=0&rec_idx=[1-9]\d*)\z")
        return F.when(trusted & good, F.regexp_extract(parts(3), r"rec_idx=([1-9]\d*)", 1))
    fields = F.split(parts(3), "&")
    of = lambda name: F.transform(F.filter(fields, lambda f: F.substring_index(f, "=", 1) == name), lambda f: F.regexp_replace(f, "^[^=]*=?", ""))
    ids = of("rec_idx")
    return F.when(trusted & (F.size(ids) == 1) & F.get(ids, 0).rlike(r"\A[1-9]\d*\z") & F.forall(of("rec_seq"), lambda x: x == "0"), F.get(ids, 0))


def saramin_url(number: Column, path: str = DETAIL) -> Column:
    return F.concat(F.lit(f"{SARAMIN}{path}?rec_idx="), number, F.lit("&rec_seq=0"))


def saramin_seeds(urls: DataFrame, path: str = DETAIL, listing: bool = False) -> tuple[DataFrame, DataFrame]:
    """Canonical addresses in order (``at``), each once, and the addresses that are none."""
    made = urls.withColumn("number", posting_number(F.col("url"), listing))
    good = made.filter("number IS NOT NULL").groupBy("number").agg(F.min("at").alias("at")).select("at", saramin_url(F.col("number"), path).alias("url"))
    return good, made.filter("number IS NULL").drop("number")


def saramin_listing(html: Column, keywords: Sequence[str] = ()) -> Column:
    """Detail addresses of a listing's flat objects that name a posting and hold a keyword."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?s)(\{[^{}]*rec_idx[^{}]*\})"), F.lit(1))
    held = F.filter(blocks, lambda b: matching.contains_any(b, keywords)) if keywords else blocks
    number = lambda b: F.regexp_extract(b, r"""["']rec_idx["']\s*:\s*["']?(\d+)""", 1)
    return F.array_distinct(F.transform(F.filter(held, lambda b: number(b) != ""), lambda b: saramin_url(number(b))))


def _breadth_first(body: str, wanted) -> str:
    """What ``wanted`` first finds in the objects of all linked data of a page."""
    for script in re.findall(r"""(?is)<script\b[^>]*type\s*=\s*['"]application/ld\+json['"][^>]*>(.*?)</script>""", body):
        try:
            level = [json.loads(html_module.unescape(script))]
        except ValueError:
            continue
        while level:
            deeper = []
            for value in level:
                if isinstance(value, dict):
                    found = wanted(value)
                    if found:
                        return found
                    deeper += value.values()
                elif isinstance(value, list):
                    deeper += value
            level = deeper
    return ""


def _title_in(value: dict) -> str:
    title = value.get("title")
    return title if isinstance(title, str) and title.strip() else ""


def _company_in(value: dict) -> str:
    named = [value.get(k) for k in COMPANY_KEYS]
    named = [v.get("name") if isinstance(v, dict) else v for v in named] + [value.get(k) for k in COMPANY_NAMES]
    for name in named:
        plain = " ".join(name.split())[:TITLE_LIMIT].rstrip() if isinstance(name, str) else ""
        if plain and plain.casefold() not in OWN_NAMES:
            return plain
    return ""


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("company", T.StringType())]))
def _linked(bodies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({k: [_breadth_first(b or "", f) for b in bodies] for k, f in (("title", _title_in), ("company", _company_in))})


def _bounded(c: Column) -> Column:
    return F.regexp_replace(F.left(text.collapse(c), F.lit(TITLE_LIMIT)), r"(?U)\s+$", "")


def _meta(html: Column, key: str) -> Column:
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<meta\b[^>]*>)"), F.lit(1))
    own = F.filter(tags, lambda t: F.lower(F.trim(F.regexp_extract(t, r"""(?i)\b(?:property|name)\s*=\s*['"]([^'"]+)['"]""", 1))) == key)
    return F.coalesce(F.get(F.transform(own, lambda t: pages.clean(F.regexp_extract(t, r"""(?i)\bcontent\s*=\s*['"]([^'"]*)['"]""", 1))), 0), F.lit(""))


def saramin(found: DataFrame, now: dt.datetime, outer: bool = False) -> DataFrame:
    """Detail pages that have one of their sections; outer pages only with all sections, a title and a company."""
    h = F.col("html")
    headers = F.filter(F.transform(F.regexp_extract_all(h, F.lit(r"""(?is)<p\b[^>]*class\s*=\s*['"][^'"]*\bjob-header__title\b[^'"]*['"][^>]*>(.*?)</p>"""), F.lit(1)), lambda x: _bounded(pages.clean(x))), lambda x: x != "")
    linked = F.when(h.contains("ld+json"), _linked(F.when(h.contains("ld+json"), h)))
    rows = found.select("url", posting_number(F.col("url")).alias("number"), "html", scalars.visible_text(h).alias("t"), headers.alias("headers"), linked.alias("ld"))
    t = F.col("t")
    parts = {k: matching.section(t, *v) for k, v in SARAMIN_SECTIONS.items()}
    before = [F.when(t.contains(m), _bounded(F.substring_index(t, m, 1))) for m in TITLE_ENDS]
    titled = F.coalesce(F.get("headers", 0), F.nullif(_bounded(_meta(h, "og:title")), F.lit("")), F.nullif(_bounded(F.col("ld.title")), F.lit("")), *before, _bounded(t))
    foreign = lambda c: F.when((c != "") & ~F.lower(c).isin(*OWN_NAMES), c)
    in_header = F.get(F.array_compact(F.transform("headers", lambda x: foreign(text.collapse(F.regexp_extract(x, r"^\[([^\]]{1,80})\]", 1))))), 0)
    about = _meta(h, "og:description")
    company = F.coalesce(in_header, F.nullif(F.col("ld.company"), F.lit("")), *[foreign(_bounded(_meta(h, k))) for k in COMPANY_META], F.when(about.contains(" - "), foreign(_bounded(F.substring_index(about, " - ", 1)))), F.lit(UNKNOWN_COMPANY))
    rows = rows.withColumns({"title": F.coalesce(F.nullif(titled, F.lit("")), F.lit(NO_TITLE)), "company": company})
    raw = raw_struct(
        required_qualifications=F.concat(some(parts["required"]), matching.known_terms(t, SARAMIN_TERMS)), preferred_qualifications=some(parts["preferred"]), responsibilities=some(parts["responsibilities"]),
        company_info=F.when(F.col("company") != UNKNOWN_COMPANY, F.array("company")).otherwise(F.array().cast("array<string>")), experience_tags=some(first(t, SARAMIN_EXPERIENCE)),
    )
    filled = [(p != "").cast("int") for p in parts.values()]
    enough = sum(filled[1:], filled[0])
    kept = rows.filter(F.col("number").isNotNull() & (enough >= (3 if outer else 1)))
    if outer:
        kept = kept.filter((F.col("title") != NO_TITLE) & ~F.lower("company").isin(*NO_COMPANIES))
    deadline = first(t, r"(?U)마감일\s*[:：]?\s*(?:~\s*)?(\d{4}년\s*\d{2}월\s*\d{2}일|\d{4}[.-]\d{1,2}[.-]\d{1,2}|채용시)")
    return kept.select(*_candidate(
        "saramin", saramin_url(F.col("number"), OUTER if outer else DETAIL), now, source_posting_id=F.col("number"), title=F.col("title"), company=F.col("company"), location=first(t, r"(?U)근무지\s+-\s*(.+?)(?:복지 및 혜택|채용절차|$)"),
        deadline=_or(deadline), raw=raw,
    ))


def lines_of(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?U)\s{2,}|\n"), lambda x: F.regexp_replace(x, "^[•·\\-–— ]+|[•·\\-–— ]+$", "")), lambda x: x != "")


def is_noise(line: Column) -> Column:
    return F.lower(line).isin(*NOISE) | F.lower(line).startswith(NOISE_START)


def english_deadline(c: Column) -> Column:
    """The day until which one can apply, named in English."""
    pattern = r"You can apply until ([A-Za-z]+) (\d{1,2}), (\d{4})"
    day = F.concat_ws(" ", F.initcap(F.regexp_extract(c, pattern, 1)), F.regexp_extract(c, pattern, 2), F.regexp_extract(c, pattern, 3))
    return F.date_format(F.try_to_date(F.when(c.rlike(pattern), day), "MMMM d yyyy"), "yyyy-MM-dd")


def rocketpunch(listing: DataFrame, now: dt.datetime) -> DataFrame:
    """Cards of listing pages in order (``at``), each from its mark to the next; cards without an id get one by place and name."""
    cut = listing.select("url", F.posexplode(F.split("html", CARD)).alias("at", "b")).filter(F.col("at") > 0)
    body, b = scalars.visible_text(F.col("b")), F.col("b")
    tagged = lambda patterns: F.coalesce(*[F.nullif(pages.clean(F.regexp_extract(b, p, 1)), F.lit("")) for p in patterns])
    plain = lines_of(body)
    title = F.coalesce(tagged(CARD_TITLES), F.get(F.filter(plain, lambda x: ~is_noise(x) & ~is_place(x)), 0), F.lit(""))
    rows = cut.withColumns({"t": body, "title": title, "lines": plain}).filter("title <> ''")
    spot = F.array_position("lines", F.col("title"))
    above = F.when(spot > 1, F.get("lines", (spot - 2).cast("int")))
    company = F.coalesce(tagged(CARD_COMPANIES), F.when(~is_noise(above), above), F.lit(""))
    rows = rows.withColumn("company", company)
    useful = F.filter("lines", lambda x: ~F.lower(x).isin("quick apply", "apply", "view") & (F.lower(x) != F.col("title")) & (F.lower(x) != F.col("company")) & ~is_noise(x))
    snippet = F.left(F.array_join(F.slice(useful, 1, 6), " "), F.lit(SNIPPET_LIMIT))
    slug = F.left(F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("-", "company", "title")), "[^a-z0-9가-힣]+", "-"), "^-+|-+$", ""), F.lit(SLUG_LIMIT))
    number = _or(F.regexp_extract(b, r'href="/en/jobs/(\d+)(?:\?[^"]*)?"', 1), F.regexp_extract(b, r"selectedJobId=(\d+)", 1))
    made_up = F.concat(F.lit("listing-"), F.col("at").cast("string"), F.lit("-"), F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown")))
    direct = F.regexp_extract(b, r'href="((?:https?://[^"]+)?/en/jobs/\d+(?:\?[^"]*)?)"', 1)
    url = F.when(direct != "", pages.absolute(F.col("url"), direct)).when(number.isNull(), F.col("url")).otherwise(pages.absolute(F.col("url"), F.concat(F.lit("/en/jobs?selectedJobId="), number)))
    terms = matching.known_terms(F.col("t"), ROCKETPUNCH_TERMS)
    place = F.coalesce(F.get(F.filter("lines", is_place), 0), F.lit(""))
    raw = raw_struct(
        required_qualifications=F.when(F.size(terms) > 0, terms).otherwise(F.array(snippet)), preferred_qualifications=F.array().cast("array<string>"), responsibilities=F.array(_or(snippet, F.col("title"))), company_info=some(F.col("company")),
        experience_tags=some(first(F.col("t"), ROCKETPUNCH_EXPERIENCE)),
    )
    return rows.select("at", *_candidate("rocketpunch", url, now, source_posting_id=F.coalesce(number, made_up), title=F.col("title"), company=_or(F.col("company"), "rocketpunch"), location=place, deadline=F.lit(None).cast("string"), raw=raw))


def rocketpunch_details(cards: DataFrame, details: DataFrame, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """Cards with what their landed detail pages add, and (source_url, code) of cards whose page cannot be trusted or is not there.

    Only the first ``most`` cards with a detail address are looked up: the budget is the collector's.
    """
    direct = F.col("source_url").rlike(r"^https?://(www\.)?rocketpunch\.com/en/jobs/\d+/?(\?.*)?$")
    seen = details.select(F.col("url").alias("__url"), scalars.visible_text(F.col("html")).alias("__t"))
    wanted = cards.filter(direct).orderBy("at").limit(most).select(F.col("at").alias("__at"))
    both = cards.join(seen, F.col("source_url") == F.col("__url"), "left").join(wanted, F.col("at") == F.col("__at"), "left")
    t, title = F.col("__t"), F.col("title")
    marker = F.concat(F.lit("List "), title)
    start = F.when(t.contains(marker), F.call_function("position", marker, t)).when(t.contains(title), F.length(t) - F.call_function("position", F.reverse(title), F.reverse(t)) - F.length(title) + 2)
    detail = F.when(F.col("__at").isNotNull(), F.substr(t, start, F.length(t)))
    both = both.withColumn("__d", detail)
    d, has = F.col("__d"), F.col("__d").isNotNull()
    parts = {k: F.coalesce(matching.section(d, *v), F.lit("")) for k, v in DETAIL_SECTIONS.items()}
    old = lambda f: F.col(f"raw_jd.{f}")
    put = lambda part, f, new=None: F.when(parts[part] != "", F.array(parts[part]) if new is None else new).otherwise(old(f))
    tag = F.coalesce(first(d, ROCKETPUNCH_EXPERIENCE), F.lit(""))
    raw = raw_struct(
        responsibilities=put("responsibilities", "responsibilities"), preferred_qualifications=put("preferred", "preferred_qualifications"), company_info=put("team", "company_info"),
        required_qualifications=put("required", "required_qualifications", F.concat(F.array(parts["required"]), matching.known_terms(parts["required"], ROCKETPUNCH_TERMS))),
        experience_tags=F.when(tag != "", F.array(tag)).otherwise(old("experience_tags")), manual_review_flags=old("manual_review_flags"),
    )
    out = both.select(*[c for c in cards.columns if c not in ("raw_jd", "deadline_raw")], F.coalesce(english_deadline(d), "deadline_raw").alias("deadline_raw"), F.when(has, raw).otherwise(F.col("raw_jd")).alias("raw_jd"))
    code = F.when(~direct, "detail_url_invalid").when(F.col("__at").isNotNull() & F.col("__url").isNull(), "detail_fetch_failed").when(~has, "detail_unverified")
    return out, both.select("source_url", code.alias("code")).filter("code IS NOT NULL")
