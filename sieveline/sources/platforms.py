"""Pages of single job sites as candidates: what each site's markup says where. Projections over landed pages(url, html)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import matching, scalars, text
from sieveline.sources import pages
from sieveline.sources.records import date_prefix, elements, field, raw_struct

#: Headings, patterns and words of the sites.
WANTED_SECTIONS = {
    "responsibilities": (("주요업무",), ("자격요건", "우대사항", "혜택 및 복지", "기술 스택", "마감일")), "required": (("자격요건",), ("우대사항", "혜택 및 복지", "기술 스택", "마감일", "근무지역")),
    "preferred": (("우대사항",), ("혜택 및 복지", "기술 스택", "마감일", "근무지역")),
}
WANTED_LOCATION = r"(?s)근무지역\s+(.+?)(?:\s+[가-힣A-Za-z0-9()]+기업소개|본 채용정보|지원하기|$)"
WANTED_DEADLINE = r"마감일\s+(\d{4}[.-]\d{1,2}[.-]\d{1,2}|상시|채용시)"
WANTED_EXPERIENCE = r"(신입-경력\s*\d+년|경력\s*\d+-\d+년|경력\s*\d+년\s*이상|경력 무관|신입)"
WANTED_TITLE = r"경력\s*[\d무관신입~\\\- ]+년?\s+(.+?)\s+합격보상"
WANTED_TERMS = ("Python", "FastAPI", "RAG", "LLM", "Git", "MySQL", "JSON", "Excel", "PostgreSQL", "SQLite", "Selenium", "Playwright")
RALLIT_SECTIONS = {
    "responsibilities": (("주요업무", "합류하면 하게 될 업무", "어떤 일을 하나요?"), ("자격요건", "지원자격", "우대사항", "혜택 및 복지")), "required": (("자격요건", "지원자격"), ("우대사항", "혜택 및 복지", "채용 절차")),
    "preferred": (("우대사항",), ("혜택 및 복지", "채용 절차")), "company": (("어떤 곳인가요?",), ("어떤 일을 하나요?", "합류하면 하게 될 업무", "주요업무")), "experience": (("경력",), ("최소 연봉", "마감일", "회사명")),
}
RALLIT_STOPS = ("비슷한 채용 공고", "새 로그 작성", "기업 서비스", "©Rallit")
RALLIT_TERMS = ("Python", "SQL", "PyTorch", "TensorFlow", "LLM", "인공지능", "머신러닝", "딥러닝")
RALLIT_LOCATION = r"근무\s*지역\s+(.{1,100}?)(?:\s+\S+\s+경력|\s+경력|\s+최소 연봉|\s+마감일|\s+회사명)"
JOBKOREA_SECTIONS = {
    "responsibilities": (("이런 업무를 해요", "주요업무", "담당업무"), ("이런 분들을 찾고 있어요", "자격요건", "지원자격", "우대사항", "근무지", "근무조건")),
    "required_qualifications": (("이런 분들을 찾고 있어요", "자격요건", "지원자격"), ("우대사항", "이런 분이면 더 좋아요", "근무지", "근무조건", "복리후생")),
    "preferred_qualifications": (("우대사항", "이런 분이면 더 좋아요"), ("근무지", "근무조건", "복리후생", "접수기간", "마감일")),
}
CITIES = ("서울", "경기", "인천", "부산", "대전", "대구", "광주", "울산", "세종", "Remote", "Seoul", "remote")


def first(value: Column, pattern: str) -> Column:
    """The first group of the first match, trimmed; empty without one."""
    return text.strip(F.regexp_extract(value, pattern, 1))


def some(*values: Column) -> Column:
    """Those of the values that are not empty, as a list."""
    return F.filter(F.array(*values), lambda x: x.isNotNull() & (x != ""))


def meta_property(html: Column, name: str) -> Column:
    """Content of a meta tag whose property comes first and its content next."""
    return text.strip(text.unescape(F.regexp_extract(html, rf"""(?i)<meta\s+property="{name}"\s+content="([^"]*)\"""", 1)))


def is_place(tag: Column) -> Column:
    found = F.lit(False)
    for city in CITIES:
        found = found | tag.contains(city)
    return found


def is_experience(tag: Column) -> Column:
    return tag.contains("경력") | tag.contains("신입")


def is_other(tag: Column) -> Column:
    """Whether a tag names a place, experience, or pay, and so no skill."""
    return is_place(tag) | is_experience(tag) | tag.contains("년↑") | tag.contains("만원")


def _or(*values: Column | str) -> Column:
    """The first value that is not empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) if isinstance(v, Column) else F.lit(v) for v in values])


def _candidate(source: str, url: Column, now: dt.datetime, **got) -> list[Column]:
    plain = lambda k, default="": got.get(k, F.lit(default)).alias(k)
    return [F.lit(source).alias("source_id"), url.alias("source_url"), plain("source_posting_id"), plain("title"), plain("company"), plain("location"), got["deadline"].alias("deadline_raw"), F.lit(now).alias("collected_at"), got["raw"].alias("raw_jd")]


def wanted(found: DataFrame, now: dt.datetime) -> DataFrame:
    """Detail pages that have one of their sections."""
    rows = found.select("url", meta_property(F.col("html"), "og:title").alias("og"), scalars.visible_text(F.col("html")).alias("t"))
    t, og = F.col("t"), F.col("og")
    parts = {k: matching.section(t, *v) for k, v in WANTED_SECTIONS.items()}
    titled = og.contains("] ") & og.contains(" 채용 공고")
    title = F.when(titled, text.strip(F.regexp_extract(og, r"(?s)^.*?\] (.*?)(?: 채용 공고|$)", 1))).otherwise(_or(first(t, WANTED_TITLE), text.strip(F.substring_index(og, "|", 1)), ""))
    company = F.coalesce(_or(first(og, r"^\[([^\]]+)\]"), first(t, r"기업 서비스\s+([^∙]+)∙")), F.lit(""))
    raw = raw_struct(
        required_qualifications=F.concat(some(parts["required"]), matching.known_terms(t, WANTED_TERMS)), preferred_qualifications=some(parts["preferred"]), responsibilities=some(parts["responsibilities"]),
        company_info=some(company), experience_tags=some(first(t, WANTED_EXPERIENCE)),
    )
    kept = rows.filter((parts["responsibilities"] != "") | (parts["required"] != "") | (parts["preferred"] != ""))
    return kept.select(*_candidate("wanted", F.col("url"), now, source_posting_id=_or(first(F.col("url"), r"/wd/(\d+)")), title=title, company=_or(company, "wanted"), location=first(t, WANTED_LOCATION), deadline=_or(first(t, WANTED_DEADLINE)), raw=raw))


def wanted_listing(html: Column, keywords: Sequence[str] = ()) -> Column:
    """Detail addresses of a listing's flat objects with a number for id, that hold a keyword."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?s)(\{[^{}]*"id"\s*:\s*\d+[^{}]*\})'), F.lit(1))
    held = F.filter(blocks, lambda b: matching.contains_any(b, keywords)) if keywords else blocks
    return F.array_distinct(F.transform(held, lambda b: F.concat(F.lit("https://www.wanted.co.kr/wd/"), F.regexp_extract(b, r'"id"\s*:\s*(\d+)', 1))))


def wanted_search(body: Column) -> Column:
    """Detail addresses of a search answer's items with a plain number for id."""
    ids = F.transform(elements(F.get_json_object(body, "$.data")), lambda x: F.when(x.startswith("{"), field(x, "id")))
    return F.coalesce(F.array_distinct(F.transform(F.filter(ids, lambda i: i.rlike(r"^[0-9]+$")), lambda i: F.concat(F.lit("https://www.wanted.co.kr/wd/"), i))), F.array().cast("array<string>"))


def json_text(value: Column) -> Column:
    """A JSON string's inside decoded, or else with its common entities decoded."""
    made = F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), value, F.lit('"'))), "$", "string")
    return text.strip(F.coalesce(made, pages.clean(value)))


def state_text(html: Column, name: str, after: str = "") -> Column:
    """A string field of a page's embedded state, where quotes are escaped or not."""
    escaped = F.regexp_extract(html, rf'\\"{name}\\"\s*:\s*\\"((?:\\\\.|[^\\"])*)\\"' + (rf'\s*,\s*\\"{after}\\"' if after else ""), 1)
    raw = F.regexp_extract(html, rf'"{name}"\s*:\s*"((?:\\.|[^"\\])*)"' + (rf'\s*,\s*"{after}"' if after else ""), 1)
    return json_text(F.coalesce(F.nullif(escaped, F.lit("")), raw))


def state_number(html: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf'\\?"{name}\\?"\s*:\s*(\d+)', 1), F.lit("")).cast("int")


def state_flag(html: Column, name: str) -> Column:
    return F.regexp_extract(html, rf'\\?"{name}\\?"\s*:\s*(true|false)', 1) == "true"


def state_texts(html: Column, name: str) -> Column:
    """All values of a string field, each once: those with escaped quotes first."""
    both = F.concat(F.regexp_extract_all(html, F.lit(rf'\\"{name}\\"\s*:\s*\\"((?:\\\\.|[^\\"])*)\\"'), F.lit(1)), F.regexp_extract_all(html, F.lit(rf'"{name}"\s*:\s*"((?:\\.|[^"\\])*)"'), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(both, json_text), lambda x: x != ""))


def jumpit(found: DataFrame, now: dt.datetime) -> DataFrame:
    """Position pages by their embedded state."""
    h, url = F.col("html"), F.col("url")
    say = lambda name: state_text(h, name)
    about = meta_property(h, "og:description")
    company = _or(say("companyName"), F.when(about.contains(" - "), text.strip(F.substring_index(about, " - ", 1))), "jumpit")
    career = state_number(h, "minCareer")
    raw = raw_struct(
        required_qualifications=F.concat(F.array(say("qualifications")), state_texts(h, "stack")), preferred_qualifications=F.array(say("preferredRequirements")), responsibilities=F.array(say("responsibility")), company_info=F.array(say("serviceInfo")),
        experience_tags=F.array_compact(F.array(F.when(state_flag(h, "newcomer"), "신입"), F.when(career.isNotNull(), F.concat(F.lit("경력"), career.cast("string"), F.lit("년↑"))))),
    )
    title = _or(state_text(h, "title", "companyName"), F.replace(meta_property(h, "og:title"), F.lit("점핏 | "), F.lit("")), "")
    posting = F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)
    return found.select(*_candidate("jumpit", url, now, source_posting_id=posting, title=title, company=company, location=say("location"), deadline=date_prefix(say("closedAt")), raw=raw))


def rallit(found: DataFrame, now: dt.datetime) -> DataFrame:
    """Position pages by the text before what follows every posting."""
    t = scalars.visible_text(F.col("html"))
    stop = F.array_min(F.array_compact(F.array(*[F.nullif(F.locate(m, t), F.lit(0)) for m in RALLIT_STOPS])))
    main = F.when(stop.isNotNull(), text.strip(F.substr(t, F.lit(1), stop - 1))).otherwise(t)
    heading = scalars.without_tags(F.regexp_extract(F.col("html"), r"(?s)<h1[^>]*>(.*?)</h1>", 1))
    rows = found.select("url", meta_property(F.col("html"), "og:title").alias("og"), heading.alias("h1"), main.alias("t"))
    t, og, url = F.col("t"), F.col("og"), F.col("url")
    parts = {k: matching.section(t, *v) for k, v in RALLIT_SECTIONS.items()}
    short = text.strip(F.regexp_replace(F.regexp_replace(og, r"(?U)\s+채용\s+-\s+랠릿$", ""), r"(?U)^.+?\s+(\[.+)$", "$1"))
    title = F.when(og != "", short).otherwise(_or(F.col("h1"), first(t, r"(?U)#\s+(.+?)\s+(?:코드 리뷰|주요업무|.+어떤 곳인가요\?)"), ""))
    company = _or(first(t, r"(?U)회사명\s+(.{1,80}?)\s+(?:\d+\s+)?지원하기"), text.strip(F.substring_index(og, " ", 1)), "rallit")
    tags = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.substring_index(t, "주요업무", 1), F.lit(r"(?U)#\s*([^#]+?)(?=\s*#|\s+주요업무|\s+자격요건|\s+우대사항|$)"), F.lit(1)), text.strip), lambda x: x != ""))
    skills = F.when(F.size(tags) > 0, tags).otherwise(matching.known_terms(t, RALLIT_TERMS))
    deadline = F.when(t.rlike(r"(?U)마감일\s+\d{4}[.-]\d{1,2}[.-]\d{1,2}"), F.translate(first(t, r"(?U)마감일\s+(\d{4}[.-]\d{1,2}[.-]\d{1,2})"), ".", "-")).when(t.rlike(r"(?U)마감일\s+채용\s*시\s*마감"), "채용시")
    raw = raw_struct(
        required_qualifications=F.concat(F.array(parts["required"]), skills), preferred_qualifications=F.array(parts["preferred"]), responsibilities=F.array(parts["responsibilities"]), company_info=F.array(parts["company"]), experience_tags=some(parts["experience"]),
    )
    posting = _or(first(url, r"/positions/(\d+)"), F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1))
    return rows.select(*_candidate("rallit", url, now, source_posting_id=posting, title=title, company=company, location=first(t, "(?U)" + RALLIT_LOCATION), deadline=deadline, raw=raw))


def jobkorea_listing(found: DataFrame, now: dt.datetime) -> DataFrame:
    """Items of listing fragments in order (``at``): those with a link and a title."""
    blocks = F.slice(F.split("html", r'<li class="recruit-item[^"]*"'), 2, 1 << 30)
    rows = found.select("url", F.posexplode(blocks).alias("at", "b")).filter(F.col("b").rlike('href="/Recruit/GI_Read/[^"]+"') & F.col("b").rlike(r'(?s)<h3 class="title">.*?</h3>'))
    b = F.col("b")
    tags = F.filter(F.transform(F.regexp_extract_all(b, F.lit(r'(?s)<li class="item[^"]*">(.*?)</li>'), F.lit(1)), pages.clean), lambda x: (x != "") & (x != "합격축하금"))
    rows = rows.select("at", "b", tags.alias("tags"), scalars.without_tags(F.regexp_extract(b, r'(?s)<h3 class="title">(.*?)</h3>', 1)).alias("title"))
    url = F.concat(F.lit("https://www.jobkorea.co.kr"), F.substring_index(F.regexp_extract(b, r'href="(/Recruit/GI_Read/[^"]+)"', 1), "?", 1))
    company = first(b, r'data-cname="([^"]+)"')
    skills = F.filter("tags", lambda x: ~is_other(x))
    asks = F.col("title").rlike(r"(?U)경력\s*\d+\s*년")
    raw = raw_struct(
        required_qualifications=skills, preferred_qualifications=skills, responsibilities=F.array("title"), company_info=some(company),
        experience_tags=F.concat(F.filter("tags", is_experience), F.when(asks, F.array("title")).otherwise(F.array().cast("array<string>"))),
    )
    place = F.coalesce(F.get(F.filter("tags", is_place), 0), F.lit(""))
    return rows.select("at", *_candidate("jobkorea", url, now, source_posting_id=F.substring_index(url, "/", -1), title=F.col("title"), company=_or(company, "jobkorea"), location=place, deadline=_or(first(b, r'data-applyclosedt="(\d{4}-\d{2}-\d{2})')), raw=raw))


def jobkorea_details(listed: DataFrame, details: DataFrame, now: dt.datetime, need_body: bool = False) -> tuple[DataFrame, DataFrame]:
    """Listed candidates with what their landed detail pages say, and (source_url, message) of pages that say nothing.

    Visible sections replace the lists; without any, linked data is merged in; without either a candidate stays as listed, or goes if a body is needed.
    """
    strip_marks = lambda c: F.regexp_replace(c, r"^[ :\-–—·\n\t]+|[ :\-–—·\n\t]+$", "")
    t = F.col("t")
    seen = details.select("url", scalars.visible_text(F.col("html")).alias("t"))
    sections = seen.select(F.col("url").alias("__url"), *[strip_marks(matching.section(t, *v)).alias(f"__{k}") for k, v in JOBKOREA_SECTIONS.items()], first(t, r"(?U)근무지\s*주소\s*[:：]?\s*(.+?)(?:\s*지도보기|$)").alias("__place"))
    linked = pages.job_postings(details, "jobkorea", now).groupBy("page_url").agg(F.min_by(F.struct("location", "deadline_raw", "raw_jd", "source_posting_id", "title", "company"), "at").alias("__ld"))
    both = listed.join(sections, F.col("source_url") == F.col("__url"), "left").join(linked, F.col("source_url") == F.col("page_url"), "left")
    has = F.coalesce((F.col("__responsibilities") != "") | (F.col("__required_qualifications") != "") | (F.col("__preferred_qualifications") != ""), F.lit(False))
    ld = F.col("__ld")
    empty = F.array().cast("array<string>")

    def merged(name: str) -> Column:
        own, other = F.coalesce(F.col(f"raw_jd.{name}"), empty), F.coalesce(ld["raw_jd"][name], empty)
        joined = F.array_distinct(F.filter(F.concat(other, own) if name == "responsibilities" else F.concat(own, other), lambda x: text.strip(x) != ""))
        return F.when(F.size(joined) > 0, joined).otherwise(F.col(f"raw_jd.{name}"))

    lists = {f: F.col(f"raw_jd.{f}") for f in ("experience_tags", "manual_review_flags")}
    for name in ("responsibilities", "required_qualifications", "preferred_qualifications", "company_info"):
        own = F.col(f"raw_jd.{name}")
        shown = F.when(F.col(f"__{name}") != "", F.array(f"__{name}")).otherwise(own) if name != "company_info" else own
        lists[name] = F.when(has, shown).when(ld.isNotNull(), merged(name)).otherwise(own)
    place = F.when(has, F.coalesce(F.nullif("__place", F.lit("")), F.nullif("location", F.lit("")), ld["location"], F.lit(""))).otherwise(F.coalesce(F.nullif(ld["location"], F.lit("")), "location"))
    kept = both.filter(has | ld.isNotNull()) if need_body else both
    out = kept.select(
        "source_id", "source_url", F.coalesce(F.nullif("source_posting_id", F.lit("")), ld["source_posting_id"]).alias("source_posting_id"), F.coalesce(F.nullif("title", F.lit("")), ld["title"]).alias("title"),
        F.coalesce(F.nullif("company", F.lit("")), ld["company"]).alias("company"), place.alias("location"), F.coalesce(ld["deadline_raw"], "deadline_raw").alias("deadline_raw"), "collected_at", raw_struct(**lists).alias("raw_jd"),
    )
    return out, both.filter(~has & ld.isNull()).select("source_url", F.lit("detail body sections not found").alias("message"))
