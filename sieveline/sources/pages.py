"""Landed pages(url, html) as candidates: anchors, linked data, page fields, link filters. Built-in expressions throughout."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import matching, text
from sieveline.sources.records import date_prefix, elements, field, raw_struct

_TAG = r"""(?is)<{name}\b([^>]*)>"""
#: What job links look like unless a source says otherwise.
INCLUDE, EXCLUDE = ("job", "recruit", "career"), ("login", "signup")
EXCERPT = 240


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or bare, entities decoded; empty without it."""
    pattern = rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return text.unescape(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]))


def attribute_in(tag: Column, name: str) -> Column:
    """``attribute`` inside a lambda, where no Python function may run: common entities only."""
    pattern = rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    got = F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        got = F.replace(got, F.lit(entity), F.lit(char))
    return got


def anchors(html: Column) -> Column:
    """(href, text) of every closed anchor with an address, in order."""
    whole = F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*>.*?</a\s*>)"), F.lit(1))
    made = F.transform(whole, lambda a: F.struct(attribute_in(F.regexp_extract(a, r"(?is)^<a\b([^>]*)>", 1), "href").alias("href"), text.collapse(F.regexp_replace(a, r"(?s)<[^>]*>", "")).alias("text")))
    return F.filter(made, lambda x: x["href"] != "")


def linked_data(html: Column) -> Column:
    """Objects of all linked-data scripts as JSON: items of a graph, of an array, or the object; a script that is no JSON has none."""
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""), F.lit(1))

    def items(body: Column) -> Column:
        good = F.try_parse_json(body)
        return F.when(good.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(elements(F.get_json_object(body, "$['@graph']")), elements(body), F.array(body)))

    return F.filter(F.flatten(F.transform(scripts, items)), lambda x: F.ltrim(x).startswith("{"))


def page_title(html: Column, closed: bool = False) -> Column:
    return text.collapse(text.unescape(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1), closed))


def meta(html: Column, *names: str) -> Column:
    """Content of the last meta tag with one of the names or properties; empty without one."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b([^>]*)>"), F.lit(1)), lambda t: F.lower(attribute_in(t, "name")).isin(*names) | F.lower(attribute_in(t, "property")).isin(*names))
    return F.coalesce(F.try_element_at(F.transform(tags, lambda t: attribute_in(t, "content")), F.lit(-1)), F.lit(""))


def absolute(base: Column, href: Column) -> Column:
    """An address against its page's: whole ones as they are, then by scheme, host and folder; dots are resolved for one level."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path.contains("/"), F.regexp_replace(path, r"[^/]*$", "")).otherwise("/")
    bare = F.regexp_replace(href, r"^(\./)+", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href)).when(href.startswith("?"), F.concat(origin, path, href)).otherwise(F.concat(origin, folder, bare))
    )


def job_links(base: Column, found: Column, domains: Sequence[str], keywords: Sequence[str] = (), include: Sequence[str] = INCLUDE, exclude: Sequence[str] = EXCLUDE) -> Column:
    """Addresses of anchors on the allowed domains that match, each once, in order."""
    whole = F.transform(found, lambda a: F.struct(absolute(base, a["href"]).alias("url"), a["text"].alias("text")))

    def wanted(a: Column) -> Column:
        host = F.regexp_extract(a["url"], r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
        ok = host.isin(*domains)
        for p in exclude:
            ok = ok & ~a["url"].rlike(p)
        some = F.lit(False)
        for p in include:
            some = some | a["url"].rlike(p)
        return ok & some & (matching.contains_any(F.concat_ws(" ", a["url"], a["text"]), keywords) if keywords else F.lit(True))

    return F.array_distinct(F.transform(F.filter(whole, wanted), lambda a: a["url"]))


def clean(value: Column) -> Column:
    """Text of a fragment: tags out, common entities decoded, collapsed (for lambdas and columns alike)."""
    got = F.regexp_replace(value, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        got = F.replace(got, F.lit(entity), F.lit(char))
    return text.collapse(got)


def cleaned_list(value: Column) -> Column:
    """A JSON array's items or a scalar, cleaned, without empty ones."""
    plain = lambda x: F.coalesce(F.try_variant_get(F.try_parse_json(x), "$", "string"), x)
    listed = F.when(value.startswith("["), elements(value))
    some = F.when(value.isNull(), F.array().cast("array<string>")).when(listed.isNotNull(), F.transform(listed, lambda x: clean(plain(x)))).otherwise(F.array(clean(value)))
    return F.filter(some, lambda x: x != "")


def place(value: Column) -> Column:
    """A place, or all of a list, by the parts of the address."""
    one = lambda v: F.when(
        v.startswith("{"),
        F.coalesce(
            F.when(F.get_json_object(v, "$.address").startswith("{"), F.concat_ws(", ", *[F.nullif(F.get_json_object(v, f"$.address.{p}"), F.lit("")) for p in ("streetAddress", "addressLocality", "addressRegion", "addressCountry")])),
            F.get_json_object(v, "$.address"), F.lit(""),
        ),
    ).otherwise(F.coalesce(F.try_variant_get(F.try_parse_json(v), "$", "string"), v))
    listed = F.when(value.startswith("["), elements(value))
    return F.coalesce(F.when(listed.isNotNull(), F.array_join(F.filter(F.transform(listed, one), lambda x: x != ""), ", ")).otherwise(one(value)), F.lit(""))


def job_postings(pages: DataFrame, source_id: str, collected_at: dt.datetime) -> DataFrame:
    """Candidates of the pages' linked data of type JobPosting, in order (``at``)."""
    rows = pages.select("url", F.posexplode(linked_data(F.col("html"))).alias("at", "item")).filter(F.get_json_object("item", "$['@type']") == "JobPosting")
    r = F.col("item")
    org = field(r, "hiringOrganization")
    get = lambda *names: F.coalesce(*[F.nullif(field(r, n), F.lit("")) for n in names])
    described = clean(F.coalesce(field(r, "description"), F.lit("")))
    either = lambda a, b: F.when(F.size(a) > 0, a).otherwise(F.array(b))
    raw = raw_struct(
        required_qualifications=cleaned_list(field(r, "qualifications")), preferred_qualifications=cleaned_list(field(r, "experienceRequirements")), responsibilities=either(cleaned_list(field(r, "responsibilities")), described),
        company_info=either(cleaned_list(field(org, "description")), F.left(described, F.lit(EXCERPT))),
    )
    return rows.select(
        F.col("url").alias("page_url"), "at", F.lit(source_id).alias("source_id"), F.coalesce(get("url"), "url").alias("source_url"), F.coalesce(get("identifier", "directApply"), F.lit("")).alias("source_posting_id"),
        F.coalesce(get("title"), F.lit("")).alias("title"), F.coalesce(F.nullif(field(org, "name"), F.lit("")), F.lit(source_id)).alias("company"), place(field(r, "jobLocation")).alias("location"),
        date_prefix(field(r, "validThrough")).alias("deadline_raw"), F.lit(collected_at).alias("collected_at"), raw.alias("raw_jd"),
    )


def page_candidates(pages: DataFrame, source_id: str, collected_at: dt.datetime, company: str | None = None, location: str = "") -> DataFrame:
    """One candidate a page from its title and description."""
    about = text.collapse(meta(F.col("html"), "description", "og:description"))
    some = F.when(about != "", F.array(about)).otherwise(F.array().cast("array<string>"))
    title = page_title(F.col("html"))
    return pages.select(
        F.col("url").alias("page_url"), F.lit(0).alias("at"), F.lit(source_id).alias("source_id"), F.col("url").alias("source_url"), F.lit(None).cast("string").alias("source_posting_id"), F.when(title != "", title).otherwise(F.col("url")).alias("title"),
        F.lit(company or source_id).alias("company"), F.lit(location).alias("location"), F.lit(None).cast("string").alias("deadline_raw"), F.lit(collected_at).alias("collected_at"), raw_struct(responsibilities=some, company_info=some).alias("raw_jd"),
    )


def collect(pages: DataFrame, source_id: str, collected_at: dt.datetime, include: Sequence[str] = (), exclude: Sequence[str] = (), company: str | None = None, location: str = "") -> DataFrame:
    """Candidates of a source's pages: linked data where a page has any, else the page; then the keyword filter."""
    posted = job_postings(pages, source_id, collected_at)
    bare = pages.join(posted.select(F.col("page_url").alias("__has")).distinct(), F.col("url") == F.col("__has"), "left_anti")
    found = posted.unionByName(page_candidates(bare, source_id, collected_at, company, location))
    return found.filter(keyword_match(include, exclude) & (text.strip(F.col("title")) != ""))


def keyword_match(include: Sequence[str], exclude: Sequence[str]) -> Column:
    """The keyword filter over all text of a candidate."""
    whole = F.concat_ws(" ", "title", "company", "location", "raw_jd.required_qualifications", "raw_jd.preferred_qualifications", "raw_jd.responsibilities", "raw_jd.company_info")
    return matching.keyword_filter(whole, include, exclude)


def sitemap_urls(xml: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Locations of a sitemap, each once, that match."""
    found = F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))

    def wanted(u: Column) -> Column:
        some = F.lit(not include)
        for p in include:
            some = some | u.rlike(p)
        for p in exclude:
            some = some & ~u.rlike(p)
        return some

    return F.array_distinct(F.filter(found, wanted))
