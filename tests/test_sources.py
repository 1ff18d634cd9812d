"""Readers: posting arrays, manual records, pages, captures, contexts."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sieveline.sources import captures, pages, records

NOW = dt.datetime(2026, 7, 1, tzinfo=dt.timezone.utc)


def test_posting_files(spark, tmp_path):
    rows = [
        {"source_id": "a", "source_url": "https://x.com/1", "title": "T", "company": "C", "raw_jd": {"required_qualifications": ["p", 3], "responsibilities": "one"}, "manual_review_flags": ["f"]},
        {"source_id": "a", "source_url": "https://x.com/2", "source_posting_id": None, "title": "U", "company": "C", "location": "Seoul", "deadline": "2026-01-01", "raw_jd": None},
    ]
    (tmp_path / "p.json").write_text(json.dumps(rows))
    got = records.posting_files(spark, str(tmp_path / "p.json"), NOW).orderBy("at").collect()
    assert (got[0].location, got[0].raw_jd.required_qualifications, got[0].raw_jd.responsibilities, got[0].raw_jd.manual_review_flags, got[0].raw_jd.company_info) == ("", ["p", "3"], ["one"], ["f"], None)
    assert (got[1].source_posting_id, got[1].location, got[1].deadline_raw, got[1].raw_jd) == (None, "Seoul", "2026-01-01", None)


def test_manual_records(spark, tmp_path):
    (tmp_path / "m.csv").write_text('job_title,url,employer,skills,expires_at\n"Dev, senior",https://x.com/1,ACME,py,2026-02-03T00:00\n,,,,\n')
    got = records.manual_candidates(records.manual_rows(spark, str(tmp_path / "m.csv")), "man", NOW).orderBy("at").collect()
    assert (got[0].title, got[0].source_url, got[0].company, got[0].raw_jd.required_qualifications, got[0].deadline_raw) == ("Dev, senior", "https://x.com/1", "ACME", ["py"], "2026-02-03")
    assert (got[1].title, got[1].source_url, got[1].company) == ("", "manual://man/unknown", "man")
    (tmp_path / "m.json").write_text(json.dumps({"jobs": [{"position": "P", "id": 7, "tags": [{"name": "x"}, ["y"], "z"], "duties": ["d"], "requirements": ["r"]}, 5]}))
    got = records.manual_candidates(records.manual_rows(spark, str(tmp_path / "m.json")), "man", NOW).collect()
    assert len(got) == 1 and (got[0].source_url, got[0].source_posting_id, got[0].raw_jd.responsibilities) == ("manual://man/7", "7", ["d"])
    assert got[0].raw_jd.required_qualifications[:2] == ["r", "x"] and "z" in got[0].raw_jd.required_qualifications


def test_registry(spark):
    reader = lambda name: lambda s, m: s.createDataFrame([(m["source_id"], name)], "source_id string, by string")
    r = records.Registry(reader("general"))
    r.by_mode["fixture"], r.by_source["x"] = reader("mode"), reader("source")
    got = r.candidates(spark, [{"source_id": "y"}, {"source_id": "x"}, {"source_id": "x", "access_mode": "fixture"}]).orderBy("source_ord").collect()
    assert [g.by for g in got] == ["general", "source", "mode"]
    with pytest.raises(LookupError):
        records.Registry().reader({"source_id": "z"})


PAGE = """<html><head><title> Jobs &amp; more </title><meta name="description" content="We  hire"><script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"Dev","url":"https://x.com/job/1","hiringOrganization":{"name":"ACME"},
"jobLocation":[{"address":{"addressLocality":"Seoul","addressCountry":"KR"}},"Remote"],"validThrough":"2026-05-06T00:00","qualifications":["<b>Python</b>",""],"description":"<p>Long &amp; good</p>"},{"@type":"Other"}]}</script>
<script type="application/ld+json">{broken</script></head><body><a href="/job/1">One</a><a href='https://x.com/login/job'>In</a><a href="https://y.com/job/2">Out</a><a href="job/3#f">Th<b>ree</b></a><a href="/job/1">again</a></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([("https://x.com/list/a", PAGE), ("https://x.com/b", "<title>Plain</title>"), ("https://x.com/c", None)], "url string, html string")
    links = df.select(pages.job_links(F.col("url"), pages.anchors(F.col("html")), ["x.com"]).alias("l")).collect()
    assert links[0].l == ["https://x.com/job/1", "https://x.com/list/job/3#f"] and links[1].l == []
    got = {r.source_url: r for r in pages.collect(df.filter("html IS NOT NULL"), "src", NOW).collect()}
    one = got["https://x.com/job/1"]
    assert (one.title, one.company, one.location, one.deadline_raw, one.raw_jd.required_qualifications, one.raw_jd.responsibilities) == ("Dev", "ACME", "Seoul, KR, Remote", "2026-05-06", ["Python"], ["Long & good"])
    assert got["https://x.com/b"].title == "Plain" and len(got) == 2
    assert pages.collect(df.filter("html IS NOT NULL"), "src", NOW, exclude=["plain"]).count() == 1
    assert df.select(pages.page_title(F.col("html")), pages.meta(F.col("html"), "description")).first()[:2] == ("Jobs & more", "We  hire")
    xml = spark.createDataFrame([("<url><loc> https://x.com/a?x=1&amp;y=2 </loc></url><loc>https://x.com/b</loc><loc>https://x.com/b</loc>",)], "x string")
    assert xml.select(pages.sitemap_urls(F.col("x"), include=["/b"])).first()[0] == ["https://x.com/b"]


def test_titles_with_cut_references(spark, tmp_path):
    """The query decodes what its SQL does: references that a semicolon ends."""
    import duckdb

    import __spark_entry__ as e

    rows = [(1, "<title>a &amp; b&amp</title>"), (2, "<title>&quot &quot;&lt;x&#39;</title>"), (3, "<title>&amp;amp;</title>"), (4, None), (5, "none"), (6, "<title></title>")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    df.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in e.queries()["s11_page_fields"](spark, str(tmp_path)).collect())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        assert got == sorted(con.execute(e.oracle_sql()["s11_page_fields"]).fetchall())
    assert got[0] == (1, "a & b&amp", "") and df.filter("page_id = 1").select(pages.page_title(F.col("html"))).first()[0] == "a & b&"


def capture(source="saramin", **more):
    post = {"source_id": "", "source_url": "https://www.saramin.co.kr/job/77/", "title": "T", "company": "C", "location": "서울 마감일 3/4", "deadline": "~ 8/9", "skills": ["Go"], "requirements": "Python\n경력 3년\n주요업무\nbuild", "captured_at": "2026-07-01T01:02:03Z"}
    return {"source_id": source, "captured_at": "2026-07-01T00:00:00", "postings": [post | more]}


def test_captures(spark, tmp_path):
    day = tmp_path / "2026-07-01"
    day.mkdir()
    (tmp_path / "2026-06-30").mkdir()
    (tmp_path / "2026-06-30" / "old.json").write_text(json.dumps(capture()))
    bodies = {"a": capture(), "b": capture(), "c": capture(requirements="", source_url="https://x.com/1"), "d": capture(email="x"), "e": capture(title=""), "f": {"postings": []}, "g": [], "i": {"postings": 3}, "j": capture(company="csrf token")}
    for name, body in bodies.items():
        (day / f"{name}.json").write_text(json.dumps(body))
    (day / "h.json").write_text("{")
    files = captures.spool(spark, str(tmp_path))
    found, problems = captures.import_captures(files, 2026, NOW)
    rows = {r.source_posting_id: r for r in found.collect()}
    assert set(rows) == {"77", "1"}
    one = rows["77"]
    assert (one.source_id, one.location, one.deadline_raw, one.collected_at) == ("saramin", "서울", "2026-08-09", dt.datetime(2026, 7, 1, 1, 2, 3))
    assert one.raw_jd.required_qualifications == ["Go", "Python", "Python 경력 3년 주요업무 build"] and one.raw_jd.experience_tags == ["Python 경력 3년 주요업무 build"]
    assert rows["1"].raw_jd.manual_review_flags == [captures.OCR_FLAG]
    said = {(r.file.rsplit("/", 1)[1][0], r.message, r.blocking) for r in problems.collect()}
    assert said == {
        ("b", "duplicate posting saramin:77", False), ("d", captures.ERRORS[4], True), ("e", captures.ERRORS[6], True), ("f", "empty postings", False), ("g", captures.ERRORS[1], True), ("h", captures.ERRORS[0], True), ("i", captures.ERRORS[2], True),
        ("j", captures.ERRORS[5], True),
    }
    assert captures.quality_gate(found, problems).first().status == "fail"
    assert captures.quality_gate(found, problems.limit(0)).first().status == "manual_review_required"
    assert captures.quality_gate(found.filter("source_posting_id = '77'"), problems.filter("NOT blocking")).first().status == "pass_with_warnings"
    contact = found.filter("source_posting_id = '77'").withColumn("title", F.lit("mail a@b.co"))
    assert [r.category for r in captures.privacy_findings(contact).collect()] == ["warning"]


def test_context_sections(spark):
    body = "Roles: data engineer / ml, backend\nSkills: SQL, Python\nrole: other\nSKILLS: Go\nLocations: Seoul, a/b\nnothing"
    df = spark.createDataFrame([(body,), ("",)], "b string")
    keys = {"roles": ("roles",), "skills": ("skills",), "locations": ("locations",)}
    got = [r[0] for r in df.select(records.context_sections(F.col("b"), keys, ("roles", "skills"))).collect()]
    assert (got[0].roles, got[0].skills, got[0].locations) == (["data engineer", "ml", "backend"], ["Go"], ["Seoul", "a/b"]) and got[1].roles == []
