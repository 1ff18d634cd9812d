"""Pages of two further sites."""

import datetime as dt

from pyspark.sql import functions as F

from sieveline.sources import boards as b

NOW = dt.datetime(2026, 7, 1)
URL = "https://www.saramin.co.kr/zf_user/jobs/relay/view-detail?rec_idx=12&rec_seq=0"


def test_posting_numbers(spark):
    base = "https://www.saramin.co.kr/zf_user/jobs/relay/view"
    cases = {
        base + "?rec_idx=5": ("5", "5"), base + "-detail?rec_seq=0&rec_idx=7": ("7", "7"), base + "?rec_idx=5&rec_seq=1": (None, None), base + "?x=1&rec_idx=9": (None, "9"), base + "?rec_idx=5&rec_idx=6": (None, None), base + "?rec_idx=0": (None, None),
        "http" + base[5:] + "?rec_idx=5": (None, None), base + "?rec_idx=5#f": (None, None), "https://x.com/zf_user/jobs/relay/view?rec_idx=5": (None, None), "": (None, None), None: (None, None),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "at int, url string")
    got = [tuple(r) for r in df.orderBy("at").select(b.posting_number(F.col("url")), b.posting_number(F.col("url"), True)).collect()]
    assert got == list(cases.values())
    good, bad = b.saramin_seeds(df.unionByName(df.withColumn("at", F.col("at") + 50)))
    assert [r.url[-19:] for r in good.orderBy("at").collect()] == ["rec_idx=5&rec_seq=0", "rec_idx=7&rec_seq=0"] and bad.count() == 18
    html = spark.createDataFrame([("{'rec_idx': '3', t:'ML'} {\"rec_idx\":4} {\"rec_idx\":4} {rec_idx}",)], "h string")
    assert [u.split("rec_idx=")[1][0] for u in html.select(b.saramin_listing(F.col("h"))).first()[0]] == ["3", "4"]
    assert len(html.select(b.saramin_listing(F.col("h"), ["ml"])).first()[0]) == 1


def test_saramin(spark):
    body = "<p>주요업무 build Redis 자격요건 Python 우대사항 nice 마감일 및 근무지 마감일 : 2026.08.09 근무지 - 서울 복지 및 혜택</p><p>경력 3년 이상</p>"
    header = '<p class="x job-header__title"> [ACME] <b>Dev</b> </p>'
    linked = '<script type="application/ld+json">{"a":[{"x":{"hiringOrganization":{"name":"Deep"}}}],"employer":"사람인"}</script>'
    rows = [(URL, header + body), (URL, linked + '<meta property="og:title" content="T &amp; U">' + body), (URL, "<p>주요업무 only</p>"), (URL, "<p>none</p>"), ("https://x.com", header + body)]
    got = b.saramin(spark.createDataFrame(rows, "url string, html string"), NOW).collect()
    assert [(r.title, r.company) for r in got] == [("[ACME] Dev", "ACME"), ("T & U", "Deep"), ("채용 공고", "회사명 확인 필요")]
    assert (got[0].source_posting_id, got[0].location, got[0].deadline_raw, got[0].raw_jd.experience_tags) == ("12", "서울", "2026.08.09", ["경력 3년 이상"])
    assert (got[0].raw_jd.required_qualifications, got[0].raw_jd.responsibilities) == (["Python", "Python", "Redis"], ["build Redis"]) and got[2].raw_jd.company_info == []
    outer = b.saramin(spark.createDataFrame(rows, "url string, html string"), NOW, outer=True).collect()
    assert [r.company for r in outer] == ["ACME", "Deep"] and outer[0].source_url.endswith("/relay/view?rec_idx=12&rec_seq=0")


def test_rocketpunch(spark):
    cards = '<div class="job-card a"><h3>Data Dev</h3><p class="company">ACME</p><a href="/en/jobs/55?x=1">x</a> Python 서울</div><li class="job-item" data-title="B"><span>selectedJobId=66</span></li><article class="listing-card"><h2>C dev</h2></article>'
    listed = b.rocketpunch(spark.createDataFrame([("https://www.rocketpunch.com/en/jobs", "<p>head</p>" + cards)], "url string, html string"), NOW)
    rows = listed.orderBy("at").collect()
    assert [(r.source_posting_id, r.title, r.company, r.source_url) for r in rows] == [
        ("55", "Data Dev", "ACME", "https://www.rocketpunch.com/en/jobs/55?x=1"), ("66", "B", "rocketpunch", "https://www.rocketpunch.com/en/jobs?selectedJobId=66"), ("listing-3-c-dev", "C dev", "rocketpunch", "https://www.rocketpunch.com/en/jobs"),
    ]
    assert "Python" in rows[0].raw_jd.required_qualifications
    page = "<p>nav Data Dev List Data Dev Team Introduction we Responsibilities do Qualifications SQL 3 years Preferred Qualifications nice Benefits x You can apply until march 5, 2026</p>"
    out, issues = b.rocketpunch_details(listed, spark.createDataFrame([("https://www.rocketpunch.com/en/jobs/55?x=1", page)], "url string, html string"))
    one = {r.source_posting_id: r for r in out.collect()}["55"]
    assert (one.deadline_raw, one.raw_jd.responsibilities, one.raw_jd.required_qualifications, one.raw_jd.preferred_qualifications, one.raw_jd.company_info, one.raw_jd.experience_tags) == ("2026-03-05", ["do"], ["SQL 3 years", "SQL"], ["nice"], ["we"], ["3 years"])
    assert {(r.source_url.rsplit("/", 1)[1], r.code) for r in issues.collect()} == {("jobs?selectedJobId=66", "detail_url_invalid"), ("jobs", "detail_url_invalid")}
