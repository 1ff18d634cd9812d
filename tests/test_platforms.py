"""Pages of the single sites."""

import datetime as dt

from pyspark.sql import functions as F

from sieveline.sources import platforms as p

NOW = dt.datetime(2026, 7, 1)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, html string")


def test_wanted(spark):
    page = '<meta property="og:title" content="[ACME] Data Dev 채용 공고 | 원티드"><p>경력 3년 이상</p><h3>주요업무</h3><p>Build SQLite &amp; Git</p><h3>자격요건</h3>Python<h3>우대사항</h3>x<h3>마감일</h3> 2026.08.01 <h3>근무지역</h3> 서울 강남 지원하기'
    got = p.wanted(frame(spark, ("https://www.wanted.co.kr/wd/77", page), ("https://www.wanted.co.kr/wd/78", "<p>none</p>"), ("u", None)), NOW).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.source_posting_id, r.title, r.company, r.location, r.deadline_raw) == ("77", "Data Dev", "ACME", "서울 강남", "2026.08.01")
    assert (r.raw_jd.responsibilities, r.raw_jd.required_qualifications, r.raw_jd.experience_tags) == (["Build SQLite & Git"], ["Python", "Python", "Git", "SQLite"], ["경력 3년 이상"])
    df = spark.createDataFrame([('x {"id": 5, "t": "ML"} {"id": 6} {"id": 5}', '{"data":[{"id":1},{"id":true},{"id":"2"},{"id":"x"},3]}'), ("", "{")], "h string, j string")
    rows = df.select(p.wanted_listing(F.col("h")).alias("a"), p.wanted_listing(F.col("h"), ["ml"]).alias("b"), p.wanted_search(F.col("j")).alias("c")).collect()
    base = "https://www.wanted.co.kr/wd/"
    assert (rows[0].a, rows[0].b, rows[0].c) == ([base + "5", base + "6"], [base + "5"], [base + "1", base + "2"]) and rows[1].c == []


def test_jumpit(spark):
    page = r'self.push("{\"title\":\"Dev\",\"companyName\":\"ACME\",\"location\":\"서울\",\"closedAt\":\"2026-09-01T00:00\",\"responsibility\":\"a\",\"qualifications\":\"b\",\"newcomer\":true,\"minCareer\":2,\"stack\":\"Go\",\"stack\":\"Go\"}")'
    raw = '{"title":"Raw \\"q\\"","companyName":"C","stack":"SQL","newcomer":false}'
    got = p.jumpit(frame(spark, ("https://jumpit.saramin.co.kr/position/9/", page), ("https://jumpit.saramin.co.kr/position/8", raw), ("https://x/1", '<meta property="og:title" content="점핏 | T">')), NOW).collect()
    assert (got[0].source_posting_id, got[0].title, got[0].company, got[0].location, got[0].deadline_raw, got[0].raw_jd.required_qualifications, got[0].raw_jd.experience_tags) == ("9", "Dev", "ACME", "서울", "2026-09-01", ["b", "Go"], ["신입", "경력2년↑"])
    assert (got[1].title, got[1].company, got[1].raw_jd.required_qualifications, got[1].raw_jd.experience_tags) == ('Raw "q"', "C", ["", "SQL"], [])
    assert (got[2].title, got[2].company) == ("T", "jumpit")


def test_rallit(spark):
    page = '<meta property="og:title" content="ACME [ML] Dev 채용 - 랠릿"><p># Python # SQL 주요업무 build 자격요건 know 우대사항 nice 채용 절차 x 근무 지역 서울 강남 경력 3년 이상 최소 연봉 1 마감일 2026.01.02 회사명 ACME Corp 지원하기 비슷한 채용 공고 other 주요업무</p>'
    r = p.rallit(frame(spark, ("https://www.rallit.com/positions/12/slug", page)), NOW).first()
    assert (r.source_posting_id, r.title, r.company, r.location, r.deadline_raw) == ("12", "[ML] Dev", "ACME Corp", "서울", "2026-01-02")
    assert (r.raw_jd.required_qualifications, r.raw_jd.responsibilities, r.raw_jd.preferred_qualifications, r.raw_jd.experience_tags) == (["know", "Python", "SQL"], ["build"], ["nice"], ["3년 이상"])


def test_jobkorea(spark):
    item = lambda n, title: f'<li class="recruit-item x" data-cname="C{n}" data-applyclosedt="2026-02-0{n} 00"><a href="/Recruit/GI_Read/{n}?s=1">x</a><h3 class="title">{title}</h3><ul><li class="item">서울 강남</li><li class="item a">Python</li><li class="item">경력 2년</li><li class="item">합격축하금</li></ul>'
    listed = p.jobkorea_listing(frame(spark, ("l", "head" + item(1, "<b>Dev</b>") + item(2, "경력 5년 Dev") + '<li class="recruit-item">none')), NOW)
    rows = listed.orderBy("at").collect()
    assert [(r.source_url, r.title, r.company, r.location, r.deadline_raw) for r in rows] == [("https://www.jobkorea.co.kr/Recruit/GI_Read/1", "Dev", "C1", "서울 강남", "2026-02-01"), ("https://www.jobkorea.co.kr/Recruit/GI_Read/2", "경력 5년 Dev", "C2", "서울 강남", "2026-02-02")]
    assert rows[0].raw_jd.required_qualifications == ["Python"] and rows[1].raw_jd.experience_tags == ["경력 2년", "경력 5년 Dev"]
    detail = frame(spark, (rows[0].source_url, "<p>주요업무: build things 자격요건 - SQL 근무지 주소: 서울시 1 지도보기</p>"), (rows[1].source_url, '<script type="application/ld+json">{"@type":"JobPosting","title":"LD","responsibilities":["lead"],"jobLocation":"부산","validThrough":"2026-12-01"}</script>'))
    got, missing = p.jobkorea_details(listed, detail, NOW)
    by = {r.source_posting_id: r for r in got.collect()}
    assert (by["1"].location, by["1"].raw_jd.responsibilities, by["1"].raw_jd.required_qualifications) == ("서울시 1", ["build things"], ["SQL"])
    assert (by["2"].location, by["2"].deadline_raw, by["2"].raw_jd.responsibilities) == ("부산", "2026-12-01", ["lead", "경력 5년 Dev"]) and missing.isEmpty()
    alone, gone = p.jobkorea_details(listed, detail.limit(0), NOW, need_body=True)
    assert alone.isEmpty() and gone.count() == 2
