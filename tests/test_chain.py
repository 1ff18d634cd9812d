"""The whole chain on a small queue: rejects, duplicates, requirements, scores, labels, report."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sieveline.operators import candidates as c
from sieveline.operators import issues, projection, scoring
from sieveline.operators.profile import Profile, Settings, Weights

T = dt.datetime(2026, 7, 1, tzinfo=dt.timezone.utc)
RUN = dt.date(2026, 7, 10)
SETTINGS = Settings(Profile(("data engineer", "ml/ai"), ("python", "sql", "spark"), ("seoul",), 3, ("gambling",), ("hush",), "bachelor"))


def cand(i, title="Data Engineer", req=("Python &amp; SQL", "학사 이상"), pref=("Spark",), resp=("build Python pipelines",), tags=("경력 2년 이상",), flags=None, dead="2026-12-31", sid="Fix", url=None, loc="Seoul 서울", co="ACME"):
    return (sid, url or f"https://ex.com/j/{i}", None if i is None else str(i), title, co, loc, dead, T, (["info"], list(tags), flags, list(pref), list(req), list(resp)))


ROWS = [
    cand(1), cand(1, pref=("Spark", "x")), cand(2, title=" "), cand(3, tags=("경력 4년 이상",)), cand(4, tags=("3년 ~ 5년 필수",)), cand(5, flags=["ocr"]), cand(6, dead="2026-01-01"), cand(7, tags=("석사 또는 박사",)),
    cand(8, tags=("병역 특례",)), cand(9, url="http://x"), cand(10, resp=("lead Gambling teams",)), cand(11, dead="not listed", req=("cook",), loc="Busan", title="Chef"), cand(12, tags=("경력 9년",), dead="2026-01-01"), (None,) * 9,
]


@pytest.fixture(scope="module")
def done(spark):
    return c.normalized(spark.createDataFrame(ROWS, c.CANDIDATE)).cache()


@pytest.fixture(scope="module")
def judged(done):
    kept = c.survivors(c.snapshots(done.filter("reject_code IS NULL")))
    return scoring.assess(kept, SETTINGS, RUN).withColumn("recommendation_id", c.recommendation_id(c.own_basis(), "r1")).cache()


def test_rejects(done):
    got = {(r.source_posting_id, r.reject_code) for r in done.filter("reject_code IS NOT NULL").collect()}
    assert got == {("2", "invalid_candidate"), ("9", "invalid_source_url"), (None, "invalid_source_id")}
    first = done.filter("source_posting_id = '1'").first()
    assert (first.source_id, first.raw_jd.required_qualifications, first.changed, first.emptied) == ("fix", ["Python & SQL", "학사 이상"], 2, 0)


def test_labels(judged):
    got = {r.source_posting_id: (r.disposition, r.reason_codes, r.experience_gap) for r in judged.collect()}
    assert got == {
        "1": ("apply", [], 0), "3": ("hold", ["experience_mismatch"], 1), "4": ("apply", [], 0), "5": ("manual_review", ["manual_flag"], 0), "6": ("expired", ["expired"], 0), "7": ("manual_review", ["education_ambiguous"], 0),
        "8": ("manual_review", ["military_program_review"], 0), "10": ("exclude", ["dealbreaker"], 0), "11": ("low_priority", [], 0), "12": ("hold", ["expired", "experience_mismatch"], 6),
    }


def test_duplicates_keep_the_fuller_one(judged):
    one = judged.filter("source_posting_id = '1'").first()
    assert (one.group_size, one.preferred_qualifications) == (2, ["Spark", "x"])


def test_evidence(spark, judged):
    rows = judged.filter("source_posting_id IN ('4', '7')").select("source_posting_id", F.explode("eligibility").alias("r")).collect()
    assert {(r.source_posting_id, r.r.evidence.kind, r.r.evidence.operator, r.r.evidence.modality, r.r.state) for r in rows} == {
        ("4", "education", "at_least", "mandatory", "match"), ("4", "experience", "range", "mandatory", "match"), ("7", "education", "at_least", "mandatory", "match"), ("7", "education", "none", "ambiguous", "review_required"),
    }
    sentences = ["5년 ~ 3년", "51년. 2 years", "경력 3년차", "Bachelor's or higher preferred, must", "a.  \n\n b"]
    snaps = c.snapshots(c.normalized(spark.createDataFrame([cand(1, tags=(s,), req=()) for s in sentences], c.CANDIDATE)))
    got = [[(e.kind, e.operator, e.modality, e.sentence_index) for e in r.evidence] for r in scoring.assess(snaps, SETTINGS, RUN).collect()]
    assert got == [[], [("experience", "at_least", "mandatory", 1)], [], [("education", "at_least", "ambiguous", 0)], []]


def test_identity(spark):
    df = spark.createDataFrame([("ID-1", "s", "u", "t", "c"), (None, "s", "u", "t", "c"), ("", "s", None, "A, B!", " C&co")], "source_posting_id string, source_id string, source_url string, title string, company string")
    assert [tuple(r[0]) for r in df.select(c.own_basis()).collect()] == [("source_posting_id", "s", "id-1"), ("canonical_url", "s", "u"), ("title_company", "s", "a b c co")]
    with pytest.raises(ValueError):
        c.recommendation_id(c.own_basis(), "")


def test_metrics(spark, done, judged):
    rows = {r.source_id: r for r in c.source_metrics(spark.createDataFrame([("fix",), ("idle",)], "source_id string"), done, judged, spark.createDataFrame([("idle", "source_timeout")], "source_id string, error_code string")).collect()}
    assert (rows["fix"].accepted, rows["fix"].rejected, rows["fix"].duplicates, rows["fix"].verified) == (11, 2, 1, 10)
    assert (rows["idle"].attempted, rows["idle"].accepted, rows["idle"].error_codes) == (True, 0, ["source_timeout"])


def test_first_score(spark):
    snaps = c.snapshots(c.normalized(spark.createDataFrame([cand(1), cand(2, req=(), pref=(), resp=(), title="Cook", loc="Busan")], c.CANDIDATE)))
    got = [(r.score, r.recommendation, r.verdict) for r in scoring.first_score(snaps, Settings(SETTINGS.profile, Weights())).orderBy("source_posting_id").collect()]
    # 45 * 1/2 + 20 + 15 + 0 + 10 + 5 = 72.5, halves to even; 0.5 of three lists and no company match, less 10
    assert got == [(72, "hold", "hold"), (30, "low_priority", "exclude")]


def test_first_wins(spark):
    df = spark.createDataFrame([(1, "A", "t", "c"), (2, "a", "t2", "c"), (3, "b", "T", "C!"), (4, "x", "t2", "c"), (5, "q", "z", "z")], "o int, source_url string, title string, company string")
    assert sorted(r.o for r in c.first_wins(df, "o").collect()) == [1, 4, 5]
    assert c.first_wins(df.limit(0), "o").count() == 0


def test_minimum_experience(spark):
    df = spark.createDataFrame([(["신입", "경력 3년"],), (["경력"],), (["경력무관", "x"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(c.minimum_experience(F.col("t"))).collect()] == [3, 1, None, None]


def test_public_fields(spark):
    df = spark.createDataFrame([("병역 특례 회사",), ("my private notes",), ("x" * 121,), (" ",), (None,), ("ok",)], "t string")
    assert [r[0] for r in df.select(projection.public_text(F.col("t"), F.lit("?"))).collect()] == ["?"] * 5 + ["ok"]
    codes = spark.createDataFrame([(["military_program_review", "manual_flag", "odd", "expired"],)], "t array<string>")
    assert codes.select(projection.public_reasons(F.col("t"))).first()[0] == ["manual_flag", "expired"]
    shown = spark.createDataFrame([(["필수 요건: a", "필수 요건: b", "근무지: Seoul", "담당 업무: army"],)], "t array<string>")
    assert shown.select(projection.public_evidence(F.col("t"))).first()[0] == ["필수 요건 일치", "근무지 조건 일치"]


def test_report(judged):
    queue = projection.report_queue(judged, "dry-run")
    rows = queue.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 11))
    assert [r["final_disposition"] for r in rows] == ["apply"] * 2 + ["hold"] * 2 + ["manual_review"] * 3 + ["low_priority", "exclude", "expired"]
    assert projection.order_collisions(queue).isEmpty()
    totals = projection.summary(judged, collected=14, rejected=3).first().asDict()
    assert (totals["duplicates_removed"], totals["apply_total"], totals["actionable_total"]) == (1, 2, 4)
    metrics = c.source_metrics(judged.select("source_id").distinct(), judged.withColumns({"reject_code": F.lit(None).cast("string"), "changed": F.lit(0), "emptied": F.lit(0)}), judged)
    good = projection.summary(judged.withColumn("group_size", F.lit(1).cast("long")))
    assert issues.inconsistent_totals(good, metrics.withColumn("duplicates", F.lit(0))).isEmpty() and not issues.inconsistent_totals(good, metrics).isEmpty()
    body, digest = projection.render_report(queue, totals, RUN, [("idle", "source_timeout")])
    assert body.startswith("# 채용 추천 리포트 — 2026-07-10\n") and "| 1 | 지원 추천 | Data Engineer | ACME |" in body and body.endswith("- 소스 `idle`: source_timeout\n") and len(digest) == 64


def test_links(spark):
    from sieveline.operators import links

    cases = [
        ("fixture", "https://jobs.example.test/abc", "abc", "https://jobs.example.test/abc"), ("fixture", "https://jobs.example.test/list-1", "list-1", None), ("wanted", "https://www.wanted.co.kr/wd/12", "12", "https://www.wanted.co.kr/wd/12"),
        ("wanted", "https://www.wanted.co.kr/wd/12?x=1", "12", None), ("wanted", "https://www.wanted.co.kr/wd/13", "12", None), ("saramin", "https://www.saramin.co.kr/zf_user/jobs/relay/view-detail", "7", "https://www.saramin.co.kr/zf_user/jobs/relay/view-detail?rec_idx=7&rec_seq=0"),
        ("rallit", "https://www.rallit.com/positions/5/a%20b", "5", "https://www.rallit.com/positions/5/a%20b"), ("rallit", "https://www.rallit.com/positions/5/a%2Fb", "5", None), ("rallit", "https://www.rallit.com/positions/5/%ED%95%9C", "5", "https://www.rallit.com/positions/5/%ED%95%9C"),
        ("jumpit", "http://jumpit.saramin.co.kr/position/1", "1", None), ("other", "https://x.com/1", "1", None),
    ]
    df = spark.createDataFrame(cases, "s string, u string, i string, w string")
    got = [(r.w, r.l) for r in df.select("w", links.verified_link(F.lit("replay"), F.col("s"), F.col("u"), F.col("i"), F.lit("verified")).alias("l")).collect()]
    assert [g for _, g in got] == [w for w, _ in got]
    assert df.select(links.verified_link(F.lit("other"), F.col("s"), F.col("u"), F.col("i"), F.lit("verified")).alias("l")).filter("l IS NOT NULL").isEmpty()


def test_report_problems(judged):
    queue = projection.report_queue(judged, "dry-run")
    totals = projection.summary(judged, collected=14, rejected=3).first().asDict()
    body, _ = projection.render_report(queue, totals, RUN, [("idle", "source_timeout")])
    assert projection.report_problems(body) == []
    for wrong in (body.replace("| 2 |", "| 7 |"), body.replace("## 지원/검토", "## x"), body.replace("Seoul", "my private notes"), body[:-1], body.replace("- 소스 `idle`", "- idle"), body.replace("지원 추천", "buy")):
        assert projection.report_problems(wrong)
