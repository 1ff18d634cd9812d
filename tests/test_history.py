"""Runs, feedback, cache, gate, relevance, streams."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sieveline.operators import candidates, gate, history, issues, probe, relevance
from sieveline.operators.profile import Profile, Settings
from sieveline.streaming import feedback as stream


def recommendations(spark, run="r1", score=5):
    return spark.createDataFrame([(run, "rec1", "k1", "s", "1", score), (run, "rec2", "k2", "s", "2", 9)], "run_id string, recommendation_id string, posting_key string, source_id string, source_posting_id string, score int")


def events(spark, *rows):
    return spark.createDataFrame(list(rows), "recommendation_id string, verdict string, reason string, movement string, created_at string")


@pytest.fixture
def store(spark, tmp_path):
    h = history.History(spark, str(tmp_path / "h"))
    h.stage("r1", {"recommendations": recommendations(spark)})
    return h


def test_runs(spark, store):
    assert store.state("r1") == "pending" and store.table("recommendations") is None
    store.finalize("r1")
    assert store.state("r1") == "committed" and store.table("recommendations").count() == 2
    assert store.stage("r1", {"recommendations": recommendations(spark)}) == "replayed"
    with pytest.raises(ValueError):
        store.stage("r1", {"recommendations": recommendations(spark, score=6)})
    store.stage("r2", {"recommendations": recommendations(spark, "r2")})
    store.discard("r2")
    assert store.state("r2") == "absent" and store.table("recommendations", "r2") is None
    assert [r.recommendation_id for r in history.order_recommendations(store.table("recommendations")).collect()] == ["rec2", "rec1"]
    runs = spark.createDataFrame([("r1", 2), ("r3", 1)], "run_id string, ranked_count long")
    assert [tuple(r) for r in history.run_count_mismatches(runs, store.table("recommendations")).collect()] == [("r3", 1, 0)]
    assert [tuple(r) for r in history.one_sided(runs, store.table("recommendations"), "run_id").collect()] == [("r3", "a")]


def test_feedback(spark, store):
    store.finalize("r1")
    one = ("rec1", "applied", "good", "up", "2026-07-01T00:00:00+00:00")
    assert store.add_feedback(events(spark, one, one)).count() == 1
    assert store.add_feedback(events(spark, one, ("rec1", "hidden", "", "down", "2026-07-02T00:00:00+00:00"))).count() == 1
    for bad in (("rec9", *one[1:]), ("rec1", "maybe", "", "up", one[4]), ("rec1", "ignored", "", "left", one[4]), ("rec1", "ignored", "", "up", "2026-02-30T00:00:00+00:00"), ("rec1", "ignored", "", "up", "2026-07-01")):
        with pytest.raises(ValueError):
            store.add_feedback(events(spark, bad))
    stored = store.feedback().collect()
    assert [r.movement for r in stored] == ["up", "down"]
    body = json.dumps(dict(zip(("recommendation_id", "verdict", "reason", "movement", "created_at"), one, strict=True)), separators=(",", ":"))
    assert stored[0].event_id == hashlib.sha256(body.encode()).hexdigest()[:32]
    assert [tuple(r) for r in history.latest_feedback(store.feedback()).collect()] == [("k1", "down", "hidden")]


def test_cache(spark, tmp_path):
    t = dt.datetime(2026, 7, 1)
    c = history.Cache(spark, str(tmp_path / "c"), 60)
    c.put(spark.createDataFrame([("a", "1"), ("b", "1")], "key string, value string"), t)
    c.put(spark.createDataFrame([("a", "2")], "key string, value string"), t + dt.timedelta(seconds=50))
    assert {(r.key, r.value) for r in c.live(t + dt.timedelta(seconds=70)).collect()} == {("a", "2")}
    assert c.prune(t + dt.timedelta(seconds=70), str(tmp_path / "d")).live(t + dt.timedelta(seconds=70)).count() == 1


def test_outcomes(spark):
    e = "collection_error"
    rows = [("a", True, True, "success", None, 1), ("b", True, True, "success", e, 1), ("c", True, False, e, None, 1), ("d", True, False, "odd", "x", 1), ("e", True, False, e, e, -1), ("f", True, False, e, e, 2), ("g", False, False, "success", None, 1), ("", True, True, "success", None, 1)]
    df = spark.createDataFrame(rows, "source_id string, attempted boolean, completed boolean, status string, error_code string, duration_ms long")
    assert sorted(r.source_id for r in history.invalid_outcomes(df).collect()) == ["", "b", "c", "d", "e", "g"]
    closed = {r.source_id: (r.status, r.error_code, r.elapsed_ms) for r in issues.closed_outcomes(df.withColumnRenamed("duration_ms", "elapsed_ms")).collect()}
    assert closed["b"] == ("success", None, 1) and closed["c"] == (e, e, 1) and closed["d"] == (e, e, 1) and closed["e"] == (e, e, 0) and "unknown-source" in closed


def test_issues(spark):
    raw = ([], [], None, [], ["x"], [])
    rows = [("s", f"https://x.com/{i}", p, "T", "C", "L", None, dt.datetime(2026, 1, 1), raw) for i, p in enumerate(["ID-1", None, "ID-3"])]
    accepted = candidates.snapshots(candidates.normalized(spark.createDataFrame(rows, candidates.CANDIDATE)))
    told = spark.createDataFrame([("S", "detail_unverified", "id-1", None), ("s", "detail_fetch_failed", None, "https://x.com/1?q"), ("s", "detail_url_invalid", "none", None), ("s", "odd", "id-3", None), ("?", "detail_unverified", "id-3", None)], "source_id string, code string, source_posting_id string, source_url string")
    keys, errors = issues.match_issues(told, accepted)
    kept = issues.lowered(candidates.survivors(accepted), keys)
    assert {r.source_url[-1]: r.detail_quality for r in kept.collect()} == {"0": "manual_only", "1": "manual_only", "2": "verified"}
    assert {tuple(r) for r in errors.collect()} == {("s", "detail_url_invalid"), ("unknown-source", "detail_unverified")}


def test_metrics_with_outcomes(spark):
    metrics = spark.createDataFrame([("a", 2, []), ("b", 0, []), ("c", 1, ["detail_unverified"]), ("d", 1, [])], "source_id string, accepted long, error_codes array<string>")
    outcomes = spark.createDataFrame([("a", True, True, "success", None, 5), ("b", True, True, "success", None, 1), ("c", True, False, "source_timeout", None, 1), ("z", True, True, "success", None, 1)], "source_id string, attempted boolean, completed boolean, status string, error_code string, elapsed_ms long")
    both, odd = issues.with_outcomes(metrics, outcomes)
    assert {tuple(r) for r in odd.collect()} == {("d", "metrics"), ("z", "outcomes")}
    assert {r.source_id: r.error_codes for r in both.collect()} == {"a": [], "b": [], "c": ["detail_unverified", "source_timeout"]}
    assert {(r.source, r.code) for r in issues.notices(both).collect()} == {("b", issues.NO_CANDIDATES), ("c", "source_timeout")}


def test_probe(spark):
    cols = "id string, title string, company string, responsibilities string, required string, preferred string"
    outer = spark.createDataFrame([("1", "Dev  A", "ACME", "build x", "sql", "go"), ("2", "Dev", "사람인", "a", "b", "c"), ("3", "T", "C", "a", "b", "c")], cols)
    detail = spark.createDataFrame([("1", "dev a", "acme", "we build", "SQL!", "go"), ("2", "Dev", "사람인", "z", "b", "c")], cols)
    r = probe.decide(probe.compare_pages(outer, detail), 3).first()
    assert (r.pairs_requested, r.pairs_outer_sufficient, r.detail_fetch_failed, r.company_missing_or_placeholder_or_mismatch, r.responsibilities_mismatch, r.title_mismatch, r.decision) == (3, 1, 1, 1, 1, 0, "detail_only")
    assert probe.decide(probe.compare_pages(outer.limit(1), detail.limit(1)), 1).first().decision == "outer_only"
    df = spark.createDataFrame([("a Private_x SESSION=1 " + "y" * 600, "ok_code"), ("b", "raw_code")], "t string, c string")
    rows = df.select(probe.redacted(F.col("t")).alias("t"), probe.safe_code(F.col("c")).alias("c")).collect()
    assert rows[0].t.startswith("a [REDACTED]x [REDACTED]1 y") and len(rows[0].t) == 500 and [r.c for r in rows] == ["ok_code", None]
    assert probe.holds_mark(df.withColumn("n", F.array(F.struct("t"))), ("private_X", "")).count() == 1
    cands = spark.createDataFrame([("s", "ftp://x", None, "T", "C", "", None, None, ([], [], None, [], ["x"], []))], candidates.CANDIDATE)
    assert tuple(probe.filterability(cands).first()) == (True, True, False, False, False, False)


def test_gate(spark):
    enabled = spark.createDataFrame([("a",), ("b",), ("c",)], "source_id string")
    metrics = spark.createDataFrame([("a", True, 3, ["collection_error"]), ("b", True, 0, [])], "source_id string, attempted boolean, accepted long, error_codes array<string>")
    found = gate.source_findings(enabled, metrics)
    assert {(r.severity, r.source_id, r.code) for r in found.collect()} == {("fail", "c", "source_not_attempted"), ("fail", "b", "source_zero_accepted"), ("warning", "a", "source_collection_warning")}
    row = gate.gate(found).first()
    assert row.status == "fail" and [f.severity for f in row.findings] == ["fail", "fail", "warning"] and row.findings[0].source == "b"
    assert gate.gate(found.filter("severity = 'warning'")).first().status == "warning" and gate.gate(found.limit(0)).first().status == "pass"
    outcomes = spark.createDataFrame([("a", "success", None), ("b", "failed", "x"), ("z", "success", None)], "source_id string, status string, error_code string")
    assert {(r.source_id, r.code) for r in gate.outcome_findings(enabled, metrics, outcomes).collect()} == {("c", "source_outcome_missing"), ("b", "source_outcome_failed"), ("z", "source_outcome_inconsistent")}
    assert {r.code for r in gate.runtime_findings(spark, ["preflight", "odd"], False).collect()} == {"preflight", "runtime", "context"}


def test_relevance(spark):
    raw = ([], [], None, [], ["python"], ["python"])
    rows = [("s", f"https://x.com/{i}", str(i), t, "C", "Seoul", "2030-01-01", dt.datetime(2026, 1, 1), raw) for i, t in enumerate(["Data Engineer", "Cook"])]
    snaps = candidates.snapshots(candidates.normalized(spark.createDataFrame(rows, candidates.CANDIDATE)))
    cases = snaps.withColumns({"case_id": F.col("source_posting_id"), "expected_verdict": F.lit("include"), "expected_movement": F.lit("up")})
    settings = Settings(Profile(("data engineer",), ("python",), ("seoul",), 3))
    # 45 + 10 + 15 + 5 + 10 + 5 = 90; without the role 75, which is an application still
    assert relevance.case_failures(cases, settings).isEmpty()
    assert relevance.case_failures(cases.withColumn("expected_movement", F.lit("same")), settings).count() == 2
    key = hashlib.sha256(json.dumps({"source_id": "s", "source_url": "https://x.com/0", "source_posting_id": "0"}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:32]
    said = spark.createDataFrame([(key, "down", "2026-01-01", "e1"), (key, "same", "2026-01-02", "e2")], "key string, movement string, created_at string, event_id string")
    assert ("0", "same") in {(r.case_id, r.movement) for r in relevance.case_failures(cases, settings, said).collect()}
    odd = spark.createDataFrame([("s", "https://x.com/é😀", None)], "a string, b string, c string")
    want = hashlib.sha256(json.dumps({"source_id": "s", "source_url": "https://x.com/é😀", "source_posting_id": None}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:32]
    assert odd.select(history.legacy_key(F.col("a"), F.col("b"), F.col("c"))).first()[0] == want


def test_stream(spark, store, tmp_path):
    store.finalize("r1")
    rows = [("e1", "k1", "rec1", "applied", "", "up", "2026-07-01T00:00:00+00:00"), ("e2", "k1", "rec1", "hidden", "", "down", "2026-07-02T00:00:00+00:00"), ("e1", "k1", "rec1", "applied", "", "up", "2026-07-01T00:00:00+00:00")]
    spark.createDataFrame(rows, stream.EVENT).write.json(str(tmp_path / "in"))
    source = spark.readStream.schema(stream.EVENT).json(str(tmp_path / "in"))
    stream.into_history(source, store, str(tmp_path / "cp1")).awaitTermination()
    assert store.feedback().count() == 2
    stream.latest_movements(source).writeStream.outputMode("complete").format("memory").queryName("moved").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("moved").collect()] == [("k1", "down", 2)]
