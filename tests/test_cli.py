"""Commands from files to files."""

import json

import pytest

from sieveline import cli, config


def made(tmp_path, **more):
    post = lambda i, **k: {"source_id": "fix", "source_url": f"https://jobs.example.test/p{i}", "source_posting_id": f"p{i}", "title": "Data Engineer", "company": f"C{i}", "location": "Seoul", "deadline": "2026-12-31", "raw_jd": {"required_qualifications": ["Python"], "preferred_qualifications": [], "responsibilities": ["Python"], "company_info": []}} | k
    rows = [post(1), post(1, title="Data Engineer "), post(2, deadline="2026-01-01"), post(3, title=""), post(4, location="Busan", title="Cook", deadline="not listed")]
    (tmp_path / "p.json").write_text(json.dumps(rows))
    data = {
        "top_n": 3, "profile": {"desired_roles": ["data engineer"], "skills": ["python"], "preferred_locations": ["seoul"], "max_experience_years": 3, "private_canaries": ["zebra"]}, "fixture_path": str(tmp_path / "p.json"),
        "sources": [{"source_id": "fix", "enabled": True, "access_mode": "fixture"}], "output_dir": str(tmp_path / "out"),
    } | more
    (tmp_path / "c.json").write_text(json.dumps(data))
    return str(tmp_path / "c.json")


def test_dry_run(spark, tmp_path, capsys):
    assert cli.main(["dry-run", "--config", made(tmp_path), "--run-date", "2026-06-30", "--print-report"]) == 0
    body = (tmp_path / "out" / "2026-06-30.md").read_text()
    assert "- 수집: 5\n- 상세 거부: 1\n- 중복 제거: 1\n" in body and "| 1 | 지원 추천 | Data Engineer | C1 | Seoul | 2026-12-31 |" in body and "| 3 | 제외 | Data Engineer | C2 |" in body
    assert body in capsys.readouterr().out
    assert cli.main(["dry-run", "--config", made(tmp_path, profile={"private_canaries": ["C1"]}), "--run-date", "2026-06-30"]) == 3


def test_scheduled_run_history_and_feedback(spark, tmp_path, capsys):
    args = ["scheduled-run", "--config", made(tmp_path), "--run-date", "2026-06-30", "--quality-gate-output", str(tmp_path / "gate.json"), "--history", str(tmp_path / "h")]
    assert cli.main(args) == 0 and cli.main(args) == 0
    state = json.loads((tmp_path / "gate.json").read_text())
    assert state["status"] == "pass" and state["summary"]["duplicates_removed"] == 1 and state["sources"][0]["candidate_count"] == 4
    capsys.readouterr()
    assert cli.main(["scheduled-history", "--history", str(tmp_path / "h")]) == 0
    rows = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert len(rows) == 3 and rows[0]["score"] >= rows[1]["score"]
    add = ["feedback-add", "--history", str(tmp_path / "h"), "--verdict", "applied", "--reason", "r", "--created-at", "2026-07-01T00:00:00+00:00", "--recommendation-id"]
    assert cli.main([*add, rows[0]["recommendation_id"]]) == 0 and cli.main([*add, "unknown"]) == 2
    capsys.readouterr()
    assert cli.main(["feedback-export", "--history", str(tmp_path / "h")]) == 0
    assert json.loads(capsys.readouterr().out)["posting_key"] == rows[0]["posting_key"]


def test_captures(spark, tmp_path):
    day = tmp_path / "spool" / "2026-07-01"
    day.mkdir(parents=True)
    (day / "a.json").write_text(json.dumps({"source_id": "jobkorea", "captured_at": "2026-07-01T00:00:00Z", "postings": [{"source_url": "https://www.jobkorea.co.kr/Recruit/GI_Read/1", "title": "Data Engineer", "company": "C", "requirements": "Python"}]}))
    assert cli.main(["capture-import", "--config", made(tmp_path), "--spool-dir", str(tmp_path / "spool"), "--run-date", "2026-07-02"]) == 0
    assert "원문 확인 필요" in (tmp_path / "out" / "2026-07-02-captures.md").read_text()
    assert cli.main(["capture-quality-gate", "--spool-dir", str(tmp_path / "spool"), "--date", "2026-07-01", "--output", str(tmp_path / "g.json")]) == 0
    assert json.loads((tmp_path / "g.json").read_text())["status"] == "pass"


def test_status_and_preferences(spark, tmp_path, capsys):
    path = made(tmp_path)
    assert cli.main(["source-status", "--config", path]) == 0 and capsys.readouterr().out.startswith("fix\tenabled\t-\tno_human")
    (tmp_path / "me.md").write_text("Skills: Go, python\nLocations: Busan\n7 years")
    assert cli.main(["context-doctor", "--config", made(tmp_path, profile={}), "--context-doc", str(tmp_path / "me.md"), "--answer", "skills=SQL", "--output", str(tmp_path / "pref.md")]) == 0
    assert capsys.readouterr().out == "missing: desired_roles\n"
    assert (tmp_path / "pref.md").read_text() == "# Preferences\n\nRoles: \nSkills: Go, python, SQL\nLocations: Busan\nExperience: 7 years\nDeal Breakers: \n"


@pytest.mark.parametrize(
    "more",
    [
        {"top_n": 0}, {"top_n": True}, {"thresholds": {"apply": 5, "hold": 50}}, {"weights": {"required": 100}}, {"scoring_weights": {"required": -1}}, {"sources": []}, {"sources": [{"source_id": "x", "enabled": True, "access_mode": "public_page"}]},
        {"sources": [{"source_id": "X", "enabled": True, "access_mode": "manual"}]}, {"advanced": {"education_claim": "guru"}}, {"sources": [{"source_id": "linkedin", "enabled": True, "access_mode": "manual"}]},
    ],
)
def test_wrong_configurations(tmp_path, more):
    assert cli.main(["source-status", "--config", made(tmp_path, **more)]) in (0, 2)
    with pytest.raises(config.ConfigError):
        config.load(open(made(tmp_path, **more)).read())


def test_identity_and_fingerprint(tmp_path):
    c = config.load(open(made(tmp_path)).read())
    import datetime as dt

    assert config.run_identity(c, dt.date(2026, 1, 1), "a") != config.run_identity(c, dt.date(2026, 1, 2), "a")
    assert config.fingerprint(["a  \r\nb\n"]) == config.fingerprint(["a\nb"]) and config.inferred_years("25년 7 years 3년") == 7
