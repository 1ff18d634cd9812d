"""Commands over landed files: runs, history, feedback, captures, source status, preferences. Exit codes: 0 done, 1 the gate or report failed, 2 usage or configuration, 3 privacy."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import config as configuration
from sieveline.functions.text import fold_word
from sieveline.operators import candidates, gate, history, projection, scoring
from sieveline.sources import captures, records

#: What the lines of a context document are called.
CONTEXT_KEYS = {
    "desired_roles": ("Roles", "희망 직무", "직무"), "skills": ("Skills", "기술", "기술 스택"), "preferred_locations": ("Locations", "희망 지역", "지역"), "exclusions": ("Deal Breakers", "제외 조건"),
}
SLASHED = ("desired_roles", "skills", "exclusions")


def session() -> SparkSession:
    return SparkSession.builder.appName("sieveline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def run(spark: SparkSession, config: configuration.Config, found: DataFrame, run_date: dt.date, mode: str, run_id: str, source_quality=None) -> dict[str, DataFrame]:
    """The chain over candidates: normalized rows, judged survivors, metrics, findings, queue, totals."""
    done = candidates.normalized(found)
    quality = F.lit("verified") if source_quality is None else source_quality
    kept = candidates.survivors(candidates.snapshots(done.filter("reject_code IS NULL"), quality))
    judged = scoring.assess(kept, config.settings, run_date).withColumn("recommendation_id", candidates.recommendation_id(candidates.own_basis(), run_id))
    if mode == "capture-import":
        judged = captures.without_links(judged)
    enabled = spark.createDataFrame([(s["source_id"],) for s in config.enabled] or [("",)], "source_id string").filter("source_id <> ''")
    attempted = done.select("source_id").distinct() if mode == "capture-import" else enabled
    metrics = candidates.source_metrics(attempted, done, kept)
    findings = gate.source_findings(attempted, metrics, capture=mode == "capture-import")
    return {"done": done, "judged": judged, "metrics": metrics, "findings": findings, "queue": projection.report_queue(judged, mode)}


def report(found: dict[str, DataFrame], run_date: dt.date) -> tuple[str, str, dict]:
    """The rendered report, its digest and its totals."""
    counts = found["done"].agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reject_code").isNotNull()).alias("bad")).first()
    totals = projection.summary(found["judged"], counts["n"], counts["bad"]).first().asDict()
    body, digest = projection.render_report(found["queue"], totals, run_date)
    problems = projection.report_problems(body)
    if problems:
        raise configuration.ConfigError("the report is not as it must be: " + "; ".join(problems))
    return body, digest, totals


def gate_json(spark: SparkSession, found: dict[str, DataFrame], totals: dict, digest: str, run_date: dt.date, mode: str, problems: list[str] = ()) -> dict:
    """The gate of a run as a plain object."""
    every = found["findings"].unionByName(gate.runtime_findings(spark, problems))
    row = gate.gate(every).first()
    counted = lambda df: {r["reason"]: r["n"] for r in df.orderBy("reason").collect()}
    return {
        "command_mode": mode, "run_date": run_date.isoformat(), "status": row["status"], "report_sha256": digest, "sources": [r.asDict() for r in gate.gate_sources(found["metrics"], candidates.SOURCE_ERRORS).collect()], "summary": totals,
        "eligibility_reason_counts": counted(gate.eligibility_reasons(found["judged"])), "findings": [f.asDict() for f in row["findings"]],
    }


def private_marks(body: str, config: configuration.Config) -> list[str]:
    """Private marks of the profile that a text would show."""
    low = fold_word(body)
    return [m for m in config.settings.profile.private_canaries if m and fold_word(m) in low]


def write(path: str | Path, body: str) -> None:
    """A whole file or none: written beside its place, then moved there."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(path.name + ".part")
    beside.write_text(body, encoding="utf-8")
    beside.replace(path)


def _loaded(args, real: bool = False) -> configuration.Config:
    made = configuration.load(Path(args.config).read_text(encoding="utf-8"), real)
    documents = [Path(p).read_text(encoding="utf-8") for p in getattr(args, "context_doc", None) or ()]
    if documents:
        spark = session()
        rows = spark.createDataFrame([(d,) for d in documents], "body string").select(records.context_sections(F.col("body"), CONTEXT_KEYS, SLASHED).alias("s")).collect()
        made = configuration.with_context(made, [r["s"].asDict() for r in rows], max(map(configuration.inferred_years, documents)))
    return made


def _date(value: str | None) -> dt.date:
    return dt.date.fromisoformat(value) if value else dt.datetime.now(dt.timezone.utc).date()


def _landed(spark: SparkSession, made: configuration.Config, run_date: dt.date) -> DataFrame:
    at = dt.datetime.combine(run_date, dt.time())
    registry = records.Registry(lambda s, m: records.manual_candidates(records.manual_rows(s, m["options"]["path"]), m["source_id"], at))
    registry.by_mode["fixture"] = lambda s, m: records.posting_files(s, m["options"].get("path", made.postings), at)
    names = [f.name for f in candidates.CANDIDATE]
    return registry.candidates(spark, made.enabled).select(*names)


def dry_run(args) -> int:
    spark, made, run_date = session(), _loaded(args), _date(args.run_date)
    found = run(spark, made, _landed(spark, made, run_date), run_date, "dry-run", configuration.run_identity(made, run_date, "dry-run"))
    body, _, _ = report(found, run_date)
    if private_marks(body, made):
        return 3
    write(Path(args.output_dir or made.output) / f"{run_date.isoformat()}.md", body)
    if args.print_report:
        print(body)
    return 0


def scheduled_run(args) -> int:
    """A run with gate and, if a history is named, its tables; the same run again changes nothing."""
    spark, made, run_date = session(), _loaded(args, True), _date(args.run_date)
    run_id = configuration.run_identity(made, run_date, "scheduled-run")
    found = run(spark, made, _landed(spark, made, run_date), run_date, "scheduled-run", run_id)
    body, digest, totals = report(found, run_date)
    if private_marks(body, made):
        return 3
    state = gate_json(spark, found, totals, digest, run_date, "scheduled-run")
    if args.history:
        store = history.History(spark, args.history)
        shown = found["queue"].select("recommendation_id", "posting_key", "source_id", "source_posting_id", "title", "company", "location", "deadline", "score", "final_disposition", F.to_json("reason_codes").alias("reason_codes_json"))
        runs = spark.createDataFrame([(run_id, run_date.isoformat(), state["status"], totals["deduplicated"])], "run_id string, run_date string, status string, ranked_count long")
        store.stage(run_id, {"recommendations": shown, "runs": runs.select(F.col("run_id").alias("id"), "run_date", "status", "ranked_count"), "quality_gates": spark.createDataFrame([(json.dumps(state, sort_keys=True, default=str),)], "gate_json string")})
        store.finalize(run_id)
    write(Path(args.output_dir or made.output) / f"{run_date.isoformat()}.md", body)
    write(args.quality_gate_output, json.dumps(state, ensure_ascii=False, indent=2, default=str) + "\n")
    return 1 if state["status"] == "fail" else 0


def _print_rows(df: DataFrame | None) -> int:
    for row in df.toLocalIterator() if df is not None else ():
        print(json.dumps(row.asDict(), ensure_ascii=False, default=str))
    return 0


def scheduled_history(args) -> int:
    found = history.History(session(), args.history).table("recommendations")
    return _print_rows(found if found is None else history.order_recommendations(found))


def feedback_add(args) -> int:
    spark = session()
    at = args.created_at or dt.datetime.now(dt.timezone.utc).isoformat()
    event = spark.createDataFrame([(args.recommendation_id, args.verdict, args.reason, args.movement, at)], "recommendation_id string, verdict string, reason string, movement string, created_at string")
    try:
        return _print_rows(history.History(spark, args.history).add_feedback(event))
    except ValueError as wrong:
        print(wrong, file=sys.stderr)
        return 2


def feedback_export(args) -> int:
    return _print_rows(history.History(session(), args.history).feedback())


def source_status(args) -> int:
    for row in configuration.status_rows(_loaded(args, True)):
        print(json.dumps(row, ensure_ascii=False) if args.json else f"{row['source_id']}\t{row['target_status']}\t{row['target_lane'] or '-'}\t{row['automation_level']}")
    return 0


def _captured(args) -> tuple[DataFrame, DataFrame, dt.date]:
    day = dt.date.fromisoformat(args.date) if args.date else None
    files = records.whole_files(session(), args.files) if args.files else captures.spool(session(), args.spool_dir, day)
    run_date = _date(getattr(args, "run_date", None) or args.date)
    return *captures.import_captures(files, run_date.year, dt.datetime.combine(run_date, dt.time())), run_date


def capture_import(args) -> int:
    spark, made = session(), _loaded(args, True)
    found, _, run_date = _captured(args)
    made_run = run(spark, made, found.select(*[f.name for f in candidates.CANDIDATE]), run_date, "capture-import", configuration.run_identity(made, run_date, "capture-import"), F.lit("manual_only"))
    body, _, _ = report(made_run, run_date)
    if private_marks(body, made):
        return 3
    write(Path(args.output_dir or made.output) / f"{run_date.isoformat()}-captures.md", body)
    if args.print_report:
        print(body)
    return 0


def capture_quality_gate(args) -> int:
    found, problems, run_date = _captured(args)
    row = captures.quality_gate(found, problems).first().asDict()
    state = row | {"selected_date": run_date.isoformat(), "findings": [r.asDict() for r in problems.collect()], "privacy": [r.asDict() for r in captures.privacy_findings(found).collect()]}
    write(args.output, json.dumps(state, ensure_ascii=False, indent=2) + "\n")
    return 1 if row["status"] == "fail" else 0


def context_doctor(args) -> int:
    """Preferences with the given answers; fields that stay open are named."""
    answers = dict(a.split("=", 1) for a in args.answer or ())
    made = _loaded(args, True)
    sections = [{k: [x.strip() for x in v.split(",") if x.strip()] for k, v in answers.items() if k in CONTEXT_KEYS}]
    made = configuration.with_context(made, sections, int(answers.get("max_experience_years", 0)))
    write(args.output, configuration.preferences(made))
    for name in configuration.questions(made):
        print(f"missing: {name}")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sieveline")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, handler, *options: tuple[str, dict]) -> None:
        sub = commands.add_parser(name, help=(handler.__doc__ or name).splitlines()[0])
        sub.set_defaults(handler=handler)
        for option, how in options:
            sub.add_argument(option, **how)

    needed, many, flag = {"required": True}, {"action": "append"}, {"action": "store_true"}
    chosen = [("--config", needed), ("--run-date", {}), ("--context-doc", many), ("--output-dir", {}), ("--print-report", flag)]
    spool = [("--spool-dir", {"default": "captures"}), ("--date", {}), ("--files", many)]
    command("dry-run", dry_run, *chosen)
    command("scheduled-run", scheduled_run, *chosen, ("--quality-gate-output", needed), ("--history", {}))
    command("live-run", scheduled_run, *chosen, ("--quality-gate-output", needed), ("--history", {}))
    command("scheduled-history", scheduled_history, ("--history", needed))
    command(
        "feedback-add", feedback_add, ("--history", needed), ("--recommendation-id", needed), ("--verdict", needed | {"choices": history.VERDICTS}), ("--reason", needed),
        ("--movement", {"default": "same", "choices": history.MOVEMENTS}), ("--created-at", {}),
    )
    command("feedback-export", feedback_export, ("--history", needed))
    command("source-status", source_status, ("--config", needed), ("--json", flag))
    command("capture-import", capture_import, *chosen, *spool)
    command("capture-quality-gate", capture_quality_gate, *spool, ("--output", needed))
    command("context-doctor", context_doctor, ("--config", needed), ("--context-doc", many), ("--answer", many), ("--output", needed))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.handler(args)
    except (configuration.ConfigError, FileNotFoundError) as wrong:
        print(wrong, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
