"""Configuration: a JSON file checked and turned into settings and source manifests. Driver-side; nothing here is data."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
from dataclasses import dataclass, field, replace
from typing import Any

from sieveline.operators.profile import CONTEXT_FIELDS, EDUCATION_CLAIMS, Profile, Settings, Weights

LOCAL_MODES = ("fixture", "manual")
#: Names of the second score's weights, states of a source, what a status row shows.
SECOND_WEIGHTS = ("required", "responsibilities", "role", "preferred", "location")
TARGET_STATUSES = ("enabled", "deferred", "blocked", "excluded")
STATUS_FIELDS = (
    "source_id", "display_name", "enabled", "v1_role", "target_status", "maintenance_status", "target_lane", "candidate_lanes", "automation_level", "status_reason", "evidence", "blockers", "next_action", "adapter_code_path", "test_refs", "docs_refs",
)
LISTS = ("candidate_lanes", "evidence", "blockers", "test_refs", "docs_refs")


class ConfigError(ValueError):
    """What is wrong with a configuration."""


@dataclass(frozen=True)
class Config:
    settings: Settings
    sources: tuple[dict[str, Any], ...] = ()
    postings: str = ""
    output: str = "reports"
    raw: dict[str, Any] = field(default_factory=dict, repr=False)

    @property
    def enabled(self) -> list[dict[str, Any]]:
        return [s for s in self.sources if s["enabled"]]


def _number(data: dict, name: str, default: int, within: str = "") -> int:
    value = data.get(name, default)
    if isinstance(value, bool) or not isinstance(value, int):
        raise ConfigError(f"{within}{name} must be an integer")
    return value


def _object(data: dict, name: str) -> dict:
    value = data.get(name, {})
    if not isinstance(value, dict):
        raise ConfigError(f"{name} must be an object")
    return value


def _weights(data: dict) -> Weights:
    key = "weights" if "weights" in data else "scoring_weights"
    given = _object(data, key)
    version = data.get("scoring_schema_version", 2 if "weights" in data else 1)
    if version not in (1, 2):
        raise ConfigError("scoring_schema_version must be 1 or 2")
    names = SECOND_WEIGHTS if version == 2 else ("required", "preferred", "responsibilities", "company", "location")
    if version == 2 and set(given) != set(names):
        raise ConfigError(f"{key} must name {', '.join(names)}")
    plain = Weights()
    values = {n: _number(given, n, getattr(plain, n, 0), f"{key}.") for n in names}
    if any(v < 0 for v in values.values()) or (sum(values.values()) != 100 if version == 2 else sum(values.values()) <= 0):
        raise ConfigError(f"{key} must not be negative, and add up to {'100' if version == 2 else 'more than 0'}")
    return Weights(**{n: v for n, v in values.items() if n != "role"} | ({"company": 0} if version == 2 else {}))


def _source(given: Any) -> dict[str, Any]:
    if not isinstance(given, dict) or "source_id" not in given:
        raise ConfigError("each source must be an object with a source_id")
    on = bool(given.get("enabled", False))
    defaults = {
        "enabled": on, "access_mode": "", "auth_required": False, "tos_review_status": "unknown", "failure_mode": "skip_source", "display_name": given["source_id"], "v1_role": "", "target_status": "enabled" if on else "deferred",
        "maintenance_status": "active" if on else "watch", "target_lane": None, "automation_level": "no_human" if on else "unknown", "status_reason": "", "next_action": "", "adapter_code_path": "", "domains": [], "options": {},
    }
    return defaults | {k: [] for k in LISTS} | given


def source_problems(sources: list[dict[str, Any]]) -> list[str]:
    """What is wrong with the registry's entries."""
    found, seen = [], set()
    for s in sources:
        name = s["source_id"]
        if not re.fullmatch(r"[a-z0-9][a-z0-9_-]{0,63}", name):
            found.append(f"{name}: source_id must be canonical")
        if name in seen:
            found.append(f"{name}: source_id is not unique")
        seen.add(name)
        if s["target_status"] not in TARGET_STATUSES:
            found.append(f"{name}: invalid target_status: {s['target_status']}")
        if s["target_status"] != "enabled" and s["target_lane"] is not None:
            found.append(f"{name}: {s['target_status']} sources must use target_lane null")
        if not s["enabled"] and s["target_status"] == "enabled":
            found.append(f"{name}: target_status enabled requires enabled=true")
        if s["enabled"] and s["target_status"] != "enabled":
            found.append(f"{name}: enabled source requires target_status=enabled")
        if name == "linkedin" and (s["enabled"] or s["access_mode"] != "manual" or s["target_status"] != "excluded" or s["auth_required"]):
            found.append(f"{name}: only manual captures are allowed")
    return found


def load(body: str, real_sources: bool = False) -> Config:
    """A checked configuration; without ``real_sources`` only local ones may be enabled."""
    try:
        data = json.loads(body)
    except json.JSONDecodeError as wrong:
        raise ConfigError(f"invalid JSON config: {wrong}") from wrong
    if not isinstance(data, dict):
        raise ConfigError("config must be an object")
    top, manual = _number(data, "top_n", 5), _number(data, "manual_review_n", 5)
    if top <= 0 or manual < 0:
        raise ConfigError("top_n must be greater than zero and manual_review_n not negative")
    limits = _object(data, "thresholds")
    apply, hold = _number(limits, "apply", 75, "thresholds."), _number(limits, "hold", 50, "thresholds.")
    if apply <= hold:
        raise ConfigError("thresholds.apply must be greater than thresholds.hold")
    person, claim = _object(data, "profile"), _object(data, "advanced").get("education_claim")
    if claim is not None and claim not in EDUCATION_CLAIMS:
        raise ConfigError(f"advanced.education_claim must be one of: {', '.join(sorted(EDUCATION_CLAIMS))}")
    lists = {k: tuple(person.get(k, ())) for k in ("desired_roles", "skills", "preferred_locations", "exclusions", "private_canaries")}
    profile = Profile(**lists, max_experience_years=_number(person, "max_experience_years", 0, "profile."), education_claim=claim)
    given = data.get("sources", [])
    if not isinstance(given, list):
        raise ConfigError("sources must be an array")
    sources = [_source(s) for s in given]
    problems = source_problems(sources)
    blocked = [s["source_id"] for s in sources if s["enabled"] and not real_sources and s["access_mode"] not in LOCAL_MODES]
    if blocked:
        problems.append("real sources are disabled for a run without network: " + ", ".join(blocked))
    if not any(s["enabled"] for s in sources):
        problems.append("at least one source must be enabled")
    if problems:
        raise ConfigError("; ".join(problems))
    settings = Settings(profile, _weights(data), apply, hold, top, manual)
    return Config(settings, tuple(sources), str(data.get("fixture_path", "")), str(data.get("output_dir", "reports")), data)


def status_rows(config: Config) -> list[dict[str, Any]]:
    """What the registry says of every source."""
    return [{k: s[k] for k in STATUS_FIELDS} | {"policy_override_mode": s["options"].get("policy_override_mode")} for s in config.sources]


def with_context(config: Config, sections: list[dict[str, list[str]]], years: int | None = None) -> Config:
    """The configuration with a person's documents: values of all, each once whatever its case, those of the configuration first; the most years."""
    p = config.settings.profile
    merged = {}
    for name in ("desired_roles", "skills", "preferred_locations", "exclusions"):
        values: dict[str, str] = {}
        for v in (*getattr(p, name), *(x for s in sections for x in s.get(name, ()))):
            values.setdefault(v.lower(), v)
        merged[name] = tuple(values.values())
    profile = replace(p, **merged, max_experience_years=max(p.max_experience_years, years or 0))
    return replace(config, settings=replace(config.settings, profile=profile))


def inferred_years(body: str, most: int = 20) -> int:
    """The largest number of years of experience that a document speaks of, up to ``most``; 0 without any."""
    found = [int(n) for n in re.findall(r"(\d{1,2})\s*(?:년|years?)", body, re.I)]
    return max((n for n in found if n <= most), default=0)


def fingerprint(documents: list[str]) -> str:
    """A digest of a person's documents that trailing blanks and line ends do not change."""
    plain = ["\n".join(line.rstrip() for line in d.replace("\r\n", "\n").split("\n")).rstrip() for d in documents]
    return hashlib.sha256(json.dumps(plain, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def run_identity(config: Config, run_date: dt.date, mode: str) -> str:
    """24 hex digits that tell runs of other dates, modes, sources or profiles apart."""
    about = {"date": run_date.isoformat(), "mode": mode, "profile": config.raw.get("profile", {}), "sources": [s["source_id"] for s in config.enabled], "thresholds": [config.settings.apply, config.settings.hold]}
    return hashlib.sha256(json.dumps(about, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:24]


def questions(config: Config) -> list[str]:
    """Fields that a person should still tell."""
    return [f for f in CONTEXT_FIELDS if not getattr(config.settings.profile, f)]


def preferences(config: Config) -> str:
    """The profile as a context document."""
    p = config.settings.profile
    rows = {"Roles": p.desired_roles, "Skills": p.skills, "Locations": p.preferred_locations, "Experience": (f"{p.max_experience_years} years",) if p.max_experience_years else (), "Deal Breakers": p.exclusions}
    return "# Preferences\n\n" + "".join(f"{k}: {', '.join(v)}\n" for k, v in rows.items())
