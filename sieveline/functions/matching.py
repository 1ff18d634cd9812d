"""Matching and shaping of posting fields: URLs, keyword lists, roles, requirement lines, identity keys, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions.text import collapse, fold, fold_word, strip

#: Longest URL, forms of a URL and an address, lengths of shown items.
URL_LIMIT = 2048
MOST_LINES, LINE_LIMIT, WHOLE_LIMIT = 8, 180, 240
_URL = r"^[Hh][Tt][Tt][Pp][Ss]://([^/?#@:\[\]\\]+)(?::([0-9]{0,5}))?(/[^?#]*)?(?:[?#].*)?$"
_OCTETS = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.|$)){4}$"

#: Weights of the score's components, penalty of an experience gap of one year.
WEIGHTS = {"required": 40, "responsibilities": 20, "role": 20, "preferred": 10, "location": 10}
GAP_PENALTY = 10
#: Priority of labels in a report.
LABEL_PRIORITY = {"apply": 0, "hold": 1, "manual_review": 2, "low_priority": 3, "exclude": 4, "expired": 5}


def canonical_url(url: Column) -> Column:
    """Canonical https URL without query and fragment, else null; hosts must be ASCII names or IPv4 addresses."""
    host, port, path = F.lower(F.regexp_extract(url, _URL, 1)), F.regexp_extract(url, _URL, 2), F.regexp_extract(url, _URL, 3)
    number = F.coalesce(F.nullif(port, F.lit("")).cast("int"), F.lit(443))
    good = (
        (F.length(url) <= URL_LIMIT) & ~url.rlike(r"(?U)[\s\x00-\x1f\x7f]") & ~F.regexp_replace(url, "%[0-9a-fA-F]{2}", "").contains("%") & url.rlike(_URL)
        & host.rlike(r"^[\x21-\x7e]{1,253}$") & ~host.rlike(r"(^|\.)(\.|-|$)|-(\.|$)|[^.]{64}")
        & (~host.rlike(r"^[0-9]+(\.[0-9]+){3}$") | host.rlike(_OCTETS)) & number.between(1, 65535) & path.rlike(r"^[A-Za-z0-9._~/!$&'()*+,;=:@%-]*$")
    )
    coded = F.array_join(F.transform(F.split(F.regexp_replace(path, "/+", "/"), "%"), lambda x, i: F.when(i > 0, F.concat(F.upper(F.left(x, F.lit(2))), F.substring(x, 3, URL_LIMIT))).otherwise(x)), "%")
    trimmed = F.regexp_replace(coded, "/+$", "")
    return F.when(good, F.concat(F.lit("https://"), host, F.when(number == 443, "").otherwise(F.concat(F.lit(":"), number.cast("string"))), F.when(trimmed == "", "/").otherwise(trimmed)))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether the lower-cased text holds one of the words; false for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for w in words:
        found = found | low.contains(w.lower())
    return found


def keyword_filter(text: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Excluded words reject first; then one of the included words is needed, if there are any."""
    return ~contains_any(text, exclude) & (contains_any(text, include) if include else F.lit(True))


def role_match(text: Column, roles: Sequence[str]) -> Column:
    """Whether the folded text holds a whole role, or all of its parts between slashes; blank roles match nothing."""
    low = fold(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for role in filter(None, map(fold_word, roles)):
        parts = [p.strip() for p in role.split("/") if p.strip()]
        every = F.lit(bool(parts))
        for p in parts:
            every = every & low.contains(p)
        found = found | low.contains(role) | every
    return found


def known_terms(text: Column, terms: Sequence[str]) -> Column:
    """Those of the terms that the text holds, in their order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, F.lower(t)))


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters; a longer text ends in an ellipsis, without white space before it."""
    return F.when(F.length(text) > limit, F.concat(F.regexp_replace(F.left(text, F.lit(limit - 1)), r"(?U)[\s\x1C-\x1F]+$", ""), F.lit("…"))).otherwise(text)


def requirement_lines(text: Column, most: int = MOST_LINES, limit: int = LINE_LIMIT, whole: int = WHOLE_LIMIT) -> Column:
    """The first lines and bullets of a section, white space collapsed, each cut to ``limit`` characters; a text that has none but is not empty is one line, cut to ``whole``."""
    lines = F.filter(F.transform(F.split(text, "[\n•ㆍ]+"), collapse), lambda x: x != "")
    found = F.transform(F.slice(lines, 1, most), lambda x: truncate(x, limit))
    return F.when((F.size(found) == 0) & (text != ""), F.array(truncate(text, whole))).otherwise(found)


def section_lines(text: Column, headings: Sequence[str], window: int = 1200) -> Column:
    """Lines after the first heading, in the order of headings, that the text holds in any case: the second to the fifth of its window, or else up to three."""
    low = F.lower(text)
    at = F.coalesce(*[F.nullif(F.locate(h.lower(), low), F.lit(0)) for h in headings])
    lines = requirement_lines(F.substr(text, at, F.lit(window)))
    after = F.slice(lines, 2, 4)
    return F.when(at.isNull(), F.array().cast("array<string>")).when(F.size(after) > 0, after).otherwise(F.slice(lines, 1, 3))


def ordered_distinct(items: Column) -> Column:
    """Items with white space collapsed, without blanks, each at its first place."""
    return F.array_distinct(F.filter(F.transform(items, collapse), lambda x: x.isNotNull() & (x != "")))


def section(text: Column, starts: Sequence[str], ends: Sequence[str]) -> Column:
    """Text after the earliest start marker up to the nearest end marker after it, or to the end, without white space around it; empty without a start."""

    def least(t: Column, markers: Sequence[str]) -> Column:
        """(position, length) of the first marker; of those at one place, the first listed."""
        at = [F.struct(F.nullif(F.locate(m, t), F.lit(0)).alias("at"), F.lit(i).alias("i"), F.lit(len(m)).alias("n")) for i, m in enumerate(markers)]
        return F.array_min(F.filter(F.array(*at), lambda x: x["at"].isNotNull()))

    start = least(text, starts)
    rest = F.substr(text, start["at"] + start["n"])
    end = least(rest, ends)
    cut = F.when(end.isNotNull(), F.substr(rest, F.lit(1), end["at"] - 1)).otherwise(rest)
    return F.when(text.isNull(), F.lit(None).cast("string")).when(start.isNull(), "").otherwise(strip(cut))


def hashed_key(prefix: str, basis: Column, within: str | None = None) -> Column:
    """First 32 hex digits of the SHA-256 of the prefix, a NUL, (``within`` and another NUL,) and the canonical JSON of a struct."""
    nul = F.unhex(F.lit("00"))
    head = [F.lit(prefix).cast("binary"), nul] + ([] if within is None else [F.lit(within).cast("binary"), nul])
    return F.left(F.sha2(F.concat(*head, F.to_json(basis, {"ignoreNullFields": "false"}).cast("binary")), 256), F.lit(32))


def component(weight: int, num: Column, den: Column) -> Column:
    """weight * num / den, halves up; 0 where there is nothing to divide by."""
    return F.when(den > 0, F.floor((2 * weight * num + den) / (2 * den))).otherwise(0).cast("long")


def total_score(parts: dict[str, tuple[Column, Column]], gap: Column) -> Column:
    """The sum of the unrounded components, halves up, less the gap penalty, within 0 to 100."""
    total = F.lit(0).cast("decimal(28,12)")
    for name, (num, den) in parts.items():
        total = total + F.when(den > 0, (WEIGHTS[name] * num).cast("decimal(18,0)") / den.cast("decimal(9,0)")).otherwise(0).cast("decimal(28,12)")
    raw = F.round(F.round(total, 9), 0).cast("long") - F.when(gap == 1, GAP_PENALTY).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("long")


def disposition(invalid: Column, gap: Column, expired: Column, dealbreaker: Column, manual: Column, score: Column, apply: int = 75, hold: int = 50) -> Column:
    """One label by fixed precedence; a gap holds a posting even if it has expired."""
    return (
        F.when(invalid, "exclude").when(gap > 0, "hold").when(expired, "expired").when(dealbreaker, "exclude")
        .when(manual, "manual_review").when(score >= apply, "apply").when(score >= hold, "hold").otherwise("low_priority")
    )


def label_priority(label: Column) -> Column:
    """Place of a label in report order."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in LABEL_PRIORITY.items() for x in kv]), label)
