"""Scalar expressions: normalization and validation of posting fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions import text

#: Longest identifier, form of a source id, form of a date.
IDENTIFIER_LIMIT = 256
SOURCE_ID = r"\A[a-z0-9][a-z0-9_-]{0,63}\z"
ISO_DATE = r"\A\d{4}-\d{2}-\d{2}\z"
CONTROL = r"[\x00-\x1f\x7f]"


def normalize_scalar(c: Column) -> Column:
    """Entities and escapes decoded, composed, white space collapsed to single spaces and trimmed; empty is null."""
    return text.scalar(c)


def normalize_list(c: Column) -> Column:
    """Every item as by ``normalize_scalar``, without empty ones, in order."""
    return text.items(c)


def source_id(c: Column) -> Column:
    """Normalized lower-case source id, null if it is not ASCII: a letter or digit followed by at most 63 of ``a-z0-9_-``."""
    plain = normalize_scalar(c)
    return F.when(plain.rlike(r"\A[\x00-\x7F]*\z") & F.lower(plain).rlike(SOURCE_ID), F.lower(plain))


def identifier(c: Column) -> Column:
    """The normalized identifier, null if it has a control character before or after, is empty or has over 256 characters."""
    plain = normalize_scalar(c)
    return F.when(~c.rlike(CONTROL) & ~plain.rlike(CONTROL) & (F.length(plain) <= IDENTIFIER_LIMIT), plain)


def deadline(c: Column) -> Column:
    """An ISO date, else null."""
    return F.when(c.rlike(ISO_DATE), F.try_to_date(c, "yyyy-MM-dd"))


def deadline_uncertain(c: Column) -> Column:
    """Whether there is no deadline to go by: none given, or not a date."""
    return deadline(c).isNull()


#: Residue of style sheets in extracted text.
STYLE_NOISE = (
    r"(?is)@(?:-webkit-)?keyframes\s+[^{\s]+\{.*?\}",
    r"\.[A-Za-z0-9_-]+\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}",
    r"\b(?:display|align-items|justify-content|box-shadow|pointer-events|white-space|overflow|font-family|animation|opacity|color|height|width):[^;}]+[;}]",
    r"(?U)(?<!\w)[0-9A-Fa-f]{6};",
)


def style_noise(c: Column) -> Column:
    """Without what style sheets leave in extracted text: animations, rules, properties, colours."""
    for pattern in STYLE_NOISE:
        c = F.regexp_replace(c, pattern, " ")
    return c


def without_tags(c: Column, closed: bool = False) -> Column:
    """Text between tags, entities (``closed``: as in ``text.unescape``) decoded, without style residue, white space collapsed."""
    return text.collapse(style_noise(text.unescape(F.regexp_replace(c, r"<[^>]+>", " "), closed)))


def visible_text(html: Column, closed: bool = False) -> Column:
    """Text of a page: scripts and styles go with their contents, then as ``without_tags``."""
    return without_tags(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), closed)
