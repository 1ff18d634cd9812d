"""Text of posting fields: decoding, normal forms, folding, entities, tags.

What built-in expressions can do exactly stays built in. Entities, backslash
escapes and Unicode composition have no built-in form; texts that may hold one
go through an Arrow UDF, all others pass it as nulls.
"""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

import sieveline

# Functions that run on executors travel by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sieveline)

#: Characters that a backslash protects, and the control characters it names.
ESCAPED = "!#$%&()*+,-./:;<=>?@[\\]^_`{|}~\"'"
NAMED = {"n": "\n", "r": "\r", "t": "\t"}
_ESCAPE = re.compile(r"\\([" + re.escape(ESCAPED) + "nrt])")
#: Below U+0300 and among the Hangul syllables nothing composes.
_PLAIN = r"^[\x00-\x25\x27-\x5B\x5D-˿가-힣]*$"
BLANKS = r"(?U)[\s\x1C-\x1F]+"


def decode_one(value: str) -> str:
    """Entities, then one level of backslash escapes, then composed characters."""
    return unicodedata.normalize("NFC", _ESCAPE.sub(lambda m: NAMED.get(m[1], m[1]), html.unescape(value)))


@F.pandas_udf(T.StringType())
def _decoded(texts: pd.Series) -> pd.Series:
    return texts.map(decode_one, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _decoded_items(lists: pd.Series) -> pd.Series:
    return lists.map(lambda xs: [None if x is None else decode_one(x) for x in xs], na_action="ignore")


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


_CLOSED = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def unescape_closed_one(value: str) -> str:
    """Only references that a semicolon ends; one that a cut has left open is text."""
    return _CLOSED.sub(lambda m: html.unescape(m[0]) if m[1][0] == "#" or m[1] + ";" in html.entities.html5 else m[0], value)


@F.pandas_udf(T.StringType())
def _unescaped_closed(texts: pd.Series) -> pd.Series:
    return texts.map(unescape_closed_one, na_action="ignore")


def decode(c: Column) -> Column:
    """The text without entities and escapes, composed; null stays null."""
    plain = c.rlike(_PLAIN)
    return F.when(plain, c).otherwise(_decoded(F.when(~plain, c)))


def decode_items(c: Column) -> Column:
    """``decode`` for every item of an array."""
    odd = F.exists(c, lambda x: ~x.rlike(_PLAIN))
    return F.when(F.coalesce(odd, F.lit(False)), _decoded_items(F.when(odd, c))).otherwise(c)


def unescape(c: Column, closed: bool = False) -> Column:
    """The text without entities; ``closed``: only those that a semicolon ends."""
    held = c.contains("&")
    return F.when(held, (_unescaped_closed if closed else _unescaped)(F.when(held, c))).otherwise(c)


def collapse(c: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def fold(c: Column) -> Column:
    """For comparison: lower case with the sharp s and the final sigma spelled out, white space collapsed."""
    return collapse(F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ")))


def fold_word(word: str) -> str:
    """``fold`` of a literal."""
    return " ".join(word.lower().replace("ß", "ss").replace("ς", "σ").split())


def scalar(c: Column) -> Column:
    """Decoded and collapsed; empty is null."""
    return F.nullif(collapse(decode(c)), F.lit(""))


def scalar_or_empty(c: Column) -> Column:
    """Decoded and collapsed; null is empty."""
    return F.coalesce(collapse(decode(c)), F.lit(""))


def items(c: Column) -> Column:
    """Items decoded and collapsed, without empty ones, in order; null is no items."""
    clean = F.transform(decode_items(c), collapse)
    return F.coalesce(F.filter(clean, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def strip_tags(c: Column) -> Column:
    """Text between tags, entities decoded, collapsed."""
    return collapse(unescape(F.regexp_replace(c, "<[^>]*>", " ")))
