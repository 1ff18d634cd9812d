"""Secret scans: keyword automaton, anchored patterns near its hits, checksum validation.

One pass of an Aho-Corasick automaton over a batch of texts finds the keywords
(ASCII letters in either case). An anchored pattern runs only where a keyword
starts; hexadecimal runs, which have no keyword, are anchored by a stride
sample that every run of the least length must touch. Kinds whose format
embeds a checksum are kept only if it holds.

Rows: every input row gives one row. A null or empty text has no spans.
Positions are code points, the end exclusive. Overlapping spans of different
kinds all stay; within a kind matches are leftmost and do not overlap.
Repeated rows are scanned each for itself; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.common import map_texts, table

#: Base kinds in their fixed order, then the kinds this method adds.
BASE = ("assign", "access", "hex")
ADDED = ("github", "npm", "jwt", "pem")
KINDS = BASE + ADDED

#: Keyword (lower case) and the kinds that may start with it.
KEYWORDS = {
    "password": ("assign",), "passwd": ("assign",), "secret": ("assign",), "token": ("assign",), "apikey": ("assign",), "api_key": ("assign",),
    "akia": ("access",),
    "ghp_": ("github",), "gho_": ("github",), "ghu_": ("github",), "ghs_": ("github",), "ghr_": ("github",),
    "npm_": ("npm",),
    "eyj": ("jwt",),
    "-----begin ": ("pem",),
}
PATTERNS = {
    "assign": rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": rb"AKIA[A-Z0-9]+",
    "github": rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "npm": rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "jwt": rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "pem": rb"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
STRIDE = 4
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: bytes) -> bytes:
    """CRC-32 of a token's random part as six base-62 digits."""
    value, out = binascii.crc32(body), bytearray()
    for _ in range(6):
        value, digit = divmod(value, 62)
        out.append(BASE62[digit])
    return bytes(reversed(out))


def accepted(kind: str, found: re.Match) -> bool:
    """Whether a match satisfies its kind's length or checksum."""
    text = found.group()
    if kind == "assign":
        return len(found.group(1)) >= LEAST_VALUE
    if kind == "access":
        return len(text) >= LEAST_ACCESS
    if kind in ("github", "npm"):
        return checksum62(text[4:-6]) == text[-6:]
    if kind == "jwt":
        head = text.split(b".", 1)[0]
        try:
            return isinstance(json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4))), dict)
        except (ValueError, RecursionError):  # no JSON, or nested beyond any header
            return False
    return True


def hex_runs(blob: bytes) -> list[tuple[int, int]]:
    """Maximal runs of lower-case hexadecimal digits of the least length or more."""
    raw = np.frombuffer(blob, np.uint8)
    sample = raw[::STRIDE]
    digit = ((sample >= 48) & (sample <= 57)) | ((sample >= 97) & (sample <= 102))
    need = LEAST_HEX // STRIDE  # so many samples in a row lie in any run that is long enough
    if len(digit) < need:
        return []
    run = digit[: len(digit) - need + 1].copy()
    for k in range(1, need):
        run &= digit[k : len(digit) - need + 1 + k]
    spans, last, body = [], -1, re.compile(rb"[0-9a-f]+")
    for at in (np.flatnonzero(run) * STRIDE).tolist():
        if at < last:
            continue
        start = at
        while start > 0 and blob[start - 1] in b"0123456789abcdef":
            start -= 1
        last = body.match(blob, start).end()
        if last - start >= LEAST_HEX:
            spans.append((start, last))
    return spans


def find_spans(texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind number) in code points for each text, by start, then kind."""
    import ahocorasick

    blob = b"\0".join(texts)  # no pattern matches a NUL, so none crosses texts
    machine = ahocorasick.Automaton()
    for word, kinds in KEYWORDS.items():
        machine.add_word(word, (len(word), kinds))
    machine.make_automaton()
    hits: dict[str, list[int]] = {k: [] for k in PATTERNS}
    for end, (length, kinds) in machine.iter(blob.lower().decode("latin-1")):
        for kind in kinds:
            hits[kind].append(end + 1 - length)
    spans = [(s, e, KINDS.index("hex")) for s, e in hex_runs(blob)]
    for kind, starts in hits.items():
        pattern, last = re.compile(PATTERNS[kind]), -1
        for at in sorted(set(starts)):
            if at >= last and (found := pattern.match(blob, at)):
                last = found.end()
                if accepted(kind, found):
                    spans.append((at, last, KINDS.index(kind)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not spans:
        return out
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(blob, np.uint8) & 0xC0) != 0x80)])
    spans.sort(key=lambda s: (s[0], s[2]))
    owner = np.searchsorted(begins, [s for s, _, _ in spans], "right") - 1
    for (s, e, k), doc in zip(spans, owner.tolist(), strict=True):
        base = points[begins[doc]]
        out[doc].append((int(points[s] - base), int(points[e] - base), k))
    return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def scan_secrets(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default: all but the text) and ``secret_spans``, an array of (kind, start, end)."""
    added = T.StructType([T.StructField("secret_spans", T.ArrayType(SPAN))])

    def scan(texts: list[bytes]) -> list[pa.Array]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        return [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in one] for one in find_spans(texts)], pa.list_(kind))]

    return map_texts(df, text, [c for c in df.columns if c != text] if keep is None else keep, added, scan)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, for every whole text of documents."""
    found = scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    spans = F.col("secret_spans")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), joined(spans).alias("spans"),
    )
