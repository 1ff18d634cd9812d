"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed entry is a host and a path; it fits its host and all subdomains where
the URL's path starts with the entry's. A URL's possible entries are its host
tails and path heads of the shapes (labels, characters) that the list has. A
blocked Bloom filter (one 64-bit block a key) passes possible hits; the hash
join with the list removes its false positives. The longest entry wins, ties
go to the longer host, then the greater entry.

Rows: every page gives one row, repeated rows too. A null URL or one without
``://`` has empty host and path and no entry. What no entry fits is not listed
and gets the default verdict. Other columns of the input pass through; ``host``,
``path``, ``rule`` and ``verdict`` replace columns of these names.
An empty list gives every page the default; an empty table gives an empty one.

Scale: the filter has one block per ``KEYS_PER_BLOCK`` entries, at most
``MAX_BLOCKS`` (a larger list only raises the share passed to the exact join).
The list is broadcast up to ``BROADCAST_ENTRIES``, and pages with at most
``QUICK`` possible hits, which is nearly all, are joined in place, one hit after
another, without a shuffle; pages with more take a row a hit and meet again.
Beyond that size the list is joined by a salted shuffle, since one entry may fit
a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import table

BITS, KEYS_PER_BLOCK, MIN_BLOCKS, MAX_BLOCKS = 4, 4, 64, 1 << 17
BROADCAST_ENTRIES, SALTS, QUICK = 100_000, 32, 3
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks)).cast("int")


def mask_of(key: Column) -> Column:
    """The bits of a key within its block."""
    h = F.xxhash64(key, F.lit(2))
    mask = F.lit(0).cast("bigint")
    for k in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def bloom(keys: DataFrame, key: str, blocks: int) -> Column:
    """All blocks in order as a scalar array."""
    filled = keys.groupBy(block_of(F.col(key), blocks).alias("b")).agg(F.bit_or(mask_of(F.col(key))).alias("w"))
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("b")).join(filled, "b", "left")
    rows = every.agg(F.array_sort(F.collect_list(F.struct("b", F.coalesce("w", F.lit(0).cast("bigint")).alias("w")))).alias("a"))
    return rows.select(F.transform("a", lambda x: x["w"])).scalar()


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", keep: list[str] | None = None, default: str = "allow") -> DataFrame:
    """The ``keep`` columns with ``host``, ``path``, ``rule`` and ``verdict``; ``listed`` has host, path, verdict, one row an entry."""
    entries = listed.filter("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("rule", F.concat("host", "path"))
    shapes = entries.groupBy(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).count().collect()  # as many as the list has shapes
    size = sum(r["count"] for r in shapes)
    blocks = max(MIN_BLOCKS, min(MAX_BLOCKS, -(-size // KEYS_PER_BLOCK)))
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(f"`{url}`").cast("string"))
    seen = pages.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"))
    if not shapes:
        return seen.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    tail = lambda n: F.substring_index("host", ".", -n)
    fits = lambda n, c: (F.size(F.split("host", r"\.", n + 1)) >= n) & (F.length("path") >= c)
    possible = F.array_compact(F.array(*[F.when(fits(r.labels, r.chars), F.concat(tail(r.labels), F.substr("path", F.lit(1), F.lit(r.chars)))) for r in shapes]))
    words = bloom(entries, "rule", blocks)
    passed = F.filter(possible, lambda k: F.get(F.col("__bloom"), block_of(k, blocks)).bitwiseAND(mask_of(k)) == mask_of(k))
    rows = seen.withColumn("__row", F.monotonically_increasing_id()).withColumn("__bloom", words)
    right = entries.select(F.col("rule").alias("__key"), F.struct(F.length("rule").alias("n"), F.length("host").alias("h"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict")).alias("__hit"))
    right = right.groupBy("__key").agg(F.max("__hit").alias("__hit"))
    names = [*[f"`{c}`" for c in keep], "host", "path"]
    told = lambda df: df.select(*names, F.col("__hit.rule").alias("rule"), F.coalesce("__hit.verdict", F.lit(default)).alias("verdict"))
    passing = rows.withColumn("__keys", passed).drop("__bloom")
    many = passing
    if size <= BROADCAST_ENTRIES:
        quick = passing.filter(F.size("__keys") <= QUICK)
        for k in range(QUICK):
            one = right.select(F.col("__key").alias(f"__key{k}"), F.col("__hit").alias(f"__hit{k}"))
            quick = quick.join(F.broadcast(one), F.get("__keys", F.lit(k)) == F.col(f"__key{k}"), "left")
        quick = told(quick.withColumn("__hit", F.greatest(*[F.col(f"__hit{k}") for k in range(QUICK)])))
        many = passing.filter(F.size("__keys") > QUICK)
    hits = many.select("__row", *names, F.explode_outer("__keys").alias("__key"))
    if size <= BROADCAST_ENTRIES:
        joined = hits.join(F.broadcast(right), "__key", "left")
    else:
        salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = hits.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int")).join(salted, ["__key", "__salt"], "left")
    slow = told(joined.groupBy("__row", *names).agg(F.max("__hit").alias("__hit")))
    return quick.unionAll(slow) if size <= BROADCAST_ENTRIES else slow


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    rows = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)
    listed = spark.sql(f"SELECT * FROM VALUES {rows} AS r(host, path, verdict)")  # a relation of literals, no Python rows
    return judge(table(spark, sf_dir, "pages"), listed, keep=["page_id"])


SQL = """
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, n, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, n, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM v),
m AS (SELECT p.n, max({'len': length(r.host) + length(r.path), 'rule': r.host || r.path, 'verdict': r.verdict}) AS hit
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.n)
SELECT p.page_id, p.host, p.path, m.hit.rule AS rule, coalesce(m.hit.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.n = m.n
"""
