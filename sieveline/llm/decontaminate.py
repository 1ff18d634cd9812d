"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Documents and items are sequences of lower-case words; a shingle is five of
them and its weight is its number of occurrences. A window is as many words of
a document as an item has, or the whole document if it has fewer. It matches
the item if the weighted Jaccard similarity of their shingles is at least
``threshold``.

Windows: every window of an item's size counts, at any place, and one that
matches shares eight ninths of its shingles with the item at least (with
threshold 0.8); windows that hold fewer places of the item's shingles than that
match nothing and are not built, all others are, whatever the order of what they
share. Shared shingles pass a fixed bit table of the items' shingles first and
then an exact hash join. Each window's 64-bit SimHash is cut into ``RADIUS`` + 1
blocks; two fingerprints within the radius agree in one block at least, so the
join on blocks (and on the item's size) guarantees every fingerprint within the
radius. What it finds is verified on the shingles themselves. At similarity 0.8
fingerprints differ in about 10 bits of 64, deviation 3; the radius lies five
deviations out, which leaves blocks of two or three bits, so it is the size and
the radius itself that tell candidates apart.

Items of fewer than five words have one shingle, their whole sequence, and
match it only where a document has these words in a row.

Rows: a result row is a (document id, item id) with the number of windows that
match and the best similarity; documents and items with no words match nothing;
null ids are kept as ids. Repeated documents with one id count their windows
once, and rows of one id are told apart by 128 bits of their texts; repeated
items with one id are told apart by text and joined in the result. Empty tables give an empty result. Columns other than those named do
not take part.

Only DataFrame functions are used. The benchmark is broadcast up to
``BROADCAST_SHINGLES`` shingles and beyond that joined by a shuffle of the
shared shingles, which no document-wide key can skew: they are dealt by shingle
with salts for frequent ones. A document's shingles are read again in runs of
``RUN`` places, so a very long one that repeats a passage is no single row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import bit_table, materialize, release, salted_join, table

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 24
TABLE_WORDS = 1 << 14
RUN = 4096
BROADCAST_SHINGLES = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), r"[\x20\t-\r]+"), lambda w: w != "")


def shingles_of(words: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words, in order."""
    return F.when(
        F.size(words) >= n,
        F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(*[F.get(words, i - 1 + k) for k in range(n)])),
    ).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> Column:
    """64-bit fingerprint: bit b is set if most occurrences have it set. Counters of 16 bits, four to a number: up to 65,535 shingles."""
    every = F.lit(0x0001000100010001).cast("bigint")

    def lane(k: int) -> Column:
        return F.aggregate(shingles, F.lit(0).cast("bigint"), lambda n, h: n + F.shiftrightunsigned(h, k).bitwiseAND(every))

    lanes, bits = [lane(k) for k in range(16)], []
    for b in range(64):
        ones = F.shiftrightunsigned(lanes[b % 16], 16 * (b // 16)).bitwiseAND(F.lit(0xFFFF).cast("bigint"))
        one = (1 << b) - (1 << 64 if b == 63 else 0)
        bits.append(F.when(ones * 2 > F.size(shingles), F.lit(one).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def blocks_of(fingerprint: Column, radius: int) -> Column:
    """(block number, bits) of the blocks into which the 64 bits are cut."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftright(fingerprint, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("bits")) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))])


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of least over sum of greatest occurrences."""
    both = F.array_intersect(a, b)
    times = lambda s, h: F.size(F.filter(s, lambda x: x == h))
    simple = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))  # then no shared shingle counts twice
    low = F.when(simple, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda n, h: n + F.least(times(a, h), times(b, h))))
    return low / (F.size(a) + F.size(b) - low)


def starts_of(hits: Column, need: Column, size: Column, last: Column) -> Column:
    """Starts, up to ``last``, of all windows of ``size`` shingles that hold ``need`` of the sorted places ``hits``: with hits j to j + need - 1 inside, a window begins between the last of them less size - 1 and the first."""
    spans = F.transform(F.sequence(F.lit(0), F.size(hits) - need), lambda j: F.struct(F.greatest(F.lit(0), F.get(hits, j + need - 1) - size + 1).alias("a"), F.least(F.get(hits, j), last).alias("b")))
    return F.array_distinct(F.flatten(F.transform(F.filter(spans, lambda x: x["a"] <= x["b"]), lambda x: F.sequence(x["a"], x["b"]))))


def text_keys(column: Column) -> list[Column]:
    return [F.xxhash64(column).alias("v1"), F.xxhash64(F.lit(1), column).alias("v2")]


def find_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(id, item_id, n_windows, similarity) for every document with a window that matches an item."""
    bench = items.select(F.col(f"`{item_id}`").alias("item_id"), words_of(F.col(f"`{item_text}`")).alias("w"))
    worded = materialize(bench.select("item_id", F.size("w").alias("len"), F.least(F.size("w"), F.lit(SHINGLE)).alias("n"), "w"), "bench-words")
    widths = list(range(1, SHINGLE + 1))
    per_width = reduce(lambda acc, n: F.when(F.col("n") == n, shingles_of(F.col("w"), n)).otherwise(acc), widths[:-1], shingles_of(F.col("w"), SHINGLE))
    bench = worded.filter("len > 0").select("item_id", "len", "n", per_width.alias("item_s"))
    bench = materialize(bench.select("*", F.struct(F.xxhash64("item_s", "len").alias("a"), F.xxhash64(F.lit(1), "item_s", "len").alias("b")).alias("item_key")), "bench")
    release(worded)
    facts = bench.select(F.sum(F.size("item_s")).alias("total"), F.collect_set("n").alias("widths")).first()
    if not facts["total"]:
        return docs.select(F.col(f"`{id_col}`").alias("id")).limit(0).select("id", F.lit(None).cast(items.schema[item_id].dataType).alias("item_id"), F.lit(0).cast("long").alias("n_windows"), F.lit(0.0).alias("similarity"))
    known = bench.select("item_key", "len", "n", F.explode("item_s").alias("h")).distinct()
    small = facts["total"] <= BROADCAST_SHINGLES
    bits, test = bit_table(known.select("h"), TABLE_WORDS)
    body = F.col(f"`{text}`")

    # explode_outer: an inner explode would let a filter on the array be pushed into the lambdas, where the text is split anew for every shingle
    split = docs.select(F.col(f"`{id_col}`").alias("id"), *text_keys(body), words_of(body).alias("w"))
    found = []
    for n in sorted(facts["widths"]):  # five at most
        s = split.select("id", "v1", "v2", shingles_of(F.col("w"), n).alias("s")).withColumn("__bits", bits)
        hits = F.filter(F.transform("s", lambda h, i: F.struct(i.alias("i"), h.alias("h"))), lambda x: test(F.col("__bits"), x["h"]))
        spots = s.select("id", "v1", "v2", F.size("s").alias("have"), F.explode_outer(hits).alias("x")).filter("x IS NOT NULL").select("id", "v1", "v2", "have", "x.i", "x.h")
        mine = known.filter(F.col("n") == n).select("h", "item_key", "len")
        if small:
            joined = spots.join(F.broadcast(mine), "h")
        else:
            per = mine.groupBy("h").agg(F.collect_set(F.struct("item_key", "len")).alias("at"))
            joined = salted_join(spots, per, "h").select("id", "v1", "v2", "have", "i", F.explode("at").alias("at")).select("id", "v1", "v2", "have", "i", "at.*")
        found.append(joined.select("id", "v1", "v2", "have", F.lit(n).alias("n"), "len", "item_key", "i"))
    pairs = reduce(DataFrame.unionByName, found).groupBy("id", "v1", "v2", "n", "len", "item_key").agg(F.max("have").alias("have"), F.array_sort(F.collect_set("i")).alias("hits"))
    size = F.col("len") - F.col("n") + 1
    window = F.least(size, F.col("have"))  # a text shorter than the item is one window
    least = F.ceil(F.lit(threshold) * (size + window) / F.lit(1 + threshold) - F.lit(1e-9)).cast("int")
    pairs = pairs.select("*", size.alias("size"), window.alias("window"), F.greatest(least, F.lit(1)).alias("need")).filter(F.size("hits") >= F.col("need"))
    laid = pairs.select("id", "v1", "v2", "n", "len", "window", F.explode(starts_of(F.col("hits"), F.col("need"), F.col("window"), F.col("have") - F.col("window"))).alias("start"))
    starts = materialize(laid.distinct().withColumn("run", F.floor(F.col("start") / RUN).cast("int")), "starts")

    # the shingles of documents with windows, in runs
    wide = starts.agg(F.max("window")).first()[0] or 1
    wanted = starts.groupBy("id", "v1", "v2", "n").agg(F.collect_set("run").alias("runs"))
    held_bits, held = bit_table(wanted.select("v1"), TABLE_WORDS)
    texts = docs.select(F.col(f"`{id_col}`").alias("did"), body.alias("text")).withColumn("__bits", held_bits).filter(held(F.col("__bits"), F.xxhash64("text"))).select("did", "text", *[c.alias(f"d{c_}") for c, c_ in zip(text_keys(F.col("text")), ("v1", "v2"), strict=True)])
    texts = texts.dropDuplicates(["did", "dv1", "dv2"])
    own = F.col("id").eqNullSafe(F.col("did")) & (F.col("v1") == F.col("dv1")) & (F.col("v2") == F.col("dv2"))
    wordy = texts.join(wanted, own).select("id", "v1", "v2", "n", "runs", words_of(F.col("text")).alias("w"))
    all_s = reduce(lambda acc, n: F.when(F.col("n") == n, shingles_of(F.col("w"), n)).otherwise(acc), widths[:-1], shingles_of(F.col("w"), SHINGLE))
    cut = wordy.select("id", "v1", "v2", "n", "runs", all_s.alias("s"))
    parts = cut.select(F.col("id").alias("pid"), F.col("v1").alias("p1"), F.col("v2").alias("p2"), F.col("n").alias("pn"), F.explode_outer(F.transform("runs", lambda r: F.struct(r.alias("r"), F.slice("s", r * RUN + 1, RUN + wide).alias("part")))).alias("x")).select("pid", "p1", "p2", "pn", "x.*")
    same = F.col("id").eqNullSafe(F.col("pid")) & (F.col("v1") == F.col("p1")) & (F.col("v2") == F.col("p2")) & (F.col("n") == F.col("pn")) & (F.col("run") == F.col("r"))
    at = starts.groupBy("id", "v1", "v2", "n", "run").agg(F.collect_list(F.struct("len", "window", "start")).alias("at"))
    windows = at.join(parts, same).select("id", "v1", "v2", "n", F.explode_outer(F.transform("at", lambda p: F.struct(p["len"].alias("len"), p["start"].alias("start"), F.slice("part", p["start"] - F.col("run") * RUN + 1, p["window"]).alias("doc_s")))).alias("p")).select("id", "v1", "v2", "n", "p.*")
    windows = windows.select("*", F.struct(F.xxhash64("doc_s", "len").alias("a"), F.xxhash64(F.lit(1), "doc_s", "len").alias("b")).alias("window_key"))
    windows = materialize(windows, "windows")
    release(starts)
    # equal windows are judged once, however many documents hold them
    left = materialize(windows.groupBy("window_key", "len", "n").agg(F.min("doc_s").alias("doc_s")).withColumn("fp", simhash(F.col("doc_s"))), "window-prints")
    right = materialize(bench.groupBy("item_key", "len", "n").agg(F.min("item_s").alias("item_s")).withColumn("ifp", simhash(F.col("item_s"))), "item-prints")
    one = left.select("window_key", "len", "n", "fp", F.explode(blocks_of(F.col("fp"), radius)).alias("b")).select("window_key", "len", "n", "fp", "b.*")
    two = right.select("item_key", "len", "n", "ifp", F.explode(blocks_of(F.col("ifp"), radius)).alias("b")).select("item_key", "len", "n", "ifp", "b.*")
    near = one.join(F.broadcast(two) if small else two, ["len", "n", "block", "bits"])
    near = near.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius).select("window_key", "item_key").distinct()
    judged = near.join(left.select("window_key", "doc_s"), "window_key").join(F.broadcast(right.select("item_key", "item_s")) if small else right.select("item_key", "item_s"), "item_key")
    good = materialize(judged.select("window_key", "item_key", weighted_jaccard(F.col("doc_s"), F.col("item_s")).alias("similarity")).filter(F.col("similarity") >= threshold), "window-matches")
    matched = good.join(bench.select("item_key", "item_id").distinct(), "item_key").groupBy("window_key").agg(F.collect_set(F.struct("item_id", "similarity")).alias("m"))
    placed = salted_join(windows.select("id", "len", "start", "v1", "v2", "window_key").distinct(), matched, "window_key").select("id", "start", "len", "v1", "v2", F.explode("m").alias("m"))
    out = materialize(placed.groupBy("id", "m.item_id").agg(F.count_distinct("start", "len", "v1", "v2").alias("n_windows"), F.max("m.similarity").alias("similarity")), "passages")
    release(bench, windows, left, right, good)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that hold a benchmark passage; columns as they are."""
    bad = find_passages(docs, items, id_col, text).select(F.col("id").alias("__bad")).distinct()
    return docs.join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col("__bad")), "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, windows and best similarity of every benchmark passage found in documents."""
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "n_windows", F.round("similarity", 9).alias("similarity"))
