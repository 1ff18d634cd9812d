"""Line dedup: an exact set-similarity join of lines; later matches are removed.

A line's set is its distinct lower-case words. A line goes if an earlier line
(order: document id, then place in the document) has a Jaccard similarity of
at least ``threshold`` with it, however few words it has. Lines without a word
stay.

Join: words are ordered by rarity, a set's prefix holds every word of which one
must be shared by any match; prefixes meet on their words under the length and
positional filters and a bound from parity bits of the whole sets, and what is
left is verified on the whole sorted arrays. Rarity comes from a table of word
counts by hash (``RARITY_BUCKETS``, fixed size); any one order keeps the filter
exact, and words that share a bucket only lengthen candidate lists. A word
alone in its bucket is in one line only and meets nothing. Words are compared
by 64-bit hashes, sets by 128-bit keys of these.

Data moved: texts are sorted by document once, so that lines are numbered in the
order of their places and one number stands for a place and for the set that is
first seen there. The words of all lines are written once; what is shuffled of
a line are its keys and its prefix, 32 bits a word. Whole arrays are read again
only for sets of candidate pairs.

Skew: equal rows and equal sets meet first and leave one row and one set with
its first place, by partial aggregation; of sets with several lines only the
prefix of the first line is sent on, by its number. Then sets with a common word (``COMMON`` lines or more may hold
it) in the prefix are compared with the first set of that word, which is one
row a word, so groups of near copies resolve in linear work; only sets that this
leaves undecided meet all others, by joins whose hot keys Spark can split.

Rows: every document stays, in its row, with the text of the lines it keeps;
a document that loses all its lines has an empty text. Null and empty texts
stay as they are. Rows that repeat a document id are told apart by their text
alone: equal rows are cleaned alike. Null ids come first. Other columns pass
through unless their names begin with ``__``. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import bit_table, dense_array, materialize, release, table

THRESHOLD_PERCENT = 80
RARITY_BUCKETS = 1 << 20
COMMON = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RANK_SHIFT = 56  # a word is ordered by one number: rarity above, the low bits of its hash below
DOC = ["__doc", "__v1", "__v2"]


def words_of(line: Column) -> Column:
    """Sorted hashes of the distinct lower-case words of a line; splitting leaves empty words, which go by their hash."""
    ascii_only = F.octet_length(line) == F.char_length(line)
    low = F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))
    unusual = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\f")) | F.contains(line, F.lit("\r"))
    spaced = F.when(unusual, F.split(low, r"[\x20\t-\r]+")).otherwise(F.split(low, " "))
    return F.sort_array(F.array_remove(F.array_distinct(F.transform(spaced, lambda w: F.xxhash64(w))), F.xxhash64(F.lit(""))))


def text_key(column: Column) -> tuple[Column, Column]:
    """128 bits of a text."""
    return F.xxhash64(column), F.xxhash64(F.lit(1), column)


def lines_of(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Lines with their document (id, text), line number, place (a number in the order of documents and lines), sorted word hashes and key; equal rows are one. No filter, which would be pushed below and compute the words twice."""
    v1, v2 = text_key(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("__doc"), v1.alias("__v1"), v2.alias("__v2"), F.col(f"`{text}`").alias("__text"))
    once = rows.groupBy(*DOC).agg(F.first("__text").alias("__text")).orderBy(*DOC)
    split = once.select(*DOC, F.posexplode(F.split("__text", "\n")).alias("__at", "line"))
    sets = split.select(*DOC, "__at", F.monotonically_increasing_id().alias("place"), words_of(F.col("line")).alias("words"))
    return sets.select(*DOC, "__at", "place", "words", F.size("words").alias("n"), F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), "words").alias("k2"))


def level(count: Column) -> Column:
    """Half steps of the logarithm of a count; 0 for a single line."""
    return F.when(count <= 1, 0).otherwise(1 + F.floor(2 * F.log2(count))).cast("tinyint")


def rarity(lines: DataFrame) -> Column:
    """Levels of word counts by hash bucket as a scalar array."""
    found = lines.select(F.explode("words").alias("w")).groupBy(F.pmod("w", F.lit(RARITY_BUCKETS)).cast("int").alias("b")).count()
    return dense_array(found.select("b", level(F.col("count")).alias("w")), RARITY_BUCKETS)


def prefix_length(n: Column, percent: int) -> Column:
    """So many of the rarest words that two sets which match share one of them."""
    return (n - F.ceil(n * percent / F.lit(100)) + 1).cast("int")


#: Sizes above which a set's parity bits are 128 and 256, not 64.
WIDER, WIDEST = 56, 160


def parity_bits(words: Column, n: Column) -> list[Column]:
    """Of each of 64 bits, whether an odd number of the words fall on it; two sets differ in at least as many words as bits. In larger sets two or four such numbers, one for each value of the next bits of a word; the exclusive or of all is what a smaller set has."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    bit = lambda w: F.call_function("shiftleft", one, w.bitwiseAND(F.lit(63)).cast("int"))
    every = F.aggregate(words, none, lambda acc, w: acc.bitwiseXOR(bit(w)))

    def share(mask: int, value: int) -> Column:
        return F.aggregate(F.filter(words, lambda w: w.bitwiseAND(F.lit(mask)) == F.lit(value)), none, lambda acc, w: acc.bitwiseXOR(bit(w)))

    wide = [F.when(n > WIDEST, share(192, 64 * k)).when(n > WIDER, share(64, 64 * k) if k < 2 else none).otherwise(every if k == 0 else none) for k in range(4)]
    return [c.alias(f"p{k}") for k, c in enumerate(wide)]


BITS = ["p0", "p1", "p2", "p3"]


def set_keys(lines: DataFrame) -> DataFrame:
    """One row a set: its keys, its number (sid), which is its first place, and its lines."""
    return lines.filter("n > 0").groupBy("k1", "k2").agg(F.min("place").alias("sid"), F.count(F.lit(1)).alias("lines"))


def distinct_sets(lines: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """One row a set: number, size, parity bits, and its prefix without words of a single line: ``skip`` words were left out, ``rare`` of the others are not common."""
    order = lambda w: F.shiftleft(F.get(F.col("__level"), w.bitwiseAND(F.lit(RARITY_BUCKETS - 1)).cast("int")).cast("bigint"), RANK_SHIFT).bitwiseOR(w.bitwiseAND(F.lit((1 << RANK_SHIFT) - 1)))
    common = (1 + int(2 * (COMMON.bit_length() - 1))) << RANK_SHIFT
    repeated = keys.filter("lines > 1")
    bits, known = bit_table(repeated.select("k1"), 1 << 16)
    held = lines.filter("n > 0").withColumn("__level", rarity(lines)).withColumn("__bits", bits)

    def cut(some: DataFrame) -> DataFrame:
        ranked = some.select("place", "n", *parity_bits(F.col("words"), F.col("n")), F.slice(F.sort_array(F.transform("words", order)), F.lit(1), prefix_length(F.col("n"), percent)).alias("prefix"))
        met = F.filter("prefix", lambda x: x >= F.lit(1 << RANK_SHIFT))
        parts = ranked.select(F.col("place").alias("sid"), "n", *BITS, F.size("prefix").alias("all"), met.alias("met"))
        return parts.select("sid", "n", *BITS, (F.col("all") - F.size("met")).alias("skip"), F.size(F.filter("met", lambda x: x < F.lit(common))).alias("rare"), F.transform("met", lambda x: (x.bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31)).cast("int")).alias("head"))

    hit = F.coalesce(known(F.col("__bits"), F.col("k1")), F.lit(False))
    # where the table passes a line, it may be a later line of its set: only first lines stay
    maybe = keys.withColumn("__bits", bits).filter(F.coalesce(known(F.col("__bits"), F.col("k1")), F.lit(False))).select("sid")
    return cut(held.filter(~hit)).union(cut(held.filter(hit)).join(maybe, "sid", "left_semi"))


def close(a: str, b: str, percent: int) -> Column:
    """The length and positional filters and the bound from parity bits, for two entries of one word."""
    n, m, p, q = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
    room = F.least(n - p, m - q)  # no more words can be shared from here on, and none before the first shared one
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * room >= percent * (n + m)) & ((100 + percent) * apart(a, b) <= (100 - percent) * (n + m))


def apart(a: str, b: str) -> Column:
    """Bits in which two sets differ, at the resolution that both have."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    xor = [F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}")) for p in BITS]
    count = lambda c: F.bit_count(c)
    even, odd = xor[0].bitwiseXOR(xor[2]), xor[1].bitwiseXOR(xor[3])
    four = count(xor[0]) + count(xor[1]) + count(xor[2]) + count(xor[3])
    return F.when(F.least(n, m) > WIDEST, four).when(F.least(n, m) > WIDER, count(even) + count(odd)).otherwise(count(even.bitwiseXOR(odd)))


def matches(a: Column, b: Column, percent: int) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return 100 * shared >= percent * (F.size(a) + F.size(b) - shared)


def words_by_set(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sid, words) of all sets in the pairs (a, b)."""
    sids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "line-needed")
    bits, known = bit_table(sids.select(F.xxhash64("sid").alias("h")), 1 << 16)
    some = lines.withColumn("__bits", bits).filter(known(F.col("__bits"), F.xxhash64("place"))).select(F.col("place").alias("sid"), "words")
    found = materialize(some.join(sids, "sid", "left_semi"), "line-words")
    release(sids)
    return found


def verified(pairs: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """Sets b (sid) of the pairs that match."""
    left = pairs.select("a", "b").join(words.select(F.col("sid").alias("a"), F.col("words").alias("wa")), "a")
    both = left.join(words.select(F.col("sid").alias("b"), F.col("words").alias("wb")), "b")
    return both.filter(matches(F.col("wa"), F.col("wb"), percent)).select(F.col("b").alias("sid")).distinct()


def nearest_first(pairs: DataFrame) -> DataFrame:
    """One pair of each b, of the fewest differing bits."""
    return pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("x")).select("b", "x.a")


def matched_sets(lines: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Sets (sid) that match one with an earlier first place."""
    entry = lambda df, *more: df.select("sid", "n", *BITS, "skip", "rare", *more, F.posexplode("head").alias("i", "w")).withColumn("pos", F.coalesce(F.col("skip") + F.col("i"), F.lit(0)))  # noqa: E731  never null: a null check would tell the two sides of a join apart
    frequent = entry(sets).filter("i >= rare").select("w", "sid", "n", *BITS, "pos")
    first = frequent.groupBy("w").agg(F.min("sid").alias("sid"), F.min_by(F.struct("n", *BITS, "pos"), "sid").alias("x")).select("w", "sid", "x.*")
    near = frequent.alias("b").join(first.alias("a"), "w").filter((F.col("a.sid") < F.col("b.sid")) & close("a", "b", percent))
    near = materialize(near.select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b"), apart("a", "b").alias("apart")).distinct(), "line-near")
    words = words_by_set(lines, near)
    decided = materialize(verified(near, words, percent).withColumn("done", F.lit(True)), "line-decided")
    release(near, words)

    marked = sets.join(decided, "sid", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    every = entry(marked, "done").select("w", "sid", "n", *BITS, "pos", "done")
    # of a pair the smaller set (a) is met in the shorter prefix that suffices for it; both sides come from one shuffle, so what concerns one side alone is written as a condition on both
    a, b = every.alias("a"), every.alias("b")
    smaller = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.sid") < F.col("b.sid")))
    shorter = F.col("a.pos") < F.col("a.n") - F.ceil(2 * percent * F.col("a.n") / F.lit(100 + percent)) + F.when(F.col("b.pos") >= 0, 1)
    later_open = F.when(F.col("a.sid") < F.col("b.sid"), ~F.col("b.done")).otherwise(~F.col("a.done"))
    met = a.join(b, F.col("a.w") == F.col("b.w")).filter(smaller & shorter & later_open & close("a", "b", percent))
    pairs = materialize(met.select(F.least("a.sid", "b.sid").alias("a"), F.greatest("a.sid", "b.sid").alias("b"), apart("a", "b").alias("apart")).distinct(), "line-pairs")
    words = words_by_set(lines, pairs)
    likely = materialize(verified(nearest_first(pairs), words, percent), "line-likely")
    rest = pairs.join(likely, F.col("b") == F.col("sid"), "left_anti")
    found = materialize(decided.select("sid").union(likely).union(verified(rest, words, percent)), "line-matched")
    release(decided, pairs, words, likely)
    return found


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """Places of the lines that go, as (__doc, __v1, __v2, __ats) a document."""
    lines = materialize(lines_of(docs, id_col, text), "lines")
    keys = materialize(set_keys(lines), "line-keys")
    sets = materialize(distinct_sets(lines, keys, percent), "line-sets")
    matched = matched_sets(lines, sets, percent)
    release(sets)
    gone = keys.join(matched.withColumn("all", F.lit(True)), "sid", "left").filter("all OR lines > 1")
    gone = materialize(gone.select("k1", "k2", "sid", F.coalesce("all", F.lit(False)).alias("all")), "line-gone")
    hit = lines.filter("n > 0").select("k1", "k2", *DOC, "__at", "place").join(gone, ["k1", "k2"]).filter(F.col("all") | (F.col("place") != F.col("sid")))
    found = materialize(hit.groupBy(*DOC).agg(F.collect_set("__at").alias("__ats")), "line-struck")
    release(lines, keys, matched, gone)
    return found


def drop_lines(docs: DataFrame, struck: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the struck lines; texts that lose none are not shuffled."""
    v1, v2 = text_key(F.col(f"`{text}`"))
    bits, known = bit_table(struck.select("__v1"), 1 << 16)
    tested = docs.withColumn("__bits", bits)
    hit = F.coalesce(known(F.col("__bits"), v1), F.lit(False))
    whole = tested.filter(~hit).select(*[F.col(f"`{c}`") for c in docs.columns], F.lit(0).cast("long").alias("__lines_removed"))
    some = tested.filter(hit).select(*[F.col(f"`{c}`") for c in docs.columns], v1.alias("__w1"), v2.alias("__w2"))
    joined = some.join(struck, F.col(f"`{id_col}`").eqNullSafe(F.col("__doc")) & (F.col("__w1") == F.col("__v1")) & (F.col("__w2") == F.col("__v2")), "left")
    kept = F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda _, i: ~F.array_contains("__ats", i))
    cleaned = F.when(F.col("__ats").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n"))
    return whole.union(joined.select(*[cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.size("__ats"), F.lit(0)).cast("long").alias("__lines_removed")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``docs`` with cleaned texts; ``__lines_removed`` counts what went."""
    return drop_lines(docs, removed_lines(docs, id_col, text, percent), id_col, text)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the number of lines removed, and the cleaned text of every document."""
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("__lines_removed").alias("lines_removed"), "text")


SQL = """
WITH l AS (SELECT DISTINCT doc_id, text, u.pos, u.line FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u),
s AS (SELECT doc_id, pos, list_sort(list_distinct(list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))) AS words FROM l),
k AS (SELECT words, min((doc_id, pos)) AS place FROM s WHERE len(words) >= 1 GROUP BY words),
e AS (SELECT words, place, len(words) AS n, unnest(words) AS word FROM k),
p AS (SELECT a.words, b.words AS other, count(*) AS c, any_value(a.n) AS an, any_value(b.n) AS bn FROM e a JOIN e b ON a.word = b.word AND b.place < a.place AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.words, b.words),
g AS (SELECT DISTINCT words FROM p WHERE 100 * c >= 80 * (an + bn - c)),
d AS (SELECT DISTINCT s.doc_id, s.pos FROM s JOIN k ON s.words = k.words LEFT JOIN g ON g.words = s.words WHERE g.words IS NOT NULL OR (s.doc_id, s.pos) <> k.place),
r AS (SELECT l.doc_id, l.text, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE d.pos IS NULL) AS kept, count(d.pos) AS gone FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.pos = d.pos GROUP BY l.doc_id, l.text)
SELECT x.doc_id, coalesce(r.gone, 0) AS lines_removed, CASE WHEN coalesce(r.gone, 0) = 0 THEN x.text ELSE coalesce(r.kept, '') END AS text
FROM documents x LEFT JOIN r ON x.doc_id = r.doc_id AND x.text = r.text
"""
