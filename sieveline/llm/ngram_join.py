"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

A text's set holds its distinct word n-grams (A-Z lower-cased, words split at
ASCII white space). Two texts link when 100 * shared >= percent * union.

Equal sets form a class with one representative (by a 128-bit digest, with
partial aggregation), so exact copies never meet each other. A tile is a size
band and one shingle of the representatives' prefixes: the rarest shingles, of
which two sets that link share at least one. Sizes of linked sets lie in one
band or in neighbouring ones. Within a tile first every member meets the first
member only; the links found are joined to components; then only members of
different components meet, under the length and positional filters. Parity
bitmaps bound the symmetric difference from below, so a bit count bounds the
overlap from above; what passes is intersected exactly as sorted arrays.
Shingles are compared by 64-bit hashes. Rarity is a fixed table of counts by
hash; collisions only change the order, never the result. Texts are read three
times: for the counts, for keys with bits and prefixes, and again for the texts
of candidate pairs alone. Classes, not ids, are what tiles and links speak of.

These links connect components and are not all there are; ``group_rows`` and the
op8 query use only them. ``class_links`` gives every link: there all members of
a tile meet under the filters.

Rows: every input row gives one row. Without words or text the set is empty and
linked with nothing, the component is the row's own id. Texts of fewer words
than n have one shingle, their whole sequence. Rows that repeat an id link by
their texts, each for itself. Rows with a null id link as others do; a
component's smallest id ignores nulls, and is null where all are. Other columns do not take part. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.common import bit_table, components, map_texts, materialize, pieces_of, release, small_batches, table, texts_of

RARITY_BUCKETS = 1 << 18
BITMAP_BITS = 512
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MIX = np.uint64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 1 << 20
PIECE_MB = 2


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


#: A value for each byte; white space, between words, adds nothing.
BYTE_VALUES = mixed(mixed(np.arange(1, 257, dtype=np.uint64) * MIX) * MIX)
BYTE_VALUES[[9, 10, 11, 12, 13, 32]] = 0


#: Random multipliers for the places of a block of a word.
BLOCK = 64
PLACES = mixed(mixed(np.arange(1001, 1001 + BLOCK, dtype=np.uint64) * MIX) * MIX) | np.uint64(1)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a byte buffer: of each block of ``BLOCK`` bytes the mixed sum of byte values times the multipliers of their places, and of a word the mixed sum of its blocks' values, mixed again with their numbers."""
    out = np.empty(len(starts), np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(b) + CHUNK_BYTES, CHUNK_BYTES))
    for i, j in zip(cuts, cuts[1:], strict=False):
        if i == j:
            continue
        lo, hi = int(starts[i]), int(ends[j - 1])
        blocks = -(-(ends[i:j] - starts[i:j]) // BLOCK)
        first = np.cumsum(blocks) - blocks
        number = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        at = np.repeat(starts[i:j] - lo, blocks) + number * BLOCK
        # white space after a word belongs to its last block and adds nothing, wherever it stands
        offset = np.arange(hi - lo) - np.repeat(at, np.diff(np.append(at, hi - lo)))
        sums = np.add.reduceat(BYTE_VALUES[b[lo:hi]] * PLACES[np.minimum(offset, BLOCK - 1)], at)
        sums = mixed(mixed(sums) + MIX * (number + 1).astype(np.uint64))
        out[i:j] = mixed(np.add.reduceat(sums, first))
    return out


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes (as int64) of each text."""
    if not texts:
        return []
    b = np.frombuffer((b"\n".join(texts) + b"\n").translate(LOWER), np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        turn = np.append(0, turn)
    starts, ends = turn[0::2], turn[1::2]
    h = word_hashes(b, starts, ends)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, offsets).tolist()
    whole = rolled(h, n)
    out = []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        if hi == lo:
            out.append(np.zeros(0, np.int64))
        elif hi - lo < n:
            out.append(rolled(h[lo:hi], hi - lo))
        else:
            out.append(np.unique(whole[lo : hi - n + 1]))
    return out


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes, as int64, of all runs of ``width`` words."""
    acc = np.full(max(0, len(h) - width + 1), width, np.uint64)
    for k in range(width):
        acc = mixed(acc * MIX + h[k : k + len(acc)])
    return acc.view(np.int64)


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of shingles in each bit's hash bucket."""
    return np.packbits(np.bincount(s.view(np.uint64) >> np.uint64(64 - 9), minlength=BITMAP_BITS).astype(np.uint8) & 1).tobytes()


def prefix(s: np.ndarray, rarity: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles, in order, of which any linked set shares one."""
    keep = len(s) - -(-len(s) * percent // 100) + 1
    bucket = (s.view(np.uint64) & np.uint64(RARITY_BUCKETS - 1)).astype(np.int64)
    return s[np.lexsort((s, rarity[bucket]))][:keep]


def rarity_table(df: DataFrame, text: str, n: int) -> np.ndarray:
    """Rarity levels by hash bucket, over all texts; fixed size.

    A bucket holds its shingles' counts and the noise of many rare ones; the level is
    the excess over the median bucket in deviations of that noise, as a logarithm, so
    shingles stand out that are frequent for a corpus of the given size.
    """

    def count(batches):
        total = np.zeros(RARITY_BUCKETS, np.int64)
        for batch in batches:
            for part in pieces_of(batch, PIECE_MB):
                sets = shingle_sets(texts_of(part.column(0)), n)
                total += np.bincount((np.concatenate(sets).view(np.uint64) & np.uint64(RARITY_BUCKETS - 1)).astype(np.int64), minlength=RARITY_BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["b", "n"])

    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{text}`").cast("string")).mapInArrow(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(RARITY_BUCKETS)
    total[rows["b"].to_numpy()] = rows["n"].to_numpy()
    usual = float(np.median(total))
    return (2 * np.log2(1 + np.maximum(0, total - usual) / max(1.0, usual) ** 0.5)).astype(np.uint8)


def classes_of(df: DataFrame, id_col: str, text: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, n_shingles, class_key), and classes of equal sets, numbered (node) in the order of their smallest ids (null last): class_key, id, the text's key of one member, size, bits, head."""
    v1, v2 = F.xxhash64(F.col(f"`{text}`").cast("string")), F.xxhash64(F.lit(1), F.col(f"`{text}`").cast("string"))
    base = df.select(F.col(f"`{id_col}`").alias("id"), v1.alias("v1"), v2.alias("v2"), F.col(f"`{text}`").cast("string").alias("text"))
    rarity = rarity_table(base, "text", n)
    kind = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("class_key", T.BinaryType()), T.StructField("bits", T.BinaryType()), T.StructField("head", T.ArrayType(T.LongType()))])

    def keys(texts):
        sets = shingle_sets(texts, n)
        return [
            pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
            pa.array([bitmap(s) for s in sets], pa.binary()), pa.array([prefix(s, rarity, percent) for s in sets], pa.list_(pa.int64())),
        ]

    signed = materialize(map_texts(base, "text", ["id", "v1", "v2"], kind, keys, PIECE_MB), "ngram-signed")
    # equal sets have equal sizes, bits and heads
    one = signed.filter("n_shingles > 0").groupBy("class_key").agg(F.min("id").alias("id"), F.min(F.struct("v1", "v2")).alias("v"), F.min("n_shingles").cast("int").alias("size"), F.first("bits").alias("bits"), F.first("head").alias("head"))
    classes = materialize(one.orderBy(F.asc_nulls_last("id"), "class_key").withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
    rows = materialize(signed.select("id", "v1", "v2", "n_shingles", "class_key"), "ngram-rows")
    release(signed)  # signatures are kept by class
    return rows, classes


def memberships(df: DataFrame, id_col: str, text: str, n: int, percent: int, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows and classes as by ``classes_of``, and links (a, b) between classes, by number: such as connect whatever is linked, or ``every`` one."""
    rows, classes = classes_of(df, id_col, text, n, percent)
    band = F.floor(F.log("size") / F.lit(float(np.log(100 / percent)))).cast("int")
    entries = classes.select("node", "size", band.alias("band"), F.posexplode("head").alias("pos", "word"))
    shared = entries.groupBy("word").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("word")
    tiles = materialize(entries.join(shared, "word", "left_semi"), "ngram-tiles")

    def verified(pairs: DataFrame) -> DataFrame:
        """Candidate pairs (a, b) that pass the bit bound and link."""
        bits = classes.select("node", "size", "bits")
        # a class has as many pairs as candidates; Spark splits skewed joins, and one side is unique
        one = pairs.join(bits.select(F.col("node").alias("a"), F.col("size").alias("sa"), F.col("bits").alias("ba")), "a")
        two = one.join(bits.select(F.col("node").alias("b"), F.col("size").alias("sb"), F.col("bits").alias("bb")), "b")

        def bound(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("ba", "bb"))
                apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)  # no more than the symmetric difference
                both = batch.column("sa").to_numpy().astype(np.int64) + batch.column("sb").to_numpy()
                most = (both - apart) // 2
                yield batch.select(["a", "b"]).filter(pa.array(100 * most >= percent * (both - most)))

        passed = materialize(two.mapInArrow(bound, "a long, b long"), "ngram-passed")
        needed = passed.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = materialize(classes.join(needed, "node", "left_semi").select("node", "v"), "ngram-wanted")
        # one text a class, by the key of the text; other texts stay out of the shuffle where the bit table does not know them
        known, test = bit_table(wanted.select("v.v1"), 1 << 16)
        v1, v2 = F.xxhash64(F.col(f"`{text}`").cast("string")), F.xxhash64(F.lit(1), F.col(f"`{text}`").cast("string"))
        texts = df.select(F.col(f"`{text}`").cast("string").alias("text")).withColumn("__bits", known).filter(test(F.col("__bits"), v1)).select("text")
        texts = texts.select("text", F.struct(v1.alias("v1"), v2.alias("v2")).alias("v")).dropDuplicates(["v"]).join(wanted, "v")
        # texts travel to their pairs: they compress, hashes of their shingles do not
        texts = materialize(texts.select("node", "text"), "ngram-texts")
        left = passed.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        whole = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

        def exact(batches):
            for batch in batches:
                for part in pieces_of(batch, PIECE_MB):
                    good = []
                    for x, y in zip(*(shingle_sets(texts_of(part.column(c)), n) for c in ("ta", "tb")), strict=True):
                        n_both = len(np.intersect1d(x, y, assume_unique=True))
                        good.append(100 * n_both >= percent * (len(x) + len(y) - n_both))
                    yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        links = materialize(whole.select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long"), "ngram-links")
        release(passed, wanted, texts)
        return links

    def fits():
        """The length and positional filters for entries p and i of one tile: before their first shared shingle nothing is shared, and after it no more than is left."""
        small, large = F.least("p.size", "i.size"), F.greatest("p.size", "i.size")
        room = F.least(F.col("p.size") - F.col("p.pos"), F.col("i.size") - F.col("i.pos"))
        return (100 * small >= percent * large) & ((100 + percent) * room >= percent * (small + large))

    def meeting(members: DataFrame) -> DataFrame:
        """Pairs (a, b) of members of one tile, of different labels, that pass the length and positional filters."""
        p, i = members.alias("p"), members.select("word", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), "node", "size", "pos", "label").alias("i")
        rest = p.join(i, ["word", "band"]).filter((F.col("p.node") < F.col("i.node")) & (F.col("p.label") != F.col("i.label")) & fits())
        return rest.select(F.col("p.node").alias("a"), F.col("i.node").alias("b")).distinct()

    if every:
        return rows, classes, verified(meeting(tiles.withColumn("label", F.col("node"))))
    heads = tiles.groupBy("word", "band").agg(F.min("node").alias("node"), F.min_by(F.struct("size", "pos"), "node").alias("x"))
    spread = heads.select("word", F.explode(F.array("band", F.col("band") + 1)).alias("band"), "node", "x.*")
    near = tiles.alias("p").join(spread.alias("i"), ["word", "band"]).filter((F.col("p.node") != F.col("i.node")) & fits())
    links = verified(near.select(F.least("p.node", "i.node").alias("a"), F.greatest("p.node", "i.node").alias("b")).distinct())
    label = materialize(components(links).withColumnRenamed("node", "of"), "ngram-labels")
    named = tiles.join(label, tiles["node"] == label["of"], "left").select("word", "band", "node", "size", "pos", F.coalesce("component", "node").alias("label"))
    mixed_tiles = named.groupBy("word").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("word")
    open_ = materialize(named.join(mixed_tiles, "word", "left_semi"), "ngram-open")
    release(tiles)
    more = verified(meeting(open_))
    release(open_, label)
    return rows, classes, links.union(more)


def group_rows(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, first) for every row; ``first`` tells whether the row is of the class that names its component (the others are near copies)."""
    rows, classes, links = memberships(df, id_col, text, n, percent)
    label = components(links).withColumnRenamed("node", "of")
    roots = classes.join(label, F.col("node") == F.col("of"), "left").select("class_key", F.coalesce("component", "node").alias("root"), "node")
    named = roots.join(classes.select(F.col("node").alias("root"), F.col("id").alias("component_id")), "root")
    named = named.select("class_key", "component_id", (F.col("root") == F.col("node")).alias("first"))
    found = rows.filter("n_shingles > 0").select("id", "n_shingles", "class_key").join(named, "class_key", "left").select("id", "n_shingles", "component_id", "first")
    return found.union(rows.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"), F.lit(True)))


def class_links(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(a, b) for all linked pairs of classes of equal sets, each named by its smallest id; members of a class link with one another besides."""
    _, classes, links = memberships(df, id_col, text, n, percent, every=True)
    names = classes.select("node", "id")
    one = links.join(names.select(F.col("node").alias("a"), F.col("id").alias("ia")), "a")
    return one.join(names.select(F.col("node").alias("b"), F.col("id").alias("ib")), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))


def first_copies(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``df`` with one row of each group of near copies: of the row's class that names the group, that of the smallest id and, among rows of one id, of the smallest text key; rows equal in id and text are one. Rows without words stay."""
    rows, classes, links = memberships(df, id_col, text, n, percent)
    label = components(links).withColumnRenamed("node", "of")
    roots = classes.join(label, F.col("node") == F.col("of"), "left_anti").select("class_key").union(classes.join(label.filter("component = of"), F.col("node") == F.col("of"), "left_semi").select("class_key"))
    keep = rows.filter("n_shingles > 0").select("id", "v1", "v2", "class_key").join(roots, "class_key")
    keep = keep.groupBy("class_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "v1", "v2")).alias("m")).select("m.*")
    keys = rows.filter("n_shingles > 0").groupBy("id", "v1", "v2").agg(F.count(F.lit(1)).alias("times"))
    kept = keep.select(F.col("id").alias("kid"), F.col("v1").alias("k1"), F.col("v2").alias("k2"))
    marked = keys.join(kept, F.col("id").eqNullSafe(F.col("kid")) & (F.col("v1") == F.col("k1")) & (F.col("v2") == F.col("k2")), "left")
    changed = marked.filter("k1 IS NULL OR times > 1").select(F.col("id").alias("__id"), F.col("v1").alias("__v1"), F.col("v2").alias("__v2"), F.col("k1").isNull().alias("__gone"))
    changed = materialize(changed, "ngram-changed")
    release(rows, classes)
    # rows that stay as they are need no shuffle
    v1, v2 = F.xxhash64(F.col(f"`{text}`").cast("string")), F.xxhash64(F.lit(1), F.col(f"`{text}`").cast("string"))
    known, test = bit_table(changed.select("__v1"), 1 << 16)
    marked = df.withColumn("__bits", known)
    hit = F.coalesce(test(F.col("__bits"), v1), F.lit(False)) & F.coalesce(F.col(f"`{text}`").cast("string").rlike(r"[^\x20\t-\r]"), F.lit(False))
    own = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__w1") == F.col("__v1")) & (F.col("__w2") == F.col("__v2"))
    some = marked.filter(hit).drop("__bits").withColumns({"__w1": v1, "__w2": v2}).dropDuplicates([id_col, "__w1", "__w2"])
    some = some.join(changed.filter("__gone"), own, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
    return marked.filter(~hit).select(*[F.col(f"`{c}`") for c in df.columns]).unionAll(some)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, set size and component of every whole text of documents: 4-word shingles, 85 per cent."""
    found = group_rows(table(spark, sf_dir, "documents"), n=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
k AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) WHERE len(s) > 0 GROUP BY s),
e AS (SELECT rep, n, unnest(s) AS g FROM k),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c, any_value(a.n) AS an, any_value(b.n) AS bn FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (an + bn - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS node, rep AS root FROM k UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node AND r.root < u.b),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id FROM s LEFT JOIN k ON list_sort(s.s) = k.s LEFT JOIN m ON m.node = k.rep
"""
