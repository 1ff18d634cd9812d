"""Helpers shared by the operators: tables, shared storage, Arrow text mapping."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import sieveline
from sieveline.shared import shared_dir

# Functions that run on executors travel by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sieveline)

#: Kept between calls only to remove what was written; see materialize().
_written: list[tuple[SparkSession, str, DataFrame]] = []
#: Rows of texts that travel to a Python worker at once.
BATCH_ROWS = 1000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark's own file systems."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives lost executors.

    Shuffle files of the write go when it ends (the result no longer needs them);
    the files written go by ``release`` or when the Python process ends. The
    driver collects its garbage then: plans and broadcasts of one write would
    else stay on its heap through the next ones, up to the heap's limit.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sieveline-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        # one dictionary for a whole column chunk: hashes of words repeat
        df.write.option("parquet.dictionary.page.size", 16 << 20).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    spark.sparkContext._jvm.System.gc()
    found = spark.read.schema(df.schema).parquet(path)
    _written.append((spark, path, found))
    return found


def release(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these frames; nothing may read them afterwards."""
    for frame in frames:
        for entry in [w for w in _written if w[2] is frame]:
            _delete(*entry[:2])
            _written.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove() -> None:
    for spark, path, _ in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


atexit.register(_remove)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column as text, modulo ``n``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def unit_hash(column: str, seed: int = 0) -> Column:
    """A value in [0, 1) that depends on the column only; used for reproducible samples."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_ROWS`` rows: what Spark and its workers keep of texts is a batch on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def pieces_of(batch: pa.RecordBatch, piece_mb: float) -> Iterable[pa.RecordBatch]:
    """Runs of rows whose last column has about ``piece_mb`` MB, or a single longer text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(sizes, before + int(piece_mb * (1 << 20)), "right")))
        yield batch.slice(at, upto - at)
        at = upto


def map_texts(df: DataFrame, text: str, keep: Sequence[str], added: T.StructType, fn: Callable[[list[bytes]], Iterable[pa.Array]], piece_mb: float = 8) -> DataFrame:
    """Apply ``fn`` to the texts of each Arrow batch, in pieces of about ``piece_mb`` MB; rows stay in place.

    ``keep`` columns pass through; a kept column whose name is one of ``added`` is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    names = {f.name for f in added}
    keep = [c for c in keep if c not in names]
    chosen = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*(chosen.schema[c] for c in keep), *added])
    arrow = to_arrow_schema(added)

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, piece_mb):
                made = list(fn(texts_of(part.column(part.num_columns - 1))))
                made = [a if a.type == f.type else a.cast(f.type) for a, f in zip(made, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *made], names=[*keep, *arrow.names])

    return chosen.mapInArrow(run, schema)


def bit_table(hashes: DataFrame, words: int = 1 << 14) -> tuple[Column, Callable[[Column, Column], Column]]:
    """A bit table of fixed size over a one-column frame of 64-bit hashes, as a scalar column, and its test (table, hash); it may pass others too."""
    h = F.col(f"`{hashes.columns[0]}`")
    word = lambda x: F.pmod(F.shiftrightunsigned(x, 6), F.lit(words)).cast("int")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int"))
    filled = hashes.groupBy(word(h).alias("b")).agg(F.bit_or(bit(h)).alias("w"))
    return dense_array(filled, words), lambda bits, x: F.get(bits, word(x)).bitwiseAND(bit(x)) != 0


def dense_array(values: DataFrame, n: int, run: int = 1024) -> Column:
    """(b, w) as one array over 0 <= b < n with 0 where b is absent, a scalar column; gathered in runs first, so one task reads n / run rows."""
    kind = values.schema["w"].dataType
    every = values.select("b", "w").union(values.sparkSession.range(n).select(F.col("id").cast("int"), F.lit(0).cast(kind)))
    one = every.groupBy("b").agg(F.sum("w").cast(kind).alias("w"))  # a bucket has its value and a zero, or the zero alone
    runs = one.groupBy(F.floor(F.col("b") / run).alias("r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "w"))), lambda x: x["w"]).alias("a"))
    return runs.agg(F.array_sort(F.collect_list(F.struct("r", "a"))).alias("a")).select(F.flatten(F.transform("a", lambda x: x["a"]))).scalar()


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: int = 256, salts: int = 32) -> DataFrame:
    """Join on ``key``, unique in ``right``; rows of ``left`` whose key has over ``hot`` rows are dealt over salts, and their row of ``right`` repeated."""
    often = left.groupBy(key).count().filter(F.col("count") > hot).select(key, F.lit(True).alias("__hot"))
    dealt = right.join(often, key, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    marked = left.join(often, key, "left")
    marked = marked.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*[f"`{c}`" for c in left.columns]), F.lit(salts)).cast("int")).otherwise(0)).drop("__hot")
    return marked.join(dealt, [key, "__salt"], how).drop("__salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges, component the smallest node reachable.

    Alternating large and small stars; each round is written, so rounds cost one pass
    and lost executors lose at most the current one. Without edges there are no nodes.
    """
    pairs = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "cc")
    last = None
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both, low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        before, pairs = pairs, materialize(small.filter("u <> v").distinct(), "cc")
        release(before)
        state = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        last = state
