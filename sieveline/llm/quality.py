"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into chunks of ``CHUNK`` bytes that overlap by the filter width
less one, so that every run of ``WIDTH`` bytes of the whole text meets every
filter once. Responses are max-pooled over a chunk, a small dense layer turns
them into the chunk's logit, and the mean of the chunk logits, weighted by
chunk length, gives one probability for the text.

Training is gradient descent (Adam) on a bounded sample: at most
``SAMPLE_PER_CLASS`` labelled rows a class, chosen by a hash of their id, of
each ``PIECES`` pieces of ``CHUNK`` characters at hashed offsets.

Rows: every input row gives one row. A null or empty text is one chunk of
padding and gets that chunk's score. Without labels of both classes every text
gets 0.5 or the only class. Ids with contradicting labels are not learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.common import crc_mod, map_texts, table, unit_hash
from sieveline.llm.language_id import PAD, windows

FILTERS, WIDTH, CHUNK, DENSE = 16, 6, 256, 8
SAMPLE_PER_CLASS = 3000
PIECES = 4
SHORT = 0.2
BLOCK = 2048


def cut(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first byte within its text, and core length of every chunk; an empty text has one."""
    count = np.maximum(1, -(-sizes // CHUNK))
    owner = np.repeat(np.arange(len(sizes)), count)
    first = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * CHUNK
    return owner, first, np.maximum(1, np.minimum(CHUNK, sizes[owner] - first))


def pooled(symbols: np.ndarray, filters: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Largest response of each filter over a position-major block of symbols, and where it was."""
    steps = len(symbols) - WIDTH + 1
    shape = (symbols.shape[1], filters.shape[2])
    best, at = np.full(shape, -np.inf, np.float32), np.zeros(shape, np.int64) if where else None
    x, part = np.empty(shape, np.float32), np.empty(shape, np.float32)
    for t in range(steps):
        np.take(filters[0], symbols[t], axis=0, out=x, mode="clip")
        for k in range(1, WIDTH):
            x += np.take(filters[k], symbols[t + k], axis=0, out=part, mode="clip")
        if where:
            at[x > best] = t
        np.maximum(best, x, out=best)
    return best, at


def head(pool: np.ndarray, length: np.ndarray, w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squashed pool with the filled share of the chunk, dense layer, and logit of each chunk."""
    a = np.concatenate([np.tanh(pool), (length / CHUNK).astype(np.float32)[:, None]], axis=1)
    d = np.tanh(a @ w[1] + w[2])
    return a, d, d @ w[3] + w[4]


def symbols_of(texts: list[bytes], part: slice, plan: tuple[np.ndarray, ...]) -> np.ndarray:
    """Position-major symbols of some chunks, each longer than its core by the overlap."""
    owner, first, begin, end = plan
    lo, hi = owner[part][0], owner[part][-1] + 1
    blob = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
    b, e = begin[part] - begin[part][0], end[part] - begin[part][0]
    return windows(blob, b, e, b + first[part], CHUNK + WIDTH - 1, 0)


def plan_of(texts: list[bytes]) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    sizes = np.array([len(t) for t in texts], np.int64)
    owner, first, length = cut(sizes)
    begin = (np.cumsum(sizes) - sizes)[owner]
    return length, (owner, first, begin, begin + sizes[owner])


def score_texts(weights: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Probability of the positive class for each text."""
    if not texts:
        return np.zeros(0)
    length, plan = plan_of(texts)
    logits = np.concatenate([head(pooled(symbols_of(texts, slice(at, at + BLOCK), plan), weights[0])[0], length[at : at + BLOCK], weights)[2] for at in range(0, len(length), BLOCK)])
    total = np.bincount(plan[0], logits * length, len(texts)) / np.bincount(plan[0], length, len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(bags: list[list[bytes]], labels: np.ndarray, epochs: int = 8, batch: int = 64, seed: int = 11) -> list[np.ndarray]:
    """Filters (offset, symbol, filter), dense weights and bias, output weights and bias."""
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 0.15, (WIDTH, PAD + 1, FILTERS)), rng.normal(0, 0.4, (FILTERS + 1, DENSE)), np.zeros(DENSE), rng.normal(0, 0.4, DENSE), np.zeros(())]
    weights = [w.astype(np.float32) for w in weights]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    share = 0.5 / np.maximum(np.bincount(labels, minlength=2), 1)
    cell = np.arange(FILTERS)
    step, total = 0, epochs * max(1, -(-len(bags) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            take = order[i : i + batch]
            short = np.where(rng.random(len(take)) < SHORT, rng.integers(20, 120, len(take)), CHUNK)  # short texts must be learned too
            texts = [p[:n] for b, n in zip(take, short.tolist(), strict=True) for p in bags[b]]
            size = len(bags[take[0]])
            begin = np.cumsum([0, *(len(t) for t in texts)])
            x = windows(np.frombuffer(b"".join(texts), np.uint8), begin[:-1], begin[1:], begin[:-1], CHUNK + WIDTH - 1, 0)
            pool, at = pooled(x, weights[0], where=True)
            a, d, logit = head(pool, np.diff(begin), weights)
            p = 1 / (1 + np.exp(-np.clip(logit.reshape(-1, size).mean(1), -30, 30)))
            dl = ((p - labels[take]) * share[labels[take]] / share[labels[take]].sum()).repeat(size) / size
            dd = dl[:, None] * weights[3] * (1 - d * d)
            da = (dd @ weights[1].T) * (1 - a * a)
            g_filters = np.zeros(weights[0].shape)
            for k in range(WIDTH):
                hit = x[at + k, np.arange(len(texts))[:, None]] * FILTERS + cell
                g_filters[k] = np.bincount(hit.ravel(), da[:, :FILTERS].ravel(), (PAD + 1) * FILTERS).reshape(PAD + 1, FILTERS)
            grads = [g_filters, a.T @ dd, dd.sum(0), d.T @ dl, dl.sum()]
            step += 1
            rate = 0.02 * (1 - step / (total + 1)) + 1e-4
            for w, g, (m, v) in zip(weights, grads, moments, strict=True):
                m += (0.1 * (g - m)).astype(np.float32)
                v += (0.01 * (g * g - v)).astype(np.float32)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return weights


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", id_col: str = "doc_id", cap: int = SAMPLE_PER_CLASS) -> list[np.ndarray] | float:
    """Trained weights, or a constant score if there are not two classes to learn; labels holds only rows that may be learned from."""
    clean = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).alias("__lo"), F.max(label).alias("__hi")).filter("__lo = __hi")
    counts = {r[0]: r[1] for r in clean.groupBy("__lo").count().collect()}
    if not counts:
        return 0.5
    if len(counts) == 1:
        return float(next(iter(counts)))
    chance = F.when(F.col("__lo") == 0, F.lit(min(1.0, cap / counts[0]))).otherwise(F.lit(min(1.0, cap / counts[1])))
    chosen = F.broadcast(clean.filter(unit_hash(id_col, 3) < chance).select(id_col, F.col("__lo").alias("__label")))  # bounded by cap
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    room = F.greatest(F.lit(1), F.length(body) - CHUNK)
    pieces = F.array(*[F.substr(body, (unit_hash(id_col, 10 + k) * room).cast("int") + 1, F.lit(CHUNK)) for k in range(PIECES)])
    got = docs.select(id_col, text).join(chosen, id_col).select(F.col(id_col).alias("id"), F.col("__label").alias("label"), pieces.alias("pieces")).groupBy("id", "label").agg(F.min("pieces").alias("pieces")).collect()  # one text an id
    got.sort(key=lambda r: (str(r["id"]), r["pieces"]))
    if len({r["label"] for r in got}) < 2:
        return float(got[0]["label"]) if got else 0.5
    return train([[p.encode()[:CHUNK] for p in r["pieces"]] for r in got], np.array([r["label"] for r in got]))


def classify(df: DataFrame, model: list[np.ndarray] | float, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default: all) and ``quality_score``."""
    added = T.StructType([T.StructField("quality_score", T.DoubleType())])

    def score(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array(np.full(len(texts), model) if isinstance(model, float) else score_texts(model, texts), pa.float64())]

    return map_texts(df, text, df.columns if keep is None else keep, added, score)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted class for every whole text of documents."""
    held_out = crc_mod("doc_id", 3) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out))
    found = classify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
