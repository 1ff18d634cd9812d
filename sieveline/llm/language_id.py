"""Language ID: a bidirectional gated recurrent network over UTF-8 bytes, in numpy.

Texts are cut into cores of ``CORE`` bytes; each direction first runs over
``WARM`` bytes of context before its core, so every byte of a text lies in
exactly one core and is labelled once. A document's probabilities are the mean
of its positions' probabilities. Gates use the clipped linear forms of the
logistic function and the hyperbolic tangent, in training and in prediction.
Beyond a text's ends the update gate is shut, so a state is that of the text
alone however short it is.

Training is backpropagation through time with Adam on a bounded sample: about
``SAMPLE_PER_LANGUAGE`` distinct texts a language (chosen by a hash of id and
text among those that may be learned from), of each ``SPANS`` spans anywhere in
the whole text, of ``SHORTEST`` to ``LONGEST`` characters, short ones as often
as long ones of double the length.

Rows: every input row gives one row. Null texts and texts without a letter get
``und`` and score 0; if no language can be learned, every text gets ``und``.
Rows with a null id or null language are predicted but not learned from.
Repeated rows are predicted each for itself; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.common import crc_mod, map_texts, table

HIDDEN = 8
CORE, WARM = 160, 16
PAD = 256
SAMPLE_PER_LANGUAGE = 800
SPANS, SHORTEST, LONGEST = 4, 10, 160
SHUT = -30.0
BLOCK = 2048
UNDETERMINED = "und"


def chunks(sizes: np.ndarray, core: int) -> tuple[np.ndarray, np.ndarray]:
    """The document and the first byte, within the batch, of every core."""
    count = -(-sizes // core)
    owner = np.repeat(np.arange(len(sizes)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return owner, inner * core + (np.cumsum(sizes) - sizes)[owner]


def windows(blob: np.ndarray, begin: np.ndarray, end: np.ndarray, start: np.ndarray, core: int, warm: int) -> np.ndarray:
    """Symbols of [start - warm, start + core + warm), time-major, one column a chunk; PAD outside [begin, end)."""
    span = core + 2 * warm
    padded = np.full(len(blob) + 2 * span, PAD, np.intp)
    padded[span : span + len(blob)] = blob
    rows = np.lib.stride_tricks.sliding_window_view(padded, span)[start - warm + span]
    at = np.arange(-warm, core + warm)[None, :] + start[:, None]
    edge = (start - warm < begin) | (start + core + warm > end)
    rows[edge] = np.where((at[edge] >= begin[edge, None]) & (at[edge] < end[edge, None]), rows[edge], PAD)
    return np.ascontiguousarray(rows.T)


def direction(rng: np.random.Generator, hidden: int) -> list[np.ndarray]:
    """One direction's weights: for update gate, reset gate and candidate a row of inputs per symbol, then their recurrent matrices."""
    tables = [(rng.normal(0, 0.3, (PAD + 1, hidden)) + shift).astype(np.float32) for shift in (0.5, 0.5, 0)]
    tables[0][PAD] = SHUT  # the state stays as it is; no gradient reaches this row
    return [*tables, *(rng.normal(0, 0.5 / hidden**0.5, (hidden, hidden)).astype(np.float32) for _ in range(3))]


def states(symbols: np.ndarray, weights: list[np.ndarray], keep: list | None = None) -> np.ndarray:
    """Hidden states after each symbol of a time-major block; ``keep`` gets what backpropagation needs."""
    tz, tr, tc, uz, ur, uc = weights
    steps, width = symbols.shape
    out = np.empty((steps, width, len(uc)), np.float32)
    h = np.zeros((width, len(uc)), np.float32)
    z, r, c, u = (np.empty_like(h) for _ in range(4))
    zero, one, minus = np.zeros_like(h), np.ones_like(h), -np.ones_like(h)
    for t in range(steps):
        if keep is not None:
            z, r, c = (np.empty_like(h) for _ in range(3))
        for gate, rows, recurrent in ((z, tz, uz), (r, tr, ur)):
            np.take(rows, symbols[t], axis=0, out=gate, mode="clip")
            gate += np.matmul(h, recurrent, out=u)
            np.maximum(gate, zero, out=gate)
            np.minimum(gate, one, out=gate)
        np.take(tc, symbols[t], axis=0, out=c, mode="clip")
        c += np.matmul(np.multiply(r, h, out=u), uc)
        np.maximum(c, minus, out=c)
        np.minimum(c, one, out=c)
        if keep is not None:
            keep.append((h, z, r, c))
        np.subtract(c, h, out=u)
        u *= z
        h = np.add(u, h, out=out[t])
    return out


def unroll(symbols: np.ndarray, grad_out: np.ndarray, weights: list[np.ndarray], keep: list) -> list[np.ndarray]:
    """Gradients of a direction's weights by backpropagation through time."""
    uz, ur, uc = weights[3:]
    grads = [np.zeros_like(w) for w in weights[3:]]
    inputs: list[list[np.ndarray]] = [[], [], []]
    dh = np.zeros_like(grad_out[0])
    for t in range(len(symbols) - 1, -1, -1):
        h, z, r, c = keep[t]
        dh = dh + grad_out[t]
        dc = dh * z * (np.abs(c) < 1)
        dz = dh * (c - h) * ((z > 0) & (z < 1))
        drh = dc @ uc.T
        dr = drh * h * ((r > 0) & (r < 1))
        for g, left, right in zip(grads, (h, h, r * h), (dz, dr, dc), strict=True):
            g += left.T @ right
        for kept, d in zip(inputs, (dz, dr, dc), strict=True):
            kept.append(d)
        dh = dh * (1 - z) + drh * r + dz @ uz.T + dr @ ur.T
    flat = symbols[::-1].ravel()
    tables = []
    for kept in inputs:
        d = np.stack(kept).reshape(len(flat), -1)
        tables.append(np.stack([np.bincount(flat, d[:, k], PAD + 1) for k in range(d.shape[1])], 1).astype(np.float32))
    return [*tables, *grads]


def softmax(x: np.ndarray) -> np.ndarray:
    """Over the first axis, in place."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def train(pieces: list[bytes], labels: np.ndarray, classes: int, hidden: int = HIDDEN, epochs: int = 6, batch: int = 96, seed: int = 7) -> list[np.ndarray]:
    """Weights: forward direction, backward direction, output matrix and bias."""
    rng = np.random.default_rng(seed)
    fwd, bwd = direction(rng, hidden), direction(rng, hidden)
    w_out, b_out = rng.normal(0, 0.3, (2 * hidden, classes)).astype(np.float32), np.zeros(classes, np.float32)
    weights = [*fwd, *bwd, w_out, b_out]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    sizes = np.array([len(p) for p in pieces])
    owner, start = chunks(sizes, CORE)
    blob = np.frombuffer(b"".join(pieces), np.uint8)
    begin = (np.cumsum(sizes) - sizes)[owner]
    target, end = labels[owner], begin + sizes[owner]
    share = 1 / np.maximum(np.bincount(target, minlength=classes), 1)
    step, total = 0, epochs * max(1, -(-len(start) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(start))
        for at in range(0, len(order), batch):
            take = order[at : at + batch]
            x = windows(blob, begin[take], end[take], start[take], CORE, 0)
            valid = x != PAD
            keep_f, keep_b = [], []
            hf = states(x, fwd, keep_f)
            hb = states(x[::-1], bwd, keep_b)[::-1]
            both = np.concatenate([hf, hb], axis=2).reshape(-1, 2 * hidden)
            p = softmax(w_out.T @ both.T + b_out[:, None]).reshape(classes, len(x), len(take))
            p[target[take], :, np.arange(len(take))] -= 1
            p *= (valid * (share[target[take]] / share[target[take]].sum())[None, :] / np.maximum(valid.sum(0), 1)[None]).astype(np.float32)
            p = p.reshape(classes, -1)
            grads_out = (p.T @ w_out.T).reshape(len(x), len(take), -1)
            gf = unroll(x, np.ascontiguousarray(grads_out[:, :, :hidden]), fwd, keep_f)
            gb = unroll(x[::-1], np.ascontiguousarray(grads_out[::-1, :, hidden:]), bwd, keep_b)
            grads = [*gf, *gb, both.T @ p.T, p.sum(1)]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            rate = 0.03 * (1 - step / (total + 1)) + 1e-4
            for w, g, (m, v) in zip(weights, grads, moments, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return weights


def label_positions(weights: list[np.ndarray], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Summed probabilities over, and labelled positions of, each text by class."""
    classes = len(weights[-1])
    sizes = np.array([len(t) for t in texts], np.int64)
    blob = np.frombuffer(b"".join(texts), np.uint8)
    owner, start = chunks(sizes, CORE)
    begin = (np.cumsum(sizes) - sizes)[owner]
    end = begin + sizes[owner]
    sums, votes = np.zeros((len(texts), classes)), np.zeros((len(texts), classes), np.int64)
    hidden = weights[5].shape[0]
    top, low = weights[12][:hidden].T, weights[12][hidden:].T
    for at in range(0, len(start), BLOCK):
        here = owner[at : at + BLOCK]
        lo, hi = begin[at], end[at : at + BLOCK][-1]  # the documents of this block
        x = windows(blob[lo:hi], *(v[at : at + BLOCK] - lo for v in (begin, end, start)), CORE, WARM)
        hf = states(x[: WARM + CORE], weights[:6])[WARM:].reshape(-1, hidden)
        hb = states(x[WARM:][::-1], weights[6:12])[WARM:][::-1].reshape(-1, hidden)
        scores = top @ hf.T
        scores += low @ hb.T
        scores += weights[13][:, None]
        inside = x[WARM : WARM + CORE] != PAD
        best, highest = np.zeros(scores.shape[1], np.int8), scores[0].copy()
        for k in range(1, classes):
            better = scores[k] > highest
            best[better] = k
            np.maximum(highest, scores[k], out=highest)
        best = best.reshape(inside.shape)
        best[~inside] = -1
        p = softmax(scores).reshape(classes, *inside.shape)
        p *= inside
        total = p.sum(1, dtype=np.float64).T
        ends = np.flatnonzero(np.diff(here, append=-1))
        starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
        sums[here[ends]] += np.add.reduceat(total, starts, axis=0)
        for k in range(classes):
            votes[here[ends], k] += np.add.reduceat((best == k).sum(0), starts)
    return sums, votes


def sample_spans(df: DataFrame, text: str, label: str, id_col: str, cap: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(label, piece): spans of about ``cap`` distinct texts a label, chosen by a hash of id and text; repeated rows count once."""
    rows = df.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in df.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0).select(F.col(label).cast("string").alias("label"), F.col(text).alias("piece"))
    chance = F.coalesce(*[F.when(F.col(label) == k, F.lit(min(1.0, cap / n))) for k, n in sorted(counts.items(), key=str)])
    draw = lambda seed, *more: F.pmod(F.xxhash64("text", F.lit(seed), *more), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.filter(F.pmod(F.xxhash64(id_col, text), F.lit(1 << 30)) / F.lit(float(1 << 30)) < chance)
    texts = chosen.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text")).distinct()
    spans = texts.select("label", "text", F.explode(F.sequence(F.lit(0), F.lit(SPANS - 1))).alias("k"))
    size = F.floor(F.lit(float(SHORTEST)) * F.pow(F.lit(LONGEST / SHORTEST), draw(1, F.col("k")))).cast("int")
    spans = spans.select("label", "text", size.alias("size"), draw(2, F.col("k")).alias("at"))
    begin = F.floor(F.col("at") * F.greatest(F.lit(1), F.length("text") - F.col("size") + 1)).cast("int")
    return spans.select("label", F.substr(F.col("text"), begin + 1, F.col("size")).alias("piece")).filter(F.col("piece").rlike(r"\p{L}"))


def fit(df: DataFrame, text: str = "text", label: str = "lang", id_col: str = "doc_id") -> tuple[list[str], list[np.ndarray]]:
    """Labels in order and the trained weights; df holds only rows that may be learned from."""
    got = sorted((r["label"], r["piece"].encode()) for r in sample_spans(df, text, label, id_col).collect())
    names = sorted({k for k, _ in got})
    if not names:
        return [], []
    return names, train([p for _, p in got], np.array([names.index(k) for k, _ in got]), len(names))


ADDED = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()),
    T.StructField("lang_positions", T.ArrayType(T.LongType())), T.StructField("lang_probs", T.ArrayType(T.DoubleType())),
])


def identify(df: DataFrame, model: tuple[list[str], list[np.ndarray]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default: all), the predicted language and its probability, and for each learned label the number of positions and the mean probability."""
    names, weights = model
    keep = df.columns if keep is None else keep

    def label(texts: list[bytes]) -> list[pa.Array]:
        if not names:
            return [pa.array([UNDETERMINED] * len(texts)), pa.array([0.0] * len(texts)), pa.array([[]] * len(texts), pa.list_(pa.int64())), pa.array([[]] * len(texts), pa.list_(pa.float64()))]
        sums, votes = label_positions(weights, texts)
        probs = sums / np.maximum(sums.sum(1, keepdims=True), 1e-300)
        best = probs.argmax(1)
        lettered = [any(c.isalpha() for c in t.decode("utf-8", "replace")) for t in texts]
        return [
            pa.array([names[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered, strict=True)]),
            pa.array([min(1.0, float(probs[i, b])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best.tolist(), lettered, strict=True))]),
            pa.array(votes.tolist(), pa.list_(pa.int64())), pa.array(probs.tolist(), pa.list_(pa.float64())),
        ]

    return map_texts(df, text, keep, ADDED, label)


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from."""
    return crc_mod(id_col, 4) == 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every whole text of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    found = identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_positions")
