"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are joined into one text, whose suffixes are
sorted to the length of the longest piece by doubling. Every piece of the
vocabulary finds its range of occurrences by binary search; the occurrences are
the edges of a lattice, sorted by their end within the word and relaxed in that
order, those of all words with the same end at once. The vocabulary is of
merges, so relaxing does not add scores: an edge extends the best path to its
beginning if its piece and the path's last piece are what merging their joined
text gives, which holds for exactly one path, the one that merging finds.
Characters that no piece covers become byte pieces.

Two pieces stay apart unless a merge across their border comes before the
merges that use up its two sides; that is read off the merges at the border of
each piece, kept in tables. Where a piece's merges are not in falling order of
score the two are merged to see.

Words begin at a space that follows another character; no piece has such a
space inside (checked when the vocabulary is read), so words are independent.

Rows: every input row gives one row in its place, with its other columns. A
null text is empty; an empty text has no pieces. Decoding ids gives the text
back except that U+2581 comes back as a space; U+0000 is a byte piece like any
character without a piece. Repeated rows give equal rows; an empty table gives
an empty one. ``piece_ids`` and ``decoded`` replace columns of these names.
Texts are processed whole, in batches of about ``BATCH_MB`` MB; a longer text is
a batch of its own.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.common import map_texts, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "\u2581"
BATCH_MB = 0.5
KNOWN_PAIRS = 1 << 18
UNREACHED, START, BYTES = -2, -3, -1
FOUR = np.array([48, 32, 16, 0], np.uint64)


class Vocabulary:
    """Pieces, their ranks, and what is derived from them; read once, sent to executors by value."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_: dict[int, int], skip: set[int]):
        self.pieces, self.bytes_ = pieces, bytes_
        self.ids = {p: i for i, p in enumerate(pieces) if i not in skip}
        self.rank = {p: scores[i] for p, i in self.ids.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space inside")
        steps = {p: self.merges(p) for p in self.ids}
        self.whole = {p: i for p, i in self.ids.items() if steps[p][0] == [p]}  # merging never makes the others
        self.longest = max(map(len, self.whole))
        self.of_byte = {i: b for b, i in bytes_.items()}
        self.byte_ids = np.array([bytes_[b] for b in range(256)], np.int32)
        self._border_tables(steps)
        self._search_keys()
        raw = [bytes([self.of_byte[i]]) if i in self.of_byte else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self._forget()

    def _forget(self) -> None:
        """Pairs judged lately, a table of fixed size; a newer pair replaces an older one."""
        self.known_pair = np.full(KNOWN_PAIRS, -1, np.int64)
        self.known_apart = np.zeros(KNOWN_PAIRS, bool)

    def __getstate__(self) -> dict:
        """What executors need: tables. Names and ranks go along only where pieces must be merged to see."""
        left_out = {"known_pair", "known_apart", "ids", "whole", "bytes_", "of_byte"} | ({"pieces", "rank"} if self.regular[self.whole_ids].all() else set())
        return {k: v for k, v in self.__dict__.items() if k not in left_out}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def merges(self, text: str) -> tuple[list[str], list[tuple[float, int, str, str]]]:
        """The pieces of a short text by merging the best pair, leftmost first, and the merges made: score, place, left, right."""
        parts, made = list(text), []
        while True:
            best = max(((self.rank[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                return parts, made
            i = -best[1]
            made.append((best[0], sum(map(len, parts[:i])), parts[i], parts[i + 1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _border_tables(self, steps: dict) -> None:
        """What stands at either border of a piece while it is merged: symbols, and the scores of the merges that use them up."""
        symbols = {p: k for k, p in enumerate(dict.fromkeys([*self.ids, *(c for p in self.ids for c in p)]))}
        n, wide = len(self.pieces), self.longest + 1
        self.side = [np.zeros((n, wide), np.int32) for _ in range(2)]
        self.until = [np.full((n, wide), -np.inf, np.float32) for _ in range(2)]
        self.regular = np.zeros(n, bool)
        if len({np.float32(r) for r in self.rank.values()}) < len(set(self.rank.values())):
            raise ValueError("scores that four bytes cannot tell apart")
        for p, i in self.whole.items():
            made = steps[p][1]
            self.regular[i] = all(x[0] >= y[0] for x, y in zip(made, made[1:], strict=False))
            for right, (sides, until) in enumerate(zip(self.side, self.until, strict=True)):
                # the piece's left border is what a piece before it meets, its right border what follows meets
                now, k = (p[-1] if right else p[0]), 0
                sides[i, 0] = symbols[now]
                for score, at, left, other in made:
                    if (at + len(left) + len(other) == len(p)) if right else at == 0:
                        until[i, k] = score
                        k += 1
                        sides[i, k] = symbols[left + other]
        splits = sorted((symbols[p[:k]] * len(symbols) + symbols[p[k:]], self.rank[p]) for p in self.ids for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.n_symbols = len(symbols)
        self.split_key = np.array([x[0] for x in splits], np.int64)
        self.split_score = np.array([x[1] for x in splits], np.float32)

    def _search_keys(self) -> None:
        """Pieces as symbols of two bytes, four to a number, filled up below and above."""
        self.used = np.array(sorted({ord(c) for p in self.whole for c in p}), np.uint32)
        names = list(self.whole)
        wide = -(-self.longest // 4) * 4
        self.sizes = np.array([len(p) for p in names], np.int32)
        self.whole_ids = np.array(list(self.whole.values()), np.int32)
        flat = self.symbols(np.array([ord(c) for p in names for c in p], np.uint32))
        inside = np.arange(wide)[None, :] < self.sizes[:, None]
        low, high = np.zeros((len(names), wide), np.uint64), np.full((len(names), wide), 0xFFFF, np.uint64)
        low[inside] = flat
        high[inside] = flat
        self.low, self.high = ((x.reshape(len(names), -1, 4) << FOUR).sum(2, dtype=np.uint64) for x in (low, high))
        self.single = np.array([chr(c) in self.whole for c in self.used.tolist()])

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Characters by rank; 1 for those of no piece, 0 is the mark between words."""
        at = np.minimum(np.searchsorted(self.used, codes), len(self.used) - 1)
        return np.where(self.used[at] == codes, at + 2, 1).astype(np.uint16)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b stay as they are when their text is merged; pairs seen lately are looked up."""
        pair = a.astype(np.int64) * len(self.regular) + b
        slot = ((pair * 0x9E3779B1) >> 7) & (KNOWN_PAIRS - 1)
        new = np.flatnonzero(self.known_pair[slot] != pair)
        out = self.known_apart[slot]
        if len(new):
            fresh, back = np.unique(pair[new], return_inverse=True)
            judged = self.judge(fresh // len(self.regular), fresh % len(self.regular))
            out[new] = judged[back]
            self.known_pair[slot[new]] = pair[new]
            self.known_apart[slot[new]] = out[new]
            clash = self.known_pair[slot[new]] != pair[new]  # two new pairs of one slot: keep neither
            self.known_pair[slot[new][clash]] = -1
        return out

    def judge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        odd = ~(self.regular[a] & self.regular[b])
        for k in np.flatnonzero(odd).tolist():
            left, right = self.pieces[a[k]], self.pieces[b[k]]
            out[k] = self.merges(left + right)[0] == [left, right]
        live = np.flatnonzero(~odd)
        i, j = np.zeros(len(a), np.int32), np.zeros(len(a), np.int32)
        while len(live):
            x, y = a[live], b[live]
            left_until, right_until = self.until[1][x, i[live]], self.until[0][y, j[live]]
            key = self.side[1][x, i[live]].astype(np.int64) * self.n_symbols + self.side[0][y, j[live]]
            at = np.minimum(np.searchsorted(self.split_key, key), len(self.split_key) - 1)
            score = np.where(self.split_key[at] == key, self.split_score[at], np.float32(-np.inf))
            # of equal scores the leftmost merge comes first
            joined = (score > left_until) & (score >= right_until) & (score > -np.inf)
            out[live[joined]] = False
            go_left = left_until >= right_until
            ended = np.where(go_left, left_until, right_until) == -np.inf
            i[live] += go_left
            j[live] += ~go_left
            live = live[~(joined | ended)]
        return out


@functools.lru_cache
def read_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    bytes_ = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
    skip = {i for i in range(n) if m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}
    return Vocabulary([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)], bytes_, skip)


def ranks(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Rank of each place by its key, equal keys alike, from 1; one place more, of rank 0, for what lies beyond the text."""
    ranked = key[order]
    out = np.zeros(len(key) + 1, np.uint64)
    out[order] = 1 + np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])]).astype(np.uint64)
    return out


def suffix_array(packed: np.ndarray, longest: int) -> np.ndarray:
    """Places in the order of the suffixes that begin there, compared to ``longest`` symbols at least; ``packed`` has four symbols at each place."""
    order, known = np.argsort(packed), 4
    key = packed
    while known < longest:
        rank = ranks(order, key)
        ahead = np.minimum(np.arange(len(key)) + known, len(key))
        key = (rank[:-1] << np.uint64(32)) | rank[ahead]
        order, known = np.argsort(key), 2 * known
    return order


def occurrences(packed: np.ndarray, order: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """For every piece the range of the suffix array whose suffixes begin with it, by binary search on four symbols at a time."""
    ranked = packed[order]
    first, last = np.searchsorted(ranked, vocab.low[:, 0], "left"), np.searchsorted(ranked, vocab.high[:, 0], "right")
    beyond = np.append(packed, np.zeros(vocab.longest + 4, np.uint64))
    for part in range(1, vocab.low.shape[1]):
        more = np.flatnonzero((vocab.sizes > 4 * part) & (first < last))
        for bound, key, right in ((first, vocab.low[more, part], False), (last, vocab.high[more, part], True)):
            lo, hi = first[more].copy(), last[more].copy()
            if right:
                lo = start[more]
            else:
                start = first.copy()
            while len(open_ := np.flatnonzero(lo < hi)):
                middle = (lo[open_] + hi[open_]) // 2
                there = beyond[order[middle] + 4 * part]
                up = there <= key[open_] if right else there < key[open_]
                lo[open_[up]] = middle[up] + 1
                hi[open_[~up]] = middle[~up]
            bound[more] = lo
    return first, np.maximum(first, last)


def encode_words(words: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the words, joined, and the number of each word's."""
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(sizes + 1) - (sizes + 1)  # with a mark after each word
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    place = np.arange(len(codes)) + word
    n = int(sizes.sum()) + len(words)
    text = np.zeros(n + 4, np.uint64)
    known = vocab.symbols(codes)
    text[place] = known
    packed = (text[:n] << FOUR[0]) | (text[1 : n + 1] << FOUR[1]) | (text[2 : n + 2] << FOUR[2]) | text[3 : n + 3]
    order = suffix_array(packed, vocab.longest)
    first, last = occurrences(packed, order, vocab)
    count = last - first
    piece = np.repeat(np.arange(len(count), dtype=np.int32), count)
    begin = order[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(piece))]
    end = begin + vocab.sizes[piece]
    origin = np.zeros(n, np.int64)
    origin[place] = starts[word]
    by = np.argsort((end - origin[begin]).astype(np.uint16 if sizes.max(initial=0) < 1 << 16 else np.int64), kind="stable")
    begin, end, piece = begin[by], end[by], vocab.whole_ids[piece[by]]
    longest = int(sizes.max(initial=0))
    cut = np.searchsorted(end - origin[begin], np.arange(longest + 2))
    lone = place[(known == 1) | ~vocab.single[np.maximum(known.astype(np.int64) - 2, 0)]]  # characters that are no piece
    lone = lone[np.argsort(lone - origin[lone], kind="stable")]
    lone_cut = np.searchsorted(lone - origin[lone] + 1, np.arange(longest + 2))
    piece_at, begin_at = np.full(n + 1, UNREACHED, np.int32), np.zeros(n + 1, np.int64)  # by the place after the piece
    piece_at[starts] = START
    for e in range(1, longest + 1):
        here = slice(cut[e], cut[e + 1])
        before = piece_at[begin[here]]
        good = (before == START) | (before == BYTES)
        ask = np.flatnonzero(before >= 0)
        if len(ask):
            good[ask] = vocab.apart(before[ask], piece[here][ask])
        at = end[here][good]
        piece_at[at] = piece[here][good]
        begin_at[at] = begin[here][good]
        chars = lone[lone_cut[e] : lone_cut[e + 1]]
        chars = chars[piece_at[chars + 1] == UNREACHED]
        piece_at[chars + 1] = BYTES
        begin_at[chars + 1] = chars
    # back from the ends, all words at once
    at, who, found = starts + sizes, np.arange(len(words)), []
    while len(who):
        p, b = piece_at[at], begin_at[at]
        found.append((who, p, b))
        more = piece_at[b] != START
        at, who = b[more], who[more]
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    who, ids, b = (np.concatenate([f[k] for f in found[::-1]]) for k in range(3))
    by = np.argsort(who, kind="stable")
    who, ids, b = who[by], ids[by], b[by]
    where = np.flatnonzero(ids == BYTES)
    if len(where):
        char = np.zeros(n, np.uint32)
        char[place] = codes
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in char[b[where]].tolist()]
        times = np.ones(len(ids), np.int64)
        times[where] = [len(r) for r in raw]
        is_byte = np.repeat(ids == BYTES, times)
        ids, who = np.repeat(ids, times), np.repeat(who, times)
        ids[is_byte] = vocab.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    return ids, np.bincount(who, minlength=len(words))


WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")


def split_words(text: str) -> list[str]:
    """Words with the spaces before them, the text's first with a space added."""
    return WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []


def gather(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``at`` and have ``size``, joined."""
    return values[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def encode_texts(texts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the texts, joined, and the number of each text's."""
    number: dict[str, int] = {}
    said, lengths = [], []
    for t in texts:
        ws = split_words(t)
        lengths.append(len(ws))
        said += [number.setdefault(w, len(number)) for w in ws]
    if not number:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    ids, sizes = encode_words(list(number), vocab)
    said = np.array(said, np.int64)
    flat = gather(ids, (np.cumsum(sizes) - sizes)[said], sizes[said])
    upto = np.append(0, np.cumsum(sizes[said]))
    ends = np.cumsum(lengths)
    return flat, upto[ends] - upto[ends - lengths]


def decode_ids(ids: list[int], vocab: Vocabulary) -> str:
    """The text of piece ids, without the space added at its beginning; runs of byte pieces are UTF-8."""
    ids = np.asarray(ids, np.int64)
    return gather(vocab.raw, vocab.raw_at[ids], vocab.raw_size[ids]).tobytes().decode("utf-8", "replace").removeprefix(" ")


def decode_flat(ids: np.ndarray, lengths: np.ndarray, vocab: Vocabulary) -> pa.Array:
    """As ``decode_ids``, for all texts of a batch."""
    size = vocab.raw_size[ids]
    raw = gather(vocab.raw, vocab.raw_at[ids], size).tobytes()
    upto = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(lengths))].tolist()
    return pa.array([raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(upto, upto[1:], strict=False)], pa.string())


def encode(df: DataFrame, text: str = "text", keep: list[str] | None = None, model: str = MODEL) -> DataFrame:
    """The ``keep`` columns (default: all), ``piece_ids``, and ``decoded``, the text decoded from them."""
    vocab = read_vocabulary(model)
    added = T.StructType([T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(texts: list[bytes]) -> list[pa.Array]:
        flat, lengths = encode_texts([t.decode("utf-8", "replace") for t in texts], vocab)
        offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())), decode_flat(flat, lengths, vocab)]

    return map_texts(df, text, df.columns if keep is None else keep, added, run, BATCH_MB)


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of the piece ids of every whole text of documents, and the digest of the text decoded from them."""
    found = encode(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", F.size("piece_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
