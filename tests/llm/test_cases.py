"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, and brute force, operator by operator."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm import ann, chat_format, decontaminate, language_id, line_dedup, ngram_join, piece_codec, quality, secret_scan, url_filter

DOCS = "doc_id long, text string"
FULL = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def words(rng, n):
    return " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(300)) for _ in range(n))


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# op1 ---------------------------------------------------------------------------------------------------------------


def test_chat_ties_nulls_and_length(spark):
    rows = [(1, 0, "b", "x"), (1, 0, "a", "y"), (1, None, "z", "first"), (None, 0, "user", "q"), (None, 0, "user", "q"), (2, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("segments", F.lit(2))
    got = {r.conv_id: r for r in chat_format.format_chats(df, chat_format.text_parts("text")).withColumn("turns", chat_format.read_back(F.col("formatted"))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("z", "first"), ("a", "y"), ("b", "x")]
    assert len(got[None].turns) == 2 and got[2].turns[0].text == "long " * 50_000


def test_chat_audio_and_documents(spark):
    part = lambda kind, **v: "named_struct(" + ", ".join(f"'{k}', {v.get(k, 'null')}" for k in ("text", "ref", "width", "height", "millis", "pages")).join([f"'type', '{kind}', ", ")"])
    parts = ", ".join([part("audio", ref="'a'", millis="81"), part("document", ref="'d'", pages="2"), part("document"), part("text")])
    r = chat_format.format_chats(spark.sql(f"select 1L conv_id, 0L turn, 'user' role, cast(array({parts}) as {chat_format.PARTS}) parts"), F.col("parts")).first()
    assert r.formatted == "<|turn|>user<|body|><|audio|><|document|><|document|><|end|>"
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [("audio", "a", 3), ("document", "d", 1024), ("document", None, 512)] and r.expanded_tokens == 1539


# op2 ---------------------------------------------------------------------------------------------------------------


def test_url_rows(spark):
    listed = spark.createDataFrame(url_filter.RULES + [(None, "/x", "block"), ("odd.com", None, "block")], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://example.com/en/x"), (1, "http://example.com/en/x"), (None, "http://q.net/fr/"), (2, "http://h.net/" + "a" * 100_000)], "page_id long, url string").withColumn("rule", F.lit("mine"))
    got = sorted(((r.page_id, r.rule, r.verdict) for r in url_filter.judge(df, listed).collect()), key=str)
    assert got == [(1, "example.com/en/", "block"), (1, "example.com/en/", "block"), (2, None, "allow"), (None, "net/fr/", "block")]
    assert url_filter.judge(df.limit(0), listed).count() == 0


def test_url_list_against_brute_force(spark):
    rng = random.Random(7)
    name = lambda: rng.choice("abc") + rng.choice("xyz")
    rules = {(".".join(name() for _ in range(rng.randrange(1, 4))), "/" + name()[: rng.randrange(3)]): rng.choice(["allow", "block"]) for _ in range(400)}
    urls = [f"http://{'.'.join(name() for _ in range(rng.randrange(1, 5)))}/{name()}/{name()}" for _ in range(600)]
    want = []
    for u in urls:
        host, path = re.match(r"http://([^/]*)(.*)", u).groups()
        fit = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        want.append((best[2], best[3]))
    listed = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()], "host string, path string, verdict string")
    got = {r.i: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "i int, url string"), listed).collect()}
    assert [got[i] for i in range(len(urls))] == want


# op3 ---------------------------------------------------------------------------------------------------------------


def nearest(x, ids, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def recall(spark, x, **how):
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 60 == 0, **how).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q in range(0, len(x), 60):
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        for _, i, s in mine:
            assert s == np.sqrt(((x[i] - x[q]) ** 2).sum())
        hit += len({i for _, i, _ in mine} & {i for i, _ in nearest(x, ids, q, 10)})
        total += 10
    return hit / total


def test_ann_recall_and_what_the_codes_do(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24))
    assert recall(spark, x) >= 0.9
    few = recall(spark, x, shortlist=40)
    monkeypatch.setattr(ann, "encode", lambda res, books: np.zeros((len(res), len(books)), np.uint8))
    assert recall(spark, x, shortlist=40) < few - 0.2


def test_ann_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(50, [0.0, 1.0]), (50, [0.0, 1.0]), (51, [2.0, 0.0, 0.0]), (52, [2.0, 1.0, 0.0]), (None, [1.0, 1.0]), (60, [0.5, 0.5]), (60, [9.0, 9.0]), (61, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query", F.lit("x")).withColumn("id", F.lit(0))
    got = {}
    for r in ann.search(df, F.col("vec_id").isin(3, 51, 60, 61), k=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert got[3] == [(0, 0.0), (1, 0.0), (2, 0.0), (4, 0.0)]
    assert got[51] == [(52, 1.0)] and set(got) == {3, 51, 60}
    assert got[60] == [(0, round(0.5**0.5, 6)), (1, round(0.5**0.5, 6)), (2, round(0.5**0.5, 6)), (3, round(0.5**0.5, 6))]


# op4, op6 ----------------------------------------------------------------------------------------------------------


def test_language_gradients(monkeypatch):
    rng = np.random.default_rng(0)
    w = [a.astype(np.float64) for a in language_id.direction(rng, 3)]
    symbols = np.array([[3, 256], [5, 7], [256, 7]])
    pull = rng.normal(size=(3, 2, 3)).astype(np.float32)
    loss = lambda: float((language_id.states(symbols, [a.astype(np.float32) for a in w]) * pull).sum())
    keep = []
    language_id.states(symbols, [a.astype(np.float32) for a in w], keep)
    grads = language_id.unroll(symbols, pull, [a.astype(np.float32) for a in w], keep)
    for table, at in ((0, (5, 1)), (1, (7, 0)), (2, (3, 2)), (3, (0, 1)), (4, (1, 1)), (5, (2, 0))):
        w[table][at] += 1e-2
        up = loss()
        w[table][at] -= 2e-2
        down = loss()
        w[table][at] += 1e-2
        assert grads[table][at] == pytest.approx((up - down) / 2e-2, abs=2e-2)
    assert not grads[0][256].any() and not grads[2][256].any()


def test_language_states_do_not_depend_on_padding():
    w = language_id.direction(np.random.default_rng(2), 4)
    text = np.array([[10], [20], [30]])
    padded = np.concatenate([np.full((5, 1), 256), text, np.full((4, 1), 256)])
    assert np.allclose(language_id.states(padded, w)[5:8], language_id.states(text, w))


@pytest.fixture(scope="module")
def language_model(spark):
    docs = documents(spark)
    return language_id.fit(docs.filter(~language_id.held_out()))


def test_language_held_out_by_length(spark, language_model):
    rows = documents(spark).filter(language_id.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    starts = rows.select("lang", F.explode(F.array(*[F.substring("text", 1, n) for n in (20, 50, 100, 240, 100_000)])).alias("text")).filter(F.col("text").rlike(r"\p{L}"))
    size = F.when(F.length("text") <= 20, 20).when(F.length("text") <= 50, 50).when(F.length("text") <= 100, 100).when(F.length("text") <= 240, 240).otherwise(1000)
    got = {r[0]: r.ok / r.n for r in language_id.identify(starts, language_model).groupBy(size.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang_pred") == F.col("lang")).alias("ok")).collect()}
    assert got[1000] >= 0.97 and got[240] >= 0.97 and got[100] >= 0.95 and got[50] >= 0.9 and got[20] >= 0.8, got


def test_language_rows(spark, language_model):
    df = spark.createDataFrame([(1, None), (1, ""), (None, "12 34 !"), (2, "the house is in the garden " * 4000), (2, "the house is in the garden " * 4000)], DOCS).withColumn("lang_pred", F.lit("mine"))
    got = language_id.identify(df, language_model).collect()
    assert len(got) == 5 and [r.lang_pred for r in got if not (r.text or "").startswith("the")] == ["und"] * 3
    long = [r for r in got if (r.text or "").startswith("the")]
    assert long[0] == long[1] and sum(long[0].lang_positions) == len(long[0].text) and abs(sum(long[0].lang_probs) - 1) < 1e-9
    assert language_id.identify(df.limit(0), language_model).count() == 0
    nothing = language_id.fit(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}


def test_language_sample_is_bounded_by_distinct_texts(spark):
    df = spark.createDataFrame([(1, "one text that a third of all rows hold", "en")] * 500 + [(i, words(random.Random(i), 30), "en") for i in range(2, 400)], DOCS + ", lang string")
    rows = language_id.sample_spans(df, "text", "lang", "doc_id", 100).collect()
    assert 0 < len(rows) <= 4 * 150 and sum("third of" in r.piece for r in rows) <= 4


def test_quality_equals_a_plain_convolution():
    rng = np.random.default_rng(3)
    w = [rng.normal(size=s).astype(np.float32) for s in ((quality.WIDTH, 257, quality.FILTERS), (quality.FILTERS + 1, quality.DENSE), quality.DENSE, quality.DENSE, ())]
    texts = [b"", b"a", b"hello world " * 60, bytes(range(256)) * 3]
    want = []
    for t in texts:
        logits, sizes = [], []
        for at in range(0, max(1, len(t)), quality.CHUNK):
            size = max(1, min(quality.CHUNK, len(t) - at))
            sym = [t[i] if i < len(t) else 256 for i in range(at, at + quality.CHUNK + quality.WIDTH - 1)]
            pool = np.max([sum(w[0][k, sym[p + k]] for k in range(quality.WIDTH)) for p in range(quality.CHUNK)], axis=0)
            a = np.append(np.tanh(pool), size / quality.CHUNK)
            logits.append(np.tanh(a @ w[1] + w[2]) @ w[3] + w[4])
            sizes.append(size)
        want.append(1 / (1 + np.exp(-np.average(logits, weights=sizes))))
    assert np.allclose(quality.score_texts(w, texts), want, atol=1e-4)


def test_quality_rows(spark):
    df = spark.createDataFrame([(i, ("good clean text " if i % 2 else "BAD!!! junk ### ") * 20) for i in range(120)] + [(500, None), (501, ""), (502, "good clean text " * 20_000), (1, "other text of a repeated id")], DOCS).withColumn("quality_score", F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(3, 0), (None, 1), (4, 7)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    got = {(r.doc_id, r.text): r.quality_score for r in quality.classify(df, model).collect()}
    assert len(got) == 124 and all(0 <= v <= 1 for v in got.values()) and got[500, None] == got[501, ""] and got[502, "good clean text " * 20_000] > 0.5
    assert quality.fit(df, labels.limit(0)) == 0.5 and quality.fit(df, labels.filter("quality = 1")) == 1.0
    assert quality.classify(df.limit(0), model).count() == 0


# op5 ---------------------------------------------------------------------------------------------------------------


def test_pieces_of_a_frame(spark):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)
    texts = [None, "", "x", "a\0b", "same", "same", "wörter 日本 " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("decoded", F.lit(1)).withColumn("piece_ids", F.lit(2)).withColumn("other", F.lit(3))
    got = {r.doc_id: r for r in piece_codec.encode(df).collect()}
    assert len(got) == len(texts) and got[0].other == 3
    for i, t in enumerate(texts):
        assert got[i].piece_ids == m.encode(t or "") and got[i].decoded == (t or "")
    assert piece_codec.encode(df.limit(0)).count() == 0


def test_pieces_that_stay_apart_are_those_that_merging_leaves():
    v = piece_codec.read_vocabulary(piece_codec.MODEL)
    rng = random.Random(5)
    ids = list(v.whole.values())
    a, b = (np.array([rng.choice(ids) for _ in range(3000)]) for _ in range(2))
    want = [v.merges(v.pieces[x] + v.pieces[y])[0] == [v.pieces[x], v.pieces[y]] for x, y in zip(a, b, strict=True)]
    assert v.judge(a, b).tolist() == want and v.apart(a, b).tolist() == want and v.apart(a, b).tolist() == want


def test_suffix_array_finds_every_piece():
    v = piece_codec.read_vocabulary(piece_codec.MODEL)
    words_ = ["▁the", "▁therefore", "▁aaaaaaaaaaaaaaaaaaaaaaaa", "éé", "\0", "▁in"]
    mark = chr(0x10FFFF)
    text = mark.join(words_) + mark
    codes = np.array([0 if c == mark else ord(c) for c in text], np.uint32)
    sym = np.where(codes == 0, 0, v.symbols(codes)).astype(np.uint64)
    padded = np.concatenate([sym, np.zeros(4, np.uint64)])
    packed = sum(padded[k : k + len(sym)] << np.uint64(48 - 16 * k) for k in range(4))
    order = piece_codec.suffix_array(packed, v.longest)
    first, last = piece_codec.occurrences(packed, order, v)
    counted = dict(zip(v.whole, (last - first).tolist(), strict=True))
    for piece, n in counted.items():
        assert n == sum(text.startswith(piece, i) for i in range(len(text))), piece


# op7 ---------------------------------------------------------------------------------------------------------------


def test_base_secrets_against_plain_patterns(spark):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    want = {}
    for r in documents(spark).select("doc_id", "text").collect():
        t = r.text or ""
        spans = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m.group(1)) >= 6]
        spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
        spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
        want[r.doc_id] = sorted(spans, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secret_spans if s.kind in secret_scan.BASE] for r in secret_scan.scan_secrets(documents(spark), keep=["doc_id"]).collect()}
    assert got == want and sum(map(len, want.values())) > 20


def test_secret_kinds_and_checksums(spark):
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = secret_scan.checksum62(body.encode()).decode()
    deep = "eyJ" + __import__("base64").urlsafe_b64encode(b'"x":' + b"[" * 20_000).decode().rstrip("=")
    texts = [
        f"ghp_{body}{good} x", f"ghp_{body}000000", f"npm_{body}{good}", "eyJhbGciOiJIUzI1NiJ9.e30.abc", "eyJxxx.e30.abc", deep + ".a.b", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PUBLIC KEY-----",
        f"token=ghp_{body}{good}", "é" * 100_000 + " password=abcdef", None, "", "TOKEN : x1y2z3",
    ]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], DOCS).withColumn("secret_spans", F.lit(1))
    rows = secret_scan.scan_secrets(df).collect()
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secret_spans] for r in rows}
    kinds = {i: [k for k, _, _ in v] for i, v in got.items()}
    assert len(rows) == len(texts) + 1
    assert kinds == {0: ["github"], 1: [], 2: ["npm"], 3: ["jwt"], 4: [], 5: [], 6: ["pem"], 7: [], 8: ["assign", "github"], 9: ["assign"], 10: [], 11: [], 12: ["assign"]}
    assert got[9] == [("assign", 100_001, 100_016)] and secret_scan.scan_secrets(df.limit(0)).count() == 0


# op8 ---------------------------------------------------------------------------------------------------------------


def test_ngram_repeated_and_null_ids(spark):
    rng = random.Random(8)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, a + " other"), (7, "w " * 3), (7, "w " * 3), (8, words(rng, 30_000))]
    df = spark.createDataFrame(rows, DOCS).withColumn("id", F.lit("x")).withColumn("class_key", F.lit(1)).withColumn("node", F.lit(2))
    got = Counter((r.id, r.n_shingles > 0, r.component_id) for r in ngram_join.group_rows(df, n=4, percent=85).collect())
    assert got == Counter({(1, True, 1): 2, (2, True, 1): 1, (3, True, 1): 1, (None, True, 1): 1, (7, True, 7): 2, (8, True, 8): 1})
    only = ngram_join.group_rows(spark.createDataFrame([(None, a), (None, a + " more")], DOCS), n=4, percent=85).collect()
    assert [r.component_id for r in only] == [None, None]
    assert ngram_join.group_rows(df.limit(0)).count() == 0


def test_words_of_any_length_hash_apart():
    thue = b"a"
    for _ in range(10):
        thue += thue.translate(bytes.maketrans(b"ab", b"ba"))
    other = thue.translate(bytes.maketrans(b"ab", b"ba"))
    texts = [thue, other, thue + b"x", b"a" * 64, b"a" * 65, b"a" * 128]
    sets = ngram_join.shingle_sets(texts, 4)
    assert len({s[0] for s in sets}) == len(texts)
    joined = ngram_join.shingle_sets([b" \t".join(texts) + b" \n  "], 1)[0]
    assert set(joined) == {s[0] for s in ngram_join.shingle_sets(texts, 1)}


def test_first_copies(spark):
    rng = random.Random(9)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(5, a + " x"), (2, a), (3, a), (2, b), (9, b + " y"), (None, a + " z"), (4, None), (4, ""), (6, "alone"), (6, "alone"), (None, words(rng, 40))]
    df = spark.createDataFrame(rows, DOCS).withColumn("__own", F.lit(1))
    got = Counter((r.doc_id, (r.text or "")[:9]) for r in ngram_join.first_copies(df).collect())
    assert got == Counter({(2, a[:9]): 1, (2, b[:9]): 1, (4, ""): 2, (6, "alone"): 1, (None, rows[-1][1][:9]): 1})


# op9 ---------------------------------------------------------------------------------------------------------------


def brute_windows(docs, items):
    def split(t):
        return [w for w in re.split(r"[\x20\t-\r]+", (t or "").translate(str.maketrans(decontaminate.UPPER, decontaminate.LOWER))) if w]

    out = {}
    for d, t in docs:
        w = split(t)
        for k, u in items:
            v = split(u)
            n, size = min(5, len(v)), min(len(v), len(w))
            if not v or len(w) < n:
                continue
            want = Counter(tuple(v[i : i + n]) for i in range(len(v) - n + 1))
            have = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
            hits = []
            for at in range(len(w) - size + 1):
                here = Counter(have[at : at + size - n + 1])
                low = sum((here & want).values())
                hits.append(low / (sum(here.values()) + sum(want.values()) - low))
            good = [h for h in hits if h >= 0.8]
            if good:
                count, best = out.get((d, k), (0, 0))
                out[d, k] = (count + len(good), max(best, *good))
    return out


def test_passages_against_all_windows(spark):
    rng = random.Random(10)
    a, b, c = words(rng, 40), words(rng, 60), words(rng, 50)
    items = [(1, a + " " + b), (2, c), (3, "tiny Item here"), (4, "u v w q r " * 20), (5, None), (6, ""), (2, c), (7, c)]
    docs = [
        (1, b + " " + a), (2, words(rng, 30) + " " + b + " " + a + " " + words(rng, 30)), (3, " ".join(c.split()[2:]) + " " + words(rng, 40)), (4, words(rng, 20) + " " + " ".join(c.split()[:-2])), (5, " ".join(c.split()[1:-1])),
        (6, "a TINY item here b"), (7, "u v w q r " * 300), (None, c.upper()), (8, None), (9, ""), (10, words(rng, 9_000) + " " + c + " " + words(rng, 9_000)), (11, c), (11, c), (12, c.replace(c.split()[20], "changed")),
    ]
    df = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("mine")).withColumn("v1", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.id, r.item_id): (r.n_windows, pytest.approx(r.similarity)) for r in decontaminate.find_passages(df, bench).collect()}
    want = brute_windows(dict.fromkeys(docs), dict(items).items())
    assert got == want and (2, 1) in got and (1, 1) in got
    left = {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.find_passages(df.limit(0), bench).count() == 0 and decontaminate.find_passages(df, bench.limit(0)).count() == 0


# op10 --------------------------------------------------------------------------------------------------------------


def brute_lines(docs):
    seen, want = [], []
    for _, text in docs:
        if text is None:
            want.append((None, 0))
            continue
        kept = []
        for line in text.split("\n"):
            s = set(re.split(r"[ \t-\r]+", line.translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER)))) - {""}
            if not (s and any(100 * len(s & t) >= 80 * len(s | t) for t in seen)):
                kept.append(line)
            seen.append(s)
        want.append(("\n".join(kept), text.count("\n") + 1 - len(kept)))
    return want


def test_lines_against_brute_force(spark):
    rng = random.Random(11)
    base = [words(rng, n) for n in (1, 2, 5, 9, 30, 60, 100, 200, 400)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(8):
            w = rng.choice(base).split()
            for _ in range(rng.randrange(1 + len(w) // 6)):
                w[rng.randrange(len(w))] = words(rng, 1)
            rng.shuffle(w)
            lines.append(rng.choice([" ", "\t", "  "]).join(w))
        docs.append((i, "\n".join(lines)))
    docs += [(50, None), (51, ""), (52, "\n\n"), (53, "ÄRGER Straße"), (54, "Ärger STRASSE"), (55, "ÄRGER straße")]
    df = spark.createDataFrame(docs, DOCS)
    for extra in ("doc", "version", "place", "words", "sid", "n", "k1"):
        df = df.withColumn(extra, F.lit(extra))
    got = {r.doc_id: (r.text, r["__lines_removed"]) for r in line_dedup.dedup_lines(df).collect()}
    assert [got[d] for d, _ in docs] == brute_lines(docs)


def test_lines_of_repeated_and_null_ids(spark):
    rows = [(None, "a b c"), (1, "a b c\nx"), (1, "a b c\nx"), (1, "y\na b c"), (2, "w " * 200_000)]
    got = Counter((r.doc_id, r.text if len(r.text) < 99 else "long", r["__lines_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect())
    assert got == Counter({(None, "a b c", 0): 1, (1, "x", 1): 2, (1, "y", 1): 1, (2, "long", 0): 1})


# pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(12)
    en = lambda n: " ".join(rng.choice("the and of with that house garden river under over when there".split()) + rng.choice(["", "s", "ly", "ing"]) for _ in range(n))
    bench = words(rng, 50)
    rows = [(i, en(60) + "\n" + en(30), "en", "s", 9) for i in range(60)]
    near = en(80).split()
    rows += [
        (100, " ".join(near), "en", "s", 1), (101, " ".join(near[:-1] + ["changed"]) + "\n" + "more of the same text here now", "en", "s", 1), (102, None, "en", "s", 0), (103, "12 34", None, None, 5), (104, en(20) + " " + bench + " " + en(20), "en", "s", 3),
        (105, rows[0][1], "en", "s", 9), (None, en(40), "en", "s", None), (None, en(40), "en", "s", None), (106, "", "en", "s", 0),
    ]
    schema = FULL + ", decoded string, lang_pred string"
    spark.createDataFrame([(*r, "mine", "own") for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{i}"))
        new = spark.read.parquet(str(tmp_path / f"out{i}"))
        assert new.columns == columns + (["piece_ids"] if i == 4 else []) and {r.decoded for r in new.collect()} == {"mine"} and {r.lang_pred for r in new.collect()} == {"own"}
        seen[name] = (Counter(r.doc_id for r in docs.collect()), Counter(r.doc_id for r in new.collect()), {r.doc_id: r.text for r in new.collect()})
        docs = new
    gone = {k: set(a) - set(b) for k, (a, b, _) in seen.items()}
    assert gone["language_id"] == {102, 103, 106}
    assert gone["line_dedup"] == {105} and seen["line_dedup"][2][101] == "more of the same text here now" and seen["line_dedup"][1][None] == 2
    assert gone["ngram_join"] == set() and gone["decontaminate"] == {104} and gone["piece_codec"] == set()
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)
    assert all(r.piece_ids == m.encode(r.text) for r in docs.collect())
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0), str(tmp_path)).count() == 0


def test_copy_stage(spark):
    rng = random.Random(13)
    a = words(rng, 80)
    rows = [(3, a), (1, a + " x"), (2, words(rng, 50)), (4, a), (2, "few")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], FULL)
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.copy_stage(spark, df, "").collect()) == sorted([(1, a + " x"), rows[2], (2, "few")])
