"""Small cases for each operator against brute force or exact round trips."""

import gc
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import ann, chat_format, common, decontaminate, language_id, line_dedup, ngram_join, piece_codec, quality, secret_scan, url_filter

DOCS = "doc_id long, text string"


def words(rng, n):
    return " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(300)) for _ in range(n))


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a<|end|>\\l <b"), (1, 1, "assistant", "\\b</s>"), (2, None, None, None), (3, 0, "assistant", ""), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_chats(df, chat_format.text_parts("text")).withColumn("turns", chat_format.read_back(F.col("formatted"))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "a<|end|>\\l <b"), ("assistant", "\\b</s>")]
    assert [tuple(t) for t in got[2].turns] == [("", "")] and len(got[3].turns) == 2
    assert chat_format.format_chats(df.limit(0), chat_format.text_parts("text")).count() == 0


def test_chat_parts(spark):
    df = spark.sql(f"select 1L conv_id, 0L turn, 'user' role, cast(array(named_struct('type','text','text','<x','ref',null,'width',null,'height',null,'millis',null,'pages',null), named_struct('type','image','text',null,'ref','r1','width',56,'height',29,'millis',null,'pages',null)) as {chat_format.PARTS}) parts")
    r = chat_format.format_chats(df, F.col("parts")).first()
    assert r.formatted == "<|turn|>user<|body|>\\lx<|image|><|end|>" and r.expanded_tokens == 4 and r.attachments[0].ref == "r1"


def test_url_filter(spark):
    urls = ["http://A.Com/x", "https://example.com/en/1", "https://www.example.com/en/1", "http://b.net/es/q?x", None, "no", "http://com", "http://xcom/", "http://b.net/es"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df, listed).collect()}
    want = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block")] + [(None, "allow")] * 5
    assert [got[i] for i in range(len(urls))] == want
    assert {r.verdict for r in url_filter.judge(df, listed.limit(0)).collect()} == {"allow"}


def test_ann_small(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2)] and got[1][3] == pytest.approx(5**0.5)
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_line_dedup(spark):
    line = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, line + "\nshort"), (2, "a b c\n" + line.replace("ten", "TEN")), (3, line.replace("ten", "eleven")), (4, None), (5, "")], DOCS)
    got = {r.doc_id: (r.text, r["__lines_removed"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: (line + "\nshort", 0), 2: ("a b c", 1), 3: ("", 1), 4: (None, 0), 5: ("", 0)}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_lines_are_numbered_in_order_and_sets_neither_sorted_nor_shuffled_whole(spark):
    docs = [(2, "b c\nA b"), (2, "b c\nA b"), (1, "x"), (None, "a B\n\ny"), (3, None), (2, "a b")]
    lines = line_dedup.lines_of(spark.createDataFrame(docs, DOCS), "doc_id", "text")
    rows = lines.orderBy("place").collect()
    assert len({r.place for r in rows}) == len(rows) == 7 and [(r["__doc"], r["__at"]) for r in rows[:4]] == [(None, 0), (None, 1), (None, 2), (1, 0)]
    assert [(r["__doc"], r["__v1"], r["__v2"], r["__at"]) for r in rows[4:]] == sorted((r["__doc"], r["__v1"], r["__v2"], r["__at"]) for r in rows[4:])
    held = common.materialize(lines, "test")
    keys = common.materialize(line_dedup.set_keys(held), "test")
    sets = line_dedup.distinct_sets(held, keys, 80)
    assert {(r.sid, r.lines) for r in keys.collect()} == {(rows[0].place, 3), (rows[2].place, 1), (rows[3].place, 1), (next(r.place for r in rows[4:] if r.k1 not in {rows[0].k1}), 1)}
    assert sorted(r.sid for r in sets.collect()) == sorted(r.sid for r in keys.collect())
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "rangepartitioning" not in plan
    common.release(held, keys)


def test_line_dedup_of_short_lines_against_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, "\n".join(" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(8))) for _ in range(6))) for i in range(12)]
    docs += [(20, "All rights reserved."), (21, "all rights reserved.\n\n \nHome"), (22, "Home"), (23, "one two three four"), (24, "one two three four five")]
    seen, want = [], {}
    for i, text in docs:
        kept = []
        for line in text.split("\n"):
            s = set(line.lower().split())
            if not (s and any(100 * len(s & t) >= 80 * len(s | t) for t in seen)):
                kept.append(line)
            seen.append(s)
        want[i] = ("\n".join(kept), text.count("\n") + 1 - len(kept))
    assert want[21] == ("\n \nHome", 1) and want[22] == want[24] == ("", 1)
    got = {r.doc_id: (r.text, r["__lines_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == want


def test_ngram_join_against_brute_force(spark):
    rng = random.Random(1)
    base = [words(rng, n) for n in (3, 4, 30, 80, 80, 300)]
    texts = [None, "", " "] + base + [b.upper() for b in base]
    for b in base[2:]:
        for _ in range(6):
            w = b.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    sets = [set(zip(*[(t or "").lower().split()[k:] for k in range(min(4, len((t or "").split())))], strict=False)) if (t or "").split() else set() for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.group_rows(spark.createDataFrame(list(enumerate(texts)), DOCS), n=4, percent=85).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_class_links_against_brute_force(spark):
    rng = random.Random(6)
    texts = [None, " "] + [words(rng, n) for n in (3, 80, 80, 300)]
    for b in texts[3:6]:
        texts += [b.upper()] + [" ".join(w if i not in cut else "changed" for i, w in enumerate(b.split())) for cut in ([0], [1], [0, 1], [40], [41], [len(b.split()) - 1])]
    firsts = {}
    for i, text in enumerate(texts):
        w = (text or "").lower().split()
        if w:
            firsts.setdefault(frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))), i)
    every = {(i, j) for s, i in firsts.items() for t, j in firsts.items() if i < j and 100 * len(s & t) >= 85 * len(s | t)}
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = [tuple(r) for r in ngram_join.class_links(df, n=4, percent=85).collect()]
    assert len(got) == len(every) and set(got) == every
    _, classes, links = ngram_join.memberships(df, "doc_id", "text", 4, 85)
    name = {r.node: r.id for r in classes.collect()}
    connecting = {(name[r.a], name[r.b]) for r in links.collect()}
    assert connecting < every


def test_decontaminate(spark):
    rng = random.Random(2)
    items = [words(rng, 40), words(rng, 60), "tiny item"]
    docs = [(1, words(rng, 50) + " " + items[0].upper() + " " + words(rng, 9)), (2, words(rng, 200)), (3, None), (4, items[1].rsplit(" ", 1)[0] + " zzz"), (5, "a tiny item here")]
    found = decontaminate.find_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r.id, r.item_id) for r in found.collect()} == {(1, 0), (4, 1), (5, 2)}


def test_decontaminate_at_the_ends_of_texts(spark):
    rng = random.Random(5)
    items = [words(rng, 40), words(rng, 60), "tiny item"]
    cut = lambda t, a, b: " ".join(t.split()[a : len(t.split()) - b])
    texts = [cut(items[0], 3, 0) + " " + words(rng, 100), words(rng, 100) + " " + cut(items[1], 0, 4), cut(items[1], 1, 2), cut(items[0], 2, 2), cut(items[0], 0, 8) + " " + words(rng, 50), cut(items[0], 5, 4), "tiny", "item tiny"]

    def bags(text, n):
        w = text.split()
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            size, w = len(item.split()), text.split()
            b = bags(item, min(size, 5))
            for at in range(max(0, len(w) - size) + 1):
                a = bags(" ".join(w[at : at + size]), min(size, 5))
                best = sum((a & b).values()) / sum((a | b).values())
                if best >= 0.8:
                    want[d, i] = max(want.get((d, i), 0), best)
    assert set(want) == {(0, 0), (1, 1), (2, 1), (3, 0)}
    found = decontaminate.find_passages(spark.createDataFrame(list(enumerate(texts)), DOCS), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r.id, r.item_id): pytest.approx(r.similarity) for r in found.collect()} == want


def test_piece_codec_equals_library():
    import sentencepiece

    texts = ["", "  a  b ", "\n\n x\ty", "日本語 🎉", "a" * 500, "   ", "The quick brown fox, http://x.org/?y=1", "</s> <0x0A>", "a\0b", "é" * 40 + "x" * 3000]
    vocab = piece_codec.read_vocabulary(piece_codec.MODEL)
    flat, sizes = piece_codec.encode_texts(texts, vocab)
    ids = [part.tolist() for part in np.split(flat, np.cumsum(sizes)[:-1])]
    assert ids == sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL).encode(texts)
    assert [piece_codec.decode_ids(i, vocab) for i in ids] == texts


def test_trained_models(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(("the and of" if i % 2 else "der und von").split()) for _ in range(40)), "en" if i % 2 else "de") for i in range(200)] + [(900, None, "en"), (901, "12 34", None)]
    df = spark.createDataFrame(docs, DOCS + ", lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(df, language_id.fit(df)).collect()}
    assert sum(got[d] == lang for d, _, lang in docs[:200]) > 190 and got[900] == got[901] == "und"
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    scores = {r.doc_id: r.quality_score for r in quality.classify(df, quality.fit(df, labels)).collect()}
    assert sum((scores[i] >= 0.5) == (i % 2 == 1) for i in range(200)) > 190


def test_secret_spans(spark):
    text = "é password = 'abcdef1' AKIA" + "A" * 20 + " " + "0" * 24 + " token=abc"
    r = secret_scan.scan_secrets(spark.createDataFrame([(1, text), (2, None)], DOCS)).orderBy("doc_id").collect()
    assert [(s.kind, text[s.start : s.end]) for s in r[0].secret_spans] == [("assign", "password = 'abcdef1"), ("access", "AKIA" + "A" * 20), ("hex", "0" * 24)] and r[1].secret_spans == []


def test_driver_garbage_goes_with_each_write(spark):
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    used = lambda: (runtime.totalMemory() - runtime.freeMemory()) >> 20
    common.release(common.materialize(spark.range(9), "test"))
    dropped = jvm.java.nio.ByteBuffer.allocate(200 << 20)
    before = used()
    del dropped
    gc.collect()
    time.sleep(3)  # the gateway lets go of it a little later
    found = common.materialize(spark.range(9), "test")
    assert used() < before - 150 and found.count() == 9
    common.release(found)
