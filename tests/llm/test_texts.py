"""Operators on texts and pages against brute force, exact round trips, SQL and held-out accuracy."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest_llm import EDGES
from pyspark.sql import functions as F

from segmenta.llm import langid, mixing, oracles, pieces, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def brute_ngrams(text):
    letters = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "]
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(letters) - n + 1):
            gram = letters[i : i + n]
            if set(gram) == {32}:
                continue
            h = n
            for c in gram:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
            out[(h * 0x9E3779B1 & 0xFFFFFFFF) >> 17] += 1
    return out


@pytest.mark.parametrize("text", ["Ein kurzer Satz, mit 12 Zahlen.", "x", "字符 and ÄÖÜ", "ab" * 3000])
def test_ngram_counts(monkeypatch, text):
    monkeypatch.setattr(langid, "CHUNK", 100)  # pieces of a text add up to the whole
    at, n = langid.sparse_counts(text)
    assert dict(zip(at.tolist(), n.tolist(), strict=True)) == dict(brute_ngrams(text))


def test_language(spark, docs_of):
    rng = random.Random(1)
    stock = {"en": "the of and house river with under letter".split(), "de": "der die und haus fluss mit unter brief".split(), "el": "και το σπίτι ποτάμι με κάτω γράμμα".split()}
    rows = [(100 + k, " ".join(rng.choices(stock[lang], k=12)), lang) for k, lang in enumerate(rng.choices(list(stock), k=150))]
    docs = docs_of([(*r, "s") for r in rows] + EDGES)
    got = {(r.doc_id, r.held_out): r for r in langid.identify(docs).collect()}
    assert all(got[i, held(i)].lang_pred == lang for i, _, lang in rows)
    assert all(got[i, held(i)].lang_pred == "und" and got[i, held(i)].score == 0 for i in (1, 2, 3))
    assert langid.identify(docs_of([])).collect() == []
    untaught = langid.identify(docs_of([(1, "words", None), (None, "words", "en")])).collect()
    assert {r.lang_pred for r in untaught} == {"und"}
    clash = docs.withColumn("__language", F.lit("mine"))
    assert {r[0] for r in langid.keep_identified(clash).select("__language").distinct().collect()} == {"mine"}
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id >= 100").count() == 150


def test_mixing(spark, docs_of):
    rng = random.Random(5)
    rows = EDGES + [(100 + k, "w " * rng.randrange(60), "en", rng.choice(["a", "b", "c", "d", None])) for k in range(300)]
    docs = docs_of(rows)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    plain = lambda rows: sorted((str(a), b, c, round(d, 6), e) for a, b, c, d, e in rows)
    want = con.execute(f"SELECT doc_id::BIGINT, {', '.join(cols[1:])} FROM ({oracles.OP6})").fetchall()
    got = [tuple(r) for r in mixing.mix(docs).select(*cols).collect()]
    assert plain(got) == plain(want) == plain(tuple(r) for r in mixing.mix(docs).select(*cols).collect())
    assert all(e <= 2 * b for _, b, _, _, e in got)
    assert sum(e for *_, e in got) == pytest.approx(1.5 * sum(b for _, b, *_ in got), rel=0.01)
    assert mixing.mix(docs_of([])).collect() == []
    clash = docs.withColumns({"__uid": F.lit("mine"), "__words": F.lit("mine"), "__SIZE": F.lit("mine")})
    assert {tuple(r) for r in mixing.mixed_documents(clash).select("__uid", "__words", "__SIZE").distinct().collect()} == {("mine",) * 3}
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns
    assert sum(len(WORD.findall(r.text or "")) for r in taken.collect()) == sum(e for *_, e in got)


@pytest.mark.parametrize(("large", "small"), [(2_499_800_000, 1000), (10_000_000, 10)])
def test_mixing_small_sources_beside_large(spark, large, small):
    """Two large sources make blocks of many words; 200 small ones, whose targets are below a block, lose none."""
    per = 1000
    big = spark.range(2 * per).selectExpr("id", "id AS uid", "concat('big', id % 2) AS source", f"CAST({large // per} AS BIGINT) AS size")
    tiny = spark.range(2 * per, 2 * per + 400).selectExpr("id", "id AS uid", "concat('tiny', id % 200) AS source", f"CAST({small // 2} AS BIGINT) AS size")
    sizes = big.union(tiny).withColumn("key", mixing.shuffle_key(F.col("id"))).checkpoint()
    plan = mixing.targets(sizes).checkpoint()
    slots, block = mixing.schedule(plan)
    assert block > 2 * small
    assert slots.count() == slots.select("t").distinct().count() == slots.select("place", "rank").distinct().count()
    taken = mixing.mix_pieces(sizes, plan).groupBy("uid").agg(F.sum("words").alias("words")).join(sizes, "uid").groupBy("source").agg(F.sum("words").alias("words"))
    got = {r.source: r.words for r in taken.collect()}
    assert got == {r.source: r.end for r in plan.collect()} and len(got) == 202


def test_pieces(spark, docs_of):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    rng = random.Random(6)
    rows = EDGES + [(100 + k, "".join(rng.choices([*"abcdefghij  \n\t", "the ", "ing", "Ä", "字", "😀", "x" * 70], k=40))) for k in range(60)]
    got = pieces.encode_documents(docs_of(rows)).collect()
    want = sorted((str(i), None if t is None else sp.encode(t)) for i, t, *_ in rows if i is not None)
    assert sorted((str(r.doc_id), None if r.ids is None else list(r.ids)) for r in got if r.doc_id is not None) == want
    assert all(r.round_trip for r in got) and len(got) == len(rows)
    assert pieces.encode_documents(docs_of([])).collect() == []
    docs = docs_of(rows)
    texts = docs.select("text", pieces.decoded(pieces.encoded(docs["text"], docs), docs).alias("back")).collect()
    assert all(r.text == r.back for r in texts)


def test_pieces_of_long_chunks():
    """One chunk at a time from a heap, or all in step: the ids of the reference library either way."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    with open(pieces.VOCABULARY, "rb") as f:
        own = pieces.Encoder(f.read())
    rng = random.Random(9)
    texts = ["".join(rng.choices([*"abcdefgiorstn", "the", "ing", "字", "é"], k=rng.randrange(1, 150))) for _ in range(60)]
    texts += ["x" * 20_000, "internationalization" * 300, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=30_000))]
    assert [a.tolist() for a in own.encode(texts)] == [sp.encode(t) for t in texts]
    for t in texts[:60]:
        v = own.v
        codes = np.frombuffer(v.normalised(t).encode("utf-32-le"), np.uint32)
        chunk = np.zeros(len(codes), np.int64)
        for a, b in zip(pieces.relax(codes, chunk, v, 0), pieces.relax(codes, chunk, v, 1 << 20), strict=True):
            assert np.array_equal(a, b)


def test_network_gradients():
    """Backward against differences of the loss."""
    net = toxicity.Net(1)
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64)
    words = ["alpha", "beta", "gamma", "delta"]
    odds = np.zeros(1 << toxicity.ODDS_BITS, np.float32)
    at = np.zeros((3, toxicity.WINDOW), np.int64)
    at[0, :3], at[1, :4], at[2, :1] = [1, 2, 3], [4, 3, 2, 1], [2]
    label = np.array([1, 0, 1])
    _, grad = net.gradients(words, odds, at, label)
    rng = np.random.default_rng(0)
    assert set(grad) == set(net.p)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        touched = np.flatnonzero(grad[name].reshape(-1))  # of the embeddings only the words' own rows
        for k in rng.choice(touched, min(4, touched.size), replace=False):
            old, step = flat[k], 1e-2
            flat[k] = old + step
            high = net.gradients(words, odds, at, label)[0]
            flat[k] = old - step
            low = net.gradients(words, odds, at, label)[0]
            flat[k] = old
            assert grad[name].reshape(-1)[k] == pytest.approx((high - low) / (2 * step), abs=2e-3), name


def test_forward_against_plain_loop():
    """The network's logit, one number at a time, as gated units and attention are defined."""
    net = toxicity.Net(5)
    net.odds = np.linspace(-1, 1, 1 << toxicity.ODDS_BITS).astype(np.float32)
    words = "one or two ordinary wörter".split()
    x = net.inputs(words).astype(float)
    for w, row in zip(words, x, strict=True):
        h = zlib.crc32(w.encode())
        assert row[0] == pytest.approx(net.odds[h % (1 << toxicity.ODDS_BITS)])
        assert row[1 : 1 + toxicity.WORD_DIM] == pytest.approx(net.p["words"][h % (1 << toxicity.WORD_BITS)])
        marked = f"<{w}>"
        grams = [[ord(c) for c in marked[k : k + 3]] for k in range(len(w))]
        at = [((((a * 0x01000193 & 0xFFFFFFFF) ^ b) * 0x01000193 & 0xFFFFFFFF) ^ c) * 0x9E3779B1 % (1 << 32) >> (32 - toxicity.GRAM_BITS) for a, b, c in grams]
        assert row[1 + toxicity.WORD_DIM :] == pytest.approx(np.mean([net.p["grams"][k] for k in at], 0), abs=1e-6)
    n, sig = toxicity.HIDDEN, lambda v: 1 / (1 + np.exp(-v))

    def states(way, order):
        h, out = np.zeros(n), {}
        for t in order:
            g, a = x[t] @ net.p[f"W{way}"] + net.p[f"b{way}"], h @ net.p[f"U{way}"]
            z, r = sig(g[:n] + a[:n]), sig(g[n : 2 * n] + a[n : 2 * n])
            h = out[t] = (1 - z) * np.tanh(g[2 * n :] + r * a[2 * n :]) + z * h
        return out

    forth, back = states("f", range(len(words))), states("b", range(len(words) - 1, -1, -1))
    both = [np.concatenate([forth[t], back[t]]) for t in range(len(words))]
    weight = np.exp([np.tanh(s @ net.p["A"]) @ net.p["v"] for s in both])
    want = sum(w * (s @ net.p["o"]) for w, s in zip(weight / weight.sum(), both, strict=True)) + net.p["c"][0]
    gates = np.concatenate([np.zeros((1, 6 * n), np.float32), net.gates(net.inputs(words))])
    at = np.zeros((1, toxicity.WINDOW), np.int64)
    at[0, : len(words)] = range(1, len(words) + 1)
    assert toxicity.window_logits(net, gates, at)[0] == pytest.approx(want, abs=1e-4)


def test_training_texts_of_repeated_ids(spark, docs_of):
    """The least text of an id is trained with, whatever the order of rows."""
    ids = [i for i in range(100) if not held(i)][:4]
    rows = [(ids[0], "b"), (ids[0], "a"), (ids[1], "c"), (ids[2], None), (ids[2], "d"), (ids[3], None)]
    labels = spark.createDataFrame([(ids[0], 1), (ids[1], 0), (ids[2], 0), (ids[2], 1), (ids[3], 0)], "doc_id bigint, toxic int")
    for order in (rows, rows[::-1]):
        got = toxicity.sample_of(docs_of(order), labels)
        assert list(zip(got["text"], got["toxic"], strict=True)) == [("a", 1), ("c", 0), ("d", 1), (None, 0)]


def test_toxicity(spark, docs_of):
    rng = random.Random(7)
    calm = "garden table morning letter window river bridge paper music yellow".split()
    foul = "grubnok zwelch murgle".split()
    rows, labels = [], []
    for i in range(100, 500):
        words = rng.choices(calm, k=rng.randrange(5, 60))
        toxic = i % 4 == 0
        if toxic:
            k = rng.randrange(len(words) + 1)
            words[k:k] = rng.choices(foul, k=3)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    table = spark.createDataFrame([*labels, (101, None), (None, 1)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs_of(rows + EDGES), table).collect()
    assert len(got) == len(rows) + len(EDGES) and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r for r in got}
    unseen = [(score[i].score, y) for i, y in labels if score[i].held_out]
    pairs = [(a > b) + 0.5 * (a == b) for a, y in unseen for b, z in unseen if y > z]
    assert sum(pairs) / len(pairs) > 0.95
    assert all(score[i].score == 0 for i in (1, 2, 3))
    none = toxicity.toxicity(docs_of(EDGES), table.limit(0)).collect()
    assert {r.score for r in none} == {0.0} and toxicity.toxicity(docs_of([]), table.limit(0)).collect() == []
