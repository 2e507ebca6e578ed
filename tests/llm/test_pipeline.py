"""The five stages in a row against a plain run of what each promises."""

import hashlib
import random
import re

import pytest

import corpus_pipeline
from segmenta.llm import pieces

STOCK = {"en": "house river letter garden winter morning bridge under between paper window table".split(), "de": "haus fluss brief garten winter morgen brücke unter zwischen papier fenster tisch".split()}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain_lines(rows):
    first, out = {}, []
    for i, text, source in rows:
        kept = []
        for line in (text or "").split("\n"):
            near = any(abs(len(line) - len(x)) <= 2 and distance(line, x) <= 2 for x in first if min(len(x), len(line)) >= 40)
            if not WORD.search(line) or (line not in first and not near):
                kept.append(line)
            if WORD.search(line):
                first.setdefault(line, i)
        out.append((i, "\n".join(kept), source))
    return out


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def plain_near(rows):
    kept = []
    for i, text, source in rows:
        s = shingles(text)
        if all(len(s & t) < 0.8 * len(s | t) for _, _, _, t in kept):
            kept.append((i, text, source, s))
    return [r[:3] for r in kept]


def plain_mix(rows):
    sources = sorted({s for _, _, s in rows})
    size = {s: sum(len(WORD.findall(t)) for _, t, x in rows if x == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        target |= {s: 2 * size[s] if s in full else level * weight[s] for s in (full or open_)}
        left -= sum(2 * size[s] for s in full)
        open_ = open_ - full if full else set()
    out = []
    for s in sources:
        key = lambda r: (int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:15], 16), len(WORD.findall(r[1])), r[0])
        at, end = 0, round(target[s])
        for i, text, _ in 2 * sorted((r for r in rows if r[2] == s), key=key):
            n = len(WORD.findall(text))
            if n and at < end:
                out.append((i, text if at + n <= end else " ".join(WORD.findall(text)[: end - at])))
            at += n
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    rows = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        lines = [" ".join(rng.choices(STOCK[lang], k=rng.randrange(12, 20))) + f" {i} {k}" for k in range(rng.randrange(2, 6))]
        rows.append((i, "\n".join(lines), lang, f"s{i % 3}"))
    texts = {r[0]: r[1] for r in rows}
    passage = "this passage of one line is in many documents of the corpus, with a small change"
    for i in (7, 21, 33):
        rows[i] = (i, f"{texts[i]}\n{passage}{'.' * (i % 3)}", rows[i][2], rows[i][3])
    long = " ".join(f"{rng.choice(STOCK['en'])}{k}" for k in range(200))
    rows += [(100, long, "en", "s0"), (101, f"{long} more", "en", "s1"), (102, long.replace(" ", "  "), "en", "s2")]
    rows += [(200, "12345 67890 !!!", "en", "s0"), (201, None, "en", "s1"), (202, "", None, "s2"), (203, texts[3], "de", "s0")]
    return rows


def test_stages_against_plain_run(spark, corpus, tmp_path):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string, lang string, source string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, tuple(r.ids)): r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    rows = [(i, t, s) for i, t, _, s in corpus if t and re.search(r"[a-z]", t)]  # all are in a known language
    rows = plain_mix(plain_near(plain_lines(rows)))
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    assert set(got) == {(i, tuple(sp.encode(t))) for i, t in rows}
    assert {101, 102} & {i for i, _ in got} == set() and all(r.round_trip for r in got.values())
    assert corpus_pipeline.drop_intermediate(spark) >= 1


def test_rows_of_each_stage(spark, tmp_path):
    """At the smallest scale each stage keeps what the stage before it returned but for what it is to drop."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "encoding":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts[name] = docs.count()
    assert counts["lines"] == counts["language"] > 0.9 * 200 and 0.5 * counts["lines"] < counts["near"] <= counts["lines"]
    assert counts["encoding"] == counts["mixing"] and docs.filter("not round_trip").count() == 0
