import hashlib
import random
import re

import pyarrow as pa
import pytest
from conftest_llm import EDGES, LOWER
from pyspark.sql import functions as F

from segmenta.llm import exact_dedup, line_dedup, simhash


def brute_exact(rows):
    digest = [hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest() for _, t, *_ in rows]
    out = []
    for (i, *_), h in zip(rows, digest, strict=True):
        ids = [r[0] for r, g in zip(rows, digest, strict=True) if g == h]
        out.append((i, max((x for x in ids if x is not None), default=None), len(ids), h))
    return out


def test_exact_edges(spark, docs_of):
    got = exact_dedup.exact_groups(docs_of(EDGES)).collect()
    assert sorted(map(str, [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got])) == sorted(map(str, brute_exact(EDGES)))
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_groups(docs_of([])).collect() == []


@pytest.mark.parametrize("bits", [1 << 16, 1 << 20])
def test_exact_many(spark, docs_of, bits):
    """More rows than a small filter can tell apart: only more rows shuffle."""
    rng = random.Random(1)
    rows = [(i, f"t{rng.randrange(20_000)}") for i in range(30_000)]
    got = exact_dedup.exact_groups(docs_of(rows), max_bits=bits).collect()
    best, size = {}, {}
    for i, t in rows:
        best[t], size[t] = max(i, best.get(t, 0)), size.get(t, 0) + 1
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(i, best[t], size[t], best[t] == i) for i, t in rows}


def brute_print(text, n=4):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, radius=4):
    label = dict(zip(prints, prints, strict=True))
    again = True
    while again:
        again = False
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= radius and label[b] < label[a]:
                    label[a], again = label[b], True
    return label


def test_simhash_edges(spark, docs_of):
    got = simhash.near_duplicates(docs_of(EDGES)).collect()
    fps = {brute_print(t) for _, t, *_ in EDGES}
    label = brute_components(sorted(fps))
    first = {}
    for i, t, *_ in EDGES:
        c = label[brute_print(t)]
        first[c] = min((x for x in (first.get(c), i) if x is not None), default=None)
    want = sorted(str((i, f"{brute_print(t):016x}", first[label[brute_print(t)]])) for i, t, *_ in EDGES)
    assert sorted(str(tuple(r)) for r in got) == want
    assert simhash.near_duplicates(docs_of([])).collect() == []
    kept = simhash.one_of_each(docs_of(EDGES))
    assert kept.columns == docs_of(EDGES).columns and kept.count() == len({" ".join((t or "").translate(LOWER).split()) for _, t, *_ in EDGES})
    assert simhash.one_of_each(docs_of([])).collect() == []


@pytest.mark.parametrize("shard", [4096, 50])
def test_links_connect_what_is_near(spark, shard):
    """A dense cluster, a chain and strangers; small shards force several trees a shard, and pivots."""
    rng = random.Random(2)
    base = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(250):
        x = base
        for b in rng.sample(range(64), rng.randrange(5)):
            x ^= 1 << b
        prints.add(x)
    x = rng.getrandbits(64)
    for _ in range(40):
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
        prints.add(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(p), [signed(p)]) for p in prints], "node bigint, fp array<bigint>").withColumn("keys", F.expr(simhash.block_keys(4)))
    root = {r.node: r.root for r in simhash.components(simhash.links(df, shard=shard)).collect()}
    label = brute_components(sorted(prints))
    groups = lambda of: {frozenset(p for p in prints if of(p) == c) for c in {of(p) for p in prints}}
    assert groups(lambda p: root.get(signed(p), signed(p))) == groups(lambda p: label[p])


def test_large_groups_meet_their_pivots_only(spark):
    """Two near groups that make one shard: rows searched grow with the group, not with its square, and both are whole."""
    rng = random.Random(5)
    prints = []
    for base in (0, (1 << 40) - 1):
        prints += [base ^ sum(1 << b for b in rng.sample(range(20, 36), rng.randrange(3))) for _ in range(900)]
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p, [p]) for p in prints], "node bigint, fp array<bigint>").withColumn("keys", F.array(F.lit(1).cast("bigint")))
    root = {r.node: r.root for r in simhash.components(simhash.links(df, shard=40)).collect()}
    label = brute_components(prints)
    assert {p: root.get(p, p) for p in prints} == label and len(set(label.values())) == 2


def test_similar_texts(spark, docs_of):
    """Pairs of known similarity of 5-word shingles: most of 0.8 and nearly all of 0.9 are linked, few of 0.6 are; a large
    group of near copies leaves one document, and columns that clash stay as they are."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    rows, true, i = [], {}, 1000
    for share in (0.6, 0.8, 0.86, 0.93):
        for _ in range(120):
            a = [word() for _ in range(300)]
            b = list(a)
            while similarity(a, b) > share:
                b[rng.randrange(300)] = word()
            rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
            true[i + 1] = share
            i += 2
    base = [word() for _ in range(300)]
    rows += [(100_000 + k, " ".join([*base[: k % 300], word(), *base[k % 300 :]])) for k in range(1500)]
    docs = docs_of(rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    gone = {share: sum(t == share and k not in ids for k, t in true.items()) / 120 for share in (0.6, 0.8, 0.86, 0.93)}
    assert gone[0.6] <= 0.05 and gone[0.8] >= 0.4 and gone[0.86] >= 0.8 and gone[0.93] >= 0.95, gone
    assert [k for k in ids if k >= 100_000] == [100_000]
    assert all(k in ids for k in range(1000, i, 2))


def similarity(a, b, n=5):
    x, y = ({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_linker_stops_after_a_flush(monkeypatch):
    """A flush keeps a large shard's members, and no row follows."""
    monkeypatch.setattr(simhash, "GATHER", 4)
    fps = pa.array([0, 1, 1 << 40, 255, 3], pa.int64())
    columns = [pa.array([7] * 5, pa.int64()), pa.array([0] * 5, pa.int32()), fps, pa.array([[x] for x in fps.to_pylist()], pa.list_(pa.int64())), pa.array([True, True, True, True, False]), pa.array([True] * 5)]
    batch = pa.RecordBatch.from_arrays(columns, ["key", "shard", "node", "fp", "member", "asks"])
    got = [tuple(e.values()) for out in simhash._linker(1)(iter([batch])) for e in out.to_pylist()]
    assert got and {n for e in got for n in e} == {0, 1, 1 << 40, 3}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute_lines(rows, edits, least):
    found = [(i is not None, i or 0, k, p, line) for k, (i, t) in enumerate(rows) for p, line in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", line)]
    first = {}
    for f in sorted(found):
        first.setdefault(f[-1], f[:-1])
    long = [x for x in first if len(x) >= least]
    near = {b for b in long for a in long if first[a] < first[b] and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits}
    lost = {}
    for f in found:
        if f[-1] in near or first[f[-1]] != f[:-1]:
            lost.setdefault(f[2], []).append(f[3])
    return lost


@pytest.mark.parametrize("edits", [1, 2, 4])
def test_bit_parallel_distance(spark, edits):
    rng = random.Random(edits)
    rows = [("a" * 300, "a" * 299 + "b"), ("x", "y"), ("x", "xyzzy")]
    for _ in range(300):
        a = rng.choices("abé😀", k=rng.randrange(1, 14))
        b = list(a)
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "x", "a"])
        rows.append(("".join(a), "".join(b) or "z"))
    got = spark.createDataFrame(rows, "a string, b string").select(line_dedup.within_edits("a", "b", edits)).collect()
    assert [r[0] for r in got] == [distance(a, b) <= edits for a, b in rows]


def test_lines_that_share_a_hash(spark, docs_of, monkeypatch):
    """Lines are told apart where their hashes are not."""
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    lines = ["the first of two lines that are quite alike", "the second line has nothing to do with the others", "the first of two lines that are quite alika"]
    rows = [(9, lines[0]), (3, lines[1]), (5, lines[2]), (12, lines[1])]
    got = {r.doc_id: (r.copy_lines, r.near_lines) for r in line_dedup.line_report(docs_of(rows)).collect()}
    assert got == {9: (0, 1), 3: (0, 0), 5: (0, 0), 12: (1, 0)}


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines_against_brute_force(spark, docs_of, edits):
    rng = random.Random(edits)
    stock = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(8, 40))) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(5)):
            s = list(rng.choice(stock))
            for _ in range(rng.randrange(5)):
                k = rng.randrange(len(s))
                s[k : k + rng.randrange(2)] = rng.choice(["", "x", "é"])
            lines.append("".join(s))
        rows.append((i, "\n".join(lines)))
    docs = docs_of(rows).coalesce(1)
    got = {r.uid: r.removed for r in line_dedup.removals(docs, edits=edits, least=12).collect()}
    assert got == brute_lines(rows, edits, 12)
    pairs = [{(bytes(r.a), bytes(r.b)) for r in line_dedup.near_pairs(docs, edits, 12, crowd).collect()} for crowd in (0, 2, 1000)]
    assert pairs[0] == pairs[1] == pairs[2] and pairs[0]


def test_a_crowd_is_not_compared_in_full(spark, docs_of, monkeypatch):
    """Lines that share a third and are unlike otherwise meet by longer keys: their distances are not taken in all pairs."""
    taken = spark.sparkContext.accumulator(0)
    plain = line_dedup.within_edits

    def counted(a, b, edits):
        return F.udf(lambda _: taken.add(1) or True, "boolean")(F.col(a)) & plain(a, b, edits)

    monkeypatch.setattr(line_dedup, "within_edits", counted)
    rng = random.Random(9)
    tail = lambda: "".join(rng.choices("abcdefghij", k=60))
    lines = ["x" * 30 + tail() for _ in range(150)]
    lines += [f"{lines[0][:50]}Z{lines[0][51:]}", f"{lines[1]}Z"]
    got = line_dedup.near_pairs(docs_of([(k, line) for k, line in enumerate(lines)])).collect()
    id_of = {hashlib.md5(line.encode()).digest(): k for k, line in enumerate(lines)}
    assert {frozenset((id_of[bytes(r.a)], id_of[bytes(r.b)])) for r in got} == {frozenset((0, 150)), frozenset((1, 151))}
    assert taken.value < 1000  # of 11,476 pairs


def test_a_crowd_of_longer_keys_is_not_compared_in_full(spark, docs_of, monkeypatch):
    """Lines that share all but two fifths meet by keys that are longer still: neither are distances taken in all pairs
    nor pairs made of them."""
    taken, plain = spark.sparkContext.accumulator(0), line_dedup.within_edits
    monkeypatch.setattr(line_dedup, "within_edits", lambda a, b, edits: F.udf(lambda _: taken.add(1) or True, "boolean")(F.col(a)) & plain(a, b, edits))
    rng = random.Random(4)
    tail = lambda n: "".join(rng.choices("abcdefghij", k=n))
    lines = ["x" * 60 + tail(40) for _ in range(150)]
    lines += [f"{lines[0][:70]}Z{lines[0][71:90]}Z{lines[0][91:]}", f"{lines[1][:65]}Z{lines[1][65:]}", f"{lines[2][:61]}{lines[2][62:]}Z"]
    rows = [(k, line) for k, line in enumerate(lines)]
    id_of = {hashlib.md5(line.encode()).digest(): k for k, line in enumerate(lines)}
    got = line_dedup.near_pairs(docs_of(rows)).collect()
    assert {frozenset((id_of[bytes(r.a)], id_of[bytes(r.b)])) for r in got} == {frozenset((k, 150 + k)) for k in range(3)}
    assert taken.value < 1000  # of 11,628 pairs


def test_lines_are_read_few_times(spark, docs_of, monkeypatch):
    """All keys of a line come from one pass; more passes fetch the texts of pairs and lines that share a hash."""
    read, plain = spark.sparkContext.accumulator(0), line_dedup.distinct_lines
    count = F.udf(lambda x: read.add(1) or x)
    monkeypatch.setattr(line_dedup, "distinct_lines", lambda docs, **k: plain(docs, **k).withColumn("line", count("line")))
    rng = random.Random(6)
    lines = ["".join(rng.choices("abcdefghij", k=60)) for _ in range(200)]
    got = line_dedup.near_pairs(docs_of(list(enumerate([*lines, f"{lines[0]}Z"])))).collect()
    assert len(got) == 1
    assert read.value <= 4 * 201


def test_rounds_of_longer_keys_take_few_tasks(spark, docs_of):
    """Each round of longer keys is one exchange by the key, whose pairs are made in place."""
    rng = random.Random(4)
    lines = ["x" * 60 + "".join(rng.choices("abcdefghij", k=40)) for _ in range(60)]
    docs, sc = docs_of(list(enumerate([*lines, f"{lines[0][:70]}Z{lines[0][71:]}"]))), spark.sparkContext
    sc.setJobGroup("rounds", "rounds of longer keys")
    assert len(line_dedup.near_pairs(docs).collect()) == 1
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {k for j in tracker.getJobIdsForGroup("rounds") for k in tracker.getJobInfo(j).stageIds}
    assert len(stages) < 50


def test_numbered_lines(spark, docs_of):
    """Lines that differ in the digits of a number alone: keys are crowded down to single characters."""
    lines = [f"entry {k:04d} of the register of the harbour office" for k in range(0, 3000, 7)] + [f"entry {k} of the register of the harbour offices" for k in range(60, 120)]
    docs = docs_of(list(enumerate(lines)))
    want = {frozenset((a, b)) for k, a in enumerate(lines) for b in lines[:k] if abs(len(a) - len(b)) < 3 and distance(a, b) < 3}
    text = {hashlib.md5(line.encode()).digest(): line for line in lines}
    assert {frozenset((text[bytes(r.a)], text[bytes(r.b)])) for r in line_dedup.near_pairs(docs).collect()} == want


def test_lines_edges(spark, docs_of):
    report = {(r.doc_id, r.n_lines): r for r in line_dedup.line_report(docs_of(EDGES)).collect() if r.doc_id != 5}
    assert report[6, 1].near_lines == 0 and report[6, 1].copy_lines == 0  # four letters differ in case
    clean = line_dedup.without_repeated_lines(docs_of(EDGES)).collect()
    assert len(clean) == len(EDGES)
    assert sorted(r.text for r in clean if r.doc_id == 5) == ["", EDGES[5][1]]
    assert [r.text for r in clean if r.doc_id == 1] == [None]
    assert line_dedup.line_report(docs_of([])).collect() == []
