"""The event engine on edge rows, and its searches, loaders and caches against plain definitions."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from segmenta.functions.predicates import predicate
from segmenta.operators import preparation, quality
from segmenta.plans import events, pool, search, sketch
from segmenta.plans.sequence import completions, matches
from segmenta.sources import detections as D

ROW = D.SCENE


def scene_of(spark, rows):
    """rows: (vid, fid, oid, x1, y1, x2, y2)."""
    return spark.createDataFrame([(o, v, f, "cube", "red", "metal", *map(float, box)) for v, f, o, *box in rows], ROW)


@pytest.fixture(scope="module")
def random_scene(spark):
    rng = random.Random(1)
    rows = [(v, f, o, x := rng.randrange(0, 400), y := rng.randrange(0, 280), x + 20, y + 20) for v in range(12) for f in range(8) for o in range(3) if rng.random() < 0.8]
    return scene_of(spark, rows).checkpoint(), rows


def plain_holds(atom, boxes):
    (name, variables, t) = atom.name, atom.variables, atom.parameter
    centre = [((boxes[v][0] + boxes[v][2]) / 2, (boxes[v][1] + boxes[v][3]) / 2) for v in variables]
    if name == "LeftQuadrant":
        return 0 <= centre[0][0] < 240
    ratio = math.dist(*centre) / 20
    return {"Near": lambda: ratio < t, "Far": lambda: ratio > t, "LeftOf": lambda: centre[0][0] < centre[1][0], "Behind": lambda: centre[0][1] < centre[1][1]}[name]()


def plain_matches(rows, program, bound):
    """Segments, by trying all bindings of all variables."""
    by = {}
    for v, f, o, *box in rows:
        by.setdefault(v, {}).setdefault(f, {})[o] = box
    names = sorted({v for s in program for v in s.variables}, key=lambda v: int(v[1:]))
    out = set()
    for vid, frames in by.items():
        oids = sorted({o for objects in frames.values() for o in objects})
        for binding in [tuple(int(n[1:]) for n in names)] if bound else itertools.permutations(oids, len(names)):
            at, end = dict(zip(names, binding, strict=True)), -1
            for step in program:
                good = {f for f, objects in frames.items() if all(at[v] in objects for v in step.variables) and all(plain_holds(a, {v: objects[at[v]] for v in a.variables}) for a in step.atoms)}
                ends = [f + step.duration - 1 for f in good if f > end and all(f + k in good for k in range(step.duration))]
                if not ends:
                    break
                end = min(ends)
            else:
                out.add(vid)
                break
    return out


PROGRAMS = ["Near(o0, o1, 4.0)", "LeftOf(o1, o0)", "Duration(Far(o0, o1, 3.0), 3)", "LeftQuadrant(o0); LeftOf(o0, o1)", "LeftOf(o0, o1); (Behind(o1, o2), LeftQuadrant(o2))", "(LeftOf(o1, o0), LeftQuadrant(o0)); Duration(Near(o0, o1, 9.0), 2); LeftQuadrant(o1)"]


@pytest.mark.parametrize("bound", [True, False])
def test_pool_and_cache_against_plain_search(spark, random_scene, bound, monkeypatch):
    df, rows = random_scene
    programs = [events.program_of(t) for t in PROGRAMS if not (bound and "o2" in t)]
    want = {(q, v) for q, p in enumerate(programs) for v in plain_matches(rows, p, bound)}
    assert {tuple(r) for r in pool.evaluate(df, programs, bound).select("qid", "vid").collect()} == want
    cache = pool.PrefixCache(df, bound)
    for q in (3, len(programs) - 1):
        assert {r.vid for r in cache.matches(programs[q]).collect()} == {v for k, v in want if k == q}
    before = len(cache.known)
    cache.matches(programs[3])
    assert len(cache.known) == before
    uncached = completions(df, cache._named(programs[-1]), bound=bound)
    assert sorted(map(tuple, cache.completions(programs[-1]).select(*uncached.columns).collect())) == sorted(map(tuple, uncached.collect()))


def test_pool_of_many_atoms(spark, random_scene):
    """More atoms than one bigint has bits."""
    df, rows = random_scene
    programs = [events.program_of(f"(Near(o0, o1, {1 + k / 8}), Far(o0, o1, {k / 10}))") for k in range(40)]
    got = {tuple(r) for r in pool.evaluate(df, programs).select("qid", "vid").collect()}
    assert got == {(q, v) for q, p in enumerate(programs) for v in plain_matches(rows, p, True)}


def test_edge_rows(spark):
    """A run broken by a missing frame, one of exactly the length, a second step that begins where the first ends, one
    object alone, boxes without width at one place and apart, and a parameter of 0."""
    far = lambda v, f: [(v, f, 0, 0, 0, 10, 10), (v, f, 1, 200, 0, 210, 10)]
    near = lambda v, f: [(v, f, 0, 0, 0, 10, 10), (v, f, 1, 2, 0, 12, 10)]
    rows = [*far(1, 0), *far(1, 2), *far(1, 3), *far(2, 4), *far(2, 5), *far(2, 6), *far(3, 0), *near(3, 1), *near(4, 0), (5, 0, 0, 0, 0, 10, 10)]
    rows += [(6, 0, 0, 5, 5, 5, 5), (6, 0, 1, 5, 5, 5, 5), (7, 0, 0, 5, 5, 5, 5), (7, 0, 1, 9, 5, 9, 5)]
    df = scene_of(spark, rows)
    hit = lambda text: {r.vid for r in matches(df, events.program_of(text), bound=True).collect()}
    assert hit("Duration(Far(o0, o1, 3.0), 3)") == {2}
    assert hit("Far(o0, o1, 3.0); Near(o0, o1, 1.0)") == {3}
    assert hit("Near(o0, o1, 1.0)") == {3, 4}  # 0/0 passes no test
    assert hit("Far(o0, o1, 0)") == {1, 2, 3, 4, 7}  # a number over 0 is infinite
    assert hit("Far(o0, o1, 3.0); Far(o0, o1, 3.0)") == {1, 2}


@pytest.mark.parametrize(("name", "box", "sql", "matrix"), [("LeftQuadrant", (230, 0, 250, 20), False, False), ("RightQuadrant", (230, 0, 250, 20), True, True), ("RightQuadrant", (470, 0, 490, 20), True, True), ("TopQuadrant", (0, 150, 20, 170), False, True), ("BottomQuadrant", (0, 310, 20, 330), True, True), ("RightPoly", (605, 100, 625, 120), True, False)])
def test_bounds(spark, name, box, sql, matrix):
    df = spark.createDataFrame([tuple(map(float, box))], D.BOX)
    assert [df.select(predicate(name, [F.col], dialect=d)).first()[0] for d in ("sql", "matrix")] == [sql, matrix]


def test_null_kinematics(spark):
    df = spark.createDataFrame([(415.0, 105.0, 425.0, 130.0, None, None, None, None), (415.0, 105.0, 425.0, 130.0, 1.0, 0.0, 0.0, 0.0)], D.BOX + ", vx double, vy double, ax double, ay double")
    strict = predicate("Southward1Upper", [F.col], columns=tuple(df.columns))
    lax = predicate("Westward2", [F.col], columns=tuple(df.columns))
    assert [bool(r[0]) for r in df.select(strict).collect()] == [False, True]
    assert None not in [r[0] for r in df.select(lax).collect()]
    assert [bool(r[0]) for r in df.select(predicate("Stopped", [F.col], 2.0)).collect()] == [False, True]


def test_pairs_of_large_ids(spark):
    rows = [(0, f, o, 0, 0, 1, 1) for f in range(3) for o in (3000, 2_000_000_001, 5)]
    df = scene_of(spark, rows)
    pairs = preparation.track_pairs(df)
    cut = preparation.pair_segments(df, pairs)
    assert cut.select("pair").distinct().count() == 6
    numbers = preparation.numbered_segments(cut).groupBy("vid").count().orderBy("vid").collect()
    assert [(r.vid, r["count"]) for r in numbers] == [(k, 6) for k in range(6)]


def test_overlapping_segments(spark):
    df = scene_of(spark, [(0, f, 0, 0, 0, 1, 1) for f in range(25)])
    got = {(r.part, r.fid) for r in preparation.cut_segments(df, 10, 4).collect()}
    assert got == {(p, f - 6 * p) for f in range(25) for p in range(5) if 0 <= f - 6 * p < 10}


def test_split_and_scores(spark):
    labels = spark.createDataFrame([(v, int(v % 7 < 3)) for v in range(101)], "vid int, label int")
    for n in (10, 33, 50):
        assert preparation.split(labels, n).filter("train").count() == n
    none = spark.createDataFrame([(0, 1), (0, 3)], "qid int, vid int")
    got = {r.qid: r.f1 for r in quality.scored(labels, none, 2).collect()}
    assert got[1] == 0 and got[0] > 0


def test_loaders_and_writers(spark, tmp_path):
    df = scene_of(spark, [(0, f, o, f, o, f + 5, o + 5) for f in range(3) for o in range(2)])
    D.write_csv(df, f"{tmp_path}/scene")
    assert sorted(D.read_csv(spark, f"{tmp_path}/scene").collect()) == sorted(df.collect())
    labels = spark.createDataFrame([(7, 1), (3, 0), (5, 1)], "vid int, label int")
    D.write_labels(labels, f"{tmp_path}/inputs", f"{tmp_path}/labels")
    assert sorted(map(tuple, D.read_labels(spark, f"{tmp_path}/inputs", f"{tmp_path}/labels").collect())) == [(3, 0), (5, 1), (7, 1)]
    (tmp_path / "tracks").mkdir()
    for name, frames in (("b", [[[1, 3, 5, 7, 9]]]), ("a", [[], [[4, 2, 2, 5, 5], [6, 1, 1, 3, 3]]])):
        (tmp_path / "tracks" / f"{name}.json").write_text(json.dumps(frames))
    got = sorted(map(tuple, D.read_tracker_frames(spark, f"{tmp_path}/tracks").collect()))
    assert got == [(1, 1, 0, 1.0, 2.0, 3.0, 4.0), (4, 0, 1, 1.0, 1.0, 2.0, 2.0), (6, 0, 1, 0.0, 0.0, 1.0, 1.0)]
    nested = preparation.nested(df)
    back = D.nested_pairs(preparation.without_empty(nested))
    assert sorted((r.vid, r.fid, r.oid, r.x1) for r in back.collect()) == sorted((r.vid, r.fid, r.oid, r.x1) for r in df.collect())
    boxes = spark.createDataFrame([(0, 1, 0, "cube", "red", "metal"), (0, 0, 1, "cube", "blue", "metal"), (0, 0, 0, "sphere", "red", "metal"), (0, 2, 0, "cube", "blue", "metal")], "vid int, fid int, pos int, shape string, color string, material string")
    assert {(r.shape, r.color): r.oid for r in D.first_seen_ids(boxes).collect()} == {("sphere", "red"): 0, ("cube", "blue"): 1, ("cube", "red"): 2}


def test_text_forms():
    for text in (*PROGRAMS, "Duration((Far(o0, o1, 3.0), Red(o0)), 5); Near(o0, o1, 1.0)", "(Color(o0, 'red'), Shape(o1, 'cube'))"):
        p = events.program_of(text)
        assert events.program_of(events.text_of(p)) == p
    assert events.program_of("Conjunction(Near_1.0(o0, o1), Far_3.0(o0, o1))") == events.program_of("(Near(o0, o1, 1.0), Far(o0, o1, 3.0))")
    mirrored = [events.program_of(t) for t in ("(LeftOf(o1, o0), Red(o0))", "(LeftOf(o0, o1), Red(o0))")]
    assert len(search.unique(mirrored, True)) == 2
    a, b = (events.program_of(t) for t in ("(Red(o1), Near(o1, o0, 1.0))", "(Near(o0, o1, 1.0), Red(o0))"))
    assert len(search.unique([a, b], True)) == 1


def test_ancestors_and_workload(spark, random_scene):
    p = events.program_of("Duration((Near(o0, o1, 1.0), Far(o0, o1, 3.0)), 5); LeftOf(o0, o1)")
    got = {events.text_of(x) for x in search.ancestors(p)}
    assert {"LeftOf(o0, o1)", "(Near(o0, o1, 1.0), Far(o0, o1, 3.0)); LeftOf(o0, o1)", "Duration(Near(o0, o1, 1.0), 5)", "Duration(Near(o0, o1, 1.0), 5); LeftOf(o0, o1)"} <= got
    assert events.text_of(p) not in got
    df, rows = random_scene
    found = search.workload(df, search.Space([("Near", [2.0, 5.0, 9.0]), ("LeftQuadrant", None), ("LeftOf", None)]), 3, 2, 1, 0.1, 0.95)
    assert found and all(0.1 <= share <= 0.95 and share == pytest.approx(len(plain_matches(rows, p, True)) / 12) for p, share in found)


def test_session_and_log(spark, random_scene, tmp_path):
    """One label a call until the budget is spent; the log reads back."""
    df, rows = random_scene
    target = plain_matches(rows, events.program_of("LeftQuadrant(o0); Near(o0, o1, 5.0)"), True)
    space = search.Space([("Near", [5.0]), ("LeftQuadrant", None)], max_atoms=2, max_steps=2)
    s = search.Search(df, space, lambda v: int(v in target), beam=4, keep=5)
    session = search.Session(s, [0, 1, 2, 3], rounds=2, budget=3)
    asked, vid = [], session.next()
    while vid is not None:
        asked.append(vid)
        vid = session.next(int(vid in target))
    assert len(asked) == len(set(asked)) == 4 + sum(session.shares[: len(s.log)]) and asked[:4] == [0, 1, 2, 3] and session.state == "terminated"
    assert s.labels == {v: int(v in target) for v in asked} and s.answers
    search.write_log(s, f"{tmp_path}/log")
    steps, final = search.read_log(f"{tmp_path}/log")
    assert [x[0] for x in steps] == list(range(len(s.log))) and len(s.log) >= 1 and {t for t, _ in final} == set(s.answers)
    assert search.budget_of(5, 3) == [2, 2, 1] and search.budget_of(4, 3) == [1, 2, 1] and sum(search.budget_of(17, 5)) == 17
    s.active = False
    assert len(set(s.next_segments(3)) - set(s.labels)) == 3


def test_top_down_against_all_programs(spark, random_scene):
    """Pruning loses no program that agrees with the labels, and keeps none that does not."""
    df, rows = random_scene
    catalog = [("Near", [2.0, 5.0, 9.0]), ("LeftQuadrant", None), ("Far", [4.0, 8.0])]
    target = plain_matches(rows, events.program_of("LeftQuadrant(o0); Near(o0, o1, 5.0)"), True)
    labels = {v: int(v in target) for v in range(8)}
    found = sketch.TopDown(df, catalog, dict(labels), max_steps=2, max_atoms=2)
    got = {events.text_of(p) for p in found.run()}
    atoms = [events.Atom(n, ("o0",) if n == "LeftQuadrant" else ("o0", "o1"), t) for n, grid in catalog for t in (grid or [None])]
    every = [(events.Step((a,)),) for a in atoms] + [(events.Step((a,)), events.Step((b,))) for a in atoms for b in atoms]
    every += [(events.Step((a, b)),) for a, b in itertools.combinations(atoms, 2) if a.name != b.name]
    agree = {events.text_of(p) for p in every if all((v in plain_matches(rows, p, True)) == bool(y) for v, y in labels.items())}
    assert got == agree and "LeftQuadrant(o0); Near(o0, o1, 5.0)" in got
    after = found.tell(9, int(9 in target))
    assert {events.text_of(p) for p in after} == {t for t in got if (9 in plain_matches(rows, events.program_of(t), True)) == (9 in target)}
