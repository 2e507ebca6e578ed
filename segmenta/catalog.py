"""Named queries of the event engine. Each takes (spark, sf_dir) and reads whole tables; segmenta.oracles has their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta import oracles
from segmenta.functions.predicates import PREDICATES, iou, predicate, score
from segmenta.operators import intervals, preparation, quality
from segmenta.plans.events import Atom, canonical, cost, program_of, text_of
from segmenta.operators.lineage import saved
from segmenta.plans.pool import PrefixCache, evaluate
from segmenta.plans.search import Search, Space
from segmenta.plans.sequence import completions, matches, predicate_table
from segmenta.plans.sketch import TopDown
from segmenta.sources.detections import co_located, restrict, sample_frames, scene, traffic

#: Events over the scene: text, and whether variables are bound to objects.
EVENTS = {
    "event_near": ("Near(o0, o1, 1.0)", False),
    "event_attributes": ("(Red(o0), Cube(o0), Metal(o1), Near(o0, o1, 3.0))", False),
    "event_duration": ("Duration((Far(o0, o1, 1.0), LeftOf(o0, o1)), 3)", False),
    "event_then": ("Duration(Far(o0, o1, 3.0), 3); Near(o0, o1, 1.0)", False),
    "event_new_variable": ("Duration(LeftOf(o0, o1), 2); (Behind(o1, o2), TopQuadrant(o2))", False),
    "event_three_steps": ("Far(o0, o1, 3.0); Near(o0, o1, 2.0); Far(o0, o1, 3.0)", True),
    "event_bound": ("(Far(o0, o1, 2.0), LeftQuadrant(o0)); (BottomQuadrant(o0), FrontOf(o0, o1))", True),
}
POOL = [
    "Near(o0, o1, 2.0)", "Far(o0, o1, 3.0)", "(Far(o0, o1, 2.0), LeftQuadrant(o0))", "Duration(Far(o0, o1, 1.0), 3)",
    "Far(o0, o1, 3.0); Near(o0, o1, 2.0)", "LeftOf(o0, o1); Duration(Behind(o0, o1), 2)", "Near(o0, o1, 2.0); (RightOf(o0, o1), TopQuadrant(o0)); Far(o0, o1, 2.0)",
]
LANES = ("LeftPoly", "RightPoly", "TopPoly", "BottomPoly", "Eastward4", "Eastward3", "Eastward2", "Westward2", "Southward1Upper")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event("event_then")(spark, sf_dir)


def _event(name: str):
    text, bound = EVENTS[name]
    return lambda spark, sf_dir: matches(co_located(scene(spark, sf_dir)), program_of(text), bound=bound)


def _pairs(detections: DataFrame) -> DataFrame:
    """Ordered pairs of objects of a frame, columns a_* and b_*."""
    sides = [detections.select("vid", "fid", *[F.col(c).alias(f"{k}_{c}") for c in detections.columns if c not in ("vid", "fid")]) for k in "ab"]
    return sides[0].join(sides[1], ["vid", "fid"]).filter("a_oid <> b_oid")


def _test(name: str, sides: str, parameter, columns: tuple[str, ...], dialect: str = "sql"):
    return predicate(name, [lambda c, k=k: F.col(f"{k}_{c}" if k else c) for k in (sides or [""])], parameter, columns, dialect)


def _hits(rows: DataFrame, tests: dict) -> DataFrame:
    """How many rows each test holds for: one aggregation, then one row for each name."""
    counts = rows.agg(*[F.count(F.when(t, 1)).alias(n) for n, t in tests.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("predicate"), F.col(n).alias("hits")) for n in tests])).alias("x")).select("x.*")


def _columns(df: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in df.columns if c not in ("oid", "vid", "fid"))


def predicates_of_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scene(spark, sf_dir)
    names = [p.name for p in PREDICATES.values() if p.arity == 1 and p.parameter is None and p.name not in LANES]
    tests = {n: _test(n, "", None, _columns(rows)) for n in names}
    tests |= {f"{n}_{v}": _test(n, "", v, _columns(rows)) for n, v in (("Color", "red"), ("Shape", "cube"), ("Material", "metal"))}
    return _hits(rows, tests)


def predicates_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scene(spark, sf_dir)
    tests = {n: _test(n, "ab", None, _columns(rows)) for n in ("LeftOf", "RightOf", "Behind", "FrontOf")}
    tests |= {f"{n}{t:g}": _test(n, "ab", t, _columns(rows)) for n, t in (("Near", 1.0), ("Near", 3.0), ("Far", 1.0), ("Far", 3.0))}
    return _hits(_pairs(rows), tests)


def predicates_of_pairs_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other dialect where it differs: boxes whose centres lie on bounds, and ratios that equal the threshold."""
    rows = _on_grid(scene(spark, sf_dir))
    tests = {f"{n}{t:g}{d}": _test(n, "ab", t, (), d) for n, t in (("Near", 1.0), ("Far", 1.0), ("Near", 2.0), ("Far", 2.0)) for d in ("sql", "matrix")}
    tests |= {f"TopQuadrant_{d}": _test("TopQuadrant", "a", None, (), d) for d in ("sql", "matrix")}
    return _hits(_pairs(rows), tests)


def _on_grid(rows: DataFrame) -> DataFrame:
    """Boxes of 40 by 40 with centres on multiples of 40."""
    at = lambda c: (F.floor(F.col(c) / 40) * 40).cast("double")
    return rows.withColumns({"x1": at("x1"), "y1": at("y1") + 20}).withColumns({"x2": F.col("x1") + 40, "y2": F.col("y1") + 40})


def predicates_of_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both dialects, at points on a grid of ten, of which some lie on edges."""
    rows = traffic(spark, sf_dir)
    at = lambda c: (F.floor(F.col(c) / 10) * 10).cast("double")
    grid = rows.withColumns({c: at(c) for c in ("x1", "y1", "x2", "y2")})
    tests = {n: _test(n, "", None, _columns(rows)) for n in LANES}
    return _hits(grid, tests | {f"{n}_matrix": _test(n, "", None, _columns(rows), "matrix") for n in LANES})


def predicates_of_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traffic(spark, sf_dir)
    tests = {"Stopped": _test("Stopped", "a", 200.0, ()), "HighAccel": _test("HighAccel", "a", 400.0, ())}
    tests |= {"DistanceSmall": _test("DistanceSmall", "ab", 100.0, ()), "Faster": _test("Faster", "ab", 1.5, ()), "Faster_matrix": _test("Faster", "ab", 1.5, (), "matrix")}
    return _hits(_pairs(rows), tests)


def predicates_of_slow_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faster at speeds so low that the matrix dialect's constant tells: 0, 1 or 2 thousandths along x."""
    rows = traffic(spark, sf_dir).withColumns({"vx": F.col("fid") % 3 * F.col("oid") % 3 / F.lit(1024.0), "vy": F.lit(0.0)})
    return _hits(_pairs(rows), {f"Faster{t:g}_{d}": _test("Faster", "ab", t, (), d) for t in (1.0, 4.0) for d in ("sql", "matrix")})


def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(scene(spark, sf_dir))
    score = iou(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))
    return rows.select("vid", "fid", "a_oid", "b_oid", F.round(score, 5).alias("iou")).filter("iou > 0")


def event_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completions(co_located(scene(spark, sf_dir)), program_of(EVENTS["event_then"][0]))


def event_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many segments the event occurs."""
    return event_completions(spark, sf_dir).agg(F.countDistinct("vid").alias("segments"))


def event_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten earliest completions, in order; ties with the tenth stay."""
    done = event_completions(spark, sf_dir)
    tenth = done.orderBy("done").limit(10).agg(F.max("done").alias("tenth"))
    return done.join(F.broadcast(tenth), F.col("done") <= F.col("tenth")).drop("tenth").orderBy("done", "vid")  # one row


def event_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(scene(spark, sf_dir), program_of(EVENTS["event_then"][0]), how="islands")


def event_unpruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(scene(spark, sf_dir), program_of(EVENTS["event_then"][0]), prune=False)


def event_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PrefixCache(scene(spark, sf_dir)).matches(program_of(EVENTS["event_then"][0]))


def event_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that a remembered first step rules out."""
    cache = PrefixCache(scene(spark, sf_dir), bound=True)
    program = program_of(EVENTS["event_three_steps"][0])
    cache.matches(program[:2])
    return cache.misses(program)


def event_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(sample_frames(scene(spark, sf_dir), 4), program_of("Far(o0, o1, 1.0); Near(o0, o1, 3.0)"))


def event_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event among segments that are given as a table: those with a yellow object."""
    rows = scene(spark, sf_dir)
    return matches(restrict(rows, rows.filter("color = 'yellow'").select("vid")), program_of("Near(o0, o1, 3.0)"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(co_located(scene(spark, sf_dir)), [program_of(t) for t in POOL])


def pool_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in free mode as one pool."""
    return evaluate(co_located(scene(spark, sf_dir)), [program_of(t) for t, bound in EVENTS.values() if not bound], bound=False)


def pool_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = quality.disagreement(pool(spark, sf_dir), len(POOL))
    return votes.select("vid", F.round("gini", 6).alias("gini"))


def predicate_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = [Atom("Near", ("o0", "o1"), 2.0), Atom("LeftOf", ("o0", "o1")), Atom("TopQuadrant", ("o1",))]
    return predicate_table(scene(spark, sf_dir), atoms, bound=False).withColumn("bits", F.col("bits")[0])


def predicate_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each predicate, frame and pair that it holds for: the relations that other engines load."""
    rows = scene(spark, sf_dir)
    tests = {"near": _test("Near", "ab", 1.0, _columns(rows)), "left_of": _test("LeftOf", "ab", None, _columns(rows))}
    held = F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda n: n.isNotNull())
    return _pairs(rows).select(F.explode(held).alias("predicate"), F.col("a_oid").alias("oid1"), F.col("b_oid").alias("oid2"), "vid", "fid")


def _bound_frames(spark: SparkSession, sf_dir: str, name: str, parameter=None) -> DataFrame:
    rows = scene(spark, sf_dir)
    pair = _pairs(rows).filter("a_oid = 0 AND b_oid = 1")
    return pair.filter(_test(name, "ab", parameter, _columns(rows))).select("vid", "fid")


def interval_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.conjunction(*[intervals.unit(_bound_frames(spark, sf_dir, *p)) for p in (("Far", 1.0), ("LeftOf",))])


def interval_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (intervals.unit(_bound_frames(spark, sf_dir, n)) for n in ("LeftOf", "RightOf"))
    return intervals.sequence(left, right)


def interval_gap_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (intervals.unit(_bound_frames(spark, sf_dir, *p)) for p in (("Near", 1.5), ("Far", 3.0)))
    return intervals.sequence(left, right, gap=True)


def interval_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.min_length(intervals.kleene_of_units(intervals.unit(_bound_frames(spark, sf_dir, "Far", 1.0))), 3)


def interval_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetitions of a two-frame pattern."""
    left, right = (intervals.unit(_bound_frames(spark, sf_dir, n)) for n in ("LeftOf", "RightOf"))
    return intervals.kleene(intervals.sequence(left, right))


def interval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best over all cuts of the lesser score: x of object 0 in one frame, then y of object 1 in the next."""
    rows = scene(spark, sf_dir)
    left = intervals.unit(rows.filter("oid = 0").select("vid", "fid", F.col("x1").alias("score")))
    right = intervals.unit(rows.filter("oid = 1").select("vid", "fid", F.col("y1").alias("score")))
    return intervals.occurs(intervals.sequence(left, right))


def interval_predicate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantitative: how far apart objects 0 and 1 are in one frame and how near in the next, the best of the lesser."""
    pair = _pairs(scene(spark, sf_dir)).filter("a_oid = 0 AND b_oid = 1")
    sides = [lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")]
    far, near = (intervals.unit(pair.select("vid", "fid", score(n, sides).alias("score"))) for n in ("Far", "Near"))
    return intervals.occurs(intervals.sequence(far, near)).select("vid", F.round("score", 4).alias("score"))


def track_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.tracks(scene(spark, sf_dir))


def track_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.track_pairs(scene(spark, sf_dir))


def pair_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scene(spark, sf_dir)
    return preparation.pair_segments(rows, preparation.track_pairs(rows)).select("vid", "pair", "oid", "fid", "x1", "y1")


def cut_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.cut_segments(scene(spark, sf_dir), 20).groupBy("vid", "part").agg(F.count("fid").alias("n"), F.max("fid").alias("last"))


def nested_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories of objects 0 and 1 as arrays, laid out again by their places; missing frames are NULL."""
    nest = preparation.nested(scene(spark, sf_dir).filter("oid < 2"))
    rows = nest.select("vid", F.posexplode("trajectories").alias("oid", "frames")).select("vid", "oid", F.posexplode("frames").alias("fid", "box"))
    return rows.select("vid", "oid", "fid", *[F.nanvl(F.col("box")[k], F.lit(None).cast("double")).alias(c) for k, c in ((0, "x1"), (3, "y2"))])


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth to compare with: segments whose number leaves 0 or 1 by 3."""
    return scene(spark, sf_dir).select("vid").distinct().withColumn("label", (F.col("vid") % 3 < 2).cast("int"))


def query_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the programs has no hit."""
    programs = [*POOL, "Far(o0, o1, 1000000.0)"]
    found = evaluate(co_located(scene(spark, sf_dir)), [program_of(t) for t in programs])
    return quality.scored(_labels(spark, sf_dir), found, len(programs)).select("qid", F.round("f1", 6).alias("f1"))


def quality_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.scored(_labels(spark, sf_dir), pool(spark, sf_dir), len(POOL)).withColumn("step", F.col("qid") % 2)
    return quality.spread(scores).select("step", *[F.round(c, 6).alias(c) for c in ("median", "low", "high")])


def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = quality.label_stats(_labels(spark, sf_dir))
    return s.select("npos", "nneg", F.round("ratio", 6).alias("ratio"))


def noisy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.noisy(_labels(spark, sf_dir), 0.2, 0.1)


def label_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.split(_labels(spark, sf_dir), 20)


def query_by_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs that explain the segments in which a target event occurs, found from 6 labels and 4 asked for."""
    rows = scene(spark, sf_dir).persist()
    hits = saved(matches(rows, program_of(POOL[2]), bound=True))
    ask = lambda v: int(hits.filter(F.col("vid") == v).count() > 0)
    first = [r.vid for r in rows.select("vid").distinct().orderBy("vid").limit(6).collect()]
    space = Space([("Near", [1.0, 2.0]), ("Far", [2.0, 3.0]), ("LeftQuadrant", None), ("TopQuadrant", None)], max_atoms=3, max_steps=2)
    found = Search(rows, space, ask, {v: ask(v) for v in first}, beam=4, keep=10).run(3, budget=4)
    rows.unpersist()
    told = [(text_of(p), float(cost(canonical(p, False))), float(s)) for p, s in found]
    return spark.createDataFrame(told, "program string, cost double, score double")


def top_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All programs of a small space that agree with eight labels of a target event, found from sketches."""
    rows = scene(spark, sf_dir).persist()
    hits = saved(matches(rows, program_of("Far(o0, o1, 2.0); Near(o0, o1, 2.0)"), bound=True))
    first = rows.select("vid").distinct().orderBy("vid").limit(8)
    labels = {r.vid: int(r.hit) for r in first.join(hits.withColumn("hit", F.lit(True)), "vid", "left").na.fill(False, ["hit"]).collect()}
    found = TopDown(rows, [("Near", [1.0, 2.0, 3.0]), ("Far", [1.0, 2.0, 3.0]), ("LeftQuadrant", None)], labels).run()
    rows.unpersist()
    return spark.createDataFrame([(text_of(p),) for p in found], "program string")


QUERIES = {name: _event(name) for name in EVENTS}
QUERIES |= {"scene": scene, "traffic": traffic}
QUERIES |= {
    f.__name__: f
    for f in (
        predicates_of_objects, predicates_of_pairs, predicates_of_pairs_matrix, predicates_of_lanes, predicates_of_motion, predicates_of_slow_motion, box_overlap, event_completions, event_islands,
        event_count, event_earliest, pool_free, predicate_relations, interval_predicate_scores, top_down,
        event_unpruned, event_cached, event_cache_misses, event_sampled, event_restricted, pool, pool_votes, predicate_bits, interval_conjunction,
        interval_sequence, interval_gap_sequence, interval_repetition, interval_closure, interval_scores, track_extents, track_pairs, pair_segments,
        cut_segments, nested_pairs, query_quality, quality_spread, label_stats, noisy_labels, label_split, query_by_example,
    )
}
ORACLES = oracles.ORACLES
