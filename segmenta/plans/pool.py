"""Evaluating a pool of candidate programs in one plan, and remembering what prefixes match.

The atoms of all candidates become bits of predicate tables, one table for each set of variables that steps use. Each frame
is matched with the distinct (atoms, duration) steps by masks and runs are found once for all of them. Sequences are
joined by the candidates' number, in one plan for all candidates whose steps use the same variables, however many.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmenta.operators.lineage import saved
from segmenta.plans.events import Atom, Program, canonical, text_of
from segmenta.plans.sequence import WORD_BITS, _columns, advance, bindings, bit_words, bound_pairs

Variables = tuple[str, ...]


def _oids(variables: Variables) -> list[str]:
    return [f"{v}_oid" for v in variables]


def _runs(frames: DataFrame, atoms: list[Atom], steps: dict[tuple[int, int], int], variables: Variables, columns: tuple[str, ...], dialect: str) -> DataFrame:
    """(vid, bindings, sid, fid, until): starts and ends of runs of each step, steps being {(mask, duration): sid}."""
    words = bit_words(atoms, columns, dialect)
    keys = ["vid", *_oids(variables)]
    table = frames.select("fid", *keys, F.array(*words).alias("bits"))
    part = lambda mask, w: mask >> w * WORD_BITS & (1 << WORD_BITS) - 1
    wanted = F.array(*[F.struct(F.lit(k).alias("sid"), F.array(*[F.lit(part(m, w)).cast("bigint") for w in range(len(words))]).alias("mask"), F.lit(d).alias("duration")) for (m, d), k in steps.items()])

    def holds(s: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.col("bits")[w].bitwiseAND(s["mask"][w]) == s["mask"][w] for w in range(len(words))])

    hit = table.withColumn("s", F.explode(F.filter(wanted, holds))).select("fid", *keys, "s.sid", "s.duration")
    runs = hit.withColumn("run", F.col("fid") - F.row_number().over(Window.partitionBy(*keys, "sid").orderBy("fid")))
    left = F.row_number().over(Window.partitionBy(*keys, "sid", "run").orderBy(F.col("fid").desc()))
    return runs.withColumn("left", left).filter(F.col("left") >= F.col("duration")).select(*keys, "sid", "fid", (F.col("fid") + F.col("duration") - 1).alias("until"))


def evaluate(detections: DataFrame, programs: list[Program], bound: bool = True, dialect: str = "sql") -> DataFrame:
    """(qid, vid): the segments that each program, numbered by its place, matches."""
    spark, columns = detections.sparkSession, _columns(detections)
    # in bound mode a segment has one binding, so no variable need be told
    of = lambda step: () if bound else tuple(step.variables)
    atoms: dict[Variables, dict[Atom, int]] = defaultdict(dict)
    steps: dict[Variables, dict[tuple[int, int], int]] = defaultdict(dict)
    shapes: dict[tuple[Variables, ...], list[tuple[int, list[int]]]] = defaultdict(list)
    for q, program in enumerate(programs):
        sids = []
        for step in program:
            known, v = atoms[of(step)], of(step)
            mask = reduce(lambda m, a: m | 1 << known.setdefault(a, len(known)), step.atoms, 0)
            sids.append(steps[v].setdefault((mask, step.duration), len(steps[v])))
        shapes[tuple(map(of, program))].append((q, sids))
    done = {}
    for v, known in atoms.items():
        frames = bound_pairs(detections) if bound else bindings(detections, list(v))
        done[v] = _runs(frames, list(known), steps[v], v, columns, dialect)
        if sum(v in shape[k:] for shape in shapes for k in range(len(shape))) > 1:
            done[v] = saved(done[v])  # looked at more than once
    found = []
    for shape, members in shapes.items():
        ends = None
        for at, v in enumerate(shape):
            plan = F.broadcast(spark.createDataFrame([(q, sids[at]) for q, sids in members], "qid int, sid int"))  # a row a program
            here = done[v].join(plan, "sid").select("qid", "vid", *_oids(v), "fid", "until")
            if ends is not None:
                before = [c for c in ends.columns if c.endswith("_oid")]
                shared = [c for c in _oids(v) if c in before]
                here = ends.join(here, ["qid", "vid", *shared]).filter(F.col("fid") > F.col("done"))
                for a in _oids(v):
                    for b in before:
                        if a not in shared and b != a:
                            here = here.filter(F.col(a) != F.col(b))
            keys = ["qid", "vid", *[c for c in here.columns if c.endswith("_oid")]]
            ends = here.groupBy(*keys).agg(F.min("until").alias("done"))
        found.append(ends.select("qid", "vid").distinct())
    return reduce(DataFrame.unionByName, found)


class PrefixCache:
    """Completions (vid, bindings, done) of prefixes of programs, under the prefix's text. A program is continued from its
    longest remembered prefix, one step a join. Programs that differ only in the order of atoms or the names of
    variables share their prefixes."""

    def __init__(self, detections: DataFrame, bound: bool = False, most: int = 256):
        self.detections, self.bound, self.most = detections, bound, most
        self.known: dict[str, DataFrame] = {}

    def _named(self, program: Program) -> Program:
        return canonical(program, free=not self.bound, sort_variables=False)

    def completions(self, program: Program) -> DataFrame:
        """Completions of the whole program, in the names of its canonical spelling; remembers those of all prefixes."""
        program = self._named(program)
        k = max((k for k in range(1, len(program) + 1) if text_of(program[:k]) in self.known), default=0)
        prefix = self.known[text_of(program[:k])] if k else None
        for step in program[k:]:
            k += 1
            prefix = saved(advance(prefix, self.detections, step, self.bound))
            while len(self.known) >= self.most:
                self.known.pop(next(iter(self.known)))
            self.known[text_of(program[:k])] = prefix
        return prefix

    def matches(self, program: Program) -> DataFrame:
        """Segments of the whole program."""
        return self.completions(program).select("vid").distinct()

    def misses(self, program: Program) -> DataFrame:
        """Segments that a remembered prefix rules out."""
        program = self._named(program)
        every = self.detections.select("vid").distinct()
        hits = [self.known[text_of(program[:k])] for k in range(len(program), 0, -1) if text_of(program[:k]) in self.known]
        return every.join(hits[0].select("vid"), "vid", "left_anti") if hits else every.limit(0)
