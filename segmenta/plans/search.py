"""Query by example: programs that explain a few labelled segments.

A beam search grows programs by a predicate, a step or a duration. A whole beam's candidates are evaluated in one Spark
plan; the driver holds programs and scores only. Segments to label next are those on which the best programs, by
their scores, disagree most. All choices are ordered by score and then by text, so a seed gives one course.
"""

from __future__ import annotations

import random
import re
from ast import literal_eval
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.functions.predicates import PREDICATES
from segmenta.operators.quality import scored
from segmenta.plans.events import Atom, Program, Step, canonical, cost, text_of
from segmenta.plans.pool import evaluate


@dataclass
class Space:
    """What programs may be made of. catalog: (predicate, parameters or None)."""

    catalog: list[tuple[str, list | None]]
    bound: bool = True
    max_atoms: int = 5
    max_steps: int = 3
    max_duration: int = 1
    variables: int = 2
    unit: int = 5
    unary_on: tuple[str, ...] = ("o0",)

    def atoms(self) -> list[Atom]:
        names = [f"o{k}" for k in range(self.variables)]
        out = []
        for name, parameters in self.catalog:
            arity = PREDICATES[name.lower()].arity
            places = permutations(names, arity) if not self.bound else [(v,) for v in self.unary_on] if arity == 1 else [("o0", "o1")]
            out += [Atom(name, tuple(v), p) for v in places for p in (parameters or [None])]
        return out

    def seeds(self) -> list[Program]:
        return unique([(Step((a,)),) for a in self.atoms()], not self.bound)

    def children(self, program: Program) -> list[Program]:
        """Programs with one predicate more in a step, with a one-predicate step more anywhere, or with a longer
        duration."""
        out: list[Program] = []
        n = sum(len(s.atoms) for s in program)
        for a in self.atoms() if n < self.max_atoms else []:
            for k, step in enumerate(program):
                if not any(b.name == a.name and set(b.variables) == set(a.variables) for b in step.atoms):
                    out.append((*program[:k], replace(step, atoms=(*step.atoms, a)), *program[k + 1 :]))
            if len(program) < self.max_steps:
                out += [(*program[:k], Step((a,)), *program[k:]) for k in range(len(program) + 1)]
        for k, step in enumerate(program):
            if step.duration < self.max_duration:
                longer = self.unit if step.duration == 1 and self.unit != 1 else step.duration + self.unit
                out.append((*program[:k], replace(step, duration=longer), *program[k + 1 :]))
        return unique(out, not self.bound)


def unique(programs: list[Program], free: bool) -> list[Program]:
    """One program of each spelling. Variables are not sorted inside atoms: that would merge programs of other meanings."""
    return list({text_of(c): c for c in (canonical(p, free, sort_variables=False) for p in programs)}.values())


@dataclass
class Search:
    """State between rounds. ask(vid) gives a label; detections hold all segments."""

    detections: DataFrame
    space: Space
    ask: Callable[[int], int]
    labels: dict[int, int] = field(default_factory=dict)
    beam: int = 32
    keep: int = 100
    weight: float = 0.01
    seed: int = 42
    active: bool = True
    answers: dict[str, tuple[Program, float]] = field(default_factory=dict)
    log: list[dict] = field(default_factory=list)

    def score(self, programs: list[Program]) -> list[tuple[Program, float]]:
        """F1 on the labelled segments less the weighted cost; best first, ties by text."""
        if not programs:
            return []
        spark = self.detections.sparkSession
        labels = spark.createDataFrame(list(self.labels.items()), "vid int, label int")
        rows = self.detections.join(F.broadcast(labels.select("vid")), "vid", "left_semi")
        found = {r.qid: r.f1 for r in scored(labels, evaluate(rows, programs, self.space.bound), len(programs)).collect()}  # a row a program
        out = [(p, found.get(q, 0.0) - self.weight * cost(p, self.space.unit)) for q, p in enumerate(programs)]
        return sorted(out, key=lambda x: (-x[1], text_of(x[0])))

    def _remember(self, found: list[tuple[Program, float]]) -> None:
        known = {**self.answers, **{text_of(p): (p, s) for p, s in found}}
        ranked = sorted(known.values(), key=lambda x: (-x[1], text_of(x[0])))
        if len(ranked) > self.keep:  # ties with the last stay
            ranked = [x for x in ranked if x[1] >= ranked[self.keep - 1][1]]
        self.answers = {text_of(p): (p, s) for p, s in ranked}

    def random_segments(self, n: int) -> list[int]:
        """Unlabelled segments in an order by hash of the seed: what active learning is compared with."""
        spark = self.detections.sparkSession
        known = spark.createDataFrame([(v,) for v in self.labels] or [(-1,)], "vid int")
        vids = self.detections.select("vid").distinct().join(known, "vid", "left_anti")
        return [r.vid for r in vids.orderBy(F.xxhash64(F.lit(self.seed), "vid"), "vid").limit(n).collect()]

    def next_segments(self, n: int, sample: int = 100) -> list[int]:
        """Unlabelled segments on which the answers, weighted by score, disagree most."""
        if not self.active:
            return self.random_segments(n)
        spark = self.detections.sparkSession
        pool = [x for x in self.answers.values() if x[1] > 0] or list(self.answers.values())
        low = min(s for _, s in pool)
        weights = [s - min(0.0, low) + 1e-9 for _, s in pool]
        known = spark.createDataFrame([(v,) for v in self.labels] or [(-1,)], "vid int")
        vids = self.detections.select("vid").distinct().join(known, "vid", "left_anti")
        chosen = vids.orderBy(F.xxhash64(F.lit(self.seed + len(self.labels)), "vid"), "vid").limit(sample)
        found = evaluate(self.detections.join(F.broadcast(chosen), "vid", "left_semi"), [p for p, _ in pool], self.space.bound)
        table = spark.createDataFrame([(q, w / sum(weights)) for q, w in enumerate(weights)], "qid int, weight double")
        p = chosen.join(found.join(F.broadcast(table), "qid").groupBy("vid").agg(F.sum("weight").alias("p")), "vid", "left")
        p = p.withColumn("u", F.coalesce(F.col("p") * (1 - F.col("p")), F.lit(0.0)))
        return [r.vid for r in p.orderBy(F.desc("u"), "vid").limit(n).collect()]

    def _beam_of(self, found: list[tuple[Program, float]], how: str) -> list[Program]:
        if how == "ties":
            return [p for p, s in found if s >= found[min(self.beam, len(found)) - 1][1]] if found else []
        rng = random.Random(self.seed * 1_000_003 + len(self.log))  # each round draws anew
        if how == "sample":  # without replacement, likelier the better
            found = sorted(found, key=lambda x: -(rng.random() ** (1 / max(1e-9, x[1]))))
        elif how == "random":
            found = sorted(found, key=lambda x: (-x[1], rng.random()))
        return [p for p, _ in found[: self.beam]]

    def run(self, rounds: int, budget: int = 0, how: str = "best") -> list[tuple[Program, float]]:
        """Rounds of growing, scoring and labelling; the answers, best first. The budget of labels is spread over the
        rounds."""
        programs = self.space.seeds()
        for k in range(rounds):
            found = self.score(programs)
            if k:
                found = [x for x in found if x[1] > 0]
            if not found:
                break
            self._remember(found)
            share = budget_of(budget, rounds)[k]
            if share:
                for v in self.next_segments(share):
                    self.labels[v] = self.ask(v)
                self.answers = {text_of(p): (p, s) for p, s in self.score([p for p, _ in self.answers.values()])}
            self.log.append({"round": k, "candidates": len(programs), "labels": len(self.labels), "best": text_of(found[0][0]), "score": found[0][1]})
            programs = unique([c for p in self._beam_of(found, how) for c in self.space.children(p)], not self.space.bound)
            programs = [p for p in programs if text_of(p) not in self.answers]
        return sorted(self.answers.values(), key=lambda x: (-x[1], text_of(x[0])))


def budget_of(budget: int, rounds: int) -> list[int]:
    """Labels of each round: as even as can be, what is left over from the middle round outwards."""
    out = [budget // rounds] * rounds
    middle = sorted(range(rounds), key=lambda k: (abs(k - (rounds - 1) / 2), k))
    for k in middle[: budget % rounds]:
        out[k] += 1
    return out


class Session:
    """The search with a person in it: each call brings one label and returns the segment to look at next, first the given
    ones, then the most disputed, until the budget is spent."""

    def __init__(self, search: Search, first: list[int], rounds: int, budget: int, how: str = "best"):
        self.search, self.first, self.rounds, self.how = search, list(first), rounds, how
        self.shares = budget_of(budget, rounds)
        self.state, self.round, self.programs, self.waiting = "label_first", 0, search.space.seeds(), list(first)

    def next(self, label: int | None = None) -> int | None:
        """label: that of the segment that the last call returned. None at the end; search.answers has the programs."""
        if label is not None and self.waiting:
            self.search.labels[self.waiting.pop(0)] = label
        while not self.waiting and self.state != "terminated":
            self._go_on()
        return self.waiting[0] if self.waiting else None

    def _go_on(self) -> None:
        s = self.search
        if self.state == "label_more":  # the labels of this round are in
            s.answers = {text_of(p): (p, x) for p, x in s.score([p for p, _ in s.answers.values()])}
            self._grow()
        if self.state == "terminated":
            return
        found = s.score(self.programs)
        found = [x for x in found if x[1] > 0] if self.round else found
        if not found:
            self.state = "terminated"
            return
        s._remember(found)
        self.found, self.state = found, "label_more"
        s.log.append({"round": self.round, "candidates": len(self.programs), "labels": len(s.labels), "best": text_of(found[0][0]), "score": found[0][1]})
        share = self.shares[self.round]
        self.waiting = s.next_segments(share) if share else []

    def _grow(self) -> None:
        s = self.search
        self.round += 1
        programs = unique([c for p in s._beam_of(self.found, self.how) for c in s.space.children(p)], not s.space.bound)
        self.programs = [p for p in programs if text_of(p) not in s.answers]
        if self.round >= self.rounds or not self.programs:
            self.state = "terminated"


def write_log(search: Search, path: str) -> None:
    """The rounds and the final answers as text lines."""
    with open(path, "w", encoding="utf-8") as f:
        for row in search.log:
            f.write(f"[Step {row['round']}] candidates {row['candidates']}, labels {row['labels']}\n({row['best']!r}, {row['score']!r})\n")
        f.write("[Final answers]\n")
        for p, s in sorted(search.answers.values(), key=lambda x: (-x[1], text_of(x[0]))):
            f.write(f"({text_of(p)!r}, {s!r})\n")


def read_log(path: str) -> tuple[list[tuple[int, str, float]], list[tuple[str, float]]]:
    """(step, best program, score) of each round, and the final answers."""
    steps, final, at = [], [], None
    with open(path, encoding="utf-8") as f:
        for line in f:
            if m := re.match(r"\[Step (\d+)\]", line):
                at = int(m[1])
            elif line.startswith("[Final answers]"):
                at = None
            elif line.startswith("("):
                program, score = literal_eval(line)
                final.append((program, score)) if at is None else steps.append((at, program, score))
    return steps, final


def workload(detections: DataFrame, space: Space, n: int, atoms: int, steps: int, low: float, high: float, durations: tuple[int, ...] = (1,), seed: int = 0, tries: int = 20) -> list[tuple[Program, float]]:
    """n random programs whose share of matching segments lies within low and high; each batch of drawn programs is evaluated
    in one plan. Fewer if `tries` batches do not bring them."""
    of = detections.agg(F.countDistinct("vid")).first()[0]
    out: dict[str, tuple[Program, float]] = {}
    for k in range(tries):
        drawn = unique([random_program(space, atoms, steps, durations, seed * 10_007 + k * 101 + i) for i in range(2 * n)], not space.bound)
        share = {r.qid: r.n / of for r in evaluate(detections, drawn, space.bound).groupBy("qid").agg(F.count(F.lit(1)).alias("n")).collect()}
        for q, p in enumerate(drawn):
            if low <= share.get(q, 0.0) <= high and len(out) < n:
                out.setdefault(text_of(p), (p, share.get(q, 0.0)))
        if len(out) == n:
            break
    return list(out.values())


def random_program(space: Space, atoms: int, steps: int, durations: tuple[int, ...] = (1,), seed: int = 0) -> Program:
    """A program for workloads: atoms dealt to steps, each step with one at least."""
    rng = random.Random(seed)
    pool = space.atoms()
    out: list[list[Atom]] = [[rng.choice(pool)] for _ in range(steps)]
    while sum(map(len, out)) < atoms:
        step, a = rng.choice(out), rng.choice(pool)
        if not any(b.name == a.name and set(b.variables) == set(a.variables) for b in step):
            step.append(a)
    return canonical(tuple(Step(tuple(s), rng.choice(durations)) for s in out), not space.bound, sort_variables=False)


def ancestors(program: Program, unit: int = 5) -> list[Program]:
    """All programs that the search can pass on the way: fewer predicates, fewer steps, shorter durations."""
    known, waiting = {}, [program]
    while waiting:
        p = waiting.pop()
        for k, step in enumerate(p):
            rest = (*p[:k], *p[k + 1 :])
            options = [(*p[:k], replace(step, atoms=tuple(a for a in step.atoms if a != b)), *p[k + 1 :]) for b in step.atoms if len(step.atoms) > 1]
            if len(step.atoms) == 1 and rest:
                options.append(rest)
            if step.duration > 1:
                options.append((*p[:k], replace(step, duration=step.duration - unit if step.duration > unit else 1), *p[k + 1 :]))
            for o in options:
                if text_of(o) not in known:
                    known[text_of(o)] = o
                    waiting.append(o)
    return list(known.values())
