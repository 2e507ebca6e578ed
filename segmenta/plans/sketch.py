"""Top-down synthesis: sketches with holes are filled step by step and cut by what they can still match.

A hole stands for any predicate; a parameter may be an interval of the grid that it can take. A sketch is over-approximated
by leaving holes out (a step of holes alone matches any stretch of frames, also none) and by taking each interval at
its loosest end; it is under-approximated by matching nothing while it has a hole, else by the tightest ends. A
sketch goes if its over-approximation misses a positive segment, or its under-approximation hits a negative one: no
filling can mend that. All children of a generation are evaluated in one Spark plan; the driver holds sketches only.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.functions.predicates import PREDICATES
from segmenta.plans.events import Atom, Program, Step, text_of
from segmenta.plans.pool import evaluate

#: Predicates that hold for more frames the larger their parameter is; the others hold for fewer.
GROWING = frozenset({"near", "stopped", "distancesmall"})


@dataclass(frozen=True)
class Open:
    """A predicate whose parameter is known to an interval of the grid, places low to high."""

    name: str
    variables: tuple[str, ...]
    grid: tuple[float, ...]
    low: int
    high: int

    def at(self, loose: bool) -> Atom:
        growing = self.name.lower() in GROWING
        return Atom(self.name, self.variables, self.grid[self.high if growing == loose else self.low])

    def halves(self) -> list[Open | Atom]:
        """The lower and the upper part; a part of one place is a predicate."""
        mid = (self.low + self.high) // 2
        parts = [replace(self, high=mid), replace(self, low=mid + 1)]
        return [p.at(True) if p.low == p.high else p for p in parts]


@dataclass(frozen=True)
class SketchStep:
    atoms: tuple[Atom | Open, ...] = ()
    holes: int = 0
    duration: int = 1


Sketch = tuple[SketchStep, ...]


def is_complete(sketch: Sketch) -> bool:
    return all(not s.holes and all(isinstance(a, Atom) for a in s.atoms) for s in sketch)


def program_of_sketch(sketch: Sketch, loose: bool) -> Program | None:
    """The program of the over- or under-approximation; None: it matches nothing (under) or everything (over, empty)."""
    if not loose and any(s.holes for s in sketch):
        return None
    steps = [Step(tuple(a.at(loose) if isinstance(a, Open) else a for a in s.atoms), s.duration if not s.holes or s.atoms else 1) for s in sketch]
    return tuple(s for s in steps if s.atoms) or None


@dataclass
class TopDown:
    """State of the search. catalog: (predicate, grid of parameters or None); variables of each arity are fixed."""

    detections: DataFrame
    catalog: list[tuple[str, list[float] | None]]
    labels: dict[int, int]
    max_steps: int = 2
    max_atoms: int = 2
    durations: tuple[int, ...] = (1,)
    bound: bool = True
    #: Sketches evaluated in one plan.
    batch: int = 64
    looked: int = 0
    answers: list[Program] = field(default_factory=list)

    def first(self) -> list[Sketch]:
        """Sketches of holes alone, the smallest first."""
        out: list[Sketch] = [()]
        for _ in range(self.max_steps):
            out += [(*s, SketchStep(holes=n, duration=d)) for s in out if len(s) == max(map(len, out)) for n in range(1, self.max_atoms + 1) for d in self.durations]
        return sorted((s for s in out if s and sum(x.holes for x in s) <= self.max_atoms), key=lambda s: (sum(x.holes for x in s), len(s)))

    def children(self, sketch: Sketch) -> list[Sketch]:
        """The first hole filled in every way, or else the first interval halved. Predicates of a step are in order of the
        catalog, so that each conjunction is made once."""
        names = [n.lower() for n, _ in self.catalog]
        for k, step in enumerate(sketch):
            put = lambda s, k=k: (*sketch[:k], s, *sketch[k + 1 :])
            if step.holes:
                start = max((names.index(a.name.lower()) + 1 for a in step.atoms), default=0)
                out = []
                for name, grid in self.catalog[start:]:
                    variables = ("o0",) if PREDICATES[name.lower()].arity == 1 else ("o0", "o1")
                    atom = Atom(name, variables) if not grid else Atom(name, variables, grid[0]) if len(grid) == 1 else Open(name, variables, tuple(sorted(grid)), 0, len(grid) - 1)
                    out.append(put(replace(step, atoms=(*step.atoms, atom), holes=step.holes - 1)))
                return out
        for k, step in enumerate(sketch):
            for j, a in enumerate(step.atoms):
                if isinstance(a, Open):
                    return [(*sketch[:k], replace(step, atoms=(*step.atoms[:j], half, *step.atoms[j + 1 :])), *sketch[k + 1 :]) for half in a.halves()]
        return []

    def _fits(self, sketches: list[Sketch]) -> list[bool]:
        """Whether each over-approximation hits all positives and each under-approximation no negative."""
        spark = self.detections.sparkSession
        own = spark.createDataFrame([(v,) for v in self.labels], "vid int")
        rows = self.detections.join(F.broadcast(own), "vid", "left_semi")
        asked = [(k, loose, p) for k, s in enumerate(sketches) for loose in (True, False) if (p := program_of_sketch(s, loose))]
        hits: dict[int, set[int]] = {}
        if asked:
            for r in evaluate(rows, [p for _, _, p in asked], self.bound).collect():  # labelled segments only
                hits.setdefault(r.qid, set()).add(r.vid)
        fits = [True] * len(sketches)
        for q, (k, loose, _) in enumerate(asked):
            found = hits.get(q, set())
            if any(found.isdisjoint({v}) for v, y in self.labels.items() if y) if loose else any(v in found for v, y in self.labels.items() if not y):
                fits[k] = False
        self.looked += len(sketches)
        return fits

    def run(self) -> list[Program]:
        """All programs of the space that agree with every label, by generations; in order of their texts."""
        waiting = self.first()
        while waiting:
            waiting, now = waiting[self.batch :], waiting[: self.batch]
            for sketch, fit in zip(now, self._fits(now), strict=True):
                if fit and is_complete(sketch):
                    self.answers.append(program_of_sketch(sketch, True))
                elif fit:
                    waiting += self.children(sketch)
        self.answers = sorted(set(self.answers), key=text_of)
        return self.answers

    def tell(self, vid: int, label: int) -> list[Program]:
        """A new label: answers that do not agree with it go."""
        self.labels[vid] = label
        if self.answers:
            rows = self.detections.filter(F.col("vid") == vid)
            hit = {r.qid for r in evaluate(rows, self.answers, self.bound).collect()}
            self.answers = [p for q, p in enumerate(self.answers) if (q in hit) == bool(label)]
        return self.answers
