"""Programs to DataFrames.

Each step joins one alias of the detections for each of its variables on segment and frame. A later step is joined with
the earliest completion of the steps before it, for each binding, so that only frames after it are looked at;
durations are tested by a window, never by recursion, and not at all if they are one frame.

In free mode variables range over all objects of a frame and differ pairwise; in bound mode o<k> is the object with
oid k. All joins, windows and groups hold the segment, so detections dealt by segment need no further shuffle.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmenta.functions.predicates import predicate
from segmenta.plans.events import Atom, Program, Step


def _columns(detections: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in detections.columns if c not in ("oid", "vid", "fid"))


def _test(atom: Atom, columns: tuple[str, ...], dialect: str) -> Column:
    objects = [lambda c, v=v: F.col(f"{v}_{c}") for v in atom.variables]
    return predicate(atom.name, objects, atom.parameter, columns, dialect)


def step_frames(detections: DataFrame, step: Step, bound: bool = False, dialect: str = "sql") -> DataFrame:
    """vid, fid and o<k>_oid of all frames and bindings for which the step's predicates hold."""
    columns = _columns(detections)
    found = None
    for v in step.variables:
        one = detections.select("vid", "fid", *[F.col(c).alias(f"{v}_{c}") for c in ("oid", *columns)])
        if bound:
            one = one.filter(F.col(f"{v}_oid") == int(v[1:]))
        for a in step.atoms:
            if a.variables == (v,):
                one = one.filter(_test(a, columns, dialect))
        found = one if found is None else found.join(one, ["vid", "fid"])
    for a in step.atoms:
        if len(a.variables) > 1:
            found = found.filter(_test(a, columns, dialect))
    if not bound:
        for a, b in combinations(step.variables, 2):
            found = found.filter(F.col(f"{a}_oid") != F.col(f"{b}_oid"))
    return found.select("vid", "fid", *[f"{v}_oid" for v in step.variables])


def held(frames: DataFrame, duration: int, keys: list[str], how: str = "lead") -> DataFrame:
    """frames with `until`, the frame that completes a run of that length from fid on; other frames go.

    how: "lead" looks one row ahead by the duration, "islands" numbers runs of consecutive frames."""
    if duration == 1:
        return frames.withColumn("until", F.col("fid"))
    ordered = Window.partitionBy(*keys).orderBy("fid")
    if how == "lead":
        ahead = frames.withColumn("until", F.lead("fid", duration - 1).over(ordered))
        return ahead.filter(F.col("until") == F.col("fid") + duration - 1)
    if how != "islands":
        raise ValueError(how)
    runs = frames.withColumn("run", F.col("fid") - F.row_number().over(ordered))
    place = Window.partitionBy(*keys, "run").orderBy(F.col("fid").desc())
    left = runs.withColumn("left", F.row_number().over(place))
    return left.filter(F.col("left") >= duration).withColumn("until", F.col("fid") + duration - 1).drop("run", "left")


def after(prefix: DataFrame, frames: DataFrame, bound: bool) -> DataFrame:
    """Frames after the completion of the steps before, under equal bindings of shared variables; new variables are
    bound to objects that no earlier one has."""
    shared = [c for c in frames.columns if c in prefix.columns and c.endswith("_oid")]
    new = [c for c in frames.columns if c.endswith("_oid") and c not in shared]
    old = [c for c in prefix.columns if c.endswith("_oid") and c not in shared]
    met = prefix.join(frames, ["vid", *shared]).filter(F.col("done") < F.col("fid"))
    if not bound:
        for a in new:
            for b in [*old, *shared]:
                met = met.filter(F.col(a) != F.col(b))
    return met


def completions(detections: DataFrame, program: Program, bound: bool = False, dialect: str = "sql", how: str = "lead", prune: bool = True) -> DataFrame:
    """vid, bindings and `done`, the earliest frame that completes the program under them.

    prune=False windows every step on all its frames and joins afterwards; the result is the same."""
    prefix = None
    for step in program:
        prefix = advance(prefix, detections, step, bound, dialect, how, prune)
    return prefix


def advance(prefix: DataFrame | None, detections: DataFrame, step: Step, bound: bool = False, dialect: str = "sql", how: str = "lead", prune: bool = True) -> DataFrame:
    """Completions of a program with one step more, from those of the program before it (None: there is none)."""
    frames = step_frames(detections, step, bound, dialect)
    own = ["vid", *[c for c in frames.columns if c.endswith("_oid")]]
    if not prune:
        frames = held(frames, step.duration, own, how)
    if prefix is not None:
        frames = after(prefix, frames, bound)
    keys = ["vid", *sorted((c for c in frames.columns if c.endswith("_oid")), key=lambda c: int(c[1:-4]))]
    if prune:
        frames = held(frames, step.duration, keys, how)
    return frames.groupBy(*keys).agg(F.min("until").alias("done"))


def matches(detections: DataFrame, program: Program, **options) -> DataFrame:
    """The segments (vid) in which the event occurs."""
    return completions(detections, program, **options).select("vid").distinct()


WORD_BITS = 62


def bit_words(atoms: list[Atom], columns: tuple[str, ...], dialect: str = "sql") -> list[Column]:
    """One bit for each atom that holds, WORD_BITS of them in each bigint."""
    bits = [F.when(_test(a, columns, dialect), F.lit(1 << k % WORD_BITS)).otherwise(F.lit(0)).cast("bigint") for k, a in enumerate(atoms)]
    return [reduce(lambda x, y: x.bitwiseOR(y), bits[k : k + WORD_BITS]) for k in range(0, len(bits), WORD_BITS)]


def bindings(detections: DataFrame, variables: list[str]) -> DataFrame:
    """vid, fid and the columns of each variable, named after it, for all distinct objects of a frame (free mode)."""
    found = None
    for v in variables:
        one = detections.select("vid", "fid", *[F.col(c).alias(f"{v}_{c}") for c in ("oid", *_columns(detections))])
        found = one if found is None else found.join(one, ["vid", "fid"])
    for a, b in combinations(variables, 2):
        found = found.filter(F.col(f"{a}_oid") != F.col(f"{b}_oid"))
    return found


def bound_pairs(detections: DataFrame) -> DataFrame:
    """vid, fid and the columns of o0 and o1, the objects 0 and 1 of a frame; either may be missing (bound mode)."""
    pick = lambda k, c: F.max(F.when(F.col("oid") == k, F.col(c))).alias(f"o{k}_{c}")
    return detections.filter(F.col("oid").isin(0, 1)).groupBy("vid", "fid").agg(*[pick(k, c) for k in (0, 1) for c in ("oid", *_columns(detections))])


def predicate_table(detections: DataFrame, atoms: list[Atom], bound: bool = True, dialect: str = "sql") -> DataFrame:
    """One row for each frame with o0 and o1 (bound mode: either may be missing) and `bits`, an array of bigints with one bit
    for each atom that holds."""
    frames = bound_pairs(detections) if bound else bindings(detections, ["o0", "o1"])
    return frames.select("vid", "fid", "o0_oid", "o1_oid", F.array(*bit_words(atoms, _columns(detections), dialect)).alias("bits"))
