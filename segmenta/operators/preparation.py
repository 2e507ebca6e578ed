"""Preparing detections: kinematics, pairs of tracks, segments, nesting, label noise and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")
SEGMENTS_OF = 1 << 12


def kinematics(boxes: DataFrame) -> DataFrame:
    """Velocity: the way of the centre to the next frame; acceleration: the change of velocity. NULL where the
    next frame is missing."""
    ordered = Window.partitionBy("vid", "oid").orderBy("fid")
    follows = F.lead("fid").over(ordered) == F.col("fid") + 1
    step = lambda c: F.when(follows, F.lead(c).over(ordered) - F.col(c))
    centred = boxes.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})
    moving = centred.withColumns({"vx": step("cx"), "vy": step("cy")})
    return moving.withColumns({"ax": step("vx"), "ay": step("vy")}).select("oid", "vid", "fid", *BOX, "vx", "vy", "ax", "ay")


def tracks(detections: DataFrame) -> DataFrame:
    """First and last frame of each object."""
    return detections.groupBy("vid", "oid").agg(F.min("fid").alias("fs"), F.max("fid").alias("fe"))


def track_pairs(detections: DataFrame) -> DataFrame:
    """Ordered pairs of tracks of a segment where the second begins while the first lasts: vid, oid1, oid2, and the frames
    fs to fe that they share."""
    a, b = (tracks(detections).select("vid", *[F.col(c).alias(f"{c}_{k}") for c in ("oid", "fs", "fe")]) for k in "ab")
    met = a.join(b, "vid").filter((F.col("oid_a") != F.col("oid_b")) & (F.col("fs_a") <= F.col("fs_b")) & (F.col("fe_a") >= F.col("fs_b")))
    return met.select("vid", F.col("oid_a").alias("oid1"), F.col("oid_b").alias("oid2"), F.col("fs_b").alias("fs"), F.least("fe_a", "fe_b").alias("fe")).distinct()


def pair_key() -> str:
    """A number for a pair within its segment that needs no global order; distinct for all ids of 32 bits."""
    return "CAST(oid1 AS BIGINT) * 4294967296 + oid2"


def pair_segments(detections: DataFrame, pairs: DataFrame) -> DataFrame:
    """The frames of each pair as a segment of its own, with objects 0 and 1 and frames from 0. The new segment is told by
    (vid, pair): numbering pairs throughout would need them all in one order."""
    keyed = pairs.withColumn("pair", F.expr(pair_key()))
    box = [c for c in detections.columns if c not in ("oid", "vid", "fid")]

    def side(k: int) -> DataFrame:
        met = detections.join(keyed.withColumnRenamed(f"oid{k + 1}", "oid"), ["vid", "oid"]).filter(F.col("fid").between(F.col("fs"), F.col("fe")))
        return met.select("vid", "pair", F.lit(k).alias("oid"), (F.col("fid") - F.col("fs")).alias("fid"), *box)

    return side(0).unionByName(side(1))


def numbered_segments(rows: DataFrame) -> DataFrame:
    """(vid, pair) replaced by one number: the place within the segment, offset by the counts of the segments before it. Those
    come from counts of stretches of SEGMENTS_OF segments, so only a row a stretch is in one order."""
    pairs = rows.select("vid", "pair").distinct()
    inside = F.row_number().over(Window.partitionBy("vid").orderBy("pair")) - 1
    counts = pairs.groupBy("vid").agg(F.count(F.lit(1)).alias("n")).withColumn("stretch", F.expr(f"vid div {SEGMENTS_OF}"))
    before = counts.groupBy("stretch").agg(F.sum("n").alias("of"))
    before = before.select("stretch", (F.sum("of").over(Window.orderBy("stretch")) - F.col("of")).alias("before"))
    in_stretch = F.sum("n").over(Window.partitionBy("stretch").orderBy("vid")) - F.col("n")
    offsets = counts.withColumn("in_stretch", in_stretch).join(before, "stretch").select("vid", (F.col("before") + F.col("in_stretch")).alias("offset"))
    named = pairs.withColumn("inside", inside).join(offsets, "vid").select("vid", "pair", (F.col("offset") + F.col("inside")).cast("int").alias("new_vid"))
    return rows.join(named, ["vid", "pair"]).drop("vid", "pair").withColumnRenamed("new_vid", "vid")


def cut_segments(detections: DataFrame, length: int = 100, overlap: int = 0) -> DataFrame:
    """Segments of fixed length; with an overlap every frame may lie in several."""
    step = length - overlap
    first = F.greatest(F.lit(0), F.expr(f"(fid - {length} + {step}) div {step}"))
    rows = detections.withColumn("part", F.explode(F.sequence(first.cast("int"), F.expr(f"CAST(fid div {step} AS INT)"))))
    return rows.withColumn("fid", (F.col("fid") - F.col("part") * step).cast("int"))


def nested(rows: DataFrame, columns: tuple[str, ...] = BOX) -> DataFrame:
    """vid and trajectories [object 0, object 1][frame][columns]; missing frames are arrays of NaN."""
    length = rows.groupBy("vid").agg((F.max("fid") + 1).alias("length"))
    spine = length.withColumn("fid", F.explode(F.sequence(F.lit(0), F.col("length") - 1))).withColumn("oid", F.explode(F.array(F.lit(0), F.lit(1))))
    values = F.array(*[F.coalesce(F.col(c), F.lit(float("nan"))) for c in columns])
    full = spine.join(rows.select("vid", "fid", "oid", *columns), ["vid", "fid", "oid"], "left").withColumn("values", values)
    each = full.groupBy("vid", "oid").agg(F.sort_array(F.collect_list(F.struct("fid", "values"))).alias("frames"))
    each = each.withColumn("frames", F.transform("frames", lambda f: f["values"]))
    return each.groupBy("vid").agg(F.transform(F.sort_array(F.collect_list(F.struct("oid", "frames"))), lambda o: o["frames"]).alias("trajectories"))


def without_empty(pairs: DataFrame) -> DataFrame:
    """Pairs both of whose trajectories have frames."""
    return pairs.filter(F.forall("trajectories", lambda t: F.size(t) > 0))


def drawn(part: str, seed: int = 42):
    """48 bits of md5 of seed:part: a number that depends on these alone, in any engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(part).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def chance(part: str, seed: int = 42):
    """A number in [0, 1)."""
    return drawn(part, seed) / F.lit(float(1 << 48))


def noisy(labels: DataFrame, missed: float, false: float, seed: int = 42) -> DataFrame:
    """Labels of which a share of the positives and of the negatives is flipped."""
    p = chance("vid", seed=seed)
    flip = F.when(F.col("label") == 1, p < missed).otherwise(p < false)
    return labels.withColumn("label", F.when(flip, 1 - F.col("label")).otherwise(F.col("label")))


def split(labels: DataFrame, n_train: int, seed: int = 42) -> DataFrame:
    """A column `train`: n_train segments, as many of each label as its share asks, in an order by hash. Shares are rounded
    cumulatively, so that they add up to n_train. Ranks come from counts of hash bins, so no label is sorted in one task."""
    keyed = labels.withColumn("h", drawn("vid", seed)).withColumn("bin", F.expr("shiftright(h, 34)"))
    bins = keyed.groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = bins.withColumn("before", F.sum("n").over(Window.partitionBy("label").orderBy("bin")) - F.col("n"))
    totals = bins.groupBy("label").agg(F.sum("n").alias("of"))  # a row a label
    upto = F.sum("of").over(Window.orderBy("label"))
    share = lambda n: F.round(F.lit(n_train) * n / F.sum("of").over(Window.partitionBy()))
    totals = totals.select("label", (share(upto) - share(upto - F.col("of"))).alias("quota"))
    rank = F.row_number().over(Window.partitionBy("label", "bin").orderBy("h", "vid")) + F.col("before")
    ranked = keyed.join(before.drop("n"), ["label", "bin"]).withColumn("rank", rank).join(totals, "label")
    return ranked.select("vid", "label", (F.col("rank") <= F.col("quota")).alias("train"))
