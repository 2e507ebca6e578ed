"""Detection relations: schemas, loaders, restriction, sampling, and detections derived from the events table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "x1 double, y1 double, x2 double, y2 double"
SCENE = f"oid int, vid int, fid int, shape string, color string, material string, {BOX}"
TRAFFIC = f"oid int, vid int, fid int, {BOX}, vx double, vy double, ax double, ay double"
CROSSING = f"oid int, vid int, fid int, {BOX}"

# The attribute domains.
SHAPES = ("cube", "sphere", "cylinder")
COLORS = ("gray", "red", "blue", "green", "brown", "cyan", "purple", "yellow")
MATERIALS = ("metal", "rubber")
EPOCH = 1704067200
FRAME_SECONDS = 43200


def read_csv(spark: SparkSession, path: str, schema: str = SCENE) -> DataFrame:
    """A headerless CSV of detections, one row for each object and frame."""
    return spark.read.schema(schema).csv(path).dropDuplicates(["vid", "fid", "oid"])


def read_labels(spark: SparkSession, inputs: str, labels: str) -> DataFrame:
    """(vid, label) of two JSON files that each hold one array, matched by position."""

    def listed(path: str, name: str) -> DataFrame:
        return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<int>")).alias("pos", name))

    return listed(inputs, "vid").join(listed(labels, "label"), "pos").drop("pos")


def read_tracker_frames(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of frames, each a list of [oid, x1, y1, x2, y2], one file a segment; coordinates are halved. Segments are
    numbered by their files' names: the list of files is what the driver reads anyway."""
    texts = spark.read.text(path, wholetext=True)
    names = sorted(texts.inputFiles())
    vids = F.broadcast(spark.createDataFrame([(n, k) for k, n in enumerate(names)], "file string, vid int"))  # a row a file
    rows = texts.select(F.input_file_name().alias("file"), F.posexplode(F.from_json("value", "array<array<array<double>>>")).alias("fid", "objects"))
    rows = rows.select("file", "fid", F.explode("objects").alias("o"))
    half = lambda k: F.floor(F.col("o")[k] / 2).cast("double")
    return rows.join(vids, "file").select(F.col("o")[0].cast("int").alias("oid"), "vid", "fid", *[half(k + 1).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))])


def write_csv(detections: DataFrame, path: str, schema: str = SCENE) -> None:
    """What read_csv reads: headerless, columns in the schema's order."""
    detections.select(*[c.split()[0] for c in schema.split(", ")]).write.mode("overwrite").csv(path)


def write_labels(labels: DataFrame, inputs: str, labels_path: str) -> None:
    """Two JSON files that each hold one array, in order of vid. A label set is what one user gave: it fits a row."""
    both = labels.agg(F.sort_array(F.collect_list(F.struct("vid", "label"))).alias("l"))
    both.select(F.to_json(F.transform("l", lambda x: x["vid"]))).coalesce(1).write.mode("overwrite").text(inputs)
    both.select(F.to_json(F.transform("l", lambda x: x["label"]))).coalesce(1).write.mode("overwrite").text(labels_path)


def nested_pairs(pairs: DataFrame) -> DataFrame:
    """vid and trajectories array<array<array<double>>> [object][frame][x1, y1, x2, y2] to rows; the attributes of such
    relations are constants."""
    rows = pairs.select("vid", F.posexplode("trajectories").alias("oid", "frames")).select("vid", "oid", F.posexplode("frames").alias("fid", "box"))
    rows = rows.filter(~F.exists("box", lambda v: v.isNull() | F.isnan(v)))
    return rows.select("oid", "vid", "fid", F.lit("cube").alias("shape"), F.lit("red").alias("color"), F.lit("metal").alias("material"), *[F.col("box")[k].alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))])


def first_seen_ids(boxes: DataFrame) -> DataFrame:
    """oid for boxes that only carry attributes: objects of a segment numbered by first frame, then place in it."""
    from pyspark.sql import Window

    key = ["vid", "shape", "color", "material"]
    seen = boxes.groupBy(*key).agg(F.min(F.struct("fid", "pos")).alias("first"))
    named = seen.withColumn("oid", F.row_number().over(Window.partitionBy("vid").orderBy("first")) - 1).drop("first")
    return boxes.join(named, key)


def restrict(detections: DataFrame, vids: Sequence[int] | DataFrame | int) -> DataFrame:
    """The detections of some segments: a table or list of ids, or all below a number."""
    if isinstance(vids, int):
        return detections.filter(F.col("vid") < vids)
    if isinstance(vids, DataFrame):
        return detections.join(vids.select("vid").distinct(), "vid", "left_semi")
    return detections.filter(F.col("vid").isin(list(vids)))


def sample_frames(detections: DataFrame, rate: int) -> DataFrame:
    """Every rate-th frame, renumbered."""
    return detections.filter(F.col("fid") % rate == 0).withColumn("fid", F.expr(f"CAST(fid div {rate} AS INT)"))


CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def co_located(detections: DataFrame) -> DataFrame:
    """Detections dealt by segment once: all uses of them in a plan share that exchange, and joins, groups and windows that
    hold the segment need no other. Joins do so only while CO_PARTITION is false; where the session leaves it at its
    default, it is set here, once for the session."""
    conf = detections.sparkSession.conf
    if conf.get(CO_PARTITION) == "true":
        conf.set(CO_PARTITION, "false")
    return detections.repartition("vid")


def _latest(events: DataFrame) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    frame = F.expr(f"CAST((seconds - {EPOCH}) div {FRAME_SECONDS} AS INT)")
    rows = events.withColumn("seconds", seconds).select(F.expr("CAST(user_id div 5 AS INT)").alias("vid"), F.expr("CAST(user_id % 5 AS INT)").alias("oid"), frame.alias("fid"), "user_id", "event_id")
    return rows.groupBy("vid", "oid", "fid").agg(F.max("event_id").alias("e"), F.max("user_id").alias("u"))


def _pick(names: Sequence[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.col("u") % len(names) + 1).cast("int"))


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with attributes, derived from events by integer arithmetic."""
    rows = _latest(spark.read.parquet(f"{sf_dir}/events.parquet"))
    rows = rows.withColumns({"x1": (F.col("e") * 7919 % 460).cast("double"), "y1": (F.col("e") * 104729 % 300).cast("double")})
    return rows.select("oid", "vid", "fid", _pick(SHAPES).alias("shape"), _pick(COLORS).alias("color"), _pick(MATERIALS).alias("material"), "x1", "y1", (F.col("x1") + 10 + F.col("e") % 40).alias("x2"), (F.col("y1") + 10 + F.col("e") % 30).alias("y2"))


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with kinematics, derived likewise."""
    from segmenta.operators.preparation import kinematics

    rows = _latest(spark.read.parquet(f"{sf_dir}/events.parquet"))
    rows = rows.withColumns({"x1": (F.col("e") * 7919 % 920).cast("double"), "y1": (F.col("e") * 104729 % 500).cast("double")})
    boxes = rows.select("oid", "vid", "fid", "x1", "y1", (F.col("x1") + 10 + F.col("e") % 40).alias("x2"), (F.col("y1") + 10 + F.col("e") % 30).alias("y2"))
    return kinematics(boxes)
