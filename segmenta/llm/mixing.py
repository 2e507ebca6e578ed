"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

Each source's rows are shuffled by a hash and laid end to end as an endless stream of words that repeats from
its start; the stream is cut into blocks of equally many words. Slot t of the schedule maps the golden-ratio
point frac(t * phi) (as a 32-bit integer) through the cumulative target shares to a source; slots are
ranked within each source, and the slot of rank r takes the source's block r. Streams end at their target, which
is at most twice the source's size, so no row is taken more than twice.

SLOTS bounds the number of scheduled slots and so the rows of one source's ranking; blocks grow with the input. The points
need not meet a small source as often as its target asks, so ranks that the schedule leaves out follow after it:
every source has a slot for each of its blocks, and all of its target is taken.
Running positions come from sums over groups of hash bins, over the bins of a group and within a bin, and ranks of
slots from counts of stretches and within a stretch, so no task gets a whole source. Tables with a row a source are
ordered in one task, as places follow from that order.

Defined cases: a null or blank text has size 0 and is never taken; null is a source of its own, ordered
last; repeated rows are separate rows; an empty table or one without words gives rows with target 0 and taken
0; other columns are ignored by the query and pass through the stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmenta.llm.common import FEW, WORD, free_name, numbered, saved, small

WEIGHTS = (3, 1, 2)
EXTRA = 1.5
REPEAT = 2
SLOTS = 1 << 20
LEAST_BLOCK = 16
BINS, GROUP = 1 << 14, 1 << 7
STRETCH = 1 << 10
CELLS = 1 << 12
RING = 1 << 32
#: 2**32 over the golden ratio.
GOLDEN = 2654435769


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def shuffle_key(doc_id: Column) -> Column:
    """60 bits of md5 of the id as text."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The narrow table that all later steps work on."""
    return saved(
        docs.select(
            F.col(id_col).alias("id"),
            F.monotonically_increasing_id().alias("uid"),
            F.col(source_col).alias("source"),
            n_words(F.col(text_col)).alias("size"),
            shuffle_key(F.col(id_col)).alias("key"),
        )
    )


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, and cumulative edges lo, hi on the ring. Water-filling: the level is the
    highest that any count of capped sources gives; a row a source."""
    cap = F.col("source_size") * REPEAT
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    per = per.withColumn("place", F.row_number().over(order))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("place") % len(WEIGHTS) + F.when(F.col("place") % len(WEIGHTS) == 0, len(WEIGHTS)).otherwise(0)))
    by_cap = Window.orderBy(cap / F.col("weight"), "place")
    per = per.withColumns(
        {
            "total": F.sum("source_size").over(everything) * EXTRA,
            "before": F.coalesce(F.sum(cap).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "left": F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    per = per.withColumn("level", F.max((F.col("total") - F.col("before")) / F.col("left")).over(everything))
    per = per.withColumn("target", F.least(F.col("level") * F.col("weight"), cap.cast("double")))
    per = per.withColumn("end", F.round("target").cast("bigint"))
    per = per.withColumns({"all_end": F.sum("end").over(everything), "hi_end": F.sum("end").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    edge = lambda x: F.expr(f"CAST(floor(CAST({x} AS DOUBLE) / all_end * {RING}) AS BIGINT)")
    some = F.col("all_end") > 0
    return per.select("source", "place", "source_size", "weight", "target", "end", "all_end", F.when(some, edge("hi_end - end")).alias("lo"), F.when(some, edge("hi_end")).alias("hi"))


def schedule(plan: DataFrame) -> tuple[DataFrame, int]:
    """Slots (place, rank, t) and the words of a block. The slots go on past the total, up to twice it; ranks that
    a source still lacks come after them. Streams end at their targets."""
    spark = plan.sparkSession
    total, least = plan.agg(F.max("all_end"), F.min(F.when(F.col("end") > 0, F.col("end")))).first()
    if not total:
        return spark.createDataFrame([], "place int, rank bigint, t bigint"), LEAST_BLOCK
    block = max(LEAST_BLOCK, -(-total // SLOTS))
    slots = -(-total // block)
    slots += min(slots, -(-4 * total // least))
    width = RING // CELLS
    points = spark.range(slots).select(F.col("id").alias("t"), (F.col("id") * GOLDEN % RING).alias("x"))
    points = points.withColumn("cell", F.expr(f"x div {width}"))
    arcs = plan.filter("hi > lo").select("place", "lo", "hi", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("cell"))
    met = points.join(arcs, (points["cell"] == arcs["cell"]) & (points["x"] >= arcs["lo"]) & (points["x"] < arcs["hi"]))
    met = met.select("place", "t", F.expr(f"t div {STRETCH}").alias("stretch"))
    counts = met.groupBy("place", "stretch").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("place", "stretch", (F.sum("n").over(Window.partitionBy("place").orderBy("stretch")) - F.col("n")).alias("sooner"))
    inside = F.row_number().over(Window.partitionBy("place", "stretch").orderBy("t")) - 1
    ranked = met.withColumn("inside", inside).join(counts, ["place", "stretch"]).select("place", (F.col("sooner") + F.col("inside")).alias("rank"), "t")
    had = met.groupBy("place").agg(F.count(F.lit(1)).alias("had"))
    lacks = plan.filter("end > 0").join(had, "place", "left").select("place", F.coalesce("had", F.lit(0)).alias("had"), F.expr(f"(end + {block} - 1) div {block}").alias("need")).filter("had < need")
    lacks = lacks.withColumn("before", F.sum(F.col("need") - F.col("had")).over(Window.orderBy("place")) - F.col("need"))
    rest = lacks.select("place", F.explode(F.expr("sequence(had, need - 1)")).alias("rank"), "before")
    return ranked.unionByName(rest.select("place", "rank", (F.col("before") + F.col("rank") + slots).alias("t"))), block


def laid_out(sizes: DataFrame) -> DataFrame:
    """sizes with begin: the words before the row in its source's shuffled order."""
    same = F.col("source").eqNullSafe(F.col("_source"))
    binned = sizes.withColumn("bin", F.expr(f"shiftright(key, {60 - BINS.bit_length() + 1})"))
    bins = binned.groupBy(F.col("source").alias("_source"), F.col("bin").alias("_bin")).agg(F.sum("size").alias("bin_size")).withColumn("group", F.expr(f"_bin div {GROUP}"))
    groups = bins.groupBy(F.col("_source").alias("_of"), F.col("group").alias("_group")).agg(F.sum("bin_size").alias("size"))
    groups = groups.select("_of", "_group", (F.sum("size").over(Window.partitionBy("_of").orderBy("_group")) - F.col("size")).alias("group_begin"))
    in_group = F.sum("bin_size").over(Window.partitionBy("_source", "group").orderBy("_bin")) - F.col("bin_size")
    bins = bins.withColumn("in_group", in_group).join(groups, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("group") == F.col("_group")))
    bins = bins.select("_source", "_bin", (F.col("group_begin") + F.col("in_group")).alias("bin_begin"))
    inside = Window.partitionBy("source", "bin").orderBy("key", "size", "id", "uid").rowsBetween(Window.unboundedPreceding, 0)
    rows = binned.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    return rows.join(bins, same & (F.col("bin") == F.col("_bin"))).withColumn("begin", F.col("bin_begin") + F.col("inside")).drop("_source", "_bin", "bin_begin", "inside", "bin")


def mix_pieces(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix: uid, epoch, slot t, first word in the row, and words taken there, one row for each part of a block."""
    slots, block = schedule(plan)
    ends = plan.select(F.col("source").alias("_source"), "place", "source_size", "end")
    rows = laid_out(sizes).filter("size > 0").join(ends, F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.withColumn("epoch", F.explode(F.array(*map(F.lit, range(REPEAT)))))
    rows = rows.withColumn("at", F.col("begin") + F.col("epoch") * F.col("source_size"))
    rows = rows.filter("at < end").withColumn("to", F.least(F.col("at") + F.col("size"), F.col("end")))
    parts = rows.withColumn("rank", F.explode(F.expr(f"sequence(at div {block}, (to - 1) div {block})")))
    met = parts.join(slots, ["place", "rank"])
    first = F.greatest(F.col("at"), F.col("rank") * block)
    return met.select("uid", "epoch", "t", (first - F.col("at")).alias("first_word"), (F.least(F.col("to"), (F.col("rank") + 1) * block) - first).alias("words"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    sizes = sized(docs)
    plan = small(saved(targets(sizes)), FEW)
    taken = mix_pieces(sizes, plan).groupBy("uid").agg(F.sum("words").alias("taken"))
    known = plan.select(F.col("source").alias("_source"), "source_size", "target")
    out = sizes.join(known, F.col("source").eqNullSafe(F.col("_source"))).join(taken, "uid", "left")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, stored: bool = False) -> DataFrame:
    """Pipeline stage: a row for each time that a document is taken; where the source's stream ends within a
    document, its text is cut after the last word taken. stored: see numbered."""
    rows, uid = numbered(docs, stored)
    sizes = saved(rows.select(F.col(uid).alias("uid"), F.col("doc_id").alias("id"), "source", n_words(F.col("text")).alias("size"), shuffle_key(F.col("doc_id")).alias("key")))
    plan = small(saved(targets(sizes)), FEW)
    times = mix_pieces(sizes, plan).groupBy("uid", "epoch").agg(F.sum("words").alias("words"))
    words, size = free_name(rows, "__words"), free_name(rows, "__size")
    times = times.join(sizes.select("uid", "size"), "uid").select(F.col("uid").alias(uid), F.col("words").alias(words), F.col("size").alias(size))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), 1), F.lit(1), F.col(words).cast("int")), " ")
    return rows.join(times, uid).withColumn("text", F.when(F.col(words) < F.col(size), first).otherwise(F.col("text"))).select(*docs.columns)
