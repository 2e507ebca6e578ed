"""Exact deduplication by two passes over Bloom filters.

Texts are hashed once; after that only digests move. In the first pass each partition notes which filter
bits its digests set once and which more often; the notes are merged slice by slice. In the second
pass a digest whose bits were all set at least twice is suspect: only suspects shuffle (a digest of many rows dealt to
many tasks), all others pass straight through as groups of one. A false alarm costs a shuffled row and never changes a result.

The filter has 16 bits a row up to max_bits, so what is broadcast never exceeds max_bits / 8 bytes. Beyond
max_bits / 16 rows the share of false alarms rises, until all digests shuffle as in a plain grouping.

Defined cases: a null text counts as empty; rows with a null id take part and lose to any other id;
of rows that tie in text and id one stays; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import dealt_join, saved, small_batches

MAX_BITS = 1 << 28
SLICE = 1 << 16
DIGEST_SCHEMA = "id bigint, uid bigint, sha binary"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shas = [hashlib.sha256((t or b"").lower()).digest() for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shas, pa.binary())], ["id", "uid", "sha"])


def _positions(column: pa.Array, bits: int) -> np.ndarray:
    """Two filter positions for each digest, shape (rows, 2)."""
    words = np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, 8)[:, :2]
    return (words & np.uint32(bits - 1)).astype(np.int64)


def _noter(bits: int):
    """First pass: for each slice the positions set once, and those set more often, as uint16 lists."""

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            pos, n = np.unique(np.concatenate(held).ravel(), return_counts=True)
            at = pos // SLICE
            slices, begin = np.unique(at, return_index=True)
            low = (pos % SLICE).astype(np.uint16)
            ends = [*begin[1:].tolist(), len(pos)]
            parts = list(zip(begin.tolist(), ends, strict=True))
            for k in range(0, len(parts), 1024):
                some = parts[k : k + 1024]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slices[k : k + 1024], pa.int64()),
                        pa.array([low[i:j].tobytes() for i, j in some], pa.binary()),
                        pa.array([low[i:j][n[i:j] > 1].tobytes() for i, j in some], pa.binary()),
                    ],
                    ["slice", "seen", "again"],
                )

        for b in batches:
            if not b.num_rows:
                continue
            p = _positions(b.column(0), bits)
            p[:, 1] = np.where(p[:, 1] == p[:, 0], (p[:, 1] + 1) & (bits - 1), p[:, 1])
            held.append(p)
            rows += len(p)
            if rows >= 1 << 19:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()

    return note


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Notes of one slice stand together; memory holds one slice."""
    now, seen, again = None, np.zeros(SLICE, bool), np.zeros(SLICE, bool)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(again).tobytes()], pa.binary())], ["slice", "again"])

    for b in batches:
        for s, one, two in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if s != now:
                if now is not None:
                    yield out()
                now = s
                seen[:], again[:] = False, False
            p = np.frombuffer(one, np.uint16)
            again[p[seen[p]]] = True
            seen[p] = True
            again[np.frombuffer(two, np.uint16)] = True
    if now is not None:
        yield out()


def _prober(bits: int, filter_):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = np.frombuffer(filter_.value, np.uint8)
        for b in batches:
            if b.num_rows:
                p = _positions(b.column(2), bits)
                p[:, 1] = np.where(p[:, 1] == p[:, 0], (p[:, 1] + 1) & (bits - 1), p[:, 1])
                hit = ((again[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(1)
            else:
                hit = np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit)], ["id", "uid", "sha", "suspect"])

    return probe


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 for every row; of equal texts the largest id stays."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("uid"), F.col(text_col).cast("binary").alias("text"))
    digests = saved(rows.mapInArrow(_digest, DIGEST_SCHEMA))
    small_batches(spark, 20_000)
    bits = min(max_bits, max(SLICE, 1 << (16 * max(1, digests.count()) - 1).bit_length()))
    notes = digests.select("sha").mapInArrow(_noter(bits), "slice bigint, seen binary, again binary")
    merged = notes.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merge, "slice bigint, again binary")
    flat = bytearray(bits // 8)
    for r in merged.toLocalIterator():  # at most max_bits / 8 bytes
        flat[r[0] * SLICE // 8 : (r[0] + 1) * SLICE // 8] = r[1]
    probed = digests.mapInArrow(_prober(bits, spark.sparkContext.broadcast(bytes(flat))), f"{DIGEST_SCHEMA}, suspect boolean")
    hexed = F.lower(F.hex("sha")).alias("text_sha256")
    alone = probed.filter(~F.col("suspect")).select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), hexed)
    suspects = probed.filter("suspect").drop("suspect")
    best = suspects.groupBy("sha").agg(F.max(F.struct("id", "uid")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    met = dealt_join(suspects, best, "sha", "uid", best.select("sha", F.col("group_size").alias("n")))
    grouped = met.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("best.uid") == F.col("uid")).alias("kept"), hexed)
    return alone.unionByName(grouped)
