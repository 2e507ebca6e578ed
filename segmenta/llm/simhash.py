"""SimHash near-duplicates over sharded BK-trees.

near_duplicates: 4-word shingles, 64-bit fingerprints, links at RADIUS or fewer differing bits, all of them. Fingerprints
that differ in at most r of 64 bits agree in two of r + 2 blocks of bits, so each distinct fingerprint goes to one
shard for each pair of blocks.

one_of_each (a pipeline stage): 5-word shingles and a similarity of SIMILAR or more. Fingerprints of WIDE bits estimate
it; pairs link at the bits that a similarity of ESTIMATE is expected to differ in. No block need agree at such a
distance, so a fingerprint goes to shards named by samples of its bits: as many bits as the number of fingerprints has,
so that shards do not grow with the corpus, and as many samples as find a pair of similarity SIMILAR with
probability RECALL, at any size.

A shard holds a BK-tree: a node's children are keyed by their Hamming distance to it, and a search follows only
edges within the radius. Trees are built and searched for many shards at once, level by level, in numpy. Of a shard's
links a spanning forest is returned, never all pairs. A shard with over SHARD members is split into several trees. Its
members within the radius of one of a few pivots are linked to it at once; two of the same pivot need not meet, so
only the others, and those that a foreign pivot's members could reach, search all trees: a large group of near
copies costs one comparison a member. Components are then found in Spark by alternating large-star and small-star steps,
until nothing changes.

Trees go where their shard is, not by broadcast: together they hold all fingerprints, which has no bound.

Defined cases: a text without words (null included) has fingerprint zero and links like any other; rows with a null
id get the component of their group, null if no row of it has an id; repeated rows are separate rows; an empty
table gives an empty table; other columns pass through the stage, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import FEW, dealt_join, numbered, saved, small, small_batches

RADIUS = 4
SHINGLE = 4
#: The stage's shingle, least similarity, the similarity whose expected distance is its radius, and its fingerprints' words.
STAGE_SHINGLE, SIMILAR, ESTIMATE = 5, 0.8, 0.77
WIDE = 256
RECALL = 0.9
LEAST_BITS = 18
SHARD = 1024
PIVOTS = 8
#: Rows of sorted shards that a task takes up together, and node visits of one step.
GATHER = 1 << 17
VISITS = 1 << 20


def shingle_bits(text: bytes | None, n: int, digest, width: int) -> np.ndarray:
    """Bits that are set in over half the shingles' hashes of `width` bits; repeats count. All zero without words."""
    words = (text or b"").lower().split()  # of bytes: blank and 9 to 13 only
    if not words:
        return np.zeros(width // 8, np.uint8)
    joined = b" ".join(words)
    m = max(1, len(words) - n + 1)
    if m == 1:
        return np.frombuffer(digest(joined), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:m].tolist()
    ends = (ends - 1)[n - 1 :].tolist()
    ones = np.zeros(width, np.int64)
    for k in range(0, m, 1 << 14):
        h = b"".join([digest(joined[i:j]) for i, j in zip(starts[k : k + (1 << 14)], ends[k : k + (1 << 14)], strict=True)])
        ones += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, width // 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > m, bitorder="little")


def digest64(shingle: bytes) -> bytes:
    return xxhash.xxh64_intdigest(shingle, 42).to_bytes(8, "little")


def digest256(shingle: bytes) -> bytes:
    return xxhash.xxh3_128_digest(shingle, 1) + xxhash.xxh3_128_digest(shingle, 2)


def fingerprint(text: bytes | None, n: int = SHINGLE) -> int:
    return int.from_bytes(shingle_bits(text, n, digest64, 64).tobytes(), "little")


def _printer(n: int, digest, width: int):
    """Rows (id, uid, text) to (id, uid, fp), fp as 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = width // 64
        for b in batches:
            bits = [shingle_bits(t, n, digest, width) for t in b.column(2).to_pylist()]
            flat = pa.array(np.concatenate([np.zeros(0, np.uint8), *bits]).view(np.int64), pa.int64())
            fp = pa.ListArray.from_arrays(pa.array(np.arange(0, words * (len(bits) + 1), words), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp], ["id", "uid", "fp"])

    return run


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of words."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class Forest:
    """BK-trees, one for each group; the members of a group stand together and differ. fp: (members, words)."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.fp, self.most = fp, 64 * fp.shape[1]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        self.groups, self.roots = group[first], first
        self.sizes = np.diff(np.r_[first, len(group)])
        at = np.repeat(first, self.sizes)
        waiting = np.setdiff1d(np.arange(len(group)), first, assume_unique=True)
        keys, nodes = [], []
        while waiting.size:
            edge = at[waiting] * (self.most + 1) + hamming(fp[waiting], fp[at[waiting]])
            found, who, of = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(found)
            nodes.append(waiting[who])
            at[waiting] = waiting[who][of]
            waiting = np.delete(waiting, who)
        keys, nodes = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *nodes])
        order = np.argsort(keys)
        self.edges, self.children = keys[order], nodes[order]

    def search(self, group: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, member) within the radius, in portions."""
        if not len(self.roots):
            return
        k = np.minimum(np.searchsorted(self.groups, group), len(self.groups) - 1)
        all_q = np.flatnonzero(self.groups[k] == group)
        if not all_q.size:
            return
        k = k[all_q]
        portion = np.cumsum(self.sizes[k]) // VISITS
        cuts = np.flatnonzero(np.r_[True, portion[1:] != portion[:-1]])
        for i, j in zip(cuts, [*cuts[1:], len(all_q)], strict=True):
            q, node = all_q[i:j], self.roots[k[i:j]]
            while q.size:
                d = hamming(fp[q], self.fp[node])
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                low = np.searchsorted(self.edges, node * (self.most + 1) + np.maximum(d - radius, 0))
                n = np.searchsorted(self.edges, node * (self.most + 1) + np.minimum(d + radius, self.most), "right") - low
                q = np.repeat(q, n)
                node = self.children[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of a[i] and b[i]; label holds the least index of each set."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        x, y, a, b = x[differ], y[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _linker(radius: int):
    """Sorted rows (key, shard, node, fp, member, asks), members of a shard first, to forest edges (a, b) of nodes."""

    def link(key: np.ndarray, node: np.ndarray, fp: np.ndarray, member: np.ndarray, asks: np.ndarray, known: int) -> pa.RecordBatch | None:
        """The first `known` rows have searched before."""
        group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        own = np.flatnonzero(member)
        asking = np.flatnonzero(asks[known:]) + known
        forest = Forest(group[own], fp[own])
        label = np.arange(len(fp))
        for q, found in forest.search(group[asking], fp[asking], radius):
            _unite(label, asking[q], own[found])
        moved = np.flatnonzero(label != np.arange(len(fp)))
        if not moved.size:
            return None
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, known = [], 0, 0

        def joined() -> list[np.ndarray]:
            return [np.concatenate([h[i] for h in held]) for i in range(5)]

        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy() * 0x10000 + b.column(1).to_numpy()
            fp = b.column(3).flatten().to_numpy().view(np.uint64).reshape(b.num_rows, -1)
            held.append((key, b.column(2).to_numpy(), fp, b.column(4).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)))
            rows += b.num_rows
            if rows - known >= GATHER:
                all_ = joined()
                key, member = all_[0], all_[3]
                last = int(np.searchsorted(key, key[-1]))
                if last > 0:  # whole shards; the last may go on
                    if out := link(*[x[:last] for x in all_], known):
                        yield out
                    held, rows, known = [tuple(x[last:] for x in all_)], len(key) - last, 0
                elif not member[-1]:  # one large shard: its members are all here, more queries may come
                    if out := link(*all_, known):
                        yield out
                    own = np.flatnonzero(member)
                    held, rows, known = [tuple(x[own] for x in all_)], len(own), len(own)
        if held and (out := link(*joined(), known)):
            yield out

    return run


def links(keyed: DataFrame, radius: int = RADIUS, words: int = 1, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) of nodes that connect all fingerprints within the radius that share a key. keyed: node, fp (distinct,
    array of 64-bit words), keys."""
    spark = keyed.sparkSession
    rows = keyed.select("node", "fp", F.explode("keys").alias("key"))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard)
    counts = small(saved(counts), FEW)
    some = [F.min_by(F.struct("node", "fp"), F.xxhash64(F.lit(k), "node")).alias(f"p{k}") for k in range(PIVOTS)]
    large = rows.join(counts, "key").groupBy("key").agg(F.first("n").alias("n"), *some)
    large = saved(large.select("key", F.ceil(F.col("n") / shard).cast("int").alias("trees"), F.array(*[f"p{k}" for k in range(PIVOTS)]).alias("pivots")))
    rows = rows.join(small(large, FEW), "key", "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    apart = "+".join(f"bit_count(p.fp[{w}] ^ fp[{w}])" for w in range(words))
    rows = rows.withColumn("far", F.expr(f"transform(pivots, p -> {apart})"))
    rows = rows.withColumn("first", F.expr(f"array_position(transform(far, d -> d <= {radius}), true)"))
    # a foreign pivot that is not itself within the radius of the first, and whose members this row could reach
    between = "+".join(f"bit_count(p.fp[{w}] ^ get(pivots, CAST(first - 1 AS INT)).fp[{w}])" for w in range(words))
    reach = f"exists(arrays_zip(pivots, far), z -> z.far <= {2 * radius} AND ({between.replace('p.fp', 'z.pivots.fp')}) > {radius})"
    rows = rows.withColumn("asks", F.expr(f"pivots IS NULL OR first = 0 OR ({reach})"))
    rows = rows.withColumn("hub", F.expr("IF(first > 0, get(pivots, CAST(first - 1 AS INT)).node, NULL)")).drop("pivots", "far", "first")
    rows = rows.withColumn("own", F.when(F.col("trees") > 1, F.pmod(F.xxhash64("node"), "trees")).otherwise(0).cast("int"))
    here = F.when(F.col("asks"), F.expr("sequence(0, trees - 1)")).otherwise(F.array("own"))
    dealt = rows.select("key", F.explode(here).alias("shard"), "node", "fp", "own", "asks")
    dealt = dealt.withColumn("member", F.col("own") == F.col("shard")).drop("own")
    small_batches(spark, 20_000)
    dealt = dealt.repartition("key", "shard").sortWithinPartitions("key", "shard", F.col("member").desc())
    found = dealt.select("key", "shard", "node", "fp", "member", "asks").mapInArrow(_linker(radius), "a bigint, b bigint")
    return found.unionByName(rows.filter("hub IS NOT NULL AND hub <> node").select(F.col("node").alias("a"), F.col("hub").alias("b")))


def block_keys(radius: int) -> str:
    """SQL for the keys of a 64-bit fingerprint fp[0]: each pair of radius + 2 blocks of bits."""
    n = radius + 2
    cuts = [64 * k // n for k in range(n + 1)]
    block = lambda k: f"(shiftrightunsigned(fp[0], {cuts[k]}) & {(1 << (cuts[k + 1] - cuts[k])) - 1})"
    keys = [f"({i} * 2097152 * 16 + {block(x)} * {1 << (cuts[y + 1] - cuts[y])} + {block(y)})" for i, (x, y) in enumerate(combinations(range(n), 2))]
    return f"array({', '.join(f'CAST({k} AS BIGINT)' for k in keys)})"


def expected_bits(similarity: float, width: int = WIDE) -> float:
    """Bits in which fingerprints of texts with that share of common shingles are expected to differ."""
    return width * math.acos(2 * similarity / (1 + similarity)) / math.pi


def samples(n: int, width: int = WIDE, recall: float = RECALL) -> np.ndarray:
    """Bit positions (samples, bits) for n fingerprints."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(2, n))))
    meet = (1 - expected_bits(SIMILAR, width) / width) ** bits
    rng = np.random.default_rng(11)
    return np.array([rng.choice(width, bits, replace=False) for _ in range(math.ceil(math.log(1 - recall) / math.log(1 - meet)))])


def _sampler(at: np.ndarray):
    """Rows (node, fp) with their keys: the sample's number and its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.int64(1) << np.arange(at.shape[1])
        for b in batches:
            fp = b.column(1).flatten().to_numpy()
            bits = np.unpackbits(fp.view(np.uint8).reshape(b.num_rows, -1), axis=1, bitorder="little").astype(np.int64)
            keys = np.stack([bits[:, sample] @ weight + (np.int64(k) << at.shape[1]) for k, sample in enumerate(at)], 1)
            whole = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, len(at)), pa.int32()), pa.array(keys.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), whole], ["node", "fp", "keys"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node that an edge (a, b) names. A hub's pairs are the
    skewed side of an inner join, which adaptive execution splits; its least partner comes from partial minima."""

    def star(pairs: DataFrame) -> DataFrame:
        """pairs (u, v) to (v, least of u and its partners)."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u")

    def mark(pairs: DataFrame):
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    pairs = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = mark(pairs)
    while before[0]:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lesser = star(large).select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = saved(lesser.union(large.groupBy("u").agg(F.min("v").alias("v"))).filter("u <> v").distinct())
        after = mark(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select("v", "v").distinct())


def _grouped(prints: DataFrame, radius: int, words: int, keyed) -> DataFrame:
    """fp, component_id (least id of the component) and best (its row number) of every distinct fingerprint of rows
    (id, uid, fp). keyed: from (node, fp) to (node, fp, keys)."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first")
    distinct = saved(prints.groupBy("fp").agg(first, F.min("uid").alias("node")))
    known = components(links(keyed(distinct.select("node", "fp")), radius, words))
    labelled = distinct.join(known, "node", "left").select("fp", "first", F.coalesce("root", "node").alias("root"))
    labelled = saved(labelled)
    best = labelled.groupBy("root").agg(F.min("first").alias("best"))
    return labelled.join(best, "root").select("fp", F.col("best.id").alias("component_id"), F.col("best.uid").alias("best"))


def near_groups(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """id, fp, component_id and best (a row number) of every row (id, uid, text), by 4-word shingles and 64 bits."""
    small_batches(rows.sparkSession)
    prints = saved(rows.select("id", "uid", F.col("text").cast("binary").alias("text")).mapInArrow(_printer(SHINGLE, digest64, 64), "id bigint, uid bigint, fp array<bigint>"))
    of = _grouped(prints, radius, 1, lambda df: df.withColumn("keys", F.expr(block_keys(radius))))
    return _with_groups(prints, of)


def similar_groups(rows: DataFrame, estimate: float = ESTIMATE, n: int = STAGE_SHINGLE) -> DataFrame:
    """id, uid, fp, component_id and best of every row (id, uid, text), by similarity of 5-word shingles."""
    small_batches(rows.sparkSession)
    prints = saved(rows.select("id", "uid", F.col("text").cast("binary").alias("text")).mapInArrow(_printer(n, digest256, WIDE), "id bigint, uid bigint, fp array<bigint>"))
    at = samples(prints.count())

    def keyed(df: DataFrame) -> DataFrame:
        return df.mapInArrow(_sampler(at), "node bigint, fp array<bigint>, keys array<bigint>")

    of = _grouped(prints, int(expected_bits(estimate)), WIDE // 64, keyed)
    return _with_groups(prints, of)


def _with_groups(prints: DataFrame, of: DataFrame) -> DataFrame:
    """Rows with their fingerprint's group."""
    counts = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    return dealt_join(prints, of, "fp", "uid", counts).select("id", "uid", "fp", "component_id", "best")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.monotonically_increasing_id().alias("uid"), "text")
    hexed = F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0"))
    return near_groups(rows).select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, stored: bool = False) -> DataFrame:
    """Pipeline stage: of each group of similar documents the one with the least id stays. stored: see numbered."""
    rows, uid = numbered(docs, stored)
    keep = similar_groups(rows.select(F.col("doc_id").cast("bigint").alias("id"), F.col(uid).alias("uid"), "text")).filter("uid = best").select(F.col("uid").alias(uid))
    return rows.join(keep, uid, "left_semi").select(*docs.columns)
