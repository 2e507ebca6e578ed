"""Line deduplication across a corpus by a segment-partition edit join; DataFrame functions only.

A later copy of a line that has a word is removed, whatever its length. So is every line of LEAST_CHARS characters or more
within EDITS edits of a line that first occurs earlier (by id, row, place in the text); shorter lines take no part in
the edit join, as two edits change what they say.

Each distinct line is cut into EDITS + 1 even segments; of two lines within EDITS edits one segment of the
longer or equally long one occurs unchanged in the other, shifted by no more than the edits that fit before and
after it. So a line enters an index by its own segments under its length, and probes, for each length at
most EDITS shorter, the substrings at the shifts that the multi-match-aware rule leaves. Lines of a segment that many
share are cut anew into PARTS segments and meet by all but EDITS of them at once; of keys that are still crowded the
segments left out are halved, again and again, down to characters. Pairs that meet are
verified, between what they both begin and end with, by a banded bit-parallel edit distance: for each number of edits
one bit for each diagonal of the band, moved on together for each character. Pairs of which too few of PIECES pieces recur in place are not passed to it.

Defined cases: null and empty texts have one empty line and lose nothing; lines without a word stay; a text that loses
every line becomes empty and its row stays; repeated rows count as later copies of each other; rows with a null id
come first; an empty table gives an empty table; other columns pass through, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmenta.llm.common import FEW, WORD, dealt_join, free_name, numbered, saved, small

EDITS = 2
#: Index rows of a key from which its lines take longer keys; for keys of PARTS segments, which most false meetings come from, fewer.
CROWD, CROWD_LONG = 16, 8
#: Segments of a line for longer keys, and pieces of a line that are looked up before its distance is taken.
PARTS, PIECES = 5, 16
#: Largest step by which equal begins and ends of two lines are found.
COMMON = 1 << 12
LEAST_CHARS = 40


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def shifts(edits: int, shorter: int, segment: int) -> list[int]:
    """Where segment (from 0) of a line that is `shorter` characters shorter can begin in the longer line, relative
    to its own begin: errors before it are at most `segment`, errors after it at most edits - segment, one
    segment being spared by the pigeonhole rule."""
    before, after = segment, edits - segment
    low = max(-before, shorter - after)
    high = min(before, shorter + after)
    return list(range(low, high + 1))


def _bounds(length: str, edits: int) -> list[tuple[str, str]]:
    """Begin (from 0) and size of each segment of a line of that length."""
    n = edits + 1
    return [(f"({length} * {k} div {n})", f"({length} * {k + 1} div {n} - {length} * {k} div {n})") for k in range(n)]


def index_keys(edits: int) -> list[str]:
    """A key for each own segment: number, length and text."""
    return [f"xxhash64({k}, len, substring(line, {b} + 1, {n}))" for k, (b, n) in enumerate(_bounds("len", edits))]


def probe_keys(edits: int) -> list[str]:
    """A key for each substring that can equal a segment of a line up to `edits` shorter. The unshifted ones for lines
    equally long are the index keys themselves."""
    out = []
    for d in range(edits + 1):
        for k, (b, n) in enumerate(_bounds(f"(len - {d})", edits)):
            out += [f"xxhash64({k}, len - {d}, substring(line, {b} + 1 + ({s}), {n}))" for s in shifts(edits, d, k) if d or s]
    return out


def long_keys(edits: int, own: bool) -> list[list[int]]:
    """The longer keys: PARTS, by how much shorter the other line is, the `edits` segments of PARTS that may hold edits, and
    the shift after each of them. An edit changes one segment, and its shift by one at most."""
    out = []
    for cut in combinations(range(PARTS), edits):
        for steps in product(range(-edits, edits + 1), repeat=edits):
            shorter = sum(steps)
            if shorter >= 0 and sum(map(abs, steps)) <= edits and own == (not any(steps)):
                out.append([PARTS, shorter, *cut, *(sum(steps[: k + 1]) for k in range(edits))])
    return out


def _begin(segment: str) -> str:
    """Where a segment of the shorter line begins, of k[0] segments."""
    return f"(len - k[1]) * ({segment}) div k[0]"


def _open_segments(edits: int) -> list[tuple[str, str]]:
    """Begin (from 0) and end, in the line itself, of each segment that may hold edits under the key that column k gives."""
    shift = lambda e: f" + k[{2 + edits + e}]" if e >= 0 else ""
    return [(_begin(f"k[{2 + e}]") + shift(e - 1), _begin(f"k[{2 + e}] + 1") + shift(e)) for e in range(edits)]


def _long_key(edits: int) -> str:
    """The key that column k, laid out as by long_keys, gives a line: the texts between the segments that may hold edits."""
    at, texts = "0", []
    for begin, end in _open_segments(edits):
        texts.append(f"substring(line, cast({at} + 1 as int), cast({begin} - ({at}) as int))")
        at = end
    cut = ", ".join(f"k[{2 + e}]" for e in range(edits))
    return f"xxhash64(len - k[1], {cut}, {', '.join(texts)}, substring(line, cast({at} + 1 as int)))"


def _least_others(others: list[str], of: list[str]) -> str:
    """Whether the segments `others`, in order, are the least of all but `of`. Segments without edits are left out besides
    those with edits; so that each pair is sought under one choice of them, it is these."""
    least = f"array_except(sequence(0L, {len(others) + len(of) - 1}L), array({', '.join(of)}))"
    return f"array({', '.join(others)}) = slice({least}, 1, {len(others)})" if others else "true"


def _halved_keys(edits: int) -> str:
    """Those k, as an array, that halve the segments which may hold edits under k and leave `edits` halves out."""
    cut = [f"k[{2 + e}]" for e in range(edits)]
    step = [f"(k[{2 + edits + e}] - k[{1 + edits + e}])" if e else f"k[{2 + edits}]" for e in range(edits)]
    out = []
    for halves in product([(), (0,), (1,), (0, 1)], repeat=edits):
        if sum(map(len, halves)) != edits:
            continue
        unused = [e for e in range(edits) if not halves[e]]
        fits = [_least_others([cut[e] for e in unused], [cut[e] for e in range(edits) if halves[e]]), *(f"{step[e]} = 0" for e in unused)]
        for split in product(*(range(-edits, edits + 1) if len(x) == 2 else (None,) for x in halves)):
            steps = [t for e, x in enumerate(halves) if x for t in ([step[e]] if len(x) == 1 else [f"{split[e]}L", f"({step[e]} - {split[e]}L)"])]
            moved = " + ".join(f"abs({t})" for t in steps)
            own = [f"2 * {cut[e]} + {x}L" for e in range(edits) for x in halves[e]]
            shifted = [" + ".join(steps[: e + 1]) for e in range(edits)]
            out.append(f"IF({' AND '.join([*fits, f'{moved} <= {edits}'])}, array(2 * k[0], k[1], {', '.join([*own, *shifted])}), NULL)")
    return f"filter(array({', '.join(out)}), x -> x IS NOT NULL)"


def _pieces_recur(a: str, b: str, edits: int) -> Column:
    """Whether all but `edits` of PIECES pieces of a are in b, shifted by at most `edits`; an edit changes one piece."""
    found = []
    for k in range(PIECES):
        at = f"cast(length({a}) * {k} div {PIECES} as int)"
        n = f"cast(length({a}) * {k + 1} div {PIECES} - length({a}) * {k} div {PIECES} as int)"
        found.append(f"IF(contains(substring({b}, greatest({at} + 1 - {edits}, 1), {n} + {2 * edits}), substring({a}, {at} + 1, {n})), 1, 0)")
    return F.expr(f"{' + '.join(found)} >= {PIECES - edits}")


def within_edits(a: str, b: str, edits: int) -> Column:
    """Whether columns a and b, not empty, are within that many edits. What both begin and end with is left out first, as it
    changes no distance. r<e> has bit edits + d if the characters of a so far can be turned into d more of b by e edits: equal
    characters keep a bit where it is, a changed one too, a dropped one moves it down, an added one up."""
    band = (1 << (2 * edits + 1)) - 1
    begin = {0: 1 << edits}
    for e in range(1, edits + 1):
        begin[e] = begin[e - 1] | (begin[e - 1] << 1) & band
    state = lambda bits: "named_struct(" + ", ".join(f"'r{e}', {x}" for e, x in enumerate(bits)) + ")"
    met = " + ".join(f"IF(get(z.cb, i + {d}) <=> get(z.ca, i), {1 << (edits + d)}L, 0L)" for d in range(-edits, edits + 1))
    moved = ["s.r0 & m"]
    for e in range(1, edits + 1):
        moved.append(f"((s.r{e} & m) | s.r{e - 1} | shiftright(s.r{e - 1}, 1) | shiftleft({moved[-1]}, 1)) & {band}L")
        moved[-1] = f"({moved[-1]})"
    step = f"aggregate(array({met}), {state('0L' for _ in moved)}, (x, m) -> {state(moved)})"  # names the mask m
    places = "IF(z.n > 0, sequence(0, z.n - 1), CAST(array() AS array<int>))"
    chars = f"aggregate({places}, {state(f'{x}L' for x in begin.values())}, (s, i) -> {step})"
    last = f"shiftright({chars}.r{edits}, length({b}) - length({a}) + {edits}) & 1 = 1"
    # lengths of what both begin and end with, from halved steps: at most 2 * COMMON - 1, as a longer one need not be left out
    steps = f"array({', '.join(str(COMMON >> k) for k in range(COMMON.bit_length()))})"
    least = f"least(length({a}), length({b}))"
    head = f"aggregate({steps}, 0, (n, t) -> IF(n + t <= {least} AND substring({a}, n + 1, t) = substring({b}, n + 1, t), n + t, n))"
    tail = f"aggregate({steps}, 0, (n, t) -> IF(n + t <= {least} - h AND substring({a}, length({a}) - n - t + 1, t) = substring({b}, length({b}) - n - t + 1, t), n + t, n))"
    rest = lambda x: f"substring({x}, h + 1, length({x}) - h - l)"
    both = f"array(named_struct('n', length({a}) - h - l, 'ca', split({rest(a)}, ''), 'cb', split({rest(b)}, '')))"  # cut once for all steps
    found = f"aggregate({both}, false, (x, z) -> {last})"
    for name, value in (("l", tail), ("h", head)):
        found = f"aggregate(array({value}), false, (x, {name}) -> {found})"
    return F.expr(f"abs(length({a}) - length({b})) <= {edits}") & _pieces_recur(a, b, edits) & F.expr(found)


def _lines(docs: DataFrame, id_col: str, text_col: str, uid: str | None = None) -> DataFrame:
    row = F.col(uid) if uid else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).alias("id"), row.alias("uid"), F.col(text_col).alias("text"))
    return rows.select("id", "uid", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))


def line_id(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uid: str | None = None) -> DataFrame:
    """lid (md5 of the line) and at (id, row, place) of each line with a word; no texts."""
    found = _lines(docs, id_col, text_col, uid).filter(F.col("line").rlike(WORD))
    return found.select(line_id(F.col("line")).alias("lid"), F.struct("id", "uid", "pos").alias("at"))


def distinct_lines(docs: DataFrame, text_col: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """h (a 64-bit hash, which different lines may share) and line, for each line long enough."""
    lines = docs.select(F.explode(lines_of(F.col(text_col))).alias("line")).filter((F.length("line") >= least) & F.col("line").rlike(WORD))
    return lines.select(F.xxhash64("line").alias("h"), "line").groupBy("h").agg(F.collect_set("line").alias("lines")).select("h", F.explode("lines").alias("line"))


def _shared_keys(rows: DataFrame, *more: Column) -> DataFrame:
    """Rows (key, own, h and others) of those keys that an index row and another line have, with n, the index rows of the key,
    and more over the key. One exchange and one sort by the key serve all that is asked of it."""
    of = Window.partitionBy("key")
    told = rows.select("*", F.count_if("own").over(of).alias("n"), (F.min("h").over(of) != F.max("h").over(of)).alias("others"), *more)
    return told.filter("n > 0 AND others").drop("others")


def _meetings(seen: DataFrame, few: str, pair: str, alone: str) -> DataFrame:
    """Of keys for which `few` holds, h_a and h_b of each two lines that meet and the fields `pair`; of rows of other keys h, twice,
    and the fields `alone`. The key's exchange and order serve again."""
    xs = F.collect_list(F.expr(f"IF(own AND {few}, h, NULL)")).over(Window.partitionBy("key"))
    once = "filter(xs, x -> IF(own, x < h, x <> h))"
    met = f"transform({once}, x -> named_struct('h_a', least(x, h), 'h_b', greatest(x, h), {pair}))"
    rows = F.expr(f"IF({few}, {met}, array(named_struct('h_a', h, 'h_b', h, {alone})))")
    return seen.withColumn("xs", xs).select(F.explode(rows).alias("m")).select("m.*")


def _asking(rows: DataFrame, edits: int) -> DataFrame:
    """Rows (h, line, len, k) with key, own (whether it is an index row), last (whether its segments are single characters) and
    hashes of the segments that may hold edits; without those k that no alignment of the line has."""
    ends = _open_segments(edits)
    texts = [F.expr(f"xxhash64(substring(line, cast({a} + 1 as int), cast({b} - ({a}) as int)))").alias(f"open{e}") for e, (a, b) in enumerate(ends)]
    own = F.expr(" AND ".join(f"k[{2 + edits + e}] = 0" for e in range(edits))).alias("own")
    can = F.expr(" AND ".join(f"{b} >= {a}" for a, b in ends))
    return rows.filter(can).select("h", "k", F.expr(_long_key(edits)).alias("key"), own, F.expr("len - k[1] <= k[0]").alias("last"), *texts)


def _crowd_pairs(lines: DataFrame, edits: int, crowd: int, later: int) -> DataFrame:
    """h_a and h_b of lines (h, line) that meet in longer keys.

    Keys are crowded from `crowd` index rows in the first round, which takes keys of PARTS segments, from `later` after it. Each
    round halves the segments that may hold edits under crowded keys. It ends where no key is crowded or all such
    segments are single characters: equally long lines that share such a key are within the edits. A crowded key all of
    whose lines agree in a segment left out is followed only if that is the least choice of it."""
    of = ", ".join(f"array({', '.join(f'{x}L' for x in k)})" for own in (True, False) for k in long_keys(edits, own))
    with_len = lines.withColumn("len", F.length("line").cast("bigint"))
    rows = _asking(with_len.withColumn("k", F.explode(F.expr(f"array({of})"))), edits)
    over = Window.partitionBy("key")
    differ = [(F.min(f"open{e}").over(over) != F.max(f"open{e}").over(over)).alias(f"differ{e}") for e in range(edits)]
    sure = []
    for which in product([True, False], repeat=edits):
        cut = {yes: [f"k[{2 + e}]" for e in range(edits) if which[e] == yes] for yes in (True, False)}
        sure.append(" AND ".join([f"differ{e} = {str(which[e]).lower()}" for e in range(edits)] + [_least_others(cut[False], cut[True])]))
    met = []
    while True:
        known = _shared_keys(rows, *differ).withColumn("crowded", F.expr(f"n > {crowd}")).filter(f"NOT crowded OR ({' OR '.join(f'({x})' for x in sure)})")
        level = saved(_meetings(known, "(last OR NOT crowded)", "'k', CAST(NULL AS ARRAY<BIGINT>)", "'k', k"))
        met.append(level.filter("k IS NULL").select("h_a", "h_b"))
        more = small(level.filter("k IS NOT NULL").select(F.col("h_a").alias("h"), "k"), FEW)
        if more.isEmpty():
            return reduce(DataFrame.union, met).distinct()
        rows = _asking(more.join(with_len, "h").withColumn("k", F.explode(F.expr(_halved_keys(edits)))), edits)
        crowd = later


def near_pairs(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b), a < b, of lids of different lines within that many edits.

    Of keys with up to `crowd` index rows (longer keys: CROWD_LONG, if that is less, in the first round) each meeting makes a
    pair of hashes, whose texts are fetched. The lines of a crowded key are stored with the verified pairs of the others and
    meet again by longer keys, those of crowded longer keys by keys that are longer still."""
    distinct = distinct_lines(docs, least=least)
    own, foreign = index_keys(edits), probe_keys(edits)
    keyed = distinct.withColumn("len", F.length("line")).select("h", F.posexplode(F.array(*map(F.expr, own + foreign))).alias("at", "key"))
    seen = _shared_keys(keyed.select("key", "h", (F.col("at") < len(own)).alias("own")))
    pairs = _meetings(seen, f"n <= {crowd}", "'alone', false", "'alone', true").repartition("h_a").distinct()
    # lines that share a hash are told apart by no key and so are met here
    shared = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("h").alias("h_a"), F.col("h").alias("h_b"), F.lit(False).alias("alone"))
    ends = [line_id(F.col(f"line_{k}")).alias(k) for k in "ab"]

    def texts(pairs: DataFrame, of: DataFrame) -> DataFrame:
        side = lambda k: of.select(F.col("h").alias(f"h_{k}"), F.col("line").alias(f"line_{k}"))
        return pairs.join(side("a"), "h_a").join(side("b"), "h_b")

    near = within_edits("line_a", "line_b", edits)
    both = texts(pairs.union(shared), distinct).filter("alone = (line_a = line_b)").filter(F.col("alone") | near)
    found = saved(both.select(*ends, F.col("h_a").alias("h"), F.when(F.col("alone"), F.col("line_a")).alias("line")))
    near_ones, rest = found.filter("line IS NULL").select("a", "b"), found.filter("line IS NOT NULL").select("h", "line")
    if not rest.isEmpty():
        met = _crowd_pairs(rest, edits, min(crowd, CROWD_LONG), crowd)
        near_ones = near_ones.union(texts(met, rest).filter("line_a <> line_b").filter(near).select(*ends))
    return near_ones.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def removals(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, id_col: str = "doc_id", uid: str | None = None) -> DataFrame:
    """uid (row number), copy_lines, near_lines and removed (places in order) of each row that loses lines."""
    pairs = saved(near_pairs(docs, edits, least))
    ends = pairs.union(pairs.select("b", "a")).toDF("lid", "other")
    found = occurrences(docs, id_col, uid=uid)
    counts = found.groupBy("lid").agg(F.count(F.lit(1)).alias("copies"))
    asked = small(saved(ends.select("lid", F.lit(True).alias("asked")).distinct()), FEW)
    told = saved(counts.join(asked, "lid", "left").filter("copies > 1 or asked"))  # lines that repeat or have near ones
    found = saved(dealt_join(found, told, "lid", "at", told.select("lid", F.col("copies").alias("n"))))
    classes = found.groupBy("lid").agg(F.min("at").alias("first"), F.first("copies").alias("copies"), F.first("asked").alias("asked"))
    firsts = classes.filter("asked").select("lid", "first")
    each = ends.join(firsts, "lid").join(firsts.select(F.col("lid").alias("other"), F.col("first").alias("before")), "other")
    near = saved(each.filter("before < first").select("lid", F.lit(True).alias("near")).distinct())
    lost = classes.join(small(near, FEW), "lid", "left").filter("copies > 1 or near").select("lid", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = dealt_join(found.select("lid", "at"), lost, "lid", "at", told.select("lid", F.col("copies").alias("n"))).filter("near or at <> first")
    return gone.groupBy(F.col("at.uid").alias("uid")).agg(
        F.sum(F.when(F.col("near"), 0).otherwise(1)).alias("copy_lines"),
        F.sum(F.when(F.col("near"), 1).otherwise(0)).alias("near_lines"),
        F.sort_array(F.collect_list("at.pos")).alias("removed"),
    )


def line_report(docs: DataFrame, stored: bool = False) -> DataFrame:
    """doc_id, n_lines, copy_lines, near_lines and removed (places, comma-joined) of every document. stored: see numbered."""
    rows, uid = numbered(docs.select("doc_id", "text"), stored)
    lost = removals(rows, uid=uid).withColumnRenamed("uid", uid)
    found = rows.select("doc_id", uid, F.size(lines_of(F.col("text"))).alias("n_lines")).join(lost, uid, "left")
    zero = F.lit(0).cast("bigint")
    return found.select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.coalesce("copy_lines", zero).alias("copy_lines"), F.coalesce("near_lines", zero).alias("near_lines"), F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed"))


def without_repeated_lines(docs: DataFrame, stored: bool = False) -> DataFrame:
    """Pipeline stage: every document, its text without the removed lines. stored: see numbered."""
    rows, uid = numbered(docs, stored)
    gone = free_name(rows, "__removed")
    lost = removals(rows, uid=uid).select(F.col("uid").alias(uid), F.map_from_arrays("removed", F.transform("removed", lambda _: F.lit(True))).alias(gone))
    kept = F.array_join(F.filter(lines_of(F.col("text")), lambda line, i: ~F.map_contains_key(gone, i)), "\n")
    return rows.join(lost, uid, "left").withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
