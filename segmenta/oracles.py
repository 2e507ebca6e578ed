"""SQL of the same results for DuckDB, written apart from the plans: durations by self-joins, sequences by existence."""

from __future__ import annotations

from segmenta.functions.predicates import OFFSETS, POLYGONS

_SCENE = """
latest AS (
  SELECT CAST(user_id // 5 AS INTEGER) AS vid, CAST(user_id % 5 AS INTEGER) AS oid,
         CAST((CAST(floor(epoch(ts)) AS BIGINT) - 1704067200) // 43200 AS INTEGER) AS fid, max(event_id) AS e, max(user_id) AS u
  FROM events GROUP BY 1, 2, 3),
scene AS (
  SELECT oid, vid, fid, ['cube', 'sphere', 'cylinder'][u % 3 + 1] AS shape,
         ['gray', 'red', 'blue', 'green', 'brown', 'cyan', 'purple', 'yellow'][u % 8 + 1] AS color, ['metal', 'rubber'][u % 2 + 1] AS material,
         CAST(e * 7919 % 460 AS DOUBLE) AS x1, CAST(e * 104729 % 300 AS DOUBLE) AS y1,
         CAST(e * 7919 % 460 + 10 + e % 40 AS DOUBLE) AS x2, CAST(e * 104729 % 300 + 10 + e % 30 AS DOUBLE) AS y2
  FROM latest)"""
_TRAFFIC = (
    _SCENE
    + """,
boxes AS (
  SELECT oid, vid, fid, CAST(e * 7919 % 920 AS DOUBLE) AS x1, CAST(e * 104729 % 500 AS DOUBLE) AS y1,
         CAST(e * 7919 % 920 + 10 + e % 40 AS DOUBLE) AS x2, CAST(e * 104729 % 500 + 10 + e % 30 AS DOUBLE) AS y2
  FROM latest),
speeds AS (
  SELECT a.*, (b.x1 + b.x2) / 2 - (a.x1 + a.x2) / 2 AS vx, (b.y1 + b.y2) / 2 - (a.y1 + a.y2) / 2 AS vy
  FROM boxes a LEFT JOIN boxes b ON a.vid = b.vid AND a.oid = b.oid AND b.fid = a.fid + 1),
traffic AS (
  SELECT a.*, b.vx - a.vx AS ax, b.vy - a.vy AS ay
  FROM speeds a LEFT JOIN speeds b ON a.vid = b.vid AND a.oid = b.oid AND b.fid = a.fid + 1)"""
)


def _cx(o: str) -> str:
    return f"(({o}.x1 + {o}.x2) / 2)"


def _cy(o: str) -> str:
    return f"(({o}.y1 + {o}.y2) / 2)"


def _distance(a: str, b: str) -> str:
    return f"sqrt(pow({_cx(a)} - {_cx(b)}, 2) + pow({_cy(a)} - {_cy(b)}, 2))"


def _ratio(a: str, b: str) -> str:
    return f"CAST({_distance(a, b)} / (({a}.x2 - {a}.x1 + {b}.x2 - {b}.x1) / 2) AS FLOAT)"


def near(a: str, b: str, t: float) -> str:
    return f"{_ratio(a, b)} < CAST({t} AS FLOAT)"


def far(a: str, b: str, t: float) -> str:
    return f"{_ratio(a, b)} > CAST({t} AS FLOAT)"


def left(a: str, b: str) -> str:
    return f"{_cx(a)} < {_cx(b)}"


def right(a: str, b: str) -> str:
    return left(b, a)


def behind(a: str, b: str) -> str:
    return f"{_cy(a)} < {_cy(b)}"


_LEFT = "{cx} >= 0 AND {cx} < 240"
_RIGHT = "{cx} >= 240 AND {cx} <= 480"
_TOP = "{cy} >= 0 AND {cy} < 160"
_BOTTOM = "{cy} >= 160 AND {cy} <= 320"


def quadrant(what: str, o: str) -> str:
    return what.format(cx=_cx(o), cy=_cy(o))


def _frames(name: str, objects: str, test: str, duration: int, bound: bool) -> str:
    """Common tables name_f (frames that pass) and name (starts and ends of runs of that length)."""
    ids = ", ".join(f"{o}.oid AS {o}" for o in objects)
    joins = f"scene {objects[0]}" + "".join(f" JOIN scene {o} ON {o}.vid = {objects[0]}.vid AND {o}.fid = {objects[0]}.fid" for o in objects[1:])
    which = [f"{o}.oid = {'abc'.index(o)}" for o in objects] if bound else [f"{p}.oid <> {q}.oid" for p in objects for q in objects if p < q]
    same = " AND ".join(f"g.{o} = f.{o}" for o in objects)
    keys = ", ".join(f"f.{o}" for o in objects)
    return f"""
{name}_f AS (SELECT {objects[0]}.vid, {objects[0]}.fid, {ids} FROM {joins} WHERE {' AND '.join([test, *which])}),
{name} AS (
  SELECT f.vid, {keys}, f.fid, f.fid + {duration - 1} AS until
  FROM {name}_f f JOIN {name}_f g ON g.vid = f.vid AND {same} AND g.fid BETWEEN f.fid AND f.fid + {duration - 1}
  GROUP BY f.vid, {keys}, f.fid HAVING count(*) = {duration})"""


def event(*steps: tuple[str, str, int], bound: bool = False, select: str | None = None, relation: str = _SCENE) -> str:
    """Segments where runs of the steps follow one another; equal letters are equal objects, others differ."""
    ctes = [relation, *[_frames(f"s{k}", o, t, d, bound) for k, (o, t, d) in enumerate(steps)]]
    where, seen = [], {}
    for k, (objects, _, _) in enumerate(steps):
        if k:
            where += [f"s{k}.vid = s0.vid", f"s{k}.fid > s{k - 1}.until"]
        for o in objects:
            if o in seen:
                where.append(f"s{k}.{o} = s{seen[o]}.{o}")
            elif not bound:
                where += [f"s{k}.{o} <> s{j}.{p}" for p, j in seen.items() if j < k]
        for o in objects:
            seen.setdefault(o, k)
    tables = ", ".join(f"s{k}" for k in range(len(steps)))
    return f"WITH {','.join(ctes)}\n{select or 'SELECT DISTINCT s0.vid'} FROM {tables}" + (f" WHERE {' AND '.join(where)}" if where else "")


_THEN = (("ab", far("a", "b", 3.0), 3), ("ab", near("a", "b", 1.0), 1))
_POOL = [
    [("ab", near("a", "b", 2.0), 1)],
    [("ab", far("a", "b", 3.0), 1)],
    [("ab", f"{far('a', 'b', 2.0)} AND {quadrant(_LEFT, 'a')}", 1)],
    [("ab", far("a", "b", 1.0), 3)],
    [("ab", far("a", "b", 3.0), 1), ("ab", near("a", "b", 2.0), 1)],
    [("ab", left("a", "b"), 1), ("ab", behind("a", "b"), 2)],
    [("ab", near("a", "b", 2.0), 1), ("ab", f"{right('a', 'b')} AND {quadrant(_TOP, 'a')}", 1), ("ab", far("a", "b", 2.0), 1)],
]
_POOL_SQL = " UNION ALL ".join(f"SELECT {k} AS qid, vid FROM ({event(*p, bound=True)})" for k, p in enumerate(_POOL))
_LABELS = "SELECT DISTINCT vid, CAST(vid % 3 < 2 AS INTEGER) AS label FROM scene"
_F1 = f"""q AS ({_POOL_SQL}), l AS ({_LABELS}), n AS (SELECT sum(label) AS pos FROM l),
f AS (SELECT qid, sum(label) AS tp, count(*) AS n FROM q JOIN l USING (vid) GROUP BY qid),
s AS (SELECT CAST(e.qid AS INTEGER) AS qid, coalesce(2.0 * tp / (f.n + pos), 0) AS f1 FROM (SELECT unnest(range({{queries}})) AS qid) e LEFT JOIN f USING (qid), n)"""


def _counts(source: str, tests: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS predicate, count(*) FILTER (WHERE {t}) AS hits FROM {source}" for n, t in tests.items())


_PAIRS = "{0} a JOIN {0} b ON a.vid = b.vid AND a.fid = b.fid AND a.oid <> b.oid"
_VALUES = {"color": "gray red blue green brown cyan purple yellow", "shape": "cube sphere cylinder", "material": "metal rubber"}
_OBJECT_TESTS = {f"{n}Quadrant": quadrant(t, "o") for n, t in (("Left", _LEFT), ("Right", _RIGHT), ("Top", _TOP), ("Bottom", _BOTTOM))}
_OBJECT_TESTS |= {v.capitalize(): f"{c} = '{v}'" for c, vs in _VALUES.items() for v in vs.split()}
_OBJECT_TESTS |= {"Color_red": "color = 'red'", "Shape_cube": "shape = 'cube'", "Material_metal": "material = 'metal'"}
_PAIR_TESTS = {"LeftOf": left("a", "b"), "RightOf": right("a", "b"), "Behind": behind("a", "b"), "FrontOf": behind("b", "a")}
_PAIR_TESTS |= {"Near1": near("a", "b", 1.0), "Near3": near("a", "b", 3.0), "Far1": far("a", "b", 1.0), "Far3": far("a", "b", 3.0)}
_SPEED = "({0}.vx * {0}.vx + {0}.vy * {0}.vy)"
_MOTION = {"Stopped": f"CAST(sqrt({_SPEED.format('a')}) AS FLOAT) <= 200", "HighAccel": "CAST(sqrt(a.ax * a.ax + a.ay * a.ay) AS FLOAT) >= 400", "DistanceSmall": f"CAST({_distance('a', 'b')} AS FLOAT) <= 100"}


def faster(t: float, matrix: bool) -> str:
    top, below = _SPEED.format("a"), _SPEED.format("b")
    if matrix:
        return f"CAST(CAST({top} AS FLOAT) / CAST(CAST({below} AS FLOAT) + CAST(1e-6 AS FLOAT) AS FLOAT) AS FLOAT) >= {t}"
    return f"CASE WHEN {below} = 0 THEN {top} > 0 ELSE CAST({top} / {below} AS FLOAT) >= {t} END"


_MOTION |= {"Faster": faster(1.5, False), "Faster_matrix": faster(1.5, True)}
_SLOW_MOTION = {f"Faster{t}_{d}": faster(t, d == "matrix") for t in (1, 4) for d in ("sql", "matrix")}
_GRID_TESTS = {f"{n}{t}{d}": f"{_ratio('a', 'b')} {op if d == 'sql' else op + '='} {t}" for n, op in (("Near", "<"), ("Far", ">")) for t in (1, 2) for d in ("sql", "matrix")}
_GRID_TESTS |= {"TopQuadrant_sql": quadrant(_TOP, "a"), "TopQuadrant_matrix": quadrant(_TOP, "a").replace("< 160", "<= 160")}


def lane(name: str, matrix: bool) -> str:
    """Even-odd rule, an edge at a time; points on an edge are in or out as the rule has it, or out in the matrix dialect."""
    points, above = POLYGONS[name], OFFSETS[name]
    x, y = "CAST((o.x1 + o.x2) / 2 AS FLOAT)", "CAST((o.y1 + o.y2) / 2 AS FLOAT)" if above is None else f"CAST(o.y2 - {above} AS FLOAT)"
    crossed, touched = [], []
    for (xi, yi), (xj, yj) in zip(points, points[-1:] + points[:-1], strict=True):
        crossed.append(f"CASE WHEN ({yi} > {y}) <> ({yj} > {y}) AND {x} < CAST(CAST({xj - xi} * ({y} - {yi}) AS FLOAT) / {yj - yi} AS FLOAT) + {xi} THEN 1 ELSE 0 END")
        touched.append(f"(CAST({x} AS DOUBLE) - {xi}) * {yj - yi} = (CAST({y} AS DOUBLE) - {yi}) * {xj - xi} AND {x} BETWEEN {min(xi, xj)} AND {max(xi, xj)} AND {y} BETWEEN {min(yi, yj)} AND {max(yi, yj)}")
    known = "" if name.startswith(("Eastward", "Westward")) else " AND o.vx IS NOT NULL AND o.vy IS NOT NULL AND o.ax IS NOT NULL AND o.ay IS NOT NULL"
    return f"({' + '.join(crossed)}) % 2 = 1{known}" + (f" AND NOT ({' OR '.join(touched)})" if matrix else "")


_LANE_TESTS = {f"{n}{'_matrix' if m else ''}": lane(n, m) for n in POLYGONS for m in (False, True)}
_DRAWN = "CAST('0x' || substr(md5('42:' || CAST(vid AS VARCHAR)), 1, 12) AS BIGINT)"


def _unit(name: str, test: str) -> str:
    return f"{name} AS (SELECT DISTINCT a.vid, a.fid AS i, a.fid + 1 AS j FROM {_PAIRS.format('scene')} WHERE a.oid = 0 AND b.oid = 1 AND {test})"


_TURNS = f"{_unit('l', left('a', 'b'))}, {_unit('r', right('a', 'b'))}, turn AS (SELECT DISTINCT l.vid, l.i, r.j FROM l JOIN r ON l.vid = r.vid AND l.j = r.i)"
_TRACKS = "t AS (SELECT vid, oid, min(fid) AS fs, max(fid) AS fe FROM scene GROUP BY vid, oid)"
_TRACK_PAIRS = f"""{_TRACKS}, p AS (SELECT DISTINCT a.vid, a.oid AS oid1, b.oid AS oid2, b.fs, least(a.fe, b.fe) AS fe
  FROM t a JOIN t b ON a.vid = b.vid AND a.oid <> b.oid AND a.fs <= b.fs AND a.fe >= b.fs)"""

ORACLES = {
    "event_near": event(("ab", near("a", "b", 1.0), 1)),
    "event_attributes": event(("ab", f"a.color = 'red' AND a.shape = 'cube' AND b.material = 'metal' AND {near('a', 'b', 3.0)}", 1)),
    "event_duration": event(("ab", f"{far('a', 'b', 1.0)} AND {left('a', 'b')}", 3)),
    "event_then": event(*_THEN),
    "event_islands": event(*_THEN),
    "event_unpruned": event(*_THEN),
    "event_cached": event(*_THEN),
    "event_completions": event(*_THEN, select="SELECT s0.vid, s0.a AS o0_oid, s0.b AS o1_oid, min(s1.until) AS done") + " GROUP BY ALL",
    "event_new_variable": event(("ab", left("a", "b"), 2), ("bc", f"{behind('b', 'c')} AND {quadrant(_TOP, 'c')}", 1)),
    "event_three_steps": event(("ab", far("a", "b", 3.0), 1), ("ab", near("a", "b", 2.0), 1), ("ab", far("a", "b", 3.0), 1), bound=True),
    "event_bound": event(("ab", f"{far('a', 'b', 2.0)} AND {quadrant(_LEFT, 'a')}", 1), ("ab", f"{quadrant(_BOTTOM, 'a')} AND {behind('b', 'a')}", 1), bound=True),
    "event_cache_misses": f"WITH {_SCENE} SELECT DISTINCT vid FROM scene WHERE vid NOT IN ({event(*_POOL[4], bound=True)})",
    "event_sampled": event(
        ("ab", far("a", "b", 1.0), 1), ("ab", near("a", "b", 3.0), 1),
        relation=_SCENE.replace("\nscene AS", "\nevery AS") + ",\nscene AS (SELECT * REPLACE (CAST(fid // 4 AS INTEGER) AS fid) FROM every WHERE fid % 4 = 0)",
    ),
    "event_restricted": f"WITH {_SCENE} SELECT vid FROM ({event(('ab', near('a', 'b', 3.0), 1))}) WHERE vid IN (SELECT vid FROM scene WHERE color = 'yellow')",
    "event_count": f"SELECT count(DISTINCT vid) AS segments FROM ({event(*_THEN)})",
    "event_earliest": f"WITH d AS ({event(*_THEN, select='SELECT s0.vid, s0.a AS o0_oid, s0.b AS o1_oid, min(s1.until) AS done')} GROUP BY ALL) SELECT * FROM d WHERE done <= (SELECT max(done) FROM (SELECT done FROM d ORDER BY done LIMIT 10))",
    "scene": f"WITH {_SCENE} SELECT * FROM scene",
    "traffic": f"WITH {_TRAFFIC} SELECT * FROM traffic",
    "predicates_of_objects": f"WITH {_SCENE} {_counts('scene o', _OBJECT_TESTS)}",
    "predicates_of_pairs": f"WITH {_SCENE} {_counts(_PAIRS.format('scene'), _PAIR_TESTS)}",
    "predicates_of_pairs_matrix": f"""WITH {_SCENE}, cornered AS (SELECT vid, fid, oid, floor(x1 / 40) * 40 AS x1, floor(y1 / 40) * 40 + 20 AS y1 FROM scene),
grid AS (SELECT *, x1 + 40 AS x2, y1 + 40 AS y2 FROM cornered) {_counts(_PAIRS.format('grid'), _GRID_TESTS)}""",
    "predicates_of_lanes": f"WITH {_TRAFFIC}, grid AS (SELECT * REPLACE (floor(x1 / 10) * 10 AS x1, floor(y1 / 10) * 10 AS y1, floor(x2 / 10) * 10 AS x2, floor(y2 / 10) * 10 AS y2) FROM traffic) {_counts('grid o', _LANE_TESTS)}",
    "predicates_of_slow_motion": f"WITH {_TRAFFIC}, slow AS (SELECT * REPLACE ((fid % 3) * oid % 3 / 1024.0::DOUBLE AS vx, 0.0::DOUBLE AS vy) FROM traffic) {_counts(_PAIRS.format('slow'), _SLOW_MOTION)}",
    "predicates_of_motion": f"WITH {_TRAFFIC} {_counts(_PAIRS.format('traffic'), _MOTION)}",
    "box_overlap": f"""WITH {_SCENE}, o AS (
  SELECT a.vid, a.fid, a.oid AS a_oid, b.oid AS b_oid, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS w, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS h,
         (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS areas FROM {_PAIRS.format('scene')})
SELECT vid, fid, a_oid, b_oid, round(CAST(CAST(w * h / (areas - w * h) AS FLOAT) AS DOUBLE), 5) AS iou FROM o
WHERE w > 0 AND h > 0 AND round(CAST(CAST(w * h / (areas - w * h) AS FLOAT) AS DOUBLE), 5) > 0""",
    "pool": _POOL_SQL,
    "predicate_relations": f"WITH {_SCENE} " + " UNION ALL ".join(f"SELECT '{n}' AS predicate, a.oid AS oid1, b.oid AS oid2, a.vid, a.fid FROM {_PAIRS.format('scene')} WHERE {t}" for n, t in (("near", near("a", "b", 1.0)), ("left_of", left("a", "b")))),
    "interval_predicate_scores": f"""WITH {_SCENE}, p AS (SELECT a.vid, a.fid, CAST({_ratio('a', 'b')} AS DOUBLE) AS apart FROM {_PAIRS.format('scene')} WHERE a.oid = 0 AND b.oid = 1)
SELECT p.vid, round(max(least(p.apart, -q.apart)), 4) AS score FROM p JOIN p q ON p.vid = q.vid AND q.fid = p.fid + 1 GROUP BY p.vid""",
    "pool_votes": f"SELECT vid, round(2 * p * (1 - p), 6) AS gini FROM (SELECT vid, count(*) / {len(_POOL)} AS p FROM ({_POOL_SQL}) GROUP BY vid)",
    "predicate_bits": f"""WITH {_SCENE} SELECT a.vid, a.fid, a.oid AS o0_oid, b.oid AS o1_oid,
  CAST(CASE WHEN {near('a', 'b', 2.0)} THEN 1 ELSE 0 END + CASE WHEN {left('a', 'b')} THEN 2 ELSE 0 END + CASE WHEN {quadrant(_TOP, 'b')} THEN 4 ELSE 0 END AS BIGINT) AS bits
FROM {_PAIRS.format('scene')}""",
    "interval_conjunction": f"WITH {_SCENE}, {_unit('r', far('a', 'b', 1.0) + ' AND ' + left('a', 'b'))} SELECT * FROM r",
    "interval_sequence": f"WITH {_SCENE}, {_TURNS} SELECT * FROM turn",
    "interval_gap_sequence": f"WITH {_SCENE}, {_unit('l', near('a', 'b', 1.5))}, {_unit('r', far('a', 'b', 3.0))} SELECT DISTINCT l.vid, l.i, r.j FROM l JOIN r ON l.vid = r.vid AND l.j <= r.i",
    "interval_repetition": f"""WITH RECURSIVE {_SCENE}, {_unit('u', far('a', 'b', 1.0))},
k AS (SELECT vid, i, j FROM u UNION SELECT k.vid, k.i, u.j FROM k JOIN u ON k.vid = u.vid AND k.j = u.i) SELECT * FROM k WHERE j - i >= 3""",
    "interval_closure": f"""WITH RECURSIVE {_SCENE}, {_TURNS},
k AS (SELECT vid, i, j FROM turn UNION SELECT k.vid, k.i, t.j FROM k JOIN turn t ON k.vid = t.vid AND k.j = t.i) SELECT * FROM k""",
    "interval_scores": f"WITH {_SCENE} SELECT a.vid, max(least(a.x1, b.y1)) AS score FROM scene a JOIN scene b ON a.vid = b.vid AND b.fid = a.fid + 1 WHERE a.oid = 0 AND b.oid = 1 GROUP BY a.vid",
    "track_extents": f"WITH {_SCENE}, {_TRACKS} SELECT * FROM t",
    "track_pairs": f"WITH {_SCENE}, {_TRACK_PAIRS} SELECT * FROM p",
    "pair_segments": f"""WITH {_SCENE}, {_TRACK_PAIRS}
SELECT p.vid, CAST(p.oid1 AS BIGINT) * 4294967296 + p.oid2 AS pair, CAST(s.oid = oid2 AS INTEGER) AS oid, s.fid - p.fs AS fid, x1, y1
FROM p JOIN scene s ON s.vid = p.vid AND s.oid IN (p.oid1, p.oid2) AND s.fid BETWEEN p.fs AND p.fe""",
    "cut_segments": f"WITH {_SCENE} SELECT vid, CAST(fid // 20 AS INTEGER) AS part, count(*) AS n, CAST(max(fid % 20) AS INTEGER) AS last FROM scene GROUP BY 1, 2",
    "nested_pairs": f"""WITH {_SCENE}, n AS (SELECT vid, max(fid) AS last FROM scene WHERE oid < 2 GROUP BY vid),
g AS (SELECT vid, CAST(oid AS INTEGER) AS oid, CAST(unnest(range(last + 1)) AS INTEGER) AS fid FROM n, (VALUES (0), (1)) o(oid)) SELECT vid, oid, fid, x1, y2 FROM g LEFT JOIN scene USING (vid, oid, fid)""",
    "noisy_labels": f"WITH {_SCENE}, l AS ({_LABELS}) SELECT vid, CASE WHEN {_DRAWN} / 281474976710656.0::DOUBLE < CASE label WHEN 1 THEN 0.2 ELSE 0.1 END THEN 1 - label ELSE label END AS label FROM l",
    "label_split": f"""WITH {_SCENE}, l AS ({_LABELS}), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_DRAWN}, vid) AS rank FROM l),
n AS (SELECT label, count(*) AS n FROM l GROUP BY label), c AS (SELECT label, n, sum(n) OVER (ORDER BY label) AS upto, sum(n) OVER () AS every FROM n)
SELECT vid, r.label, rank <= round(20 * upto / every::DOUBLE) - round(20 * (upto - n) / every::DOUBLE) AS train FROM r JOIN c USING (label)""",
    "query_quality": f"WITH {_SCENE}, {_F1.format(queries=8)} SELECT qid, round(f1, 6) AS f1 FROM s",
    "quality_spread": f"WITH {_SCENE}, {_F1.format(queries=7)} SELECT qid % 2 AS step, round(quantile_cont(f1, 0.5), 6) AS median, round(quantile_cont(f1, 0.25), 6) AS low, round(quantile_cont(f1, 0.75), 6) AS high FROM s GROUP BY 1",
    "label_stats": f"WITH {_SCENE}, l AS ({_LABELS}) SELECT CAST(sum(label) AS BIGINT) AS npos, CAST(sum(1 - label) AS BIGINT) AS nneg, round(avg(label), 6) AS ratio FROM l",
}
_FREE = [ORACLES[n] for n in ("event_near", "event_attributes", "event_duration", "event_then", "event_new_variable")]
ORACLES["pool_free"] = " UNION ALL ".join(f"SELECT {k} AS qid, vid FROM ({q})" for k, q in enumerate(_FREE))
