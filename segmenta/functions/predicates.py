"""Predicates over one or two detections, as Column expressions.

Arithmetic is that of 32-bit floats where it decides: coordinates are narrowed, ratios are rounded to float. A
predicate that is NULL filters like false; `strict` ones are NULL if any column of the relation that they
are given is NULL, the others if one that they use is.

dialect "sql" has strict thresholds for Near and Far; dialect "matrix" counts the threshold itself in, closes the
TopQuadrant range, adds a small constant below the ratio of Faster and counts the edges of lanes out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from segmenta.sources.detections import COLORS, MATERIALS, SHAPES

BOXES = ("x1", "y1", "x2", "y2")
KINEMATICS = (*BOXES, "vx", "vy", "ax", "ay")

# Lanes and zones as polygons of pixel coordinates, in order.
POLYGONS = {
    "LeftPoly": [(250, 272), (0, 325), (0, 540), (495, 532)],
    "RightPoly": [(615, 206), (813, 285), (960, 172), (960, 0), (615, 0)],
    "TopPoly": [(590, 205), (341, 105), (191, 123), (273, 273)],
    "BottomPoly": [(821, 322), (525, 472), (525, 540), (960, 540), (960, 322)],
    "Eastward4": [(0, 330), (330, 362), (789, 369), (960, 355), (960, 372), (803, 391), (351, 389), (0, 351)],
    "Eastward3": [(0, 351), (351, 389), (803, 391), (960, 372), (960, 394), (838, 413), (424, 422), (153, 395), (0, 370)],
    "Eastward2": [(0, 370), (153, 395), (424, 422), (838, 413), (960, 394), (960, 420), (763, 451), (414, 460), (97, 420), (0, 397)],
    "Westward2": [(0, 262), (709, 213), (708, 242), (0, 288)],
    "Southward1Upper": [(384, 113), (414, 115), (565, 223), (543, 224)],
}
# How far above the lower edge of the box a lane predicate looks; None: at the centre.
OFFSETS = {"LeftPoly": None, "RightPoly": None, "TopPoly": None, "BottomPoly": None, "Eastward4": 10, "Eastward3": 10, "Eastward2": 10, "Westward2": 4, "Southward1Upper": 0}
EPSILON = 1e-6

Get = Callable[[str], Column]


def _f(c: Column) -> Column:
    return c.cast("float")


def _real(x: float) -> Column:
    return F.lit(x).cast("float")


def _cx(o: Get) -> Column:
    return _f((_f(o("x1")) + _f(o("x2"))) / 2)


def _cy(o: Get) -> Column:
    return _f((_f(o("y1")) + _f(o("y2"))) / 2)


def _distance(a: Get, b: Get) -> Column:
    return F.sqrt(F.pow(_cx(a) - _cx(b), F.lit(2.0)) + F.pow(_cy(a) - _cy(b), F.lit(2.0)))


def _ratio_test(top: Column, bottom: Column, test: Callable[[Column], Column], infinite: bool) -> Column:
    """test(top / bottom) as C arithmetic has it: a positive number over zero is infinite, zero over zero passes
    no test."""
    return F.when(bottom == 0, (top > 0) & F.lit(infinite)).otherwise(test(_f(top / F.when(bottom != 0, bottom))))


def _near(a: Get, b: Get, theta: float, dialect: str) -> Column:
    width = _f((_f(a("x2")) - _f(a("x1")) + _f(b("x2")) - _f(b("x1"))) / 2)
    return _ratio_test(_distance(a, b), width, lambda r: r <= _real(theta) if dialect == "matrix" else r < _real(theta), False)


def _far(a: Get, b: Get, theta: float, dialect: str) -> Column:
    width = _f((_f(a("x2")) - _f(a("x1")) + _f(b("x2")) - _f(b("x1"))) / 2)
    return _ratio_test(_distance(a, b), width, lambda r: r >= _real(theta) if dialect == "matrix" else r > _real(theta), True)


def _square(o: Get, x: str, y: str) -> Column:
    return _f(o(x)) * _f(o(x)) + _f(o(y)) * _f(o(y))


def _faster(a: Get, b: Get, theta: float, dialect: str) -> Column:
    below = _square(b, "vx", "vy")
    if dialect == "matrix":
        below = below + _real(EPSILON)
    return _ratio_test(_square(a, "vx", "vy"), below, lambda r: r >= _real(theta), True)


def inside(polygon: list[tuple[float, float]], x: Column, y: Column) -> Column:
    """Even-odd rule: an odd number of edges is crossed by the ray to the right."""
    crossings = []
    for (xi, yi), (xj, yj) in zip(polygon, [polygon[-1], *polygon[:-1]], strict=True):
        if yi != yj:  # level edges never count
            at = _f(_f(_real(xj - xi) * (y - _real(yi))) / _real(yj - yi)) + _real(xi)
            crossings.append(F.when(((y < _real(yi)) != (y < _real(yj))) & (x < at), 1).otherwise(0))
    return reduce(lambda a, b: a + b, crossings) % 2 == 1


def on_edge(polygon: list[tuple[float, float]], x: Column, y: Column) -> Column:
    """Whether the point lies on an edge or a corner."""
    on = []
    for (xi, yi), (xj, yj) in zip(polygon, [polygon[-1], *polygon[:-1]], strict=True):
        turned = (x - xi) * (yj - yi) == (y - yi) * (xj - xi)
        on.append(turned & x.between(min(xi, xj), max(xi, xj)) & y.between(min(yi, yj), max(yi, yj)))
    return reduce(lambda a, b: a | b, on)


def _lane(name: str) -> Callable[..., Column]:
    def test(o: Get, theta: None = None, dialect: str = "sql") -> Column:
        above = OFFSETS[name]
        y = _cy(o) if above is None else _f(_f(o("y2")) - above)
        known = reduce(lambda a, b: a & b, [o(c).isNotNull() for c in BOXES])
        x = _cx(o)
        within = inside(POLYGONS[name], x, y)
        if dialect == "matrix":
            within = within & ~on_edge(POLYGONS[name], x.cast("double"), y.cast("double"))
        return F.when(known, within)

    return test


def _within(c: Column, low: float, high: float, closed: bool) -> Column:
    return (c >= low) & ((c <= high) if closed else (c < high))


def iou(a: Get, b: Get) -> Column:
    """Intersection over union of two boxes; 0 for disjoint ones."""
    w = F.least(a("x2"), b("x2")) - F.greatest(a("x1"), b("x1"))
    h = F.least(a("y2"), b("y2")) - F.greatest(a("y1"), b("y1"))
    area = lambda o: (o("x2") - o("x1")) * (o("y2") - o("y1"))
    return F.when((w < 0) | (h < 0), 0.0).otherwise(_f(w * h / (area(a) + area(b) - w * h)).cast("double"))


def score(name: str, objects: list[Get]) -> Column:
    """How well a predicate with a number holds, for quantitative evaluation: larger is better, and the predicate holds at
    parameter t where the score is at least t (Far, HighAccel, Faster) or at least -t (Near, Stopped, DistanceSmall). NULL
    where it is not defined."""
    a, b = objects[0], objects[-1]
    width = _f((_f(a("x2")) - _f(a("x1")) + _f(b("x2")) - _f(b("x1"))) / 2)
    apart = _f(_distance(a, b) / F.when(width != 0, width))
    length = lambda x, y: _f(F.sqrt(_square(a, x, y)))
    scores = {"near": -apart, "far": apart, "distancesmall": -_f(_distance(a, b)), "stopped": -length("vx", "vy"), "highaccel": length("ax", "ay")}
    scores["faster"] = _f(_square(a, "vx", "vy") / (_square(b, "vx", "vy") + _real(EPSILON)))
    return scores[name.lower()].cast("double")


@dataclass(frozen=True)
class Predicate:
    name: str
    arity: int
    #: None, "number" or "text"
    parameter: str | None
    build: Callable[..., Column]
    strict: bool = True


def _of_attribute(name: str) -> Callable[..., Column]:
    return lambda o, value=None, dialect="sql": o(name) == value


def _fixed(name: str, value: str) -> Callable[..., Column]:
    return lambda o, _=None, dialect="sql": o(name) == value


def _one(f: Callable[[Get], Column]) -> Callable[..., Column]:
    return lambda o, theta=None, dialect="sql": f(o)


def _two(f: Callable[[Get, Get], Column]) -> Callable[..., Column]:
    return lambda a, b, theta=None, dialect="sql": f(a, b)


_ALL = [
    Predicate("Near", 2, "number", _near),
    Predicate("Far", 2, "number", _far),
    Predicate("LeftOf", 2, None, _two(lambda a, b: _cx(a) < _cx(b))),
    Predicate("RightOf", 2, None, _two(lambda a, b: _cx(a) > _cx(b))),
    Predicate("Behind", 2, None, _two(lambda a, b: _cy(a) < _cy(b))),
    Predicate("FrontOf", 2, None, _two(lambda a, b: _cy(a) > _cy(b))),
    Predicate("LeftQuadrant", 1, None, _one(lambda o: _within(_cx(o), 0, 240, False))),
    Predicate("RightQuadrant", 1, None, _one(lambda o: _within(_cx(o), 240, 480, True))),
    Predicate("TopQuadrant", 1, None, lambda o, theta=None, dialect="sql": _within(_cy(o), 0, 160, dialect == "matrix")),
    Predicate("BottomQuadrant", 1, None, _one(lambda o: _within(_cy(o), 160, 320, True))),
    Predicate("Color", 1, "text", _of_attribute("color")),
    Predicate("Shape", 1, "text", _of_attribute("shape")),
    Predicate("Material", 1, "text", _of_attribute("material")),
    *[Predicate(v.capitalize(), 1, None, _fixed(k, v)) for k, vs in (("color", COLORS), ("shape", SHAPES), ("material", MATERIALS)) for v in vs],
    *[Predicate(n, 1, None, _lane(n), n.endswith("Poly") or n == "Southward1Upper") for n in POLYGONS],
    Predicate("Stopped", 1, "number", lambda o, theta, dialect="sql": _f(F.sqrt(_square(o, "vx", "vy"))) <= _real(theta), False),
    Predicate("HighAccel", 1, "number", lambda o, theta, dialect="sql": _f(F.sqrt(_square(o, "ax", "ay"))) >= _real(theta), False),
    Predicate("DistanceSmall", 2, "number", lambda a, b, theta, dialect="sql": _f(_distance(a, b)) <= _real(theta), False),
    Predicate("Faster", 2, "number", _faster, False),
]
#: By lower-case name: case does not count in names.
PREDICATES = {p.name.lower(): p for p in _ALL}


def predicate(name: str, objects: list[Get], parameter=None, columns: tuple[str, ...] = (), dialect: str = "sql") -> Column:
    """The predicate over objects, each a function from a column's name to the Column. columns: those of the relation
    that strict predicates inspect."""
    p = PREDICATES[name.lower()]
    if len(objects) != p.arity:
        raise ValueError(f"{p.name} takes {p.arity} objects")
    if (p.parameter is None) != (parameter is None):
        raise ValueError(f"{p.name} takes {'a' if p.parameter else 'no'} parameter")
    out = p.build(*objects, parameter, dialect)
    looked = columns if p.strict else ()
    if looked:
        out = reduce(lambda a, b: a & b, [o(c).isNotNull() for o in objects for c in looked]) & out
    return out
