"""Polygons as array<array<double>> rings, implicitly closed, measured and cut with column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _xy(x: Column, y: Column) -> Column:
    return F.array(x.cast("double"), y.cast("double"))


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(_xy(x1, y1), _xy(x2, y1), _xy(x2, y2), _xy(x1, y2))


def _around(ring: Column, term: Callable[[Column, Column], Column]) -> Column:
    """The sum of term(point, next point) over the closed ring; 0 for fewer than two points."""

    def of(r: Column) -> Column:
        terms = F.transform(r, lambda p, i: term(p, F.get(r, F.pmod(i + 1, F.size(r)))))
        return F.when(F.size(r) < 2, F.lit(0.0)).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t))

    return let(ring, of)


def signed_area(ring: Column) -> Column:
    return _around(ring, lambda p, q: (p[0] * q[1] - q[0] * p[1]) / 2)


def area(ring: Column) -> Column:
    """Shoelace area; 0 for fewer than three points."""
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.abs(signed_area(ring)))


def perimeter(ring: Column) -> Column:
    return _around(ring, lambda p, q: F.sqrt((q[0] - p[0]) * (q[0] - p[0]) + (q[1] - p[1]) * (q[1] - p[1])))


def bounding_box(ring: Column) -> Column:
    """(cx, cy, w, d, x1, y1, x2, y2); zeros for an empty or null ring."""
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    low_x, low_y, high_x, high_y = F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)
    full = F.coalesce(F.size(ring) > 0, F.lit(False))
    values = {"cx": (low_x + high_x) / 2, "cy": (low_y + high_y) / 2, "w": high_x - low_x, "d": high_y - low_y, "x1": low_x, "y1": low_y, "x2": high_x, "y2": high_y}
    return F.struct(*[F.when(full, v).otherwise(F.lit(0.0)).alias(k) for k, v in values.items()])


def affine(ring: Column, origin_x: float, origin_y: float, pixel_width: float, pixel_height: float) -> Column:
    """Pixel to geographic coordinates, without rotation."""
    return F.transform(ring, lambda p: F.array(F.lit(origin_x) + p[0] * F.lit(pixel_width), F.lit(origin_y) + p[1] * F.lit(pixel_height)))


def _turned(ring: Column) -> Column:
    """Counter-clockwise."""
    return let(ring, lambda r: F.when(signed_area(r) < 0, F.reverse(r)).otherwise(r))


def _side(a: Column, b: Column, p: Column) -> Column:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _cut(ring: Column, a: Column, b: Column) -> Column:
    """What of the ring lies left of a -> b."""

    def corner(p: Column, i: Column) -> Column:
        def of(q: Column) -> Column:
            sp, sq = _side(a, b, p), _side(a, b, q)
            t = sq / (sq - sp)
            meet = F.array(q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1]))
            none = F.array().cast("array<array<double>>")
            return F.when((sp >= 0) & (sq >= 0), F.array(p)).when(sp >= 0, F.array(meet, p)).when(sq >= 0, F.array(meet)).otherwise(none)

        return let(F.get(ring, F.pmod(i - 1, F.size(ring))), of)

    return F.flatten(F.transform(ring, corner))


def clip(ring: Column, window: Column) -> Column:
    """The ring within a convex window (Sutherland and Hodgman)."""

    def of(w: Column) -> Column:
        return F.aggregate(F.transform(w, lambda p, i: F.struct(p.alias("a"), F.get(w, F.pmod(i + 1, F.size(w))).alias("b"))), ring, lambda r, e: _cut(r, e["a"], e["b"]))

    return let(_turned(window), of)


def _fan(ring: Column) -> Column:
    """Signed triangles from the first point."""

    def of(r: Column) -> Column:
        tri = lambda i: F.array(F.get(r, F.lit(0)), F.get(r, i), F.get(r, i + 1))
        return F.when(F.size(r) < 3, F.array().cast("array<array<array<double>>>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(r) - 2), tri))

    return let(ring, of)


def _convex(ring: Column) -> Column:
    def of(r: Column) -> Column:
        turn = F.transform(r, lambda p, i: _side(p, F.get(r, F.pmod(i + 1, F.size(r))), F.get(r, F.pmod(i + 2, F.size(r)))))
        return let(turn, lambda t: F.forall(t, lambda x: x >= 0) | F.forall(t, lambda x: x <= 0))

    return let(ring, of)


def intersection_area(one: Column, other: Column) -> Column:
    """Of two simple rings of any shape: by clipping where the second is convex, else over signed triangles of both. 0 if one has under three points."""

    def pair(t: Column, u: Column) -> Column:
        return F.signum(signed_area(t)) * F.signum(signed_area(u)) * F.abs(signed_area(clip(_turned(t), u)))

    def fans(a: Column, b: Column) -> Column:
        return F.abs(F.aggregate(a, F.lit(0.0), lambda n, t: n + F.aggregate(b, F.lit(0.0), lambda m, u: m + F.when(signed_area(u) == 0, F.lit(0.0)).otherwise(pair(t, u)))))

    general = let(F.struct(_fan(one).alias("a"), _fan(other).alias("b")), lambda s: fans(s["a"], s["b"]))
    return F.when((F.size(one) < 3) | (F.size(other) < 3), F.lit(0.0)).when(_convex(other), area(clip(one, other))).otherwise(general)


def total_area(parts: Column) -> Column:
    """Of rings that don't overlap."""
    return F.aggregate(parts, F.lit(0.0), lambda n, r: n + area(r))


def common_area(ones: Column, others: Column) -> Column:
    """Of two lists of rings; those of one list don't overlap."""
    return F.aggregate(ones, F.lit(0.0), lambda n, a: n + F.aggregate(others, F.lit(0.0), lambda m, b: m + intersection_area(a, b)))


def is_rectangle(ring: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether the ring is its own bounding box, from any corner and either way round."""
    at = lambda k: F.get(ring, F.lit(k))
    corner = F.forall(ring, lambda p: ((p[0] == x1) | (p[0] == x2)) & ((p[1] == y1) | (p[1] == y2)))
    opposite = lambda p, q: (p[0] != q[0]) & (p[1] != q[1])
    return F.coalesce((F.size(ring) == 4) & corner & opposite(at(0), at(2)) & opposite(at(1), at(3)) & ((at(0)[0] == at(1)[0]) != (at(0)[1] == at(1)[1])), F.lit(False))


def is_simple(ring: Column) -> Column:
    """Whether no two sides meet that don't follow one another; points that repeat the next one don't count."""

    def of(r: Column) -> Column:
        n = F.size(r)
        at = lambda i: F.get(r, F.pmod(i, n))

        def apart(a: Column, b: Column, c: Column, d: Column, k: int) -> Column:
            return (F.greatest(a[k], b[k]) < F.least(c[k], d[k])) | (F.greatest(c[k], d[k]) < F.least(a[k], b[k]))

        def meets(i: Column, j: Column) -> Column:
            a, b, c, d = at(i), at(i + 1), at(j), at(j + 1)
            across = (_side(a, b, c) * _side(a, b, d) <= 0) & (_side(c, d, a) * _side(c, d, b) <= 0)
            return (j > i + 1) & ~((i == 0) & (j == n - 1)) & ~apart(a, b, c, d, 0) & ~apart(a, b, c, d, 1) & across

        every = F.sequence(F.lit(0), n - 1)
        return F.when(n < 4, F.lit(True)).otherwise(~F.exists(every, lambda i: F.exists(every, lambda j: meets(i, j))))

    return let(let(ring, lambda r: F.filter(r, lambda p, i: p != F.get(r, F.pmod(i + 1, F.size(r))))), of)


def repaired(ring: Column) -> Column:
    """Trapezoids (rings that don't overlap) of what a ring encloses that crosses or touches itself; none for an empty ring.

    The ring is cut into strips at all corners and crossings. What its sides go around the same way as the place below the topmost
    corner counts (once, however often they do); what they go around the other way doesn't, so a bow tie keeps one of its halves.
    """
    none = F.array().cast("array<array<array<double>>>")

    def side(p: Column, q: Column) -> Column:
        slope = (q[0] - p[0]) / (q[1] - p[1])
        return F.struct(F.least(p[1], q[1]).alias("low"), F.greatest(p[1], q[1]).alias("high"), slope.alias("m"), (p[0] - slope * p[1]).alias("c"), F.when(q[1] > p[1], -1).otherwise(1).alias("turn"))

    def sides(r: Column) -> Column:
        pairs = F.transform(r, lambda p, i: F.struct(p.alias("p"), F.get(r, F.pmod(i + 1, F.size(r))).alias("q")))
        return F.transform(F.filter(pairs, lambda s: s["p"][1] != s["q"][1]), lambda s: side(s["p"], s["q"]))

    def crossings(s: Column) -> Column:
        ys = F.transform(s, lambda e: F.transform(F.filter(s, lambda f: f["m"] != e["m"]), lambda f: F.struct(((f["c"] - e["c"]) / (e["m"] - f["m"])).alias("y"), F.greatest(e["low"], f["low"]).alias("low"), F.least(e["high"], f["high"]).alias("high"))))
        return F.transform(F.filter(F.flatten(ys), lambda t: (t["low"] < t["y"]) & (t["y"] < t["high"])), lambda t: t["y"])

    def strip(s: Column, low: Column, high: Column) -> Column:
        """Places between two following sides, from the left: how often they are gone around, and the trapezoid."""
        x = lambda e, y: e["m"] * y + e["c"]
        across = F.array_sort(F.transform(F.filter(s, lambda e: (e["low"] <= low) & (e["high"] >= high)), lambda e: F.struct(x(e, (low + high) / 2).alias("at"), x(e, low).alias("xl"), x(e, high).alias("xh"), e["turn"].alias("turn"))))

        def place(t: Column, k: Column) -> Column:
            l, r = F.get(t, k), F.get(t, k + 1)  # noqa: E741
            return F.struct(F.aggregate(F.slice(t, 1, k + 1), F.lit(0), lambda n, e: n + e["turn"]).alias("times"), F.array(_xy(l["xl"], low), _xy(r["xl"], low), _xy(r["xh"], high), _xy(l["xh"], high)).alias("ring"))

        return let(across, lambda t: F.when(F.size(t) < 2, F.array().cast("array<struct<times:int,ring:array<array<double>>>>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda k: place(t, k))))

    def places(s: Column) -> Column:
        ys = F.array_sort(F.array_distinct(F.concat(F.transform(s, lambda e: e["low"]), F.transform(s, lambda e: e["high"]), crossings(s))))
        return let(ys, lambda y: F.transform(F.sequence(F.size(y) - 2, F.lit(0), F.lit(-1)), lambda i: strip(s, F.get(y, i), F.get(y, i + 1))))

    def chosen(strips: Column) -> Column:
        way = F.get(F.get(strips, F.lit(0)), F.lit(0))["times"]
        return let(way, lambda w: F.transform(F.filter(F.flatten(strips), lambda p: p["times"] * w > 0), lambda p: p["ring"]))

    return let(ring, lambda r: let(sides(r), lambda s: F.when(F.size(s) < 2, none).otherwise(let(places(s), chosen))))
