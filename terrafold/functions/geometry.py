"""Geometry on rings, arrays of (x, y) structs in metres without the closing point: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import let


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(x0, y0, x1, y1) -> Column:
    x0, y0, x1, y1 = (F.col(c) if isinstance(c, str) else c for c in (x0, y0, x1, y1))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def rotated(ring: Column) -> Column:
    """The ring from its second point on, so that zipping it with the ring gives the edges."""
    return F.concat(F.slice(ring, 2, F.greatest(F.lit(0), F.size(ring) - 1)), F.slice(ring, 1, 1))


def over_edges(ring: Column, term) -> Column:
    """The sum of term(a, b) over the edges."""
    return F.aggregate(F.zip_with(ring, rotated(ring), term), F.lit(0.0), lambda s, x: s + x)


def signed_area(ring: Column) -> Column:
    return over_edges(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return over_edges(ring, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))


def vertex_mean(ring: Column) -> Column:
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[c]) / F.size(ring)
    return point(mean("x"), mean("y"))


def centroid(ring: Column) -> Column:
    """Weighted by area; the vertices' mean for a ring without area."""
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    a6 = 6 * signed_area(ring)
    weighted = point(over_edges(ring, lambda a, b: (a["x"] + b["x"]) * cross(a, b)) / a6, over_edges(ring, lambda a, b: (a["y"] + b["y"]) * cross(a, b)) / a6)
    return F.when(a6 == 0, vertex_mean(ring)).otherwise(weighted)


def bounds(ring: Column) -> Column:
    of = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    return F.struct(of(F.array_min, "x").alias("x0"), of(F.array_min, "y").alias("y0"), of(F.array_max, "x").alias("x1"), of(F.array_max, "y").alias("y1"))


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """By ray casting: an odd number of edges to the right."""
    crossed = lambda a, b: F.when((a["y"] > y) != (b["y"] > y), (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]).cast("int")).otherwise(0)
    return over_edges(ring, lambda a, b: crossed(a, b).cast("double")) % 2 == 1


def contains_ring(ring: Column, other: Column) -> Column:
    return F.forall(other, lambda p: contains_point(ring, p["x"], p["y"]))


def buffered(box: Column, d: Column) -> Column:
    return F.struct((box["x0"] - d).alias("x0"), (box["y0"] - d).alias("y0"), (box["x1"] + d).alias("x1"), (box["y1"] + d).alias("y1"))


def distance_rule(d: Column, span: Column) -> Column:
    """A distance as it is; at most a fifth of a span below 1; never negative."""
    d = F.greatest(d, F.lit(0.0))
    return F.when((span > 0) & (span < 1), F.least(d, span * 0.2)).otherwise(d)


def ring_errors(ring: Column) -> Column:
    """The faults of a ring, in a fixed order."""
    edges = F.zip_with(ring, rotated(ring), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.array_compact(F.array(
        F.when(F.size(ring) < 3, "fewer than 3 points"),
        F.when(F.exists(edges, lambda e: (e["a"]["x"] == e["b"]["x"]) & (e["a"]["y"] == e["b"]["y"])), "edge of no length"),
        F.when(F.size(F.array_distinct(ring)) < F.size(ring), "repeated point"),
        F.when(~(area(ring) > 0), "no area"),
        F.when(crosses_itself(ring), "crosses itself"),
    ))


def counter_clockwise(ring: Column) -> Column:
    """Without repeated neighbours and closing point, counter-clockwise."""
    kept = F.filter(ring, lambda p, i: ~p.eqNullSafe(F.when(i == 0, F.lit(None)).otherwise(F.get(ring, F.greatest(i - 1, F.lit(0))))))
    open_ = F.when((F.size(kept) > 1) & (F.get(kept, F.lit(0)) == F.try_element_at(kept, F.lit(-1))), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
    return F.when(signed_area(open_) < 0, F.reverse(open_)).otherwise(open_)


def compactness(area_: Column, perimeter_: Column) -> Column:
    return F.when(perimeter_ > 0, 4 * F.pi() * area_ / (perimeter_ * perimeter_))


def vertices(text: Column) -> Column:
    """Lines of x,y as a ring moved to its smallest corner; bad lines are left out, fewer than three points give null."""
    pairs = F.transform(F.split(text, "\n"), lambda line: F.split(F.trim(line), r"\s*[,;]\s*"))
    points = F.filter(F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    low = lambda ps: F.struct(*(F.array_min(F.transform(ps, lambda p: p[c])).alias(c) for c in ("x", "y")))
    moved = lambda ps: let(low(ps), lambda at: F.transform(ps, lambda p: point(p["x"] - at["x"], p["y"] - at["y"])))
    return let(points, lambda ps: F.when(F.size(ps) >= 3, moved(ps)))


def ring_text(ring: Column) -> Column:
    return F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", F.round(p["x"], 3).cast("string"), F.round(p["y"], 3).cast("string"))), ",")


def edges(ring: Column) -> Column:
    """The ring's edges as structs of their ends a, b and number i."""
    return F.transform(F.zip_with(ring, rotated(ring), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda e, i: F.struct(e["a"].alias("a"), e["b"].alias("b"), i.alias("i")))


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two segments share a point, ends included; parallel ones count as apart."""
    rx, ry, sx, sy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
    turn, qx, qy = rx * sy - ry * sx, c["x"] - a["x"], c["y"] - a["y"]
    return F.when(F.abs(turn) < 1e-9, False).otherwise(((qx * sy - qy * sx) / turn).between(0, 1) & ((qx * ry - qy * rx) / turn).between(0, 1))


def rings_meet(one: Column, other: Column) -> Column:
    """Whether edges cross or a ring holds the other's first point; false for an empty ring."""
    cross = F.exists(edges(one), lambda e: F.exists(edges(other), lambda f: segments_cross(e["a"], e["b"], f["a"], f["b"])))
    first = lambda r: F.get(r, F.lit(0))
    held = contains_point(one, first(other)["x"], first(other)["y"]) | contains_point(other, first(one)["x"], first(one)["y"])
    return F.when((F.size(one) > 0) & (F.size(other) > 0), cross | held).otherwise(False)


def crosses_itself(ring: Column) -> Column:
    """Whether two edges that aren't neighbours share a point; never with fewer than four points."""
    apart = lambda e, f: (f["i"] > e["i"] + 1) & ~((e["i"] == 0) & (f["i"] == F.size(ring) - 1))
    return (F.size(ring) >= 4) & F.exists(edges(ring), lambda e: F.exists(edges(ring), lambda f: apart(e, f) & segments_cross(e["a"], e["b"], f["a"], f["b"])))


def clipped(points: Column, ring: Column) -> Column:
    return F.filter(points, lambda p: contains_point(ring, p["x"], p["y"]))


def split_by_line(ring: Column, a: Column, b: Column) -> Column:
    """The points on both sides of the line's middle, across its longer axis; a side of fewer than three is the whole ring."""
    wide = F.abs(b["x"] - a["x"]) >= F.abs(b["y"] - a["y"])
    at = lambda p: F.when(wide, p["x"]).otherwise(p["y"])
    middle = (at(a) + at(b)) / 2
    whole = lambda side: F.when(F.size(side) >= 3, side).otherwise(ring)
    return F.array(whole(F.filter(ring, lambda p: at(p) <= middle + 1e-9)), whole(F.filter(ring, lambda p: at(p) >= middle - 1e-9)))


def box_ring(box: Column) -> Column:
    return rectangle(box["x0"], box["y0"], box["x1"], box["y1"])


def united(rings: Column) -> Column:
    """The box around all rings."""
    return box_ring(bounds(F.flatten(rings)))


def difference(base: Column, cut: Column) -> Column:
    """Coarse: nothing where the cut is as wide as the base, else the base's points outside the cut."""
    b, c = bounds(base), bounds(cut)
    outside = F.filter(base, lambda p: ~contains_point(cut, p["x"], p["y"]))
    return F.when(~rings_meet(base, cut), base).when((c["x0"] <= b["x0"]) & (c["x1"] >= b["x1"]), F.slice(base, 1, 0)).otherwise(outside)


def edge_distance(ring: Column, x: Column, y: Column) -> Column:
    """A point's distance from the ring's nearest edge."""

    def one(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        t = F.when(dx * dx + dy * dy > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy) / (dx * dx + dy * dy)))).otherwise(0.0)
        return F.hypot(x - e["a"]["x"] - t * dx, y - e["a"]["y"] - t * dy)

    return F.array_min(F.transform(edges(ring), one))


def rings_cross(one: Column, other: Column) -> Column:
    return F.exists(edges(one), lambda e: F.exists(edges(other), lambda f: segments_cross(e["a"], e["b"], f["a"], f["b"])))
