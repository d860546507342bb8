"""Boundaries: rings from loose segments, insets, relations of plots, sites and land use, picks and nested listings."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import layer_class
from ..lineage import cut

#: Files of more segments aren't taken apart in a task, nor are their loops of more points walked along in one: all tasks do so together.
WALKED = 10_000


def snapped(segments: DataFrame) -> DataFrame:
    """file_id, layer, u, v (grid places, as structs i, j), eps, n: ends moved to a grid of a millionth of the file's diagonal, 0.01 at least; n: the file's segments.

    segments: file_id, layer, ax, ay, bx, by. Segments without a length on the grid go.
    """
    low, high = lambda c: F.min(F.least("a" + c, "b" + c)), lambda c: F.max(F.greatest("a" + c, "b" + c))
    size = segments.groupBy("file_id").agg(F.greatest(F.lit(0.01), F.hypot(high("x") - low("x"), high("y") - low("y")) * 1e-6).alias("eps"), F.count("*").alias("n"))
    place = lambda p: F.struct(*(F.bround(F.col(p + c) / F.col("eps")).cast("long").alias(k) for c, k in (("x", "i"), ("y", "j"))))
    return segments.join(size.hint("merge"), "file_id").select("file_id", "layer", place("a").alias("u"), place("b").alias("v"), "eps", "n").where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """file_id, u, label: each node's smallest reachable node. edges: file_id, u, v, both directions.

    Labels go to neighbours and jump to their own label's label, so rounds grow far slower than a chain's length; each round is checkpointed.
    """
    labels = cut(edges.select("file_id", "u").distinct().withColumn("label", F.col("u")))
    while True:
        near = edges.join(labels.hint("merge"), ["file_id", "u"]).groupBy("file_id", F.col("v").alias("u")).agg(F.min("label").alias("near"))
        least = cut(labels.join(near.hint("merge"), ["file_id", "u"]).select("file_id", "u", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        jump = least.select("file_id", F.col("u").alias("label"), F.col("label").alias("next"))
        moved = cut(least.join(jump.hint("merge"), ["file_id", "label"]).select("file_id", "u", F.col("next").alias("label"), (F.col("old") != F.col("next")).alias("moved")))
        labels = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return labels


def path(near: dict[tuple, Iterable[tuple]], start: tuple) -> list[tuple]:
    """A loop's nodes in order, from start towards its smaller neighbour."""
    out, at = [start], min(near[start])
    while at != start:
        out.append(at)
        at = next(n for n in near[at] if n != out[-2])
    return out


def walk(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
    """One loop's nodes in order, from the smallest node."""
    near: dict[tuple, list[tuple]] = {}
    for ui, uj, vi, vj in zip(edges["ui"], edges["uj"], edges["vi"], edges["vj"]):
        near.setdefault((ui, uj), []).append((vi, vj))
    eps = edges["eps"].iloc[0]
    return pd.DataFrame({"file_id": [key[0]], "ri": [key[1]], "rj": [key[2]], "ring": [[{"x": i * eps, "y": j * eps} for i, j in path(near, min(near))]]})


def loops_of_file(key: tuple, segments: pd.DataFrame) -> pd.DataFrame:
    """All simple loops of one file of up to WALKED segments with their layers, as rings has them."""
    ends = list(zip(zip(segments["ui"], segments["uj"]), zip(segments["vi"], segments["vj"])))
    near: dict[tuple, set[tuple]] = {}
    for u, v in ends:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    label: dict[tuple, tuple] = {}
    for node in sorted(near):
        todo = [] if node in label else [node]
        while todo:
            at = todo.pop()
            if at not in label:
                label[at] = node
                todo += near[at]
    no_loop = {label[node] for node, others in near.items() if len(others) != 2}
    on: dict[tuple, dict] = {}
    for (u, v), layer in zip(ends, segments["layer"]):
        if label[u] not in no_loop:
            on.setdefault(label[u], {}).setdefault(layer if isinstance(layer, str) else None, []).append(math.hypot(u[0] - v[0], u[1] - v[1]))
    eps = segments["eps"].iloc[0]
    rows = [(key[0], *start, [{"x": i * eps, "y": j * eps} for i, j in path(near, start)], min(layers, key=lambda x: (-math.fsum(layers[x]), x is not None, x or ""))) for start, layers in on.items()]
    return pd.DataFrame(rows, columns=["file_id", "ri", "rj", "ring", "layer"])


def ordered(parts: DataFrame) -> DataFrame:
    """file_id, ri, rj, ring of long loops, as walk gives them: each directed edge doubles its way to the loop's end until all have arrived.

    parts: file_id, ri, rj, u, v, eps, edges in both directions. A loop takes as many rounds as its number of points has binary digits.
    """
    ahead = parts.select("file_id", F.col("u").alias("v"), F.col("v").alias("after"))
    begin = F.struct(F.col("ri").alias("i"), F.col("rj").alias("j"))
    ways = parts.join(ahead.hint("merge"), ["file_id", "v"]).where("after <> u").withColumn("over", F.col("v") == begin)
    edge = lambda a, b: F.when(~F.col("over"), F.struct(F.col(a).alias("u"), F.col(b).alias("v")))
    ways = cut(ways.select("file_id", "ri", "rj", "eps", F.struct("u", "v").alias("at"), edge("v", "after").alias("to"), F.when(F.col("over"), F.col("u")).alias("end"), F.when(F.col("over"), 0).otherwise(1).cast("long").alias("left")))
    while not ways.where("to IS NOT NULL").isEmpty():
        on = ways.select("file_id", F.col("at").alias("to"), F.col("to").alias("to_"), F.col("end").alias("end_"), F.col("left").alias("left_"))
        ways = cut(ways.join(on.hint("merge"), ["file_id", "to"], "left").select("file_id", "ri", "rj", "eps", "at", F.col("to_").alias("to"), F.coalesce("end", "end_").alias("end"), (F.col("left") + F.coalesce("left_", F.lit(0))).alias("left")))
    last = ways.where(F.col("at.u") == begin).groupBy("file_id", "ri", "rj").agg(F.max("at.v").alias("end"))
    told = ways.join(last.hint("merge"), ["file_id", "ri", "rj", "end"])
    points = F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("n"), (F.col("at.u.i") * F.col("eps")).alias("x"), (F.col("at.u.j") * F.col("eps")).alias("y"))))
    return told.groupBy("file_id", "ri", "rj").agg(F.transform(points, lambda p: G.point(p["x"], p["y"])).alias("ring"))


def rings(segments: DataFrame) -> DataFrame:
    """file_id, ri, rj, ring, layer: simple loops of loose segments, each with the layer of the greatest length on it.

    Components that branch or stay open give no ring. Repeated and reversed segments count once for the loop, and all for the layer; ties go to
    the smaller layer name. Files of up to WALKED segments are taken apart each in a task, larger ones by all tasks together.
    """
    every = snapped(segments)
    flat = every.select("file_id", "layer", *(F.col(f"{p}.{k}").alias(p + k) for p in "uv" for k in "ij"), "eps", "n")
    found = flat.where(F.col("n") <= WALKED).drop("n").groupBy("file_id").applyInPandas(loops_of_file, "file_id long, ri long, rj long, ring array<struct<x: double, y: double>>, layer string")
    if segments.groupBy("file_id").count().where(F.col("count") > WALKED).isEmpty():
        return found
    return found.unionByName(rings_of_large(every.where(F.col("n") > WALKED).drop("n")))


def rings_of_large(snapped_: DataFrame) -> DataFrame:
    """rings of files of any size: loops of up to WALKED points are walked along in a task, longer ones are put in order by doubling."""
    on = cut(snapped_)
    both = on.select("file_id", "u", "v", "eps").unionByName(on.select("file_id", F.col("v").alias("u"), F.col("u").alias("v"), "eps")).distinct()
    labels = components(both.drop("eps"))
    named = cut(both.join(labels.hint("merge"), ["file_id", "u"]).select("file_id", F.col("label.i").alias("ri"), F.col("label.j").alias("rj"), "u", "v", "eps"))
    degree = named.groupBy("file_id", "ri", "rj", "u").agg(F.count("*").alias("n"))
    loops = cut(degree.groupBy("file_id", "ri", "rj").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("points")).where("low = 2 AND high = 2").select("file_id", "ri", "rj", "points"))
    of = lambda test: named.join(loops.where(test).drop("points").hint("merge"), ["file_id", "ri", "rj"])
    parts = of(F.col("points") <= WALKED).select("file_id", "ri", "rj", F.col("u.i").alias("ui"), F.col("u.j").alias("uj"), F.col("v.i").alias("vi"), F.col("v.j").alias("vj"), "eps")
    found = parts.groupBy("file_id", "ri", "rj").applyInPandas(walk, "file_id long, ri long, rj long, ring array<struct<x: double, y: double>>")
    if not loops.where(F.col("points") > WALKED).isEmpty():
        found = found.unionByName(ordered(of(F.col("points") > WALKED)))
    length = F.hypot(F.col("u.i") - F.col("v.i"), F.col("u.j") - F.col("v.j"))
    per = on.join(labels.hint("merge"), ["file_id", "u"]).groupBy("file_id", F.col("label.i").alias("ri"), F.col("label.j").alias("rj"), "layer").agg(F.sum(length).alias("total"))
    layer = per.groupBy("file_id", "ri", "rj").agg(F.min_by("layer", F.struct(-F.col("total"), "layer")).alias("layer"))
    return found.join(layer.hint("merge"), ["file_id", "ri", "rj"])


def inset(plots: DataFrame, ring: str, widths: str) -> DataFrame:
    """plots with inset: each edge of the ring moved inwards by its width (3 where there is none), neighbours intersected.

    Where a corner leaves the ring, all shrink towards their mean, in at most 25 steps. Null for fewer than three points or no area. Parallel
    neighbours move their corner by one metre.
    """
    unit = lambda x, y: F.when(F.hypot(x, y) == 0, 1.0).otherwise(F.hypot(x, y))
    r = F.col(ring)
    ahead = F.zip_with(r, G.rotated(r), lambda a, b: F.struct(a.alias("v"), ((b["x"] - a["x"]) / unit(b["x"] - a["x"], b["y"] - a["y"])).alias("dx"), ((b["y"] - a["y"]) / unit(b["x"] - a["x"], b["y"] - a["y"])).alias("dy")))
    width = lambda i: F.coalesce(F.get(F.col(widths), i), F.lit(3.0))
    side = F.when(F.col("area_") >= 0, 1.0).otherwise(-1.0)
    lines = F.transform(F.col("ahead_"), lambda e, i: F.struct(e["v"].alias("v"), e["dx"].alias("dx"), e["dy"].alias("dy"), (-e["dy"] * side * width(i)).alias("ox"), (e["dx"] * side * width(i)).alias("oy")))

    def corner(q: Column, e: Column) -> Column:
        turn = q["dx"] * e["dy"] - q["dy"] * e["dx"]
        t = ((e["ox"] - q["ox"]) * e["dy"] - (e["oy"] - q["oy"]) * e["dx"]) / turn
        mx, my = q["ox"] + e["ox"], q["oy"] + e["oy"]
        beside = G.point(e["v"]["x"] + mx / unit(mx, my), e["v"]["y"] + my / unit(mx, my))
        return F.when(F.abs(turn) < 1e-9, beside).otherwise(G.point(e["v"]["x"] + q["ox"] + q["dx"] * t, e["v"]["y"] + q["oy"] + q["dy"] * t))

    before = F.concat(F.slice("lines_", -1, 1), F.slice("lines_", 1, F.greatest(F.size("lines_") - 1, F.lit(0))))
    shrunk = lambda m: F.transform("out_", lambda p: G.point(F.col("mean_.x") + (p["x"] - F.col("mean_.x")) * F.pow(F.lit(0.92), m * (m + 1) / 2), F.col("mean_.y") + (p["y"] - F.col("mean_.y")) * F.pow(F.lit(0.92), m * (m + 1) / 2)))
    inside = lambda m: G.contains_ring(r, shrunk(m))
    m = F.when(G.contains_ring(r, F.col("out_")), 0).otherwise(F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.lit(24)), inside)), F.lit(25)))
    stages = plots.withColumn("area_", F.when(F.size(r) >= 3, G.signed_area(r))).withColumn("ahead_", F.when(F.col("area_").isNotNull(), ahead))
    stages = stages.withColumn("lines_", lines).withColumn("out_", F.zip_with(before, F.col("lines_"), corner)).withColumn("out_", F.when(G.area(F.col("out_")) >= 1e-6, F.col("out_")))
    stages = stages.withColumn("mean_", G.vertex_mean(F.col("out_"))).withColumn("m_", m).withColumn("inset", F.when(F.col("m_") == 0, F.col("out_")).otherwise(shrunk(F.col("m_"))))
    return stages.withColumn("inset", F.when(G.area(F.col("inset")) >= 1e-6, F.col("inset"))).drop("area_", "ahead_", "lines_", "out_", "mean_", "m_")


def relation_checks(plots: DataFrame, land_use: DataFrame) -> DataFrame:
    """feature_id, plot_id, site_contains_plot, in_range, useful: a land use is in range inside its plot or site, useful where it meets the plot.

    plots: plot_id, plot (ring), site (ring or null); land_use: feature_id, plot_id, shape (points).
    """
    j = land_use.join(plots.hint("merge"), "plot_id")
    inside = lambda r: F.coalesce(G.contains_ring(F.col(r), F.col("shape")), F.lit(False))
    return j.select("feature_id", "plot_id", F.coalesce(G.contains_ring(F.col("site"), F.col("plot")), F.lit(False)).alias("site_contains_plot"), (inside("plot") | inside("site")).alias("in_range"), (G.rings_meet(F.col("plot"), F.col("shape")) | inside("plot")).alias("useful"))


def boundary_summary(plots: DataFrame, land_use: DataFrame) -> DataFrame:
    """plot_id, plot_area, plot_perimeter, site_contains_plot, split_count, buildable_area.

    Land uses count in order of feature_id: a line splits all parts so far in two, a polygon with three points on the plot adds a part.
    The buildable area is that of the building polygons and of building lines' points on the plot, or the plot's where there are none.
    land_use: feature_id, plot_id, is_line, is_building, shape. A plot's land uses are one window group.
    """
    j = land_use.join(plots.select("plot_id", "plot").hint("merge"), "plot_id").withColumn("on", G.clipped(F.col("shape"), F.col("plot")))
    later = Window.partitionBy("plot_id").orderBy(F.desc("feature_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = j.withColumn("lines", F.count_if("is_line").over(later))
    piece = F.when(F.col("is_line"), F.col("on")).otherwise(F.col("shape"))
    sums = j.groupBy("plot_id").agg(
        F.sum(F.when(~F.col("is_line") & (F.size("on") >= 3), F.pow(F.lit(2.0), "lines")).otherwise(0.0)).alias("parts"), F.count_if("is_line").alias("cuts"),
        F.count_if("is_building").alias("zones"), F.sum(F.when(F.col("is_building") & (F.size(piece) >= 3), G.area(piece)).otherwise(0.0)).alias("zoned"),
    )
    own = G.area(F.col("plot"))
    out = plots.join(sums.hint("merge"), "plot_id", "left")
    split = F.pow(F.lit(2.0), F.coalesce("cuts", F.lit(0))) + F.coalesce("parts", F.lit(0.0))
    return out.select("plot_id", own.alias("plot_area"), G.perimeter(F.col("plot")).alias("plot_perimeter"), F.coalesce(G.contains_ring(F.col("site"), F.col("plot")), F.lit(False)).alias("site_contains_plot"), split.cast("long").alias("split_count"), F.when(F.coalesce("zones", F.lit(0)) > 0, F.col("zoned")).otherwise(own).alias("buildable_area"))


def plot_pick(entities: DataFrame) -> DataFrame:
    """file_id, its plot (the largest closed polyline, those on plot layers first) and the bounds of its lines; one aggregation, no window.

    Ties go to the smallest layer, x, y, w, h. A first choice without an area gives no plot.
    """
    closed = (F.col("etype") == "LWPOLYLINE") & F.col("closed")
    area = F.col("w") * F.col("h")
    rank = F.when(closed, F.struct((layer_class(F.col("layer")) != "plot").alias("other"), (-area).alias("a"), "layer", "x", "y", "w", "h"))
    drawn = lambda c: F.when(F.col("etype").isin("LWPOLYLINE", "LINE"), c)
    out = entities.groupBy("file_id").agg(F.min(rank).alias("p"), F.min(drawn(F.col("x"))).alias("x0"), F.min(drawn(F.col("y"))).alias("y0"), F.max(drawn(F.col("x") + F.col("w"))).alias("x1"), F.max(drawn(F.col("y") + F.col("h"))).alias("y1"))
    told = F.when(F.col("p.a") < 0, F.col("p"))
    return out.select("file_id", *(told[c].alias(c) for c in ("layer", "x", "y", "w", "h")), "x0", "y0", "x1", "y1")


def either_key(requests: DataFrame, plots: DataFrame) -> DataFrame:
    """request_id, plot_id, action: the lowest project plot whose parcel or external reference is the wanted one, else an insert.

    requests: request_id, project_id, wanted, has_geometry; plots: plot_id, project_id, parcel_id, external_ref. Each key is reduced to its
    lowest plot before the one join, so a key held by many plots doesn't multiply.
    """
    keys = plots.select("project_id", "plot_id", F.explode(F.array_distinct(F.array("parcel_id", "external_ref"))).alias("wanted")).where("wanted IS NOT NULL")
    first = keys.groupBy("project_id", "wanted").agg(F.min("plot_id").alias("plot_id"))
    out = requests.join(first.hint("merge"), ["project_id", "wanted"], "left")
    return out.select("request_id", "plot_id", F.when(F.col("plot_id").isNull(), "insert").when(F.col("has_geometry"), "update").otherwise("keep").alias("action"))


def nested(parents: DataFrame, children: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """parents with an array of their children (without the key), in order; empty for a parent without any. One parent's children are one row."""
    rest = [c for c in children.columns if c not in (key, *order)]
    per = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
    return parents.join(per.hint("merge"), key, "left").withColumn(name, F.coalesce(name, F.array()))


def first_distinct(rows: DataFrame, key: str, value: str, order: str, n: int = 6) -> DataFrame:
    """key and its first n distinct values, in order of their first place (ties by value); values are told apart before any are gathered."""
    per = rows.groupBy(key, value).agg(F.min(order).alias("at"))
    ranked = per.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("at", value))).where(F.col("r") <= n)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", value))), lambda x: x[value]).alias(value + "s"))


def on_warning(linked: DataFrame, k: int = 3) -> DataFrame:
    """The k best candidates of the requests whose match is ambiguous; the others have none."""
    warned = F.bool_or("ambiguous").over(Window.partitionBy("request_id"))
    return linked.where(F.col("rank") <= k).withColumn("warned", warned).where("warned").drop("warned")


def union_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """All layers' rows in one table with their layer's name; columns that a layer lacks are null."""
    named: Iterator[DataFrame] = (df.withColumn("layer_name", F.lit(name)) for name, df in layers.items())
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def merged_external(results: DataFrame, docs: DataFrame, catalogue: list[tuple[str, str | None]]) -> DataFrame:
    """doc_id, field_key, value, unit, confidence, status of every catalogue field of every document.

    results: doc_id, field_key, value, unit, confidence of an outside model, one row a field. A value without confidence has 0.75, no value
    is to be reviewed, with 0; the catalogue gives missing units.
    """
    listed = F.array(*(F.struct(F.lit(k).alias("field_key"), F.lit(u).cast("string").alias("own")) for k, u in catalogue))
    every = docs.select("doc_id", F.inline(listed))
    told = F.col("value").isNotNull()
    out = every.join(results.hint("merge"), ["doc_id", "field_key"], "left")
    return out.select("doc_id", "field_key", "value", F.coalesce(F.nullif("unit", F.lit("")), "own").alias("unit"), F.when(told, F.coalesce("confidence", F.lit(0.75))).otherwise(0.0).alias("confidence"), F.when(told, "EXTRACTED").otherwise("REQUIRES_REVIEW").alias("status"))
