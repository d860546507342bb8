"""CAD entity tables: layers, units, normalised drawings and boundary candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import compactness
from ..functions.text import layer_class
from ..lineage import cut

#: Unit codes of a drawing's header, names and metres.
UNITS = [(1, "inch", 0.0254), (2, "foot", 0.3048), (3, "mile", 1609.344), (4, "mm", 0.001), (5, "cm", 0.01), (6, "m", 1.0), (7, "km", 1000.0), (8, "microinch", 0.0000254), (9, "mil", 0.0000254), (10, "yard", 0.9144), (11, "angstrom", 1e-10), (12, "nanometer", 1e-9), (13, "micron", 1e-6), (14, "dm", 0.1), (15, "dam", 10.0), (16, "hm", 100.0), (17, "gm", 1e9), (18, "au", 149597870700.0), (19, "ly", 9460730472580800.0), (20, "pc", 30856775814913700.0)]
#: Words in the names of layers that hold plot boundaries.
BOUNDARY_WORDS = "dzialka|działka|dzialki|granica|granice|boundary|parcel|plot|egb|egib|kontur"
HINT_WORDS = "dzialk|działk|parcel|plot|granica|boundary"


def layer_summary(entities: DataFrame) -> DataFrame:
    """file_id, layer, n, class, types: the number of each kind of entity, by name."""
    per = entities.groupBy("file_id", "layer", "etype").agg(F.count("*").alias("n"))
    types = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("etype", "n"))), lambda e: F.concat(e["etype"], F.lit("="), e["n"].cast("string"))), ",")
    return per.groupBy("file_id", "layer").agg(F.sum("n").alias("n"), types.alias("types")).withColumn("class", layer_class(F.col("layer")))


def layer_details(entities: DataFrame) -> DataFrame:
    """file_id, layer, and the sorted different line types, colours, block names and attribute tags of its entities, joined by commas.

    entities: also linetype, colour, block (of INSERT entities only, as are tags) and tags (an array). Missing names are left out.
    """
    block = F.col("etype") == "INSERT"
    named = F.array(*(F.struct(F.lit(kind).alias("kind"), value.alias("name")) for kind, value in (("line_types", F.col("linetype")), ("colours", F.col("colour")), ("blocks", F.when(block, F.col("block"))))))
    tags = F.transform(F.when(block, F.coalesce("tags", F.array())).otherwise(F.array().cast("array<string>")), lambda t: F.struct(F.lit("attributes").alias("kind"), t.alias("name")))
    told = entities.select("file_id", "layer", F.explode(F.concat(named, tags)).alias("x")).where("x.name <> ''").select("file_id", "layer", "x.kind", "x.name").distinct()
    kinds = ("line_types", "colours", "blocks", "attributes")
    names = told.groupBy("file_id", "layer").agg(*(F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("name")))), ",").alias(k) for k in kinds))
    every = entities.select("file_id", "layer").distinct()
    return every.join(names.hint("merge"), ["file_id", "layer"], "left").select("file_id", "layer", *(F.coalesce(k, F.lit("")).alias(k) for k in kinds))


def signatures(entities: DataFrame) -> DataFrame:
    return entities.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set(F.lower("layer"))), "|").alias("signature"))


def bounds(entities: DataFrame) -> DataFrame:
    fine = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    return entities.groupBy("file_id").agg(F.min(fine(F.col("x"))).alias("x0"), F.min(fine(F.col("y"))).alias("y0"), F.max(fine(F.col("x") + F.col("w"))).alias("x1"), F.max(fine(F.col("y") + F.col("h"))).alias("y1"))


def unit_of(code: Column, diagonal: Column) -> tuple[Column, Column, Column]:
    """Name, metres and source of a drawing's unit: by the header's code, else by the size."""
    table = lambda i, t: F.create_map(*(F.lit(x) for u in UNITS for x in (u[0], t(u[i]))))[code]
    known = code.between(1, 20)
    name = F.when(known, table(1, str)).when(diagonal > 10_000, "mm").when(diagonal > 1_000, "cm").otherwise("m")
    scale = F.when(known, table(2, float)).when(diagonal > 10_000, 0.001).when(diagonal > 1_000, 0.01).otherwise(1.0)
    return name, scale, F.when(known, "header").otherwise("heuristic")


def with_units(boxes: DataFrame, code: Column) -> DataFrame:
    name, scale, source = unit_of(code, F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    return boxes.select("file_id", name.alias("unit"), scale.alias("scale"), source.alias("source"))


def normalised(entities: DataFrame, boxes: DataFrame, units: DataFrame) -> DataFrame:
    """Entities moved to the drawing's smallest corner and scaled to metres."""
    out = entities.join(boxes.hint("merge"), "file_id").join(units.select("file_id", "scale").hint("merge"), "file_id")
    return out.select("file_id", "layer", "etype", "closed", *(((F.col(c) - F.col(o)) * F.col("scale")).alias(c) for c, o in (("x", "x0"), ("y", "y0"))), *((F.col(c) * F.col("scale")).alias(c) for c in ("w", "h")))


def layer_hints(entities: DataFrame, boxes: DataFrame, k: int = 8) -> DataFrame:
    """file_id, layer, score, rank: 2 for the name, 1 for a closed line, 1 for a mean area of note; the k best of each file."""
    closed = F.when(F.col("closed"), F.col("w") * F.col("h"))
    per = entities.groupBy("file_id", "layer").agg(F.bool_or("closed").alias("any_closed"), F.avg(closed).alias("mean_area"))
    whole = boxes.select("file_id", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("map_area"))
    score = F.when(F.lower("layer").rlike(HINT_WORDS), 2).otherwise(0) + F.col("any_closed").cast("int") + F.when(F.col("mean_area") >= F.greatest(F.lit(25.0), 0.002 * F.col("map_area")), 1).otherwise(0)
    told = per.join(whole.hint("merge"), "file_id").select("file_id", "layer", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("score"), "layer"))
    return told.withColumn("rank", rank).where(F.col("rank") <= k)


def parcel_layers(entities: DataFrame, hints: DataFrame) -> DataFrame:
    """file_id, layer: all of the best score, or, where none scores, of the most closed lines."""
    n = entities.groupBy("file_id", "layer").agg(F.count_if("closed").alias("n_closed"))
    w = Window.partitionBy("file_id")
    told = hints.join(n.hint("merge"), ["file_id", "layer"]).withColumn("best", F.max("score").over(w)).withColumn("most", F.max("n_closed").over(w))
    return told.where("(best > 0 AND score = best) OR (best <= 0 AND n_closed = most)").select("file_id", "layer")


def boundary_candidates(entities: DataFrame, boxes: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """file_id, layer, x, y, w, h, score, rank, confidence of the closed outlines, the best first.

    Outlines below 5 % of the map (and 1) go unless that leaves none. One candidate is sure to 1 with a telling layer name,
    else to 0.85; of several the best is sure to 0.5 and half its lead (at most 0.95), 0.1 more with a telling name.
    """
    whole = boxes.select("file_id", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("map_area"))
    area = F.col("w") * F.col("h")
    shapes = entities.where("closed AND w > 0 AND h > 0").select("file_id", "layer", "x", "y", "w", "h").distinct().withColumn("area", area).join(whole.hint("merge"), "file_id")
    w = Window.partitionBy("file_id")
    large = F.col("area") >= F.greatest(F.lit(1.0), 0.05 * F.col("map_area"))
    shapes = shapes.withColumn("large", large).withColumn("any_large", F.bool_or("large").over(w)).where("large OR NOT any_large").withColumn("top", F.max("area").over(w))
    ratio, round_ = F.col("area") / F.col("map_area"), compactness(F.col("area"), 2 * (F.col("w") + F.col("h")))
    by_ratio = F.when(ratio <= 0, 0.0).when((ratio > 0.9) | (ratio < 0.0001), -0.4).when((ratio >= 0.01) & (ratio <= 0.6), 0.4).when(ratio < 0.01, 0.15).otherwise(0.1)
    by_shape = F.when(round_ < 0.05, -0.2).when(round_ > 0.7, 0.25).when(round_ > 0.2, 0.15).otherwise(0.0)
    telling = F.lower("layer").rlike(BOUNDARY_WORDS)
    score = F.when(telling, 2.0).otherwise(0.0) + 1.0 + F.col("area") / F.col("top") + by_ratio + by_shape
    if preferred is not None:
        shapes = shapes.join(preferred.select("file_id", F.col("layer").alias("preferred")).hint("merge"), "file_id", "left")
        score = score + F.when(F.col("layer") == F.col("preferred"), 1.0).otherwise(0.0)
    order = w.orderBy(F.desc("score"), F.desc("area"), "layer", "x", "y", "w", "h")
    ranked = shapes.withColumn("score", F.round(score, 9)).withColumn("rank", F.row_number().over(order)).withColumn("n", F.count("*").over(w)).withColumn("next", F.lead("score").over(order))
    several = F.least(F.lit(1.0), F.least(F.lit(0.95), 0.5 + (F.col("score") - F.col("next")) / 2) + F.when(telling, 0.1).otherwise(0.0))
    sure = F.when(F.col("rank") == 1, F.when(F.col("n") == 1, F.when(telling, 1.0).otherwise(0.85)).otherwise(several))
    return ranked.select("file_id", "layer", "x", "y", "w", "h", F.round("score", 6).alias("score"), "rank", F.round(sure, 6).alias("confidence"))


def main_boundary(candidates: DataFrame) -> DataFrame:
    """The largest candidate of each file, whatever its score, with the job's status by the best one's confidence."""
    order = F.struct(F.col("w") * F.col("h"), -F.col("rank"))
    out = candidates.groupBy("file_id").agg(F.max_by(F.struct("layer", "x", "y", "w", "h"), order).alias("b"), F.max("confidence").alias("confidence"))
    return out.select("file_id", "b.*", F.when(F.col("confidence") >= 0.8, "COMPLETED").otherwise("NEEDS_REVIEW").alias("status"))


def nearest_label(entities: DataFrame) -> DataFrame:
    """file_id and a closed outline's box with the layer and distance of the nearest text of its file (from the centre; ties: label, place).

    Texts lie in grid cells, about one a cell at first. An outline looks into its cell and the eight around; a text nearer than a cell is wide is
    proven to be the nearest. The others look again in cells twice as wide, until a cell is as wide as their drawing, so each meets but few texts.
    """
    box = entities.where("closed AND etype <> 'TEXT'").select("file_id", "x", "y", "w", "h").distinct().withColumn("cx", F.col("x") + F.col("w") / 2).withColumn("cy", F.col("y") + F.col("h") / 2)
    text = entities.where("etype = 'TEXT'").select("file_id", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("layer").alias("label")).distinct()
    reach = lambda df, x, y, n: df.groupBy("file_id").agg(F.count("*").alias(n), *(f(c).alias(f"{n}{name}{a}") for f, name in ((F.min, "lo"), (F.max, "hi")) for c, a in ((x, "x"), (y, "y"))))
    files = reach(text, "tx", "ty", "t").join(reach(box, "cx", "cy", "b").hint("merge"), "file_id")
    wide = F.greatest(*(F.greatest(f"thi{a}", f"bhi{a}") - F.least(f"tlo{a}", f"blo{a}") for a in "xy"))
    files = cut(files.select("file_id", wide.alias("extent"), F.greatest(wide / F.sqrt("t"), F.lit(1e-3)).alias("size")))
    text, left, proven, level = text.join(files.hint("merge"), "file_id"), box.join(files.hint("merge"), "file_id"), [], 0
    place = lambda c: F.floor(F.col(c) / (F.col("size") * 2**level))
    while not proven or not left.isEmpty():
        around = F.array(*(F.struct((place("cx") + i).alias("i"), (place("cy") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        here = text.select("file_id", place("tx").alias("i"), place("ty").alias("j"), "tx", "ty", "label")
        d = F.when(F.col("label").isNotNull() | F.col("tx").isNotNull(), F.round(F.hypot(F.col("cx") - F.col("tx"), F.col("cy") - F.col("ty")), 6))
        met = cut(left.select("*", F.inline(around)).join(here.hint("merge"), ["file_id", "i", "j"], "left").groupBy(*left.columns).agg(F.min(F.when(d.isNotNull(), F.struct(d.alias("distance"), "label", "tx", "ty"))).alias("t")))
        cell = F.col("size") * 2**level
        sure = F.coalesce(F.col("t.distance") < cell - 1e-6, F.lit(False)) | (cell > F.col("extent"))
        proven.append(met.where(sure).select("file_id", "x", "y", "w", "h", "t.label", "t.distance"))
        left, level = met.where(~sure).drop("t"), level + 1
    return reduce(lambda a, b: a.unionByName(b), proven)


def polygon_features(entities: DataFrame, k: int = 200) -> DataFrame:
    """file_id, layer, area, perimeter, label, distance, rank of a file's closed outlines, the first k by layer and place; label: of the nearest text.

    Places are counted by layer first, so only a file's layers, and a layer's own outlines, share a window.
    """
    closed = entities.where("closed AND etype <> 'TEXT'").select("file_id", "layer", "x", "y", "w", "h").distinct()
    within = closed.withColumn("own_", F.row_number().over(Window.partitionBy("file_id", "layer").orderBy("x", "y", "w", "h"))).where(F.col("own_") <= k)
    sizes = closed.groupBy("file_id", "layer").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("file_id").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = within.join(sizes.withColumn("before_", before).hint("merge"), ["file_id", "layer"]).withColumn("rank", F.col("own_") + F.col("before_")).where(F.col("rank") <= k)
    near = nearest_label(entities)
    out = first.join(near.hint("merge"), ["file_id", "x", "y", "w", "h"], "left")
    return out.select("file_id", "layer", "x", "y", "w", "h", (F.col("w") * F.col("h")).alias("area"), (2 * (F.col("w") + F.col("h"))).alias("perimeter"), "label", "distance", F.col("rank").cast("int").alias("rank"))
