"""Feature rows of GML feature collections, by pattern functions on the body column; no Python and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import let

PREFIX = r"(?:[\w.-]+:)?"
REST = r"(?:\s[^>]*)?(?<!/)>"
ELEMENT = rf"(?s)<([\w.:-]+){REST}.*?</\1>"
#: Children that are never properties, and entities of XML.
GEOMETRY_NAMES = ("boundedby", "geometryproperty", "shape")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def named(names: str) -> str:
    return rf"(?s)<({PREFIX}(?:{names})){REST}(.*?)</\1>"


def found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def ring(polygon: Column) -> Column:
    """The first coordinate list of a polygon: a posList (of srsDimension numbers a point) is closed where it is open, coordinates stay.

    Null for fewer than four points, or where something isn't a number.
    """
    first = rf"(?s)<{PREFIX}(posList|coordinates){REST}\s*([^<\s][^<]*)<"
    kind, text = F.regexp_extract(polygon, first, 1), F.trim(F.regexp_replace(F.regexp_extract(polygon, first, 2), r"\s+", " "))
    point = lambda x, y: F.struct(x.try_cast("double").alias("x"), y.try_cast("double").alias("y"))
    step = F.greatest(F.lit(2), F.coalesce(F.regexp_extract(polygon, r'srsDimension\s*=\s*["\'](\d+)', 1).try_cast("int"), F.lit(2)))
    listed = lambda numbers: F.when(F.size(numbers) >= 2, F.transform(F.sequence(F.lit(0), F.size(numbers) - 2, step), lambda i: point(F.get(numbers, i), F.get(numbers, i + 1))))
    closed = lambda points: F.when(F.get(points, F.lit(0)) != F.element_at(points, -1), F.concat(points, F.slice(points, 1, 1))).otherwise(points)
    pairs = lambda numbers: F.filter(F.transform(numbers, lambda p: F.split(p, ",")), lambda p: F.size(p) >= 2)
    good = lambda points: F.when((F.size(points) >= 4) & F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), points)
    told = lambda numbers: F.when(kind == "posList", let(listed(numbers), lambda ps: F.when(F.size(ps) >= 4, let(closed(ps), good)))).when(kind == "coordinates", let(F.transform(pairs(numbers), lambda p: point(F.get(p, F.lit(0)), F.get(p, F.lit(1)))), good))
    return let(F.split(text, " "), told)


def unescaped(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def properties(children: Column) -> Column:
    """Names and texts of the children without children of their own; the last of a name stays."""
    named_ = F.transform(children, lambda c: F.struct(F.regexp_extract(c, rf"^<{PREFIX}([\w.-]+)", 1).alias("key"), F.trim(unescaped(F.regexp_extract(c, r"(?s)^<[^>]*>\s*([^<]*?)\s*</[^>]*>$", 1))).alias("value")))
    told = F.filter(named_, lambda p: (p["value"] != "") & ~F.lower(p["key"]).isin(*GEOMETRY_NAMES))
    last = lambda told: F.filter(told, lambda p, i: ~F.exists(F.slice(told, i + 2, F.size(told)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(let(told, last))


def feature(element: Column) -> Column:
    children = found(F.regexp_replace(element, r"(?s)^<[^>]*>|</[^>]*>$", ""), ELEMENT)
    rings = lambda c: F.array_compact(F.transform(found(c, named("Polygon"), 0), ring))
    shapes = lambda children: F.filter(F.transform(children, rings), lambda r: F.size(r) > 0)
    id_ = F.nullif(F.regexp_extract(element, r'^<[^>]*?\s(?:[\w.-]+:id|fid)\s*=\s*["\']([^"\']*)', 1), F.lit(""))
    return let(children, lambda found_: F.struct(id_.alias("id"), properties(found_).alias("properties"), F.get(shapes(found_), F.lit(0)).alias("rings")))


def gml_features(payloads: DataFrame) -> DataFrame:
    """payload_id, n, id, properties (map), rings of each feature with a polygon; several rings are a multi-polygon.

    Features are the children of each featureMember or member; only where these give none, those of featureMembers. A body that is null,
    broken or of another kind gives no rows. Comments and CDATA aren't told apart from text.
    """
    of = lambda names: F.filter(F.transform(F.flatten(F.transform(found(F.col("body"), named(names), 2), lambda m: found(m, ELEMENT))), feature), lambda f: f["rings"].isNotNull())
    told = payloads.select("payload_id", "body", of("featureMember|member").alias("single"))
    every = told.select("payload_id", F.when(F.size("single") > 0, F.col("single")).otherwise(of("featureMembers")).alias("f"))
    return every.select("payload_id", F.posexplode("f").alias("n", "f")).select("payload_id", "n", "f.*")
