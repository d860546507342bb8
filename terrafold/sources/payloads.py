"""Stored payloads of map services: formats, features, rejects, and nested export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upload kinds (extension, media type) and their largest size.
UPLOADS = [("pdf", "application/pdf", 20 << 20), ("png", "image/png", 20 << 20), ("jpg", "image/jpeg", 20 << 20), ("jpeg", "image/jpeg", 20 << 20), ("dxf", "application/dxf", 50 << 20), ("dwg", "application/acad", 50 << 20)]
COLLECTION = "type string, features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def payload_format(body: Column) -> Column:
    """What a body is by its first 300 characters: empty, json, html, xml_exception, gml_xml, xml or unknown."""
    head = F.lower(F.substr(F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+", "")), F.lit(1), F.lit(300)))
    return (
        F.when(head == "", "empty").when(head.startswith("{") | head.startswith("["), "json").when(head.startswith("<!doctype html") | head.contains("<html"), "html")
        .when(head.startswith("<") & head.contains("exceptionreport"), "xml_exception").when(head.startswith("<") & (head.contains("featurecollection") | head.contains("gml")), "gml_xml").when(head.startswith("<"), "xml").otherwise("unknown")
    )


def parsed_collections(payloads: DataFrame) -> DataFrame:
    """payload_id, format, error (null for good ones) and the parsed collection c."""
    told = payloads.withColumn("format", payload_format(F.col("body"))).withColumn("c", F.when(F.col("format") == "json", F.from_json("body", COLLECTION, {"mode": "PERMISSIVE"})))
    bad = F.when(F.col("format") == "empty", "empty_response").when(F.col("format") == "html", "html_response").when(F.col("format") == "xml_exception", "service_exception").when(F.col("format") != "json", "unsupported")
    broken = F.when(F.try_parse_json("body").isNull(), "invalid_json").when(F.col("c.features").isNull(), "missing_features")
    return told.withColumn("error", F.coalesce(bad, broken))


def features(payloads: DataFrame) -> DataFrame:
    """payload_id, n, number, geom_type, coordinates of the features of good payloads."""
    good = parsed_collections(payloads).where("error IS NULL")
    return good.select("payload_id", F.posexplode("c.features").alias("n", "f")).select("payload_id", "n", F.col("f.properties")["numer_dzialki"].alias("number"), F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def quarantine(payloads: DataFrame) -> DataFrame:
    return parsed_collections(payloads).where("error IS NOT NULL").select("payload_id", "format", "error")


def parcel_reply(payload: Column, requested: Column) -> tuple[Column, Column, Column]:
    """id, wkb_hex, wkt of a JSON or a delimited reply."""
    json = payload.startswith("{")
    parts = F.filter(F.transform(F.split(F.replace(payload, F.lit("|"), F.lit(";")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    geometry = lambda x: F.upper(x).rlike(r"^(SRID=\d+;)?(POINT|LINESTRING|POLYGON|MULTI)")
    hexes = lambda x: x.rlike("^[0-9A-Fa-f]{10,}$") & (F.length(x) % 2 == 0)
    first = lambda test: F.get(F.filter(parts, test), F.lit(0))
    names = first(lambda x: ~geometry(x) & ~hexes(x) & (x.contains("_") | x.contains(".")))
    id_ = F.when(json, F.get_json_object(payload, "$.id")).otherwise(F.coalesce(names, F.get(parts, F.lit(0))))
    return F.coalesce(id_, requested), F.when(json, F.get_json_object(payload, "$.geom_wkb")).otherwise(first(hexes)), F.when(json, F.get_json_object(payload, "$.geom_wkt")).otherwise(first(geometry))


def wkt_ring(wkt: Column) -> Column:
    """The first ring of a WKT geometry."""
    ring = F.regexp_extract(wkt, r"\(\s*([-0-9.eE+ ,]+?)\s*\)", 1)
    pair = lambda p: F.split(F.trim(p), r"\s+")
    return F.when(ring != "", F.transform(F.split(ring, ","), lambda p: F.struct(F.get(pair(p), F.lit(0)).try_cast("double").alias("x"), F.get(pair(p), F.lit(1)).try_cast("double").alias("y"))))


def gml_rings(body: Column) -> Column:
    """The coordinate lists of a GML body's polygons as arrays of numbers."""
    lists = F.xpath(body, F.lit("//*[local-name()='posList']/text()"))
    return F.transform(lists, lambda s: F.transform(F.split(F.trim(s), r"\s+"), lambda x: x.try_cast("double")))


def decoded(value: Column) -> tuple[Column, Column]:
    """A JSON value, and the raw string where it isn't JSON."""
    parsed = F.try_parse_json(value)
    return F.to_json(parsed), F.when(parsed.isNull(), value)


def eligible(files: DataFrame) -> DataFrame:
    """files (name, media_type, size) with reject_reason: extension, media type, emptiness, size, in this order."""
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    kind = F.create_map(*(F.lit(x) for e, m, _ in UPLOADS for x in (e, m)))[ext]
    most = F.create_map(*(F.lit(x) for e, _, s in UPLOADS for x in (e, s)))[ext]
    return files.withColumn("reject_reason", F.when(kind.isNull(), "EXTENSION").when(F.lower("media_type") != kind, "MEDIA_TYPE").when(F.col("size") <= 0, "EMPTY").when(F.col("size") > most, "TOO_LARGE"))


def exported(features: DataFrame, key: str) -> DataFrame:
    """key, json: each key's features as a FeatureCollection with the layer among the properties."""
    one = F.to_json(F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("layer"), F.col("layer_key"), F.lit("feature_id"), F.col("feature_id").cast("string")).alias("properties")))
    every = F.array_sort(F.collect_list(F.struct("feature_id", one.alias("json"))))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform(every, lambda x: x["json"]), ","), F.lit("]}"))
    return features.groupBy(key).agg(text.alias("json"))


def write_partial(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite", by: str | None = None) -> dict[str, str]:
    """Writes each table to folder/name; one that fails is reported and doesn't stop the others."""
    done = {}
    for name, df in tables.items():
        try:
            writer = df.write.mode(mode)
            (writer.partitionBy(by) if by and by in df.columns else writer).parquet(f"{folder}/{name}")
            done[name] = "ok"
        except Exception as e:  # noqa: BLE001  each table stands alone
            done[name] = f"error: {type(e).__name__}"
    return done
