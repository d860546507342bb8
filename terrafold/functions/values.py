"""Small value functions: Column in, Column out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb; near-white, which can't be seen on paper, becomes black."""
    part = lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))
    return F.when((r >= 250) & (g >= 250) & (b >= 250), "#000000").otherwise(F.concat(F.lit("#"), part(r), part(g), part(b)))


def display(value: Column, unit: Column) -> Column:
    return F.when(value.isNotNull(), F.concat_ws(" ", value, F.nullif(F.trim(unit), F.lit(""))))


def expiry(created: Column, seconds: int = 86_400) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(created) + seconds)


def safe_float(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def arc_points(sweep: Column) -> Column:
    """Into how many pieces an arc is cut: at least 8, 32 for a full turn."""
    return F.greatest(F.lit(8), F.floor(32 * F.abs(sweep) / (2 * F.pi())).cast("int"))


def search_predicate(mapping: dict[str, str], number: Column, precincts: Column, locality: Column) -> Column:
    """A register's search by its column names: number, any precinct variant, locality by a part of its name; absent names are not asked."""
    parts = []
    if "number" in mapping:
        parts.append(F.col(mapping["number"]) == number)
    if "precinct" in mapping:
        parts.append((F.size(precincts) == 0) | F.array_contains(precincts, F.col(mapping["precinct"])))
    if "locality" in mapping:
        parts.append(locality.isNull() | F.contains(F.lower(mapping["locality"]), F.lower(locality)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def typed(json_text: Column) -> tuple[Column, Column]:
    """The text to keep and its type: JSON, BOOLEAN, INTEGER, NUMBER or TEXT; text that isn't JSON stays as it is."""
    # The parser stops after the first value, so what may follow it is told by the text's shape.
    whole = json_text.rlike(r'(?s)^\s*(\{.*\}|\[.*\]|".*"|true|false|null|-?\d[-+.\deE]*)\s*$')
    v = F.when(whole, F.try_parse_json(json_text))
    schema = F.schema_of_variant(v)
    kind = (
        F.when(schema.rlike("^(OBJECT|ARRAY)"), "JSON").when(schema == "BOOLEAN", "BOOLEAN").when(json_text.rlike(r"^\s*-?\d+\s*$"), "INTEGER")
        .when(schema.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "NUMBER").otherwise("TEXT")
    )
    value = F.when(v.isNull(), json_text).when(schema == "STRING", F.try_variant_get(v, "$", "string")).when(schema != "VOID", F.trim(json_text))
    return value, kind


def form_columns(form: Column, names: dict[str, str], decimals: set[str] = frozenset()) -> Column:
    """A form's map by the register's column names: unknown keys go, empty texts become null, decimals (columns) take a comma or a point."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    known = F.transform_keys(F.map_filter(form, lambda k, v: k.isin(*names)), lambda k, v: table[k])
    decimal = lambda v: F.replace(F.trim(v), F.lit(","), F.lit(".")).try_cast("double").cast("string")
    return F.transform_values(known, lambda k, v: F.when(k.isin(*decimals), decimal(v)).otherwise(F.nullif(v, F.lit(""))))


#: Source types of layers that are derived; all others are imported.
DERIVED_TYPES = ("analysis", "derived")


def source_kind(status: Column, source_type: Column) -> Column:
    """The status goes before the source type."""
    return F.when(status == "manual_placeholder", "placeholder").when(status == "derived", "derived").when(source_type.isin(*DERIVED_TYPES), "derived").otherwise("imported")
