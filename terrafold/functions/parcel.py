"""Parcel numbers, precincts and localities: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_marks_and_l

SEPARATORS = r"[.\-\\/]+"


def compact(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit("")), SEPARATORS, "/")


def canonical(c: Column) -> Column:
    """A typed number: one slash, leading zeros kept, a part after the slash of 0 dropped."""
    parts = F.split(compact(c), "/", 2)
    part = lambda i: F.coalesce(F.nullif(F.get(parts, F.lit(i)), F.lit("")), F.lit("0"))
    return F.when(part(1) != "0", F.concat(part(0), F.lit("/"), part(1))).otherwise(part(0))


def register_number(c: Column) -> Column:
    """A register's number: as canonical, but a 0 after the slash stays; an empty one stays empty."""
    text = compact(c)
    parts = F.split(text, "/", 2)
    part = lambda i: F.coalesce(F.nullif(F.get(parts, F.lit(i)), F.lit("")), F.lit("0"))
    return F.when(text == "", "").when(text.contains("/"), F.concat(part(0), F.lit("/"), part(1))).otherwise(text)


def text_number(c: Column) -> Column:
    """A number found in text: odd slashes made plain, leading zeros of each part dropped."""
    plain = F.regexp_replace(F.translate(F.regexp_replace(c, r"\s+", ""), "／\\⁄", "///"), r"/+", "/")
    return F.array_join(F.transform(F.split(plain, "/"), lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")), "/")


def padded(c: Column) -> Column:
    short = F.regexp_replace(c, r"^0+(?=\d)", "")
    return F.when(F.length(short) < 4, F.lpad(short, 4, "0")).otherwise(short)


def precinct_variants(c: Column) -> Column:
    raw = F.trim(F.coalesce(c, F.lit("")))
    digits = F.nullif(F.regexp_replace(raw, r"[^0-9]", ""), F.lit(""))
    chunks = F.filter(F.split(raw, "[^0-9A-Za-z]+"), lambda x: x != "")
    last = F.when(F.try_element_at(chunks, F.lit(-1)).rlike("^[0-9]+$"), F.try_element_at(chunks, F.lit(-1)))
    return F.array_distinct(F.array_compact(F.array(F.nullif(raw, F.lit("")), digits, padded(digits), last, padded(last))))


def locality_variants(c: Column) -> Column:
    raw = F.trim(F.coalesce(c, F.lit("")))
    return F.array_distinct(F.filter(F.array(raw, F.lower(raw), strip_marks_and_l(F.lower(raw))), lambda x: x != ""))


def looks_like_id(c: Column) -> Column:
    return F.coalesce(c.contains("_") & c.contains("."), F.lit(False))
