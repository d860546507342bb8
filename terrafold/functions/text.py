"""Text functions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import let

#: Characters that scanners take for letters, and the letters.
LOOKALIKES = ("1034528", "ioeaszb")
LETTERS = "A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


#: Letters with accents, and without.
ACCENTS = ("ąćęńóśźżäöüéèêëàâçîïôùûñíáúì", "acenoszzaoueeeeaaciiouuniaui")


def strip_marks(c: Column) -> Column:
    """Accents go, ł stays; for the lower-case alphabets in use."""
    return F.translate(c, *ACCENTS)


def strip_marks_and_l(c: Column) -> Column:
    return strip_marks(F.translate(c, "łŁ", "lL"))


def fold(c: Column) -> Column:
    """Lower case, single spaces, no accents, scanners' digits as letters."""
    return F.translate(squeeze(F.lower(c)), *(a + b for a, b in zip(ACCENTS, LOOKALIKES)))


def similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def clean_value(c: Column) -> Column:
    return let(F.trim(F.regexp_replace(squeeze(c), r"[,:;.)]+$", "")), lambda out: F.when(out != "", out))


def free_value(c: Column) -> Column:
    out = F.regexp_replace(squeeze(c), r"^[ ,;]+|[ ,;]+$", "")
    return F.when(out != "", out)


def scan_penalty(c: Column) -> Column:
    """0.15 for a text with few letters, else 0."""
    text = F.coalesce(c, F.lit(""))
    letters, digits, full = F.regexp_count(text, F.lit(f"[{LETTERS}]")), F.regexp_count(text, F.lit(r"\d")), F.length(F.regexp_replace(text, r"\s+", ""))
    return F.when((full < 60) | (letters < 35), 0.15).when((letters + digits) / full < 0.55, 0.15).otherwise(0.0)


def land_use_symbol(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))


def network_class(c: Column) -> Column:
    """Class of a connection error's text, the first that fits (fixed values)."""
    text = F.lower(c)
    rules = [
        ("PROXY_CONNECT_403", ("tunnel connection failed: 403",)),
        ("DNS_ERROR", ("name or service not known", "temporary failure in name resolution")),
        ("TCP_TIMEOUT", ("timed out", "timeout")),
        ("TLS_ERROR", ("ssl", "certificate", "tls")),
        ("NETWORK_UNREACHABLE", ("network is unreachable", "no route to host")),
        ("TCP_BLOCKED", ("connection refused", "failed to establish a new connection")),
    ]
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for code, marks in rules:
        test = F.lit(False)
        for mark in marks:
            test = test | text.contains(mark)
        out = out.when(test, code)
    return out.otherwise("NETWORK_ERROR")


def layer_class(c: Column) -> Column:
    """What a CAD layer shows, by the first word list that its name meets (fixed values)."""
    name = F.lower(c)
    rules = [
        ("plot", "granica|dzialk|działk|boundary|plot|parcel"), ("road", "droga|road|street"), ("building", "budynek|building|neighbor|sasiad|sąsiad"), ("water", "woda|water|hydrant"),
        ("gas", "gaz|gas"), ("power", "prad|prąd|electric|power|elek"), ("sewer", "kanal|kanaliz|sewer|sanit"), ("terrain", "teren|height|elev|contour|rzędn"),
    ]
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, words in rules:
        out = out.when(name.rlike(words), label)
    return out.otherwise("other")


def normal_text(c: Column) -> Column:
    """One kind of line end, dash and blank, no control characters, no empty lines."""
    steps = ((r"\r\n?", "\n"), (r"[\x00-\x09\x0B-\x1F\x7F]", ""), ("[‐‑‒–—−]", "-"), (r"[ \t]+", " "), (r"\n{2,}", "\n"))
    for pattern, put in steps:
        c = F.regexp_replace(c, pattern, put)
    return F.regexp_replace(c, r"^\s+|\s+$", "")


#: Words that end a street's or a place's name.
STREET_ENDS = r"(?iU)\s+\b(miejscowość|miejscowosc|miasto|gm\.?|gmina|obr[eę]b|dzielnic\w*)\b.*$"
PLACE_ENDS = r"(?iU)\s+\b(gmina|gm\.?|powiat|wojew[oó]dztwo|obr[eę]b)\b.*$"


def street_name(c: Column) -> Column:
    out = F.regexp_replace(squeeze(c), r"^[ ,.;]+|[ ,.;]+$", "")
    for pattern in (r"\s+\d{2}-\d{3}.*$", STREET_ENDS, ",.*$", r"(?iU)\s+w\s+dzielnic\w*\s+.*$"):
        out = F.regexp_replace(out, pattern, "")
    return F.when(c != "", F.regexp_replace(out, r"^[ ,.;]+|[ ,.;]+$", ""))


def place_name(c: Column) -> Column:
    out = F.regexp_replace(squeeze(c), r"^[ .,]+|[ .,]+$", "")
    for pattern in (r"\s+\d{2}-\d{3}.*$", PLACE_ENDS, ",.*$"):
        out = F.regexp_replace(out, pattern, "")
    return F.when(c != "", F.when(F.lower(out).startswith("warszaw") & F.lower(out).endswith("wie"), "Warszawa").otherwise(out))
