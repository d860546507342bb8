"""Whole documents as flat forms: fields by pattern with the plot's location (P4), and the key sentence's fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_value
from ..functions.values import let
from .extraction import WIDE
from .location import MONTHS, first_pages, holds, issue_sign, located, long_date, plain

#: Key, pattern (value in group 1), kind of value. A key's second pattern is for texts without a match of its first.
PATTERNS = [
    ("wydany_dla", r"(?:wydany dla|dla)\s*[:\-]?\s*([^\n]{3,120})", "clean"),
    ("symbol_terenu_mpzp", r"(?:symbol\s+terenu|przeznaczenie\s+terenu)\s*[:\-]?\s*([A-Z0-9/.-]{1,8})", "upper"),
    ("symbol_terenu_mpzp", r"\b([A-Z]{1,3}(?:/[A-Z0-9]{1,3})?)\s*[–-]\s*[^\n]+", "upper"),
    ("status_planu", r"\b(obowiązuje|zmiana|brak)\b", "lower"),
    ("podstawa_prawna", r"(uchwała[^,\n]+(?:nr|numer)?\s*[A-Za-z0-9./-]+[^,\n]*\d{4})", "trim"),
    ("przeznaczenie_podstawowe", r"przeznaczenie podstawowe[^\n]*[:\-]?\s*([^\n]+)", "trim"),
    ("przeznaczenie_podstawowe", r"\b[A-Z]{1,3}(?:/[A-Z0-9]{1,3})?\s*[–-]\s*([^\n]+)", "trim"),
    ("przeznaczenie_dopuszczalne", r"przeznaczenie dopuszczalne[^\n]*[:\-]?\s*([^\n]+)", "trim"),
    ("funkcje_zakazane", r"(zakaz[^\n\.]+|nie dopuszcza się[^\n\.]+)", "trim"),
    ("mozliwosc_laczenia_funkcji", r"(?:możliwość|mozliwosc)\s+łączenia\s+funkcji[^\n]*[:\-]?\s*(tak|nie)", "trim"),
    ("max_wysokosc", r"(?:maksymalna wysoko(?:ść|sc)|wysoko(?:ść|sc) zabudowy)[^\d]{0,20}(\d+[,.]?\d*)\s*m", "number"),
    ("max_liczba_kondygnacji_nadziemnych", r"(?:maksymalna liczba kondygnacji nadziemnych|liczba kondygnacji nadziemnych)[^\d]{0,20}(\d+)", "number"),
    ("max_liczba_kondygnacji_podziemnych", r"(?:maksymalna liczba kondygnacji podziemnych|liczba kondygnacji podziemnych)[^\d]{0,20}(\d+)", "number"),
    ("max_wysokosc_kalenicy", r"(?:maksymalna wysoko(?:ść|sc) kalenicy|wysoko(?:ść|sc) kalenicy)[^\d]{0,20}(\d+[,.]?\d*)\s*m", "number"),
    ("max_wysokosc_okapu", r"(?:maksymalna wysoko(?:ść|sc) okapu|wysoko(?:ść|sc) okapu)[^\d]{0,20}(\d+[,.]?\d*)\s*m", "number"),
    ("min_intensywnosc", r"(?:minimalna|min\.?)\s*intensywność zabudowy[^\d]{0,20}(\d+[,.]?\d*)", "number"),
    ("max_intensywnosc", r"(?:maksymalna|max\.?)\s*intensywność zabudowy[^\d]{0,20}(\d+[,.]?\d*)", "number"),
    ("max_intensywnosc", r"intensywność zabudowy[^\d]{0,20}(\d+[,.]?\d*)", "number"),
    ("max_pow_zabudowy", r"(?:maksymalna powierzchnia zabudowy|powierzchnia zabudowy)[^\d]{0,20}(\d+[,.]?\d*)\s*(?:%|m2|m²)", "number"),
    ("min_pow_biol_czynna", r"powierzchni[a]?\s+biologicznie\s+czynn(?:a|ej)[^\d]{0,20}(\d+[,.]?\d*)\s*(?:%|m2|m²)", "number"),
    ("min_szerokosc_elewacji_frontowej", r"(?:minimalna|min\.?)\s*szerokość elewacji frontowej[^\d]{0,20}(\d+[,.]?\d*)\s*m", "number"),
    ("max_szerokosc_elewacji_frontowej", r"(?:maksymalna|max\.?)\s*szerokość elewacji frontowej[^\d]{0,20}(\d+[,.]?\d*)\s*m", "number"),
    ("linie_zabudowy", r"(linie zabudowy[^\n]+)", "trim"),
    ("dach_typ", r"(dach\s+(?:dwuspadowy|wielospadowy|płaski|jednospadowy))", "trim"),
    ("parking_wymagania", r"(miejsc[ae]\s+postojow[ey]ch[^\n]+|parking[^\n]+)", "trim"),
    ("strefy_ograniczenia", r"(strefa ochron[^\n\.]+|obszar ochron[^\n\.]+)", "trim"),
]
#: Dashes, and the place that both patterns with one look for.
DASHES, DASHED = ("–", "-"), r"\b[A-Z]{1,3}(?:/[A-Z0-9]{1,3})?\s*[–-]\s*[^\n]+"
#: What each pattern needs (plain), in the patterns' order; a pattern is tried only on texts that hold one of its words.
PATTERN_WORDS = [
    ("dla",), ("terenu",), DASHES, ("obowiązuje", "zmiana", "brak"), ("uchwała",), ("przeznaczenie podstawowe",), DASHES, ("przeznaczenie dopuszczalne",), ("zakaz", "nie dopuszcza"), ("funkcji",),
    ("wysoko",), ("kondygnacji nadziemnych",), ("kondygnacji podziemnych",), ("kalenicy",), ("okapu",), ("intensywność zabudowy",), ("intensywność zabudowy",), ("intensywność zabudowy",), ("powierzchnia zabudowy",),
    ("biologicznie",), ("szerokość elewacji frontowej",), ("szerokość elewacji frontowej",), ("linie zabudowy",), ("dach",), ("postojow", "parking"), ("strefa ochron", "obszar ochron"),
]
PATTERN_KEYS = list(dict.fromkeys(key for key, *_ in PATTERNS))
CONFIDENCE = 0.7


def whole_texts(pages: DataFrame, between: str) -> DataFrame:
    """doc_id, text: a document's pages that have a text, in order, as one; a document is one row."""
    return pages.groupBy("doc_id").agg(one_text(between))


def one_text(between: str) -> Column:
    parts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("page", "text"))))
    return F.array_join(F.transform(parts, lambda p: p["text"]), between).alias("text")


def shaped(value: Column, kind: str) -> Column:
    number = F.replace(value, F.lit(","), F.lit(".")).try_cast("double")
    return {"clean": clean_value(value), "upper": F.upper(value), "lower": F.lower(value), "trim": F.nullif(F.trim(value), F.lit("")), "number": number.cast("string")}[kind]


def shaper(kind: str):
    return lambda x: shaped(F.when(x != "", x), kind)


def prepared(rows: DataFrame) -> DataFrame:
    """rows with low_, the text's plain form, and dashed_, the first place of a symbol with a dash, which two keys read."""
    low = rows.withColumn("low_", plain(F.col("text")))
    return low.withColumn("dashed_", F.when(holds(F.col("low_"), *DASHES), F.regexp_extract("text", WIDE + DASHED, 0)).otherwise(""))


def pattern_values(text: Column, low: Column, dashed: Column) -> dict[str, Column]:
    """Each key's value as text, null where no pattern of it matches; low and dashed: as prepared."""
    found: dict[str, list[Column]] = {}
    for (key, pattern, kind), words in zip(PATTERNS, PATTERN_WORDS, strict=True):
        value = let(F.regexp_extract(dashed if words == DASHES else text, WIDE + pattern, 1), shaper(kind))
        found.setdefault(key, []).append(F.when(holds(low, *words), value))
    return {key: F.coalesce(*some) for key, some in found.items()}


def as_form(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """doc_id, form_key, value, confidence: CONFIDENCE where there is a value other than zero, else 0."""
    entries = F.array(*(F.struct(F.lit(key).alias("form_key"), value.cast("string").alias("value")) for key, value in values.items()))
    sure = F.col("value").isNotNull() & (F.col("value") != "") & ~F.coalesce(F.col("value").try_cast("double") == 0, F.lit(False))
    return rows.select("doc_id", F.inline(entries)).withColumn("confidence", F.when(sure, CONFIDENCE).otherwise(0.0))


def pattern_form(pages: DataFrame) -> DataFrame:
    """The keys that patterns alone decide."""
    return as_form(prepared(whole_texts(pages, " ")), pattern_values(F.col("text"), F.col("low_"), F.col("dashed_")))


def flat_form(pages: DataFrame) -> DataFrame:
    """doc_id, form_key, value, confidence of all 34 keys of every document: its patterns', its sign and date, and its plot's location.

    notatki tells how the location was found, evidence which of its parts were.
    """
    rows = located(pages.groupBy("doc_id").agg(one_text(" "), first_pages().alias("first_")), "text")
    shown, _ = long_date(F.col("text"))
    values = pattern_values(F.col("text"), F.col("low_"), F.col("dashed_"))
    rows = prepared(rows).withColumn("symbol_", values["symbol_terenu_mpzp"])
    values["symbol_terenu_mpzp"] = F.col("symbol_")
    told = F.array_compact(F.array(F.when(F.size("parcels") > 0, "parcels"), *(F.when(F.col(c).isNotNull(), c) for c in ("precinct", "street", "city"))))
    values |= {
        "znak_sprawy": issue_sign(F.col("text")), "data_wydania": F.when(holds(F.col("low_"), *MONTHS), shown), "symbol_terenu": values["symbol_terenu_mpzp"],
        "numer_dzialki": F.get("parcels", F.lit(0)), "numery_dzialek": F.array_join("parcels", ","), "obreb_gmina": F.col("precinct"), "ulica": F.col("street"), "miejscowosc": F.col("city"),
        "location_confidence": F.col("confidence"), "evidence": F.array_join(told, ","), "notatki": F.concat(F.lit("score "), F.col("score").cast("string"), F.when(F.col("qualified"), "; subject window").otherwise("; best window")),
    }
    return as_form(rows.withColumn("value", F.lit(None).cast("string")), values)


#: What a key sentence holds, its fields' patterns, and those of a text without one; towns behind a postal code.
SENTENCE = {
    "numer_dzialki": r"(?:działk\w*|dzialk\w*).*?nr\s*(?:ew\.?)?\s*(\d+(?:\s*/\s*\d+)?)",
    "obreb": r"obr[ęe]b\w*\s+nr\s*(\d{1,2}(?:-\d{1,2}){2})",
    "ulica": r"przy\s+((?:\b(?:ul|al|pl|os)\b\.?|\b(?:ulica|aleja|plac|osiedle)\b)\s*[:\-]?\s*[^,.\n]+?)(?:\s+w\b|,|\.|\b\d{2}-\d{3}\b|$)",
}
TOWN = r"\bw\s+([A-Za-zĄĆĘŁŃÓŚŹŻąęćłńóśźż\-]+)"
ELSEWHERE = {
    "numer_dzialki": r"(?s)(?:działk\w*|dzialk\w*).*?nr\s*(?:ew\.?|ewid\.?|ewidencyjn\w*)?\s*(\d+(?:\s*/\s*\d+)?)",
    "obreb": r"obr[ęe]b\w*(?:\s+nr)?\s*(\d{1,2}(?:-\d{1,2}){2}|\d{4,6}|[A-Za-zĄĆĘŁŃÓŚŹŻąęćłńóśźż\- ]{2,50})",
    "ulica": r"((?:\b(?:ul|al|pl|os)\b\.?|\b(?:ulica|aleje?|plac|osiedle)\b)\s*[:\-]?\s*[A-Za-zĄĆĘŁŃÓŚŹŻąęćłńóśźż0-9\-\. ]{2,80}?)(?=\s*(?:,|\n|$|\b\d{2}-\d{3}\b|\bw\s+dzielnic\w*\b|\b(?:miejscowość|miejscowosc|miasto|gm\.|gmina|obr[eę]b)\b))",
}
NAME = r"([A-ZĄĆĘŁŃÓŚŹŻ][A-Za-zĄĆĘŁŃÓŚŹŻąęćłńóśźż\- ]{2,60})"
#: A field's confidence from a key sentence, and from anywhere.
SURE = {"numer_dzialki": 0.9, "obreb": 0.9, "ulica": 0.8, "miejscowosc": 0.7}
UNSURE = 0.6


def street_form(c: Column) -> Column:
    """Without a postal code, a place or a district behind it, up to the first comma."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^[ ,.;]+|[ ,.;]+$", "")
    c = F.regexp_replace(c, r"\s+\d{2}-\d{3}.*$", "")
    c = F.regexp_replace(c, WIDE + r"\s+\b(?:miejscowo(?:ść|sc)|miasto|gm\.?|gmina|obr[eę]b|dzielnic\w*)\b.*$", "")
    return F.regexp_replace(F.regexp_replace(F.substring_index(c, ",", 1), WIDE + r"\s+w\s+dzielnic\w*\s+.*", ""), r"^[ ,.;]+|[ ,.;]+$", "")


def town_form(c: Column) -> Column:
    """Without what belongs to a wider district; the capital's case of place becomes its name."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^[ .,]+|[ .,]+$", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\s+\d{2}-\d{3}.*$", ""), WIDE + r"\s+\b(?:gmina|gm\.?|powiat|wojew[oó]dztwo|obr[eę]b)\b.*$", "")
    c = F.substring_index(c, ",", 1)
    return F.when(F.lower(c).startswith("warszaw") & F.lower(c).endswith("wie"), "Warszawa").otherwise(c)


def key_sentences(pages: DataFrame) -> DataFrame:
    """doc_id, the key sentence with its page, and number, precinct, street and town with their confidences.

    The sentence is the first line, page by page, that speaks of a plot and a precinct, with the two lines after it. A town behind a postal
    code anywhere comes before the sentence's last one. Documents without such a line are searched whole.
    """
    kept = F.filter(F.transform(F.split("text", r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.array_position(F.transform("kept_", lambda x: F.regexp_like(x, F.lit(WIDE + "działk|dzialk")) & F.regexp_like(x, F.lit(WIDE + "obr"))), F.lit(True)).cast("int")
    lines = pages.select("doc_id", "page", kept.alias("kept_")).withColumn("at_", first).where("at_ > 0")
    told = lines.groupBy("doc_id").agg(F.min(F.struct("page", F.array_join(F.slice("kept_", F.col("at_"), F.lit(3)), " ").alias("sentence"))).alias("key"))
    rows = whole_texts(pages, "\n").join(told.hint("merge"), "doc_id", "left").withColumn("said", F.col("key.sentence"))
    one = lambda c, p, flags=WIDE: F.nullif(F.regexp_extract(c, flags + p, 1), F.lit(""))
    last = lambda c, p: F.try_element_at(F.regexp_extract_all(c, F.lit("(?uU)" + p), F.lit(1)), F.lit(-1))
    postal = F.nullif(F.trim(one(F.col("text"), r"\b\d{2}-\d{3}\s+" + NAME, "(?uU)")), F.lit(""))
    has = F.col("said").isNotNull()
    raw = {k: F.when(has, one(F.col("said"), p)).otherwise(one(F.col("text"), ELSEWHERE[k])) for k, p in SENTENCE.items()}
    raw["miejscowosc"] = F.coalesce(postal, F.when(has, last(F.col("said"), TOWN)).otherwise(last(F.col("text"), r"\bw\s+" + NAME)))
    forms = {"numer_dzialki": lambda c: F.regexp_replace(F.trim(c), r"\s*/\s*", "/"), "obreb": lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), "ulica": street_form, "miejscowosc": town_form}
    rows = rows.withColumns({f"{k}_raw": c for k, c in raw.items()})
    sure = {k: F.when(F.col(f"{k}_raw").isNull(), 0.0).when(has, SURE[k]).otherwise(UNSURE).alias(f"{k}_confidence") for k in forms}
    return rows.select("doc_id", *(f(F.col(f"{k}_raw")).alias(k) for k, f in forms.items()), *sure.values(), "said", F.coalesce("key.page", F.lit(1)).alias("page"))
