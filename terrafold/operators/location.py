"""Where a planning document's plot lies: parcels, precinct, city and street from free text, and a bundle of one window.

Each extraction is a few columns beside the text it reads, so all windows of all documents go through one projection;
only the choice of a window shuffles, by document. Matches with their places come from marking them in the text.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_value
from ..functions.values import let
from .extraction import FOOTER, SIGN_WORDS, WIDE, able, may_count, signs, tells_place, worth

#: What numbers, names and places look like, and what leads to them or ends them (group n: the value).
LETTER, ANY = "A-ZĄĆĘŁŃÓŚŹŻ", r"A-Za-zÀ-ÿĄĆĘŁŃÓŚŹŻąćęłńóśźż0-9 .'-"
TOKEN = r"\d+[A-Za-z]?(?:\s*[/-]\s*\d+[A-Za-z]?){0,2}(?=[^A-Za-z]|$)"
TOKENS = rf"({TOKEN}(?:\s*(?:,|;|/|oraz|i)\s*{TOKEN})*)"
WAYS = r"(?:ul\.?|al\.?|alej\w*|pl\.?|os\.?|rondo)"
FULL_ID = r"\b\d{6,8}[_\.-]\d(?:[_\.-]\d{4})?[_\.-](\d{1,5}\s*/\s*\d{1,5}[A-Za-z]?)\b"
BLOCKS = [
    rf"(?:dzia[łl]k(?:a|i|ę|ach|ami)?|dz\.?)[^\n]{{0,120}}?(?:(?:nr|numer)\s*(?:ewid(?:\. |\.|encyjn\w*)?|ew\.?)?|(?:ewid(?:\. |\.|encyjn\w*)?|ew\.?)\s*(?:nr|numer)?)?\s*[:\-]?\s*{TOKENS}",
    rf"(?:nr|numer)\s+dzia[łl]k(?:i|a)?\s*[:\-]?\s*{TOKENS}",
    rf"(?:nr|numer)\s+ewidencyjn\w*\s+dzia[łl]k(?:i|a)?\s*[:\-]?\s*{TOKENS}",
]
INLINE = r"(?<!\d)(?:\d{1,5}\s*[/-]\s*\d{1,5}(?:\s*[/-]\s*\d{1,5}[A-Za-z]?)?|\d{1,5})(?!\d)"
COMPACT = r"(?<!\d)(\d{1,5})\s*(?:[\-\.]|\s)\s*(\d{1,5}[A-Za-z]?)(?![\dA-Za-z])"
HINT = r"\bdzia[łl]k|\bdz\.?|\bobr\.?|obr[eę]b"
DATE = r"\d{1,2}[\./-]\d{1,2}[\./-]\d{2,4}"
PRECINCT_HEAD = r"(?:w\s+obr[eę]bie|[o0]br[eę]b(?:u|ie)?|obr\.?)\s*[:\-]?\s*(?:ewidencyjn\w*)?\s*(?:nr|numer)?\s*"
PRECINCT_END = rf"(?=(?:\s+po[łl]o[zż]on|\s+przy\s+{WAYS}|\s+w\s+[{LETTER}]|\s+(?:miejscowo[śs][ćc]|miasto|gmina|ulica)\s*[:\-]|\s+na\s+terenie|\s*[,.;)]|$))"
PRECINCT_NUMBERED = rf"{PRECINCT_HEAD}(\d{{1,4}}(?:[-./]\d{{1,4}})*)(?:\s*(?:[-–—:]|\))\s*|\s+)?((?!(?:w\s+[{LETTER}]|na\s+terenie))[{LETTER}][{ANY}]{{1,60}}?)?{PRECINCT_END}"
PRECINCT_NAMED = rf"{PRECINCT_HEAD}((?!na\s+terenie)[{LETTER}][{ANY}]{{1,60}}?){PRECINCT_END}"
PRECINCT_BRACKETS = r"\((\d{1,4}(?:[-./]\d{1,4})*)\)"
CITIES = [
    rf"(?:miejscowo[śs][ćc]|w\s+miejscowo[śs][ćc]i|miasto|gmina|m\.)\s*[:\-]?\s*([{LETTER}][{ANY}]{{1,80}}?)(?=(?:\s*(?:,|\.|;)|\s+(?:ul\.?|al\.?|pl\.?|os\.?|rondo)|$))",
    rf"po[łl]o[zż]enie\s+nieruchomo[śs]ci\s+([{LETTER}][{ANY}]{{1,80}}?)(?=(?:\s*,|\s+(?:ul\.?|al\.?|pl\.?|os\.?|rondo)|\s+dz\.?|\.|$))",
    rf"po[łl]o[zż]on\w*[^\n]{{0,100}}?\bw\s+([{LETTER}][{ANY}]{{1,80}}?)(?=(?:\s+przy\s+{WAYS}|\s*(?:,|\.|;)|\s+dla\b|$))",
    rf"\b\d{{2}}-\d{{3}}\s+([{LETTER}][{ANY}]{{1,80}}?)(?=(?:\s*(?:,|\.|;)|\s+(?:ul\.?|al\.?|pl\.?|os\.?|rondo)|$))",
    rf"\bw\s+([{LETTER}][{ANY}]{{1,80}}?)(?=(?:\s*(?:,|\.|;)|\s+dla\b|$))",
]
#: What each of them needs (plain).
CITY_WORDS = [("miejscowo", "miasto", "gmina", "m."), ("nieruchomo",), ("położon", "polożon", "połozon", "polozon"), ("-",), ("w",)]
STREET_WORDS = ("ul", "al", "pl", "os", "rondo")
STREET_HEAD = r"(?:ul|ulica|al|alej\w*|pl|plac|os|osiedle|rondo)\.?\s*[:\-]?\s"
STREET = rf"(?:przy\s+|rejonie\s+)?(?:ul\.?|ulica|al\.?|alej\w*|pl\.?|plac|os\.?|osiedle|rondo)\s*[:\-]?\s+([{LETTER}0-9][A-Za-zÀ-ÿĄĆĘŁŃÓŚŹŻąćęłńóśźż0-9 .'/\-]{{1,90}}?)(?=(?:\s+w\s+[{LETTER}]|\s*[-,]\s*dz\.?|\s+dz\.?|\s+dzia[łl]k|\s+z\s+obr|\s+obr\.?|\s*[,]|\.|$))"
#: Signs on a street's line (pattern, whether case counts, points), and names that are no city.
STREET_SIGNS = [(r"po[łl]o[zż]on|dotyczy|inwestycj", False, 3), (r"dzia[łl]k|\bdz\.\b|\bobr", False, 2), (r"\b(?:ul\.?|ulica|al\.?|alej\w*|pl\.?|plac|os\.?|osiedle|rondo)\b", False, 1), (rf"\bw\s+[{LETTER}]", True, 1), (FOOTER, False, -4)]
#: What each of a line's signs needs (in lower case).
STREET_SIGN_WORDS = [("położon", "polożon", "połozon", "polozon", "dotyczy", "inwestycj"), ("dzia", "dz.", "obr"), STREET_WORDS, ("w",), SIGN_WORDS["footer"]]
NO_CITY = ("st", "st.", "m", "m.", "m st", "m. st")
#: Street and locality references, the line's signs that rank them, the fallbacks in order, and words that are no locality.
STREET_REF = r"(?:\b(?:ul|al|pl|os)\b\.?|\b(?:ulica|aleja|plac|osiedle)\b)\s*[:\-]?\s*([A-Za-zÀ-ÿĄĆĘŁŃÓŚŹŻąćęłńóśźż0-9 .'-]+?)(?=\s*(?:,|\n|$|\b\d{2}-\d{3}\b|\bw\s+dzielnic\w*\b|\b(?:miejscowość|miejscowosc|miasto|gm\.|gmina|obr[eę]b)\b))"
LOCALITY_REF = r"(?:\bmiejscowość\b|\bmiejscowosc\b|\bmiasto\b|\bm\.|\bgm\.|\bgmina\b)\s*[:\-]?\s*([A-Za-zÀ-ÿĄĆĘŁŃÓŚŹŻąćęłńóśźż0-9 .'-]+?)(?=\s*(?:,|\n|$|\b\d{2}-\d{3}\b|\b(?:ul|al|pl|os|ulica|aleja|plac|osiedle|obr[eę]b)\b))"
LOCALITY_ADDRESS = r"(?:adres|siedziba)\s*[:\-]?\s*[^,\n]+,\s*([A-Za-zÀ-ÿ0-9 .'-]+)"
LOCALITY_POSTAL = r"\b\d{2}-\d{3}\s+([A-Za-zÀ-ÿ0-9 .'-]+)"
#: A run that leads to a date is taken from its begin, so that places within it aren't tried anew.
LOCALITY_DATE = r"(?<![A-Za-zÀ-ÿ0-9 .'-])([A-Za-zÀ-ÿ0-9 .'-]+)\s*,\s*(?:dn\.?|dnia)\s*\d{1,2}"
LOCALITY_IN = r"(?:w\s+dzielnicy\s+[A-Za-zÀ-ÿ0-9 .'-]+\s+)?w\s+([A-ZĄĆĘŁŃÓŚŹŻ][A-Za-zÀ-ÿ0-9 .'-]+)"
NO_LOCALITY = ("sprawie", "zakresie", "dniu", "dnia", "związku", "obszarze", "granicach", "mieście")


def plain(c: Column) -> Column:
    """Lower case, with the letters that patterns without case also take for plain ones; only to look for literals."""
    for one, other in (("İ", "i"), ("ı", "i"), ("ſ", "s")):
        c = F.replace(c, F.lit(one), F.lit(other))
    return F.lower(c)


def holds(c: Column, *words: str) -> Column:
    """Whether a plain text holds one of the words; a pattern that needs one of them is tried on such texts only."""
    return reduce(or_, (c.contains(word) for word in words))


def has(c: Column, pattern: str, cased: bool = False) -> Column:
    return c.rlike(("(?uU)" if cased else WIDE) + pattern)


def group(c: Column, pattern: str, n: int) -> Column:
    """Group n of the first match, null without one."""
    return F.when(has(c, pattern), F.regexp_extract(c, WIDE + pattern, n))


def matches(c: Column, pattern: str) -> Column:
    """All matches, as an array of (at, found)."""
    return F.transform(lined_matches(c, pattern), lambda m: F.struct(m["at"].alias("at"), m["found"].alias("found")))


def lined_matches(c: Column, pattern: str) -> Column:
    """All matches, as an array of (at, line, found), line counting line ends before: marked in the text, which is then taken apart at the marks."""
    pieces = F.split(F.regexp_replace(c, WIDE + pattern, "\u0001$0\u0002"), "\u0001")
    none = F.array().cast("array<struct<at: int, line: int, found: string>>")

    def placed(pieces: Column) -> Column:
        ends = lambda piece: F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit("")))
        place = lambda at, line: F.struct(at.alias("at"), line.alias("line"))
        # Each piece's begin is the one before's and its length, but for the mark of an end.
        start = F.array(let(F.get(pieces, F.lit(0)), lambda piece: place(F.length(piece), ends(piece))))
        after = lambda starts, k: let(F.get(pieces, k), lambda piece: F.array_append(starts, let(F.element_at(starts, -1), lambda s: place(s["at"] + F.length(piece) - 1, s["line"] + ends(piece)))))
        starts = F.when(F.size(pieces) > 2, F.aggregate(F.sequence(F.lit(1), F.size(pieces) - 2), start, after)).otherwise(start)
        return F.zip_with(starts, F.slice(pieces, F.lit(2), F.size(pieces)), lambda s, piece: F.struct(s["at"].alias("at"), s["line"].alias("line"), F.substring_index(piece, "\u0002", 1).alias("found")))

    return let(pieces, lambda ps: F.when(F.size(ps) > 1, placed(ps)).otherwise(none))


def tidy(c: Column) -> Column:
    """Single spaces, without blanks, commas, stops and dashes around."""
    return let(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "), r"^[ ,;.-]+|[ ,;.-]+$", ""), lambda x: F.nullif(x, F.lit("")))


def parcel_number(c: Column) -> Column:
    """A number's parts joined by slashes, without leading zeros."""
    parts = F.filter(F.split(F.regexp_replace(F.translate(tidy(c), "／\\", "//"), r"\s*[/-]\s*", "/"), "/"), lambda x: x != "")
    return let(F.array_join(F.transform(parts, lambda x: F.regexp_replace(x, r"^0+(?=\d+[A-Za-z]?$)", "")), "/"), lambda x: F.nullif(x, F.lit("")))


def parcel_tokens(c: Column) -> Column:
    """The different numbers of a list, in order; several without a slash, two of which stand together, are one number."""
    text = F.translate(F.regexp_replace(F.regexp_replace(F.translate(c, "／\\", "//"), r"(?U)\s+", " "), WIDE + r"\b(?:oraz|i|and|&)\b", ","), ";|", ",,")
    found = F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(WIDE + TOKEN), F.lit(0)), parcel_number)))
    pair = F.when(has(text, COMPACT) & ~F.exists(found, lambda x: x.contains("/")) & (F.size(found) > 0), parcel_number(F.concat(group(text, COMPACT, 1), F.lit("/"), group(text, COMPACT, 2))))
    return F.when(pair.isNotNull(), F.array(pair)).otherwise(found)


def like_date(text: Column, at: Column, length: Column) -> Column:
    """Whether the six characters around a match and itself hold a date."""
    first = F.greatest(F.lit(1), at - 5)
    return has(F.substr(text, first, at + length + 6 - first + 1), DATE)


def first_of(items: Column, told, kind: str = "string") -> Column:
    """told(item) of the first item for which it isn't null; later ones aren't looked at."""
    return F.aggregate(items, F.lit(None).cast(kind), lambda found, x: F.coalesce(found, told(x)))


def joined(c: Column) -> Column:
    return parcel_number(F.concat(group(c, COMPACT, 1), F.lit("/"), group(c, COMPACT, 2)))


def labelled(t: Column, block: Column) -> Column:
    """The numbers behind a label; one number without a slash may go on after a blank or a dash, within 24 characters."""
    span = F.substr(t, F.position(block["all"], t), F.length(block["all"]) + 24)
    near = lambda s: let(F.get(matches(s, COMPACT), F.lit(0)), lambda m: F.when(m.isNotNull() & ~like_date(s, m["at"], F.length(m["found"])), joined(m["found"])))

    def told(listed: Column) -> Column:
        alone = F.when((F.size(listed) == 1) & ~F.get(listed, F.lit(0)).contains("/"), let(span, near))
        return F.coalesce(let(alone, lambda x: F.when(x.isNotNull(), F.array(x))), F.when(F.size(listed) > 0, listed))

    return let(parcel_tokens(block["numbers"]), told)


def parcels_of(text: Column) -> Column:
    """The numbers of the plots a text tells: a full identifier's, else those after a label, else the first number in a text that speaks of plots."""
    # Every pattern below needs a slash (full identifiers) or a word for a plot or a precinct; other texts are as good as empty.
    none = F.array().cast("array<string>")
    flat = F.regexp_replace(F.translate(text, "／\\", "//"), r"(?U)\s+", " ")

    def told(t: Column, dz: Column) -> Column:
        one = lambda c: let(c, lambda x: F.when(x.isNotNull(), F.array(x)))
        block = F.coalesce(*(F.when(has(t, p), F.struct(F.lit(i).alias("i"), F.regexp_extract(t, WIDE + p, 0).alias("all"), F.regexp_extract(t, WIDE + p, 1).alias("numbers"))) for i, p in enumerate(BLOCKS)))
        usable = lambda m: let(parcel_number(m["found"]), lambda x: F.when((F.length(x) > 1) & ~x.isin("00", "000", "0000") & ~like_date(t, m["at"], F.length(m["found"])), x))
        # At last two numbers with a blank, a dash or a stop between them, unless they belong to a date.
        apart = first_of(matches(t, COMPACT), lambda m: F.when(~like_date(t, m["at"], F.length(m["found"])), m["found"]))
        spoken = F.when((t != "") & has(t, HINT), F.coalesce(first_of(matches(t, INLINE), usable), let(apart, joined)))
        return F.coalesce(one(F.when(t.contains("/"), parcel_number(group(t, FULL_ID, 1)))), F.when(dz, let(block, lambda b: F.when(b.isNotNull(), labelled(t, b)))), one(spoken))

    able_ = lambda low: F.when(holds(low, "dz", "obr", "/", "／", "\\"), let(flat, lambda t: told(t, holds(low, "dz"))))
    return F.coalesce(let(plain(text), able_), none)


def precinct_of(text: Column) -> Column:
    """precinct (number and name where both are told) and precinct_number; both may be null."""

    def told(t: Column, low: Column) -> Column:
        # Heads need obr or 0br, brackets a bracket.
        headed = holds(low, "obr", "0br")
        parts = lambda number, name: F.struct(number.alias("number"), name.alias("name"))
        nothing, of = F.lit(None).cast("string"), lambda p, n: tidy(F.regexp_extract(t, WIDE + p, n))
        return F.when(headed & has(t, PRECINCT_NUMBERED), parts(of(PRECINCT_NUMBERED, 1), of(PRECINCT_NUMBERED, 2))).when(headed & has(t, PRECINCT_NAMED), parts(nothing, of(PRECINCT_NAMED, 1))).when(low.contains("(") & has(t, PRECINCT_BRACKETS), parts(of(PRECINCT_BRACKETS, 1), nothing))

    both = let(F.coalesce(text, F.lit("")), lambda t: let(plain(t), lambda low: told(t, low)))
    return let(both, lambda x: F.struct(F.nullif(F.concat_ws(" – ", x["number"], x["name"]), F.lit("")).alias("precinct"), x["number"].alias("precinct_number")))


def city_of(text: Column) -> Column:
    """The city by the first kind of phrase that names one."""
    usable = lambda c: F.when(~F.lower(c).isin(*NO_CITY) & (F.length(c) > 2), c)

    def told(t: Column, low: Column) -> Column:
        named = lambda p: F.regexp_replace(tidy(group(t, p, 1)), r"(?i)^m\.\s*", "")
        return F.coalesce(*(F.when(holds(low, *words), let(named(p), usable)) for p, words in zip(CITIES, CITY_WORDS)))

    return let(F.coalesce(text, F.lit("")), lambda t: let(plain(t), lambda low: told(t, low)))


def line_points(line: Column) -> Column:
    """What the signs on a street's line are worth."""
    return let(F.lower(line), lambda low: sum((F.when(holds(low, *words) & has(line if cased else low, p, True), n).otherwise(0) for (p, cased, n), words in zip(STREET_SIGNS, STREET_SIGN_WORDS)), F.lit(0)))


def street_of(text: Column) -> Column:
    """Of all streets the one whose line has the most points, the last of equals; none below -2."""

    def told(t: Column) -> Column:
        after = lambda m: F.substring_index(F.substr(t, m["at"] + F.length(m["found"]) + 1, F.length(t)), "\n", 1)

        def judged(m: Column, points: Column) -> Column:
            # A street on one line has that line's points, which are counted once a line; one across a line's end has its own.
            before = F.substring_index(F.substr(t, F.lit(1), m["at"]), "\n", -1)
            own = F.when(m["found"].contains("\n"), line_points(F.concat(before, m["found"], after(m)))).otherwise(F.get(points, m["line"]))
            return F.struct((-own).alias("points"), (-m["at"]).alias("at"), m["found"].alias("found"))

        def best(points: Column, found: Column) -> Column:
            ranked = F.array_sort(F.filter(F.transform(found, lambda m: judged(m, points)), lambda x: x["points"] <= 2))
            place = lambda x: F.struct((-x["at"]).alias("at"), x["found"].alias("found"))
            # Names are read in order of rank until there is one.
            name = lambda m: tidy(F.regexp_replace(F.regexp_extract(F.concat(m["found"], after(m)), WIDE + STREET, 1), r"(?iu)^(?:ul\.?|ulica)\s+", ""))
            return first_of(ranked, lambda x: let(place(x), name))

        lined = lambda found: let(F.array_distinct(F.transform(found, lambda m: m["line"])), lambda ns: F.transform(F.split(t, "\n"), lambda line, i: F.when(F.array_contains(ns, i), line_points(line))))
        return let(lined_matches(t, STREET), lambda found: F.when(F.size(found) > 0, let(lined(found), lambda points: best(points, found))))

    # A street's word needs a blank behind it, after a stop or a mark; the cheap pattern tells texts without one.
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(holds(plain(t), *STREET_WORDS) & has(t, STREET_HEAD), told(t)))


def with_parcels(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with parcels, as parcels_of."""
    return rows.withColumn("parcels", parcels_of(F.col(text)))


def with_street(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with street, as street_of."""
    return rows.withColumn("street", street_of(F.col(text)))


KINDS = ["parcels", "precinct", "precinct_number", "street", "city"]
BUNDLE = "struct<parcels: array<string>, precinct: string, precinct_number: string, street: string, city: string, present: int>"
#: What each kind of field takes along, and how a text tells it (null where it doesn't).
GROUPS = {"parcels": ["parcels"], "precinct": ["precinct", "precinct_number"], "street": ["street"], "city": ["city"]}
GROUP_TYPES = {"parcels": "array<string>", "precinct": "struct<precinct: string, precinct_number: string>", "street": "string", "city": "string"}
TELLS = {
    "parcels": lambda t: let(parcels_of(t), lambda x: F.when(F.size(x) > 0, x)), "precinct": lambda t: let(precinct_of(t), lambda x: F.when(x["precinct"].isNotNull(), x)),
    "street": street_of, "city": city_of,
}


def bundle(text: Column) -> Column:
    """parcels, precinct, precinct_number, street, city and present (how many of the four are told)."""
    told = F.struct(*(tell(text).alias(k) for k, tell in TELLS.items()))
    present = lambda x: sum((x[k].isNotNull().cast("int") for k in GROUPS), F.lit(0))
    fields = lambda x: F.struct(F.coalesce(x["parcels"], F.array().cast("array<string>")).alias("parcels"), x["precinct"]["precinct"].alias("precinct"), x["precinct"]["precinct_number"].alias("precinct_number"), x["street"].alias("street"), x["city"].alias("city"), present(x).alias("present"))
    return let(told, fields)


def complete(text: Column) -> Column:
    """bundle of a text that tells all four, else null; the rarer fields are looked for first."""
    got = lambda x, then: F.when(x.isNotNull(), then)
    whole = lambda p, n, s, c: F.struct(n.alias("parcels"), p["precinct"].alias("precinct"), p["precinct_number"].alias("precinct_number"), s.alias("street"), c.alias("city"), F.lit(4).alias("present"))
    return let(TELLS["precinct"](text), lambda p: got(p, let(TELLS["parcels"](text), lambda n: got(n, let(city_of(text), lambda c: got(c, let(street_of(text), lambda s: got(s, whole(p, n, s, c)))))))))


class Page:
    """A page's lines that aren't blank, in a row of its own, and the windows over them: each line with its neighbours up to one and up to two lines away.

    A window's number is 2 * line + radius - 1. Its text is put together only where it is looked at.
    """

    def __init__(self, lines: Column):
        self.kept, self.lows = lines["kept"], lines["lows"]

    @staticmethod
    def of(text: Column, then) -> Column:
        """then(page), its lines split once."""
        # Literal ends of lines are found far faster than a pattern of all kinds.
        plain_ends = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
        kept = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
        return let(plain_ends, lambda t: let(F.struct(kept(t).alias("kept"), kept(F.lower(t)).alias("lows")), lambda lines: then(Page(lines))))

    def joined(self, lines: Column, n: Column, radius: Column) -> Column:
        first = F.greatest(n - radius, F.lit(0))
        return F.array_join(F.slice(lines, first + 1, n + radius - first + 1), "\n")

    def text(self, w: Column) -> Column:
        return self.joined(self.kept, w["n"], w["radius"])

    def where(self, test) -> Column:
        """The numbers of the windows that hold a line, given as it is and in lower case, with test."""
        at = F.array_compact(F.transform(self.lows, lambda low, i: F.when(test(F.get(self.kept, i), low), i)))
        near = F.flatten(F.transform(at, lambda p: F.array(*(2 * (p + by) + radius - 1 for radius in (1, 2) for by in range(-radius, radius + 1)))))
        return F.array_distinct(F.filter(near, lambda w: (w >= 0) & (w < 2 * F.size(self.kept))))

    def judged(self, windows: Column) -> Column:
        """n, radius, start, score, subject and footer of numbered windows."""

        def one(w: Column) -> Column:
            n, radius = F.shiftright(w, 1), w % 2 + 1
            shown = lambda s: F.struct(n.alias("n"), radius.alias("radius"), F.greatest(F.lit(0), n - radius).alias("start"), worth(s).alias("score"), tells_place(s).alias("subject"), s["footer"].alias("footer"))
            return let(signs(self.joined(self.kept, n, radius), self.joined(self.lows, n, radius)), shown)

        return F.transform(windows, one)

    def all_judged(self) -> Column:
        """judged of all windows; those without a line that may count aren't searched."""
        every = F.when(F.size(self.kept) > 0, F.sequence(F.lit(0), 2 * F.size(self.kept) - 1)).otherwise(F.array().cast("array<int>"))
        n, radius = lambda w: F.shiftright(w, 1), lambda w: w % 2 + 1
        unsigned = lambda w: F.struct(n(w).alias("n"), radius(w).alias("radius"), F.greatest(F.lit(0), n(w) - radius(w)).alias("start"), F.lit(0).alias("score"), F.lit(False).alias("subject"), F.lit(False).alias("footer"))
        return let(self.where(lambda line, low: may_count(low)), lambda some: F.concat(self.judged(some), F.transform(F.array_except(every, some), unsigned)))

    def main(self) -> Column:
        """The best window, as order (the less the better), its score, subject and footer, and its bundle.

        A subject window comes before one without a footer, that before any other; then the highest score, most told fields and earliest place.
        """
        keyed = lambda ws: F.array_sort(F.transform(ws, lambda w: F.struct(F.when(w["subject"], 0).when(~w["footer"], 1).otherwise(2).alias("rank"), (-w["score"]).alias("score"), w["start"].alias("start"), w["n"].alias("n"), w["radius"].alias("radius"), w["subject"].alias("subject"), w["footer"].alias("footer"))))
        alike = lambda ws: F.filter(ws, lambda w: (w["rank"] == F.get(ws, F.lit(0))["rank"]) & (w["score"] == F.get(ws, F.lit(0))["score"]))
        none = F.lit(None).cast(f"struct<rank: int, score: int, absent: int, start: int, n: int, radius: int, subject: boolean, footer: boolean, told: {BUNDLE}>")

        def better(found: Column, w: Column) -> Column:
            row = lambda b: F.struct(w["rank"].alias("rank"), w["score"].alias("score"), (4 - b["present"]).alias("absent"), w["start"].alias("start"), w["n"].alias("n"), w["radius"].alias("radius"), w["subject"].alias("subject"), w["footer"].alias("footer"), b.alias("told"))
            tried = let(bundle(self.text(w)), lambda b: F.when(found.isNull() | (4 - b["present"] < found["absent"]), row(b)).otherwise(found))
            return F.when(found["absent"] == 0, found).otherwise(tried)

        # A subject window speaks of a precinct, so it holds a line that does.
        subjects = F.filter(self.judged(self.where(lambda line, low: able(low, SIGN_WORDS["precinct"]))), lambda w: w["subject"])
        best = lambda ws: F.aggregate(let(keyed(ws), alike), none, better)
        return best(let(subjects, lambda ws: F.when(F.size(ws) > 0, ws).otherwise(self.all_judged())))

    def full(self) -> Column:
        """The best window that tells all four: its order and its bundle."""
        possible = self.where(lambda line, low: holds(low, "obr", "0br") | (low.contains("(") & has(line, PRECINCT_BRACKETS)))
        ranked = F.array_sort(F.transform(self.judged(possible), lambda w: F.struct((-w["score"]).alias("score"), w["start"].alias("start"), w["n"].alias("n"), w["radius"].alias("radius"))))
        told = lambda w: let(complete(self.text(w)), lambda b: F.when(b.isNotNull(), F.struct(w.alias("w"), b.alias("told"))))
        return first_of(ranked, told, f"struct<w: struct<score: int, start: int, n: int, radius: int>, told: {BUNDLE}>")

    def elsewhere(self, lacking: dict[str, Column]) -> Column:
        """Of each kind that is lacking the first window's, in order of their scores, with that order."""
        ranked = F.array_sort(F.transform(self.all_judged(), lambda w: F.struct((-w["score"]).alias("score"), w["n"].alias("n"), w["radius"].alias("radius"))))
        told = lambda w, k: let(TELLS[k](self.text(w)), lambda x: F.when(x.isNotNull(), F.struct(w.alias("w"), x.alias("told"))))
        kind = lambda k: f"struct<w: struct<score: int, n: int, radius: int>, told: {GROUP_TYPES[k]}>"
        return let(ranked, lambda ws: F.struct(*(F.when(lacks, first_of(ws, lambda w, k=k: told(w, k), kind(k))).alias(k) for k, lacks in lacking.items())))


def first_pages() -> Column:
    """The texts of a document's page 1, in a row; of equal numbers all count."""
    return F.array_sort(F.collect_list(F.when(F.col("page") == 1, F.col("text"))))


def with_main(rows: DataFrame) -> DataFrame:
    """rows with main: the fields and marks of the subject window of the texts in first_, null without one."""
    best = F.array_min(F.transform("first_", lambda t: Page.of(t, Page.main)))
    marks = lambda x: F.when(x.isNotNull(), F.struct(x["told"].alias("told"), (-x["score"]).alias("score"), x["subject"].alias("qualified"), x["footer"].alias("has_footer")))
    return rows.withColumn("main", let(best, marks))


def trusted(out: DataFrame) -> DataFrame:
    """out with confidence and accepted: by the subject window's score, less 0.15 where it doesn't qualify and 0.2 for each of parcel, precinct and city that is missing."""
    missing = sum((x.cast("int") for x in (F.coalesce(F.size("parcels"), F.lit(0)) < 1, F.col("precinct").isNull(), F.col("city").isNull())), F.lit(0))
    base = 0.35 + F.greatest(F.lit(0), F.least(F.lit(18), F.col("score"))) / 22 - F.when(F.col("qualified"), 0.0).otherwise(0.15) - 0.2 * missing
    sure = F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.98), base)), 3)
    return out.withColumn("confidence", sure).withColumn("accepted", (missing == 0) & (sure >= 0.45) & F.col("qualified") & ~F.col("has_footer")).drop("has_footer")


def located(rows: DataFrame, *more: str) -> DataFrame:
    """locations of documents in a row each, whose page 1 is in first_; more: columns to keep."""
    full = F.array_min(F.transform("first_", lambda t: Page.of(t, Page.full)))["told"]
    out = with_main(rows).withColumn("used", F.coalesce(F.when(F.col("main.told.present") < 4, full), F.col("main.told")))
    return trusted(out.select("doc_id", *more, *(F.col(f"used.{k}").alias(k) for k in KINDS), *marked()))


def marked() -> list[Column]:
    return [F.coalesce(f"main.{c}", F.lit(other)).alias(c) for c, other in (("score", 0), ("qualified", False), ("has_footer", False))]


def locations(pages: DataFrame) -> DataFrame:
    """doc_id, parcels, precinct, precinct_number, street, city, score, qualified, confidence, accepted, by the windows of page 1.

    The subject window is a qualified one (parcel, precinct and a place), else one without a footer, else any; of these the highest score,
    most told fields and earliest line. If it doesn't tell all four, the best window that does takes its place; its score stays the measure.
    accepted: all but the street told, sure to 0.45, qualified and without a footer. A document is one row; only windows that may win are read.
    """
    return located(pages.groupBy("doc_id").agg(first_pages().alias("first_")))


def merged_locations(pages: DataFrame) -> DataFrame:
    """locations' columns and sources, with each field that the subject window lacks taken from elsewhere.

    A field comes from the other windows in order of their scores, else from the whole first page, else from all pages together, the first
    that tells it; a precinct brings its number along. sources: where parcels, precinct, street and city are from (subject, window, page,
    document, or nothing). Only what is still lacking is looked for, step by step. A document's pages are one text for the last step.
    """
    own = {"parcels": F.when(F.size("main.told.parcels") > 0, F.col("main.told.parcels")), "precinct": F.when(F.col("main.told.precinct").isNotNull(), F.struct("main.told.precinct", "main.told.precinct_number")), "street": F.col("main.told.street"), "city": F.col("main.told.city")}
    rows = with_main(pages.groupBy("doc_id").agg(first_pages().alias("first_"), F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("pages_")))
    lacking = {k: c.isNull() for k, c in own.items()}
    found = F.transform("first_", lambda t: Page.of(t, lambda page: page.elsewhere(lacking)))
    rows = rows.withColumn("windows_", F.when(reduce(or_, lacking.values()), found))
    near = {k: F.array_min(F.col(f"windows_.{k}"))["told"] for k in GROUPS}
    rows = rows.withColumns({f"w_{k}": F.coalesce(own[k], near[k]) for k in GROUPS}).withColumns({f"own_{k}": lacks for k, lacks in lacking.items()})
    # What no window tells is looked for in the first page, then in all pages.
    texts = F.concat(F.transform("first_", lambda t: F.struct(F.lit("page").alias("source"), t.alias("text"))), F.array(F.struct(F.lit("document").alias("source"), F.array_join(F.transform("pages_", lambda p: p["text"]), "\n").alias("text"))))
    told = lambda x, k: let(TELLS[k](x["text"]), lambda v: F.when(v.isNotNull(), F.struct(x["source"].alias("source"), v.alias("told"))))
    rest = {k: F.when(F.col(f"w_{k}").isNull(), first_of(F.col("texts_"), lambda x, k=k: told(x, k), f"struct<source: string, told: {GROUP_TYPES[k]}>")).alias(f"t_{k}") for k in GROUPS}
    rows = rows.withColumn("texts_", texts).select("doc_id", "main", *(f"own_{k}" for k in GROUPS), *(f"w_{k}" for k in GROUPS), *rest.values())
    f = {k: F.coalesce(f"w_{k}", f"t_{k}.told") for k in GROUPS}
    fields = {"parcels": F.coalesce(f["parcels"], F.array().cast("array<string>")), "precinct": f["precinct"]["precinct"], "precinct_number": f["precinct"]["precinct_number"], "street": f["street"], "city": f["city"]}
    source = lambda k: F.when(~F.col(f"own_{k}"), "subject").when(F.col(f"w_{k}").isNotNull(), "window").otherwise(F.col(f"t_{k}.source")).alias(k)
    sources = F.struct(*map(source, GROUPS)).alias("sources")
    return trusted(rows.select("doc_id", *(fields[k].alias(k) for k in KINDS), *marked(), sources)).select("doc_id", *KINDS, "score", "qualified", "confidence", "accepted", "sources")


def ranked_references(pages: DataFrame, pattern: str, name: str, priority) -> DataFrame:
    """doc_id, page, rank and each cleaned reference, by the priority of its line (priority(found, line)) and its place."""
    out = pages.select("doc_id", "page", "text", F.explode(matches(F.col("text"), pattern)).alias("m"))
    before, after = F.substr("text", F.lit(1), F.col("m.at")), F.substr("text", F.col("m.at") + F.length("m.found") + 1, F.length("text"))
    line = F.concat(F.substring_index(before, "\n", -1), F.col("m.found"), F.substring_index(after, "\n", 1))
    whole = F.concat(F.col("m.found"), F.lit("\n"))
    out = out.withColumn("line_", line).select("doc_id", "page", F.col("m.at").alias("at"), priority(F.col("m.found"), F.col("line_")).alias("priority"), clean_value(F.regexp_extract(whole, WIDE + pattern, 1)).alias(name)).where(f"{name} IS NOT NULL")
    order = Window.partitionBy("doc_id", "page").orderBy(F.desc("priority"), "at")
    return out.withColumn("rank", F.row_number().over(order)).drop("at")


def street_references(pages: DataFrame) -> DataFrame:
    """Streets on address lines first (2), then on those of a place (1)."""
    return ranked_references(pages, STREET_REF, "street", lambda found, line: F.when(has(line, r"\badres\b"), 2).when(has(line, r"\bpołożon\w*\b|\bpolozon\w*\b|\bprzy\b"), 1).otherwise(0))


def locality_references(pages: DataFrame) -> DataFrame:
    """Labelled localities, towns first; on pages up to a document's first with a result, failing a label, an address, a postal code, a date or a phrase."""
    low = lambda found: F.lower(found)
    told = ranked_references(pages, LOCALITY_REF, "locality", lambda found, line: F.when(low(found).contains("miejscow") | low(found).contains("miasto"), 2).when(has(found, r"\bm\."), 1).otherwise(0))
    t, low_ = F.col("text"), plain(F.col("text"))
    address, postal = F.when(holds(low_, "adres", "siedziba"), clean_value(group(t, LOCALITY_ADDRESS, 1))), clean_value(group(t, LOCALITY_POSTAL, 1))
    phrase = clean_value(group(t, LOCALITY_IN, 1))
    other = F.when(has(t, LOCALITY_POSTAL), postal).when(holds(low_, "dn") & has(t, LOCALITY_DATE), clean_value(group(t, LOCALITY_DATE, 1))).when(~F.lower(phrase).isin(*NO_LOCALITY), phrase)
    spare = pages.select("doc_id", "page", F.explode(F.array_compact(F.array(F.coalesce(address, other)))).alias("locality")).select("doc_id", "page", F.lit(0).alias("priority"), "locality", F.lit(1).alias("rank"), F.lit(False).alias("told_"))
    every = told.withColumn("told_", F.lit(True)).unionByName(spare)
    of = Window.partitionBy("doc_id")
    first = lambda test: F.min(F.when(test, F.col("page"))).over(of)
    placed = every.withColumns({"labelled_": first(F.col("told_")), "spare_": first(~F.col("told_"))})
    kept = placed.where(F.col("told_") | ((F.col("page") == F.col("spare_")) & (F.col("labelled_").isNull() | (F.col("page") < F.col("labelled_")))))
    return kept.drop("told_", "labelled_", "spare_")


def issue_sign(c: Column) -> Column:
    """A document's case sign: behind its label, else the first line of the top 1,600 characters that is a sign with a letter and a digit."""
    #: The label, and what a sign looks like.
    label = r"(?:^|\n)\s*(?:znak sprawy|sygn\.?|sygnatura)\s*[:\-]?\s*([A-Z0-9./-]{4,})"
    alone = r"^\s*([A-Z0-9]{1,8}(?:[-./][A-Z0-9]{1,12}){2,})\s*$"
    top = F.split(F.substr(c, F.lit(1), F.lit(1600)), "\n")
    signs = F.array_compact(F.transform(top, lambda x: clean_value(group(x, alone, 1))))
    labelled_ = F.when(holds(plain(c), "znak", "sygn"), clean_value(group(c, label, 1)))
    return F.coalesce(labelled_, F.get(F.filter(signs, lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]")), F.lit(0)))


#: Months of a written date.
MONTHS = ("stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "września", "października", "listopada", "grudnia")


def long_date(c: Column) -> tuple[Column, Column]:
    """The first written date as it stands, and as a date (null where there is no such day)."""
    pattern = rf"\b(\d{{1,2}})\s+({'|'.join(MONTHS)})\s+(\d{{4}})\s*r?\.?"
    month = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS) for x in (m, f"{i + 1:02d}")))[F.lower(group(c, pattern, 2))]
    return clean_value(group(c, pattern, 0)), F.try_to_date(F.concat_ws("-", group(c, pattern, 3), month, F.lpad(group(c, pattern, 1), 2, "0")), "yyyy-MM-dd")

