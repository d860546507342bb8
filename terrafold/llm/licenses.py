"""License scans by ordered signature rules.

A rule is a regular expression over a text's words (lower-cased, joined by single spaces), the keywords that must be in
the text before the expression is tried, a label and a priority. One Aho-Corasick automaton of all keywords goes over a
text first, and only the rules whose keywords it met are tried. Of overlapping detections one that lies within another
of the same or a higher priority is suppressed, so "gpl-2.0-only" stands and the "gpl" within it does not; base rules are
counted and labelled before that and always stay.

Written rules (WRITTEN) know licenses by their own words: the clauses of a notice or a grant, addresses, tags and short
names as people write them. Hundreds more come from the families below by FORMS: a name alone, with a version, as an SPDX
tag, and as a phrase of licensing; short names only with a marked version ("GPL v2"). Each name of an SPDX expression ("Apache-2.0 OR
MIT") counts. A rule doesn't count behind "not". A text's score is 1 minus the product of (1 - weight) over its labels' best detections.

Null texts count as empty. An empty text has no words and no labels; an empty table gives no rows. Equal detections count
once; of equal priority and length the earlier place, then the rule's name goes first. Very long texts are scanned whole.
Rows that repeat are judged separately. Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Family, names as lower-case words, versions (as words), label.
FAMILIES = [
    ("gpl", ("gnu general public license", "gnu gpl", "gpl"), ("1", "2", "3", "1 0", "2 0", "3 0"), "gpl"),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"), ("2", "3", "2 0", "2 1", "3 0"), "lgpl"),
    ("agpl", ("gnu affero general public license", "affero general public license", "gnu agpl", "agpl"), ("1", "3", "1 0", "3 0"), "agpl"),
    ("gfdl", ("gnu free documentation license", "gfdl"), ("1 1", "1 2", "1 3"), "gfdl"),
    ("apache", ("apache software license", "apache license", "apache"), ("1", "2", "1 0", "1 1", "2 0"), "apache"),
    ("mit", ("mit license", "expat license", "mit x11 license"), (), "mit"),
    ("bsd", ("bsd license", "berkeley software distribution license", "new bsd license", "simplified bsd license", "modified bsd license"), ("2 clause", "3 clause", "4 clause"), "bsd"),
    ("mpl", ("mozilla public license", "mpl"), ("1 0", "1 1", "2 0"), "mpl"),
    ("epl", ("eclipse public license", "epl"), ("1 0", "2 0"), "epl"),
    ("cddl", ("common development and distribution license", "cddl"), ("1 0", "1 1"), "cddl"),
    ("cpl", ("common public license",), ("0 5", "1 0"), "cpl"),
    ("eupl", ("european union public license", "european union public licence", "eupl"), ("1 0", "1 1", "1 2"), "eupl"),
    ("artistic", ("artistic license", "perl artistic license"), ("1 0", "2 0"), "artistic"),
    ("boost", ("boost software license", "bsl"), ("1 0",), "boost"),
    ("zlib", ("zlib license", "zlib libpng license"), (), "zlib"),
    ("isc", ("isc license",), (), "isc"),
    ("unlicense", ("the unlicense", "unlicense"), (), "unlicense"),
    ("wtfpl", ("wtfpl", "do what the fuck you want to public license"), ("2",), "wtfpl"),
    ("ofl", ("sil open font license", "open font license"), ("1 0", "1 1"), "ofl"),
    ("psf", ("python software foundation license", "psf license"), ("2",), "psf"),
    ("odbl", ("open database license", "odbl"), ("1 0",), "odbl"),
    ("odc-by", ("open data commons attribution license",), ("1 0",), "odc-by"),
    ("pddl", ("public domain dedication and license",), ("1 0",), "pddl"),
    ("postgresql", ("postgresql license",), (), "postgresql"),
    ("openssl", ("openssl license",), (), "openssl"),
    ("php", ("php license",), ("3 0", "3 01"), "php"),
    ("ms-pl", ("microsoft public license", "ms pl"), (), "ms-pl"),
    ("ms-rl", ("microsoft reciprocal license", "ms rl"), (), "ms-rl"),
    ("afl", ("academic free license",), ("1 1", "2 0", "2 1", "3 0"), "afl"),
    ("osl", ("open software license",), ("1 0", "2 0", "2 1", "3 0"), "osl"),
    ("cc0", ("creative commons zero", "cc0", "cc zero"), ("1 0",), "cc0"),
    ("cc-by-nc-nd", ("creative commons attribution noncommercial noderivatives", "creative commons attribution noncommercial noderivs", "cc by nc nd"), ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc-by-nc-nd"),
    ("cc-by-nc-sa", ("creative commons attribution noncommercial sharealike", "cc by nc sa"), ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc-by-nc-sa"),
    ("cc-by-nc", ("creative commons attribution noncommercial", "cc by nc"), ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc-by-nc"),
    ("cc-by-nd", ("creative commons attribution noderivatives", "creative commons attribution noderivs", "cc by nd"), ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc-by-nd"),
    ("cc-by-sa", ("creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa"), ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc-by-sa"),
    ("cc-by", ("creative commons attribution", "cc by"), ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc-by"),
    ("public-domain", ("released into the public domain", "dedicated to the public domain", "placed in the public domain"), (), "public-domain"),
    ("proprietary", ("all rights reserved", "proprietary and confidential"), (), "proprietary"),
]
#: name: (expression around the family's name N and a version V, needs a version, priority, weight)
FORMS = {
    "tag": (r"spdx license identifier N(?: v)?(?: v?V)?(?: only| or later)?", False, 50, 0.99),
    "granted": (r"(?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of )?(?:the )?N(?: license| licence)?(?: version| v)?(?: v?V)?(?: only| or later| or any later version)?", False, 40, 0.95),
    "version": (r"N(?: license| licence)?(?: version| v)? v?V(?: only| or later| international| unported)?", True, 30, 0.9),
    "marked version": (r"N(?: license| licence)? (?:version |v )?(?:v)?V(?: only| or later| license| licence)", True, 32, 0.9),
    "or later": (r"N(?: version| v)? v?V or (?:any later version|at your option any later version)", True, 35, 0.95),
    "name": (r"N", False, 20, 0.7),
}
#: Written rules: keyword, expression over the text's words, label, priority, weight. Notices outrank names, tags outrank all.
WRITTEN = [
    ("permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", 60, 0.97),
    ("permission is hereby granted", r"permission is hereby granted free of charge to any person", "mit", 55, 0.85),
    ("the above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit", 60, 0.9),
    ("permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", 60, 0.97),
    ("permission to use copy modify", r"permission to use copy modify (?:and )?distribute this software and its documentation for any purpose", "historical-permission", 58, 0.85),
    ("redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", 60, 0.97),
    ("redistribution and use", r"redistribution and use in source and binary forms", "bsd", 55, 0.85),
    ("neither the name", r"neither the name of (?:[^ ]+ ){1,12}?nor the names of its contributors may be used to endorse or promote products", "bsd", 60, 0.93),
    ("all advertising materials", r"all advertising materials mentioning features or use of this software must display", "bsd", 60, 0.93),
    ("redistributions of source code", r"redistributions of source code must retain the above copyright notice", "bsd", 58, 0.9),
    ("redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice", "bsd", 58, 0.9),
    ("this program is free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", 62, 0.98),
    ("this program is free software", r"this program is free software you can redistribute it", "gpl", 55, 0.85),
    ("this library is free software", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "lgpl", 62, 0.98),
    ("this library is free software", r"this library is free software you can redistribute it", "lgpl", 55, 0.85),
    ("either version", r"either version (?:2|3) of the license or at your option any later version", "gpl", 52, 0.85),
    ("you should have received a copy", r"you should have received a copy of the gnu general public license", "gpl", 57, 0.95),
    ("you should have received a copy", r"you should have received a copy of the gnu lesser general public license", "lgpl", 57, 0.95),
    ("you should have received a copy", r"you should have received a copy of the gnu affero general public license", "agpl", 57, 0.95),
    ("with the classpath exception", r"(?:gpl|gnu general public license)(?: v| version)? ?(?:2|3)?(?: 0)? with the classpath exception", "gpl-classpath", 61, 0.97),
    ("linking this library statically", r"linking this library statically or dynamically with other modules is making a combined work", "gpl-classpath", 61, 0.97),
    ("gcc runtime library exception", r"gcc runtime library exception", "gpl-gcc", 58, 0.95),
    ("gplv", r"gplv(?:2|3)(?: 0)?(?: only)?", "gpl", 45, 0.9),
    ("lgplv", r"lgplv(?:2|3)(?: 0| 1)?(?: only)?", "lgpl", 45, 0.9),
    ("agplv", r"agplv3(?: 0)?(?: only)?", "agpl", 45, 0.9),
    ("gnu org licenses", r"(?:www )?gnu org licenses (?:old licenses )?gpl(?: 2 0| 3 0)?(?: html| txt)?", "gpl", 59, 0.96),
    ("gnu org licenses", r"(?:www )?gnu org licenses (?:old licenses )?lgpl(?: 2 1| 3 0)?(?: html| txt)?", "lgpl", 59, 0.96),
    ("gnu org licenses", r"(?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?", "agpl", 59, 0.96),
    ("gnu org licenses", r"(?:www )?gnu org licenses fdl(?: 1 2| 1 3)?(?: html| txt)?", "gfdl", 59, 0.96),
    ("apache org licenses", r"(?:www )?apache org licenses license 2 0(?: html| txt)?", "apache", 59, 0.97),
    ("unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache", 60, 0.95),
    ("you may not use this file except", r"you may not use this file except in compliance with the license", "apache", 58, 0.9),
    ("opensource org licenses", r"opensource org licenses? (?:mit|mit license(?: php)?)", "mit", 59, 0.96),
    ("opensource org licenses", r"opensource org licenses? (?:bsd(?: license(?: php)?)?|bsd [234] clause)", "bsd", 59, 0.96),
    ("opensource org licenses", r"opensource org licenses? (?:apache 2 0|apache2 0(?: php)?)", "apache", 59, 0.96),
    ("opensource org licenses", r"opensource org licenses? isc", "isc", 59, 0.96),
    ("creativecommons org", r"creativecommons org licenses by nc nd(?: [0-9] [0-9])?", "cc-by-nc-nd", 63, 0.97),
    ("creativecommons org", r"creativecommons org licenses by nc sa(?: [0-9] [0-9])?", "cc-by-nc-sa", 63, 0.97),
    ("creativecommons org", r"creativecommons org licenses by nc(?: [0-9] [0-9])?", "cc-by-nc", 60, 0.97),
    ("creativecommons org", r"creativecommons org licenses by nd(?: [0-9] [0-9])?", "cc-by-nd", 60, 0.97),
    ("creativecommons org", r"creativecommons org licenses by sa(?: [0-9] [0-9])?", "cc-by-sa", 60, 0.97),
    ("creativecommons org", r"creativecommons org licenses by(?: [0-9] [0-9])?", "cc-by", 58, 0.97),
    ("creativecommons org", r"creativecommons org publicdomain zero(?: 1 0)?", "cc0", 60, 0.97),
    ("creativecommons org", r"creativecommons org publicdomain mark(?: 1 0)?", "public-domain", 60, 0.95),
    ("mozilla org mpl", r"(?:www )?mozilla org mpl(?: 1 1| 2 0)?", "mpl", 59, 0.96),
    ("this source code form is subject", r"this source code form is subject to the terms of the mozilla public license", "mpl", 62, 0.98),
    ("eclipse org legal", r"(?:www )?eclipse org legal epl(?: v10| v20| 2 0)?", "epl", 59, 0.96),
    ("this is free and unencumbered", r"this is free and unencumbered software released into the public domain", "unlicense", 62, 0.98),
    ("anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software", "unlicense", 60, 0.95),
    ("do what the fuck you want", r"(?:you just )?do what the fuck you want to", "wtfpl", 58, 0.95),
    ("this software is provided as is", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "zlib", 60, 0.95),
    ("altered source versions", r"altered source versions must be plainly marked as such", "zlib", 60, 0.95),
    ("boost org license", r"(?:www )?boost org license 1 0(?: txt)?", "boost", 59, 0.97),
    ("scripts sil org ofl", r"scripts sil org ofl", "ofl", 59, 0.97),
    ("openfontlicense org", r"(?:www )?openfontlicense org", "ofl", 59, 0.97),
    ("opendatacommons org", r"(?:www )?opendatacommons org licenses odbl(?: 1 0)?", "odbl", 59, 0.97),
    ("opendatacommons org", r"(?:www )?opendatacommons org licenses by(?: 1 0)?", "odc-by", 59, 0.97),
    ("opendatacommons org", r"(?:www )?opendatacommons org licenses pddl(?: 1 0)?", "pddl", 59, 0.97),
    ("spdx license identifier", r"spdx license identifier mit", "mit", 70, 0.99),
    ("spdx license identifier", r"spdx license identifier bsd [0234] clause", "bsd", 70, 0.99),
    ("spdx license identifier", r"spdx license identifier (?:isc|0bsd)", "isc", 70, 0.99),
    ("spdx license identifier", r"spdx license identifier zlib", "zlib", 70, 0.99),
    ("spdx license identifier", r"spdx license identifier bsl 1 0", "boost", 70, 0.99),
    ("spdx license identifier", r"spdx license identifier gpl 2 0(?: only| or later)? with classpath exception 2 0", "gpl-classpath", 71, 0.99),
    ("under mit", r"(?:licensed|released|distributed|available|published) under (?:the )?mit", "mit", 41, 0.93),
    ("under bsd", r"(?:licensed|released|distributed|available|published) under (?:the |a )?bsd", "bsd", 41, 0.93),
    ("under the mit", r"(?:licensed|released|distributed|available|published) under the mit", "mit", 41, 0.93),
    ("under the bsd", r"(?:licensed|released|distributed|available|published) under the bsd", "bsd", 41, 0.93),
    ("without express written permission", r"no part of this (?:publication|work|document) may be reproduced [^ ]+(?: [^ ]+){0,30}? without (?:the )?(?:prior )?(?:express )?written permission", "proprietary", 58, 0.9),
    ("no part of this publication", r"no part of this publication may be reproduced", "proprietary", 56, 0.85),
    ("gpl v", r"(?:gnu )?gpl (?:v|v |version )[123](?: [01])?(?: or later| only)?", "gpl", 52, 0.95),
    ("lgpl v", r"(?:gnu )?lgpl (?:v|v |version )[23](?: [01])?(?: or later| only)?", "lgpl", 53, 0.95),
    ("agpl v", r"(?:gnu )?agpl (?:v|v |version )[13](?: 0)?(?: or later| only)?", "agpl", 53, 0.95),
    ("mpl v", r"mpl (?:v|v |version )[12](?: [01])?", "mpl", 52, 0.93),
    ("apache v", r"apache (?:v|v |version )2(?: 0)?", "apache", 52, 0.93),
    ("apache2 ", r"apache2(?: 0)? licen[sc]ed?", "apache", 52, 0.93),
    ("bsd ", r"bsd [0234] clause(?: clear)?(?: licen[sc]e)?", "bsd", 52, 0.95),
    ("artistic 2 0", r"artistic 2 0", "artistic", 50, 0.85),
    ("sspl", r"sspl(?: v?1(?: 0)?)?", "sspl", 52, 0.9),
    ("server side public licen", r"server side public licen[sc]e(?: (?:version |v)?1(?: 0)?)?", "sspl", 52, 0.97),
    ("elastic licen", r"elastic licen[sc]e(?: (?:version |v)?[12](?: 0)?)?", "elastic", 52, 0.95),
    ("business source licen", r"business source licen[sc]e(?: (?:version |v)?1 [01])?", "busl", 52, 0.97),
    ("busl 1", r"busl 1 1", "busl", 52, 0.97),
    ("polyform ", r"polyform (?:noncommercial|small business|perimeter|shield|strict|internal use|free trial|defensive)(?: licen[sc]e)?(?: 1 0 0)?", "polyform", 52, 0.97),
    ("commons clause", r"commons clause(?: licen[sc]e)?(?: condition)?(?: v?1 0)?", "commons-clause", 52, 0.95),
    ("beerware", r"(?:the )?beerware(?: licen[sc]e)?", "beerware", 52, 0.93),
    ("beer ware licen", r"(?:the )?beer ware licen[sc]e", "beerware", 52, 0.93),
]
#: Names within an SPDX expression, as words, and their labels.
SPDX = [
    (r"mit", "mit"), (r"0bsd", "bsd"), (r"isc", "isc"), (r"zlib", "zlib"), (r"unlicense", "unlicense"), (r"apache [12] [01]", "apache"), (r"bsd [234] clause", "bsd"),
    (r"lgpl [23] [01](?: only| or later)?", "lgpl"), (r"agpl [13] 0(?: only| or later)?", "agpl"), (r"gpl [123] 0(?: only| or later)?", "gpl"), (r"mpl [12] [01]", "mpl"),
    (r"epl [12] 0", "epl"), (r"cddl 1 [01]", "cddl"), (r"bsl 1 0", "boost"), (r"artistic [12] 0", "artistic"), (r"cc0 1 0", "cc0"), (r"cc by sa [1-4] 0", "cc-by-sa"), (r"cc by [1-4] 0", "cc-by"), (r"busl 1 1", "busl"), (r"sspl 1 0", "sspl"),
]
SPDX_TAG, SPDX_PRIORITY = "spdx license identifier", 72
#: Names too short to say anything outside a tag, a version or a phrase of licensing.
SHORT = {"gpl", "lgpl", "agpl", "apache", "mpl", "epl", "bsl", "the unlicense", "psf license"}


#: A rule begins with a word, and doesn't count behind a "not".
BEGIN = "(?<![^ ])(?<!not )"


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: re.Pattern
    keyword: str
    label: str
    priority: int
    weight: float


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, the highest priority first."""
    out = []
    for family, names, versions, label in FAMILIES:
        for name in names:
            for form, (text, versioned, priority, weight) in FORMS.items():
                if (versioned and not versions) or (form in ("name", "version") and name in SHORT):
                    continue
                any_version = "(?:" + "|".join(sorted(versions, key=len, reverse=True)) + ")" if versions else "(?:0)"
                pattern = text.replace("V", any_version).replace("N", re.escape(name).replace("\\ ", " "))
                out.append(Rule(f"{family}: {form} of {name}", re.compile(f"{BEGIN}{pattern}(?![^ ])"), name, label, priority, weight))
    out += [Rule(f"written {i}: {keyword}", re.compile(f"{BEGIN}{pattern}(?![^ ])"), keyword, label, priority, weight) for i, (keyword, pattern, label, priority, weight) in enumerate(WRITTEN)]
    return tuple(sorted(out, key=lambda r: -r.priority))


@lru_cache(maxsize=1)
def prefilter() -> tuple[ahocorasick.Automaton, dict[str, list[Rule]]]:
    by: dict[str, list[Rule]] = {}
    for rule in rules():
        by.setdefault(rule.keyword, []).append(rule)
    machine = ahocorasick.Automaton()
    for keyword in [*by, *BASE]:
        machine.add_word(keyword, keyword)
    machine.make_automaton()
    return machine, by


#: ASCII upper case to lower, other ASCII that is no letter or digit to a space; other bytes stay.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@lru_cache(maxsize=1)
def expression() -> tuple[re.Pattern, list[tuple[re.Pattern, Rule]]]:
    """An SPDX expression of several names behind its tag, and each name's rule."""
    names = [(re.compile(f"(?<![^ ]){p}(?![^ ])"), Rule(f"spdx expression: {p}", re.compile(p), SPDX_TAG, label, SPDX_PRIORITY, 0.99)) for p, label in SPDX]
    one = "(?:" + "|".join(p for p, _ in SPDX) + ")(?: with [^ ]+(?: [^ ]+){0,3}? exception(?: [0-9] [0-9])?)?"
    return re.compile(f"(?<![^ ]){SPDX_TAG} {one}(?: (?:or|and) {one})+(?![^ ])"), names


def in_expressions(joined: str) -> list[tuple[int, int, Rule]]:
    """Each name of every SPDX expression of several names; of names at one place the longest."""
    whole, names = expression()
    found = []
    for tag in whole.finditer(joined):
        here = [(m.start(), m.end(), rule) for p, rule in names for m in p.finditer(joined, tag.start() + len(SPDX_TAG), tag.end())]
        found += [x for x in here if not any((y[0], y[1]) != (x[0], x[1]) and y[0] <= x[0] and x[1] <= y[1] for y in here)]
    return found


def suppress(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """The detections (begin, end, rule) that don't lie within another of the same or a higher priority."""
    kept: list[tuple[int, int, Rule]] = []
    begins: list[int] = []  # of the kept detections that lie in no other; their ends rise with their begins
    ends: list[int] = []
    for begin, end, rule in sorted(set(found), key=lambda x: (-x[2].priority, -(x[1] - x[0]), x[0], x[2].name)):
        i = bisect_right(begins, begin)
        if i and ends[i - 1] >= end:
            continue
        kept.append((begin, end, rule))
        j = bisect_left(begins, begin)
        while j < len(ends) and ends[j] <= end:
            del begins[j], ends[j]
        begins.insert(j, begin)
        ends.insert(j, end)
    return kept


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    words = (text or "").encode().translate(TO_WORDS).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, []
    joined = b" ".join(words).decode()
    machine, by = prefilter()
    met = {keyword for _, keyword in machine.iter(joined)}
    if not met:
        return len(words), 0, None, None, "", "", 0.0, []
    letters = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    spaces = np.flatnonzero(letters == 32)
    word_at = lambda i: int(np.searchsorted(spaces, i))
    places, base = [], set()
    for phrase, label in BASE.items():
        if phrase in met:
            at = [word_at(m.start()) for m in re.finditer(f"(?<![^ ])(?={phrase}(?![^ ]))", joined)]
            places += at
            if at:
                base.add(label)
    found = [(m.start(), m.end(), rule) for keyword in sorted(met & by.keys()) for rule in by[keyword] for m in rule.pattern.finditer(joined)]
    if SPDX_TAG in met:
        found += in_expressions(joined)
    kept = suppress(found)
    best: dict[str, float] = dict.fromkeys(base, 0.7)
    for _, _, rule in kept:
        best[rule.label] = max(best.get(rule.label, 0.0), rule.weight)
    score = 1.0 - float(np.prod([1.0 - w for w in best.values()])) if best else 0.0
    spans = [f"{rule.label}@{word_at(b)}-{word_at(e) + 1}" for b, e, rule in sorted(kept, key=lambda x: x[:2])]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(best)), score, spans


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(pa.string()))])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for each document; detections: the label and the words (begin, end) of each detection that stands."""

    def run(batches):
        for batch in batches:
            rows = [(i, *scan(t.as_py())) for i, t in zip(batch.column(0).to_pylist(), batch.column(1))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

    return id_text(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<string>")
