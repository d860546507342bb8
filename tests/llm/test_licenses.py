import re

from terrafold.llm.licenses import BASE, rules, scan, scan_licenses, suppress

from .corpus import collected, frame, lower, texts

CASES = [
    "Licensed under the Apache License, Version 2.0.", "mit license MIT License MIT-LICENSE", "gnu general public licenses", "CC BY-SA 4.0 and cc by", "cc by cc by", "GNU General Public License v3 or later",
    "éapache license apache licensé", None, "", "   ", "SPDX-License-Identifier: GPL-2.0-only", "all rights reserved " * 3000,
]


def brute(text):
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lower(text or ""))
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_against_brute_force(spark):
    rows = list(enumerate(CASES + texts()))
    got = collected(scan_licenses(frame(spark, rows)))
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not r["base_labels"]
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_rules_and_suppression():
    assert 200 < len(rules()) and len({r.name for r in rules()}) == len(rules())
    assert scan("SPDX-License-Identifier: GPL-2.0-only")[7] == ["gpl@0-7"]
    assert scan("Creative Commons Attribution-NonCommercial 4.0 International")[5] == "cc-by-nc"
    assert scan("GNU General Public License v3 or later")[7] == ["gpl@0-7"]
    r = rules()[-1]
    kept = suppress([(0, 10, r), (2, 5, r), (8, 12, r), (8, 12, r), (8, 11, r)])
    assert sorted(x[:2] for x in kept) == [(0, 10), (8, 12)]


PROBES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"), ("Redistribution and use in source and binary forms, with or without", "bsd"), ("see https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa"),
    ("http://www.apache.org/licenses/LICENSE-2.0", "apache"), ("SPDX-License-Identifier: MIT", "mit"), ("The code is licensed under MIT.", "mit"), ("It is GPLv3.", "gpl"), ("This program is free software; you can redistribute it", "gpl"),
    ("creativecommons.org/licenses/by/4.0", "cc-by"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd"), ("epl 1 0 football score", ""), ("the permission of the city was granted", ""), ("apache helicopters 2 0", ""),
]


MORE_PROBES = [
    ("It is under GPL v2.", "gpl"), ("LGPL v2.1 or later", "lgpl"), ("BSD 3-Clause License", "bsd"), ("Artistic-2.0", "artistic"), ("the apache2 license", "apache"), ("SSPL", "sspl"), ("Server Side Public License v1", "sspl"),
    ("Elastic License 2.0", "elastic"), ("Business Source License 1.1", "busl"), ("PolyForm Noncommercial License 1.0.0", "polyform"), ("with the Commons Clause", "commons-clause"), ("THE BEER-WARE LICENSE", "beerware"), ("beerware", "beerware"),
    ("This is not licensed under MIT.", ""), ("an artistic evening with beer", ""), ("a business source said", ""),
]
EXPRESSIONS = [
    ("SPDX-License-Identifier: Apache-2.0 OR MIT", "apache,mit"), ("SPDX-License-Identifier: (MIT AND BSD-3-Clause) or more", "bsd,mit"),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note exception OR BSD-2-Clause", "bsd,gpl"), ("SPDX-License-Identifier: MIT or so", "mit"),
]
PROBES += MORE_PROBES


def test_expressions_by_labels():
    for text, labels in EXPRESSIONS:
        assert scan(text)[5] == labels, text


def test_written_rules_by_labels():
    for text, labels in PROBES:
        assert scan(text)[5] == labels, text


def test_every_label_is_a_rule_over_the_whole_text_met_without_the_prefilter():
    """Brute force: every rule is tried on every text, without keywords, and what lies within a detection of the same or a higher priority goes."""
    for text in [t for t, _ in PROBES] + CASES[:6] + [" ".join(t for t, _ in PROBES)]:
        words = " ".join(re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lower(text or "")))
        found = {(m.start(), m.end(), r) for r in rules() for m in r.pattern.finditer(words)}
        stands = {r.label for a, b, r in found if not any(c <= a and b <= d and (c, d) != (a, b) and q.priority >= r.priority for c, d, q in found)}
        base = {x for x in brute(text)[4].split(",") if x}
        assert set(scan(text)[5].split(",")) - {""} <= stands | base, text
        assert base <= set(scan(text)[5].split(",")) | {""} - {""} or not base


def test_empty_table_and_repeated_rows(spark):
    assert scan_licenses(frame(spark, [])).count() == 0
    rows = scan_licenses(frame(spark, [(1, "mit license"), (1, "mit license"), (None, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["labels"]) for r in rows) == [(0, ""), (1, "mit"), (1, "mit")]
