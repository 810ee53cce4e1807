"""License scans: base places against a search by words, notices and tags on known texts, expressions against a parser of another kind."""

import random
import re
import time

import pytest

pytest.importorskip("textloom.llm")
from textloom.llm import licenses  # noqa: E402

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(text):
    words = WORD.findall((text or "").translate(UPPER))
    places = [(k, label) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_places(spark):
    rnd = random.Random(6)
    bits = ["cc", "by", "CC-BY", "general", "Public", "license", "all", "Rights", "reserved", "é", "\x85", "İ", "K", "x", "cc by cc by", "sa", "4.0"]
    texts = [" ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))).replace(" ", rnd.choice((" ", "\n", ", ", "\x00", "."))) for _ in range(300)] + [None, "", " \n", "cc by " * 50_000, "cc" * 100_000]
    rows = [(k % 290 if k % 7 else None, t, 0, "", 0.5) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, labels string, score double").repartition(3)
    got = [tuple(r) for r in licenses.scan_licenses(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(got, key=key) == sorted(((i, *brute(t)) for i, t, *_ in rows), key=key)
    found = licenses.scan_licenses(df).collect()
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in found)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,labels,demand",
    [
        ("// SPDX-License-Identifier: MIT", "mit", "notice"),
        ("# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR MIT\nimport x", "gpl,mit", "notice"),
        ("/* SPDX-License-Identifier: (MIT AND Apache-2.0) */", "apache,mit", "notice"),
        ("SPDX-License-Identifier: LicenseRef-Own", "other", "leave"),
        ("SPDX-License-Identifier: Strange-1.0", "other", None),
        ('{"name": "x", "license": "BSD-3-Clause"}', "bsd", "notice"),
        ("License: AGPL-3.0-or-later.", "agpl", "network"),
        ("License: see the file beside this", "", None),
        ("This license, as a word: nothing. Licensed goods; unlicensed: MIT", "", None),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl", None),
        ("Licensed under the Apache License, Version 2.0 (the License)", "apache", None),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit", None),
        ("GNU Lesser General\n * Public License", "gpl,lgpl", None),
        ("Creative Commons Attribution-ShareAlike (CC BY-SA 4.0)", "cc-by,cc-by-sa", None),
        ("© 2020. All rights reserved.", "reserved", None),
        ("Tous droits réservés", "reserved", None),
        ("a clean text by cc about general public matters", "", None),
    ],
)
def test_labels(text, labels, demand):
    got = licenses.scan_text(text)
    assert (got[5], got[8]) == (labels, demand)


def reference(tokens):
    """A recursive descent over a whole expression: the demand of each rule."""

    def unit():
        if tokens[0] == "(":
            tokens.pop(0)
            v = choice()
            assert tokens.pop(0) == ")"
            return v
        v = licenses.identify(tokens.pop(0))
        v = v and v[1]
        if tokens and tokens[0].lower() == "with":
            del tokens[:2]
            v = None if v is None else max(v - 1, min(v, 1))
        return v

    def joined(part, word, least):
        v = part()
        while tokens and tokens[0].lower() == word:
            tokens.pop(0)
            w = part()
            v = w if v is None else v if w is None else least(v, w)
        return v

    def choice():
        return joined(lambda: joined(unit, "and", max), "or", min)

    return choice()


def test_expressions():
    rnd = random.Random(9)

    def grow(depth):
        if depth == 0 or rnd.random() < 0.3:
            one = rnd.choice(("MIT", "GPL-3.0-or-later", "apache-2.0", "LGPL-2.1+", "AGPL-3.0-only", "Foo-1.0", "MPL-2.0", "CC0-1.0"))
            return [one, rnd.choice(("WITH", "with")), "Some-exception-1.0"] if rnd.random() < 0.2 else [one]
        a, b = grow(depth - 1), grow(depth - 1)
        out = [*a, rnd.choice(("AND", "or", "OR", "and")), *b]
        return ["(", *out, ")"] if rnd.random() < 0.5 else out

    for _ in range(500):
        tokens = grow(4)
        text = " ".join(tokens).replace("( ", "(").replace(" )", ")")
        got = licenses.parse_expression(text + "\nmore text")
        assert got.whole and got.end == len(text) and got.demand == reference(list(tokens)), text
    cut = {"MIT OR": (["MIT"], False), "(MIT OR Apache-2.0": (["MIT", "Apache-2.0"], False), "MIT this file": (["MIT"], True), "MIT)": (["MIT"], True), "MIT AND (": (["MIT"], False), "MIT with": (["MIT"], False)}
    for text, (names, whole) in cut.items():
        got = licenses.parse_expression(text)
        assert (got.licenses, got.whole) == (names, whole), text
    for text in ("", "OR MIT", ")", "(", "()", "(((", "\nMIT"):
        assert licenses.parse_expression(text) is None, text


def test_long_texts():
    """Twice the text takes about twice the time, also where it is full of tags, parentheses and phrases."""
    for bit in ("spdx-license-identifier: (", "license: MIT OR (", "(", "SPDX-License-Identifier: MIT\n", "all rights reserved ", "MIT OR "):
        took = []
        for size in (1_000_000, 2_000_000):
            text = "SPDX-License-Identifier: " + bit * (size // len(bit))
            began = time.perf_counter()
            licenses.scan_text(text)
            took.append(time.perf_counter() - began)
        assert took[1] < 3.5 * took[0] + 0.2 and took[1] < 20, (bit, took)
