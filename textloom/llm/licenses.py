"""License scans: tags and notice phrases found by an Aho-Corasick automaton, and license expressions read by a shunting-yard parser.

A text is reduced to its words once, and one pass of the automaton over them finds all phrases at all places; a second pass over the lower-cased text finds tags that are
followed by an expression, such as ``SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0``. The parser brings the expression into postfix order
(``with`` binds before ``and``, ``and`` before ``or``) and evaluates it on the way: its licenses, and how much the whole asks of a reader, where ``or`` is the lesser, ``and`` the greater of
its two sides, and an exception takes one step off the license before it.

Null and empty texts have no words, places, labels or expressions and the score 0. Time grows with the length of a text, however it is built; nothing is cut off. Rows are
independent, so equal rows have equal results and identifiers may repeat or be null; further columns never reach the operator; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, quote_columns

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# What texts say of licenses, the label that follows, and how sure it is.
NOTICES = {
    "cc by sa": ("cc-by-sa", 0.7), "cc by nc": ("cc-by-nc", 0.7), "cc by nd": ("cc-by-nd", 0.7), "cc by nc sa": ("cc-by-nc-sa", 0.7), "cc by nc nd": ("cc-by-nc-nd", 0.7), "cc0": ("cc0", 0.6),
    "creative commons attribution": ("cc-by", 0.8), "creative commons attribution sharealike": ("cc-by-sa", 0.9), "creative commons attribution share alike": ("cc-by-sa", 0.9),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.9), "creative commons attribution non commercial": ("cc-by-nc", 0.9), "creative commons zero": ("cc0", 0.9),
    "dedicated to the public domain": ("public-domain", 0.8), "released into the public domain": ("public-domain", 0.8), "free and unencumbered software released into the public domain": ("unlicense", 0.95),
    "gnu general public license": ("gpl", 0.8), "gnu lesser general public license": ("lgpl", 0.9), "gnu library general public license": ("lgpl", 0.9), "gnu affero general public license": ("agpl", 0.9),
    "gnu free documentation license": ("gfdl", 0.9), "apache license": ("apache", 0.7), "licensed under the apache license version 2 0": ("apache", 0.95), "mit license": ("mit", 0.7),
    "licensed under the mit license": ("mit", 0.9), "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9), "bsd license": ("bsd", 0.7),
    "redistribution and use in source and binary forms with or without modification are permitted": ("bsd", 0.9), "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.9),
    "isc license": ("isc", 0.7), "mozilla public license": ("mpl", 0.8), "eclipse public license": ("epl", 0.8), "european union public licence": ("eupl", 0.8), "boost software license": ("bsl", 0.8),
    "artistic license": ("artistic", 0.7), "zlib license": ("zlib", 0.7), "open database license": ("odbl", 0.8), "sil open font license": ("ofl", 0.8), "do what the fuck you want to public license": ("wtfpl", 0.9),
    "proprietary and confidential": ("proprietary", 0.8), "unauthorized copying of this file": ("proprietary", 0.8), "no part of this publication may be reproduced": ("reserved", 0.9), "alle rechte vorbehalten": ("reserved", 0.6),
    "tous droits réservés": ("reserved", 0.6), "todos los derechos reservados": ("reserved", 0.6),
}
#: How sure a base phrase and an expression of known and of unknown licenses are; a base phrase that a notice holds adds nothing of its own.
BASE_SURE, KNOWN_SURE, UNKNOWN_SURE = 0.5, 0.95, 0.5
# What licenses ask: nothing, a notice, the same license for changed files, for the whole work, also over a network, or no use without leave.
DEMANDS = ("none", "notice", "files", "work", "network", "leave")
# The first parts of license identifiers, their labels and what they ask.
IDENTIFIERS = {
    "0bsd": ("0bsd", 0), "cc0": ("cc0", 0), "unlicense": ("unlicense", 0), "wtfpl": ("wtfpl", 0), "mit-0": ("mit", 0), "pddl": ("public-domain", 0), "mit": ("mit", 1), "x11": ("mit", 1), "isc": ("isc", 1), "bsd": ("bsd", 1), "apache": ("apache", 1),
    "zlib": ("zlib", 1), "libpng": ("zlib", 1), "bsl": ("bsl", 1), "artistic": ("artistic", 1), "python": ("python", 1), "psf": ("python", 1), "postgresql": ("postgresql", 1), "ncsa": ("ncsa", 1), "unicode": ("unicode", 1), "curl": ("mit", 1), "ms-pl": ("ms-pl", 1),
    "ofl": ("ofl", 1), "cc-by": ("cc-by", 1), "odc-by": ("odc-by", 1), "mpl": ("mpl", 2), "lgpl": ("lgpl", 2), "epl": ("epl", 2), "cddl": ("cddl", 2), "ms-rl": ("ms-rl", 2), "gpl": ("gpl", 3), "eupl": ("eupl", 3), "gfdl": ("gfdl", 3), "odbl": ("odbl", 3), "osl": ("osl", 3),
    "cc-by-sa": ("cc-by-sa", 3), "agpl": ("agpl", 4), "sspl": ("sspl", 4), "cc-by-nc": ("cc-by-nc", 5), "cc-by-nd": ("cc-by-nd", 5), "cc-by-nc-sa": ("cc-by-nc-sa", 5), "cc-by-nc-nd": ("cc-by-nc-nd", 5), "busl": ("busl", 5), "licenseref": ("other", 5),
}
# Tags that an expression follows, and whether one of unknown licenses counts after them.
TAGS = {"spdx-license-identifier": True, "license-expression": True, "license": False, "licence": False}
BINDS = {"or": 1, "and": 2, "with": 3}

_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:_-]*)")
_AFTER_TAG = re.compile(r"""["']?[ \t]*[:=][ \t]*["']?""")
_NO_WORD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def _automaton(patterns: dict) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for text, value in patterns.items():
        a.add_word(text, (len(text), value))
    a.make_automaton()
    return a


def _as_bytes(text: str) -> str:
    """A character for each UTF-8 byte, as the automaton reads them."""
    return text.encode().decode("latin-1")


_WORDS = _automaton({f" {_as_bytes(k)} ": (BASE.get(k), NOTICES.get(k)) for k in {**BASE, **NOTICES}})
_TAGS = _automaton(TAGS)


def identify(name: str) -> tuple[str, int] | None:
    """The label and demand of a license identifier; versions and suffixes don't matter: its longest known first part decides."""
    parts = re.split(r"[-_]", name.lower().rstrip("+"))
    for n in range(len(parts), 0, -1):
        if found := IDENTIFIERS.get("-".join(parts[:n])):
            return found
    return None


@dataclass(frozen=True)
class Expression:
    """``licenses`` in their order, all in ``postfix`` order, the ``demand`` of the whole (None if no license is known), ``whole`` if nothing had to be closed or dropped, and its ``end``."""

    licenses: list[str]
    postfix: list[str]
    demand: int | None
    whole: bool
    end: int


def _apply(op: str, values: list) -> None:
    b, a = values.pop(), values.pop()
    if op == "with":
        values.append(None if a is None else max(a - 1, min(a, 1)))
    else:  # an unknown side doesn't decide
        values.append(b if a is None else a if b is None else min(a, b) if op == "or" else max(a, b))


def parse_expression(text: str, start: int = 0) -> Expression | None:
    """The longest expression that begins at ``start`` and ends in the same line; None if there is none.

    A trailing operator is dropped and open parentheses are closed at its end; ``whole`` is false then.
    """
    ops: list[str] = []
    values: list[int | None] = []
    licenses, postfix = [], []
    at, operand, whole, after_with = start, True, True, False
    while m := _TOKEN.match(text, at):
        token = m.group(1)
        if len(token) > 1 and token[-1] in ".:" and not after_with:
            token = token.rstrip(".:")  # the end of a sentence
        word = token.lower()
        if operand:
            if word in BINDS or token == ")":
                break
            if token == "(":
                if after_with:
                    break
                ops.append(token)
            else:
                found = identify(token)
                if after_with:
                    values.append(None)
                else:
                    licenses.append(token)
                    values.append(found[1] if found else None)
                postfix.append(token)
                operand, after_with = False, False
        elif word in BINDS:
            if word == "with" and (not postfix or postfix[-1].lower() in BINDS):
                break  # an exception belongs to a license
            while ops and ops[-1] != "(" and BINDS[ops[-1]] >= BINDS[word]:
                postfix.append(ops.pop())
                _apply(postfix[-1], values)
            ops.append(word)
            operand, after_with = True, word == "with"
        elif token == ")":
            if "(" not in ops:
                break
            while ops[-1] != "(":
                postfix.append(ops.pop())
                _apply(postfix[-1], values)
            ops.pop()
        else:
            break  # the sentence goes on
        at = m.end()
        if len(token) < len(m.group(1)):
            break
    while operand and ops:  # what came last has no right side
        whole = False
        operand = ops.pop() == "("
    if not licenses:
        return None
    while ops:
        op = ops.pop()
        if op == "(":
            whole = False
        else:
            postfix.append(op)
            _apply(op, values)
    return Expression(licenses, postfix, values[0], whole, at)


def _phrases(line: str) -> list[tuple[int, int, str | None, tuple[str, float] | None]]:
    """Start, end, base label and notice of all phrases in a line of words that spaces divide, begin and end."""
    found = [(end - size + 1, end, base, notice) for end, (size, (base, notice)) in _WORDS.iter(line)]
    return sorted(found, key=lambda p: (p[0], -p[1]))


def _expressions(text: str) -> Iterator[tuple[str, Expression, bool]]:
    """The expressions after tags with their texts; the flag says that unknown licenses count."""
    low, done = text.lower(), 0
    for end, (size, alone) in _TAGS.iter(low):
        start = end - size + 1
        m = _AFTER_TAG.match(low, end + 1)
        if m and start >= done and not (start and low[start - 1].isalnum()) and (found := parse_expression(text, m.end())):
            done = found.end
            yield text[m.end() : found.end].strip(), found, alone


def scan_text(text: str | None) -> tuple:
    """Number of words and of base places, first and last start of these, base labels, all labels, score, expressions, and what the strictest of them asks."""
    data = (text or "").encode()
    words = data.lower().translate(_NO_WORD).split()  # of bytes only A-Z are lowered
    line = f" {b' '.join(words).decode('latin-1')} "
    places = _phrases(line)
    starts = [p[0] for p in places if p[2]]
    # the words before a place are the spaces before it
    first = line.count(" ", 0, starts[0]) if starts else None
    last = first + line.count(" ", starts[0], starts[-1]) if starts else None
    base = {p[2] for p in places if p[2]}
    sure: dict[str, float] = {}
    inside = -1
    for _, end, base_label, notice in places:
        if end > inside:  # else it stands in a longer phrase, which says more
            inside = end
            label, weight = notice or (base_label, BASE_SURE)
            sure[label] = max(sure.get(label, 0.0), weight)
    expressions, demand = [], None
    for span, found, alone in _expressions(data.decode("latin-1")):
        known = [identify(x) for x in found.licenses]
        if not alone and known[0] is None:
            continue
        expressions.append(span)
        for x in known:
            label, weight = (x[0], KNOWN_SURE if found.whole else UNKNOWN_SURE) if x else ("other", UNKNOWN_SURE)
            sure[label] = max(sure.get(label, 0.0), weight)
        if found.demand is not None:
            demand = max(demand or 0, found.demand)
    doubt = 1.0
    for label in sorted(sure):
        doubt *= 1 - sure[label]
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | set(sure))), 1 - doubt, expressions, None if demand is None else DEMANDS[demand]


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, demand string"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and for each row: ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` of the base phrases; ``labels`` with those of notices and expressions;
    ``score``, the chance that at least one of these holds, each label by its surest sign; ``expressions``; ``demand``, what the strictest expression asks (one of ``DEMANDS``, or null).
    """
    rows = docs.select(*quote_columns(docs, id_col, text_col)).toDF("id", "text")
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                found = zip(*map(scan_text, b.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(found, types, strict=True))], ["id", *names])

    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, {COLUMNS}").toDF(id_col, *names)
