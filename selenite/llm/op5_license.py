"""Licences in whole texts: Aho-Corasick for identifier tags and notice phrases, a shunting-yard for expressions.

One automaton runs over the normalised words and finds all places of all phrases; another one finds
identifier tags in the text as written, and what follows a tag on its line is read as an expression
of licences with AND, OR, WITH and parentheses. WITH binds closest, then AND, then OR.

Defined results: a null text is an empty one; without finds the labels are empty strings and the
score is 0; an expression that doesn't parse gives no label, one that does gives all its licences,
however long it is; a licence found in several ways counts once, by the strongest; an empty table
gives an empty one; texts are scanned whole in one pass, whatever their length; repeated rows get
equal results; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .arrow import map_rows
from .common import table

#: Fixed phrases of the base and their labels; the notice phrases that the method adds.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "permission to use copy modify and or distribute this software": "isc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
    "licensed under the mit license": "mit",
    "the software is provided as is without warranty of any kind": "mit",
    "released under the mit license": "mit",
    "apache software license version 1 1": "apache-1.1",
    "you may not use this file except in compliance with the license": "apache-2",
    "neither the name of the copyright holder nor the names of its contributors": "bsd",
    "new bsd license": "bsd",
    "gnu library general public license": "lgpl",
    "gnu free documentation license": "gfdl",
    "either version 2 of the license or at your option any later version": "gpl-2",
    "either version 3 of the license or at your option any later version": "gpl-3",
    "common development and distribution license": "cddl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "boost software license version 1 0": "bsl-1.0",
    "business source license": "busl",
    "server side public license": "sspl",
    "artistic license": "artistic",
    "python software foundation license": "psf",
    "the zlib license": "zlib",
    "sil open font license": "ofl",
    "open database license": "odbl",
    "community data license agreement": "cdla",
    "do what the fuck you want to public license": "wtfpl",
    "academic free license": "afl",
    "creative commons zero": "cc0",
    "cc0 1 0 universal": "cc0",
    "creative commons attribution 4 0 international": "cc-by",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nd": "cc-by-nd",
    "dedicated to the public domain": "public-domain",
    "this work is in the public domain": "public-domain",
    "proprietary and confidential": "proprietary",
}
TAGS = ("spdx-license-identifier:", "license-expression:", "spdx-license:")
#: Labels of identifiers that have one already; others become their own lower-cased identifier.
KNOWN = {
    "mit": "mit", "mit-0": "mit", "apache-2.0": "apache-2", "isc": "isc", "0bsd": "bsd", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd",
    "gpl-2.0": "gpl-2", "gpl-2.0-only": "gpl-2", "gpl-2.0-or-later": "gpl-2", "gpl-2.0+": "gpl-2",
    "gpl-3.0": "gpl-3", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3", "gpl-3.0+": "gpl-3",
    "lgpl-2.1": "lgpl", "lgpl-2.1-only": "lgpl", "lgpl-2.1-or-later": "lgpl", "lgpl-3.0": "lgpl", "lgpl-3.0-only": "lgpl", "lgpl-3.0-or-later": "lgpl",
    "agpl-3.0": "agpl-3", "agpl-3.0-only": "agpl-3", "agpl-3.0-or-later": "agpl-3", "mpl-2.0": "mpl-2", "epl-1.0": "epl", "epl-2.0": "epl",
    "cddl-1.0": "cddl", "eupl-1.1": "eupl", "eupl-1.2": "eupl", "cc0-1.0": "cc0", "ofl-1.1": "ofl", "odbl-1.0": "odbl", "gfdl-1.3": "gfdl", "gfdl-1.3-only": "gfdl",
    "cc-by-3.0": "cc-by", "cc-by-4.0": "cc-by", "cc-by-sa-3.0": "cc-by-sa", "cc-by-sa-4.0": "cc-by-sa", "cc-by-nc-3.0": "cc-by-nc", "cc-by-nc-4.0": "cc-by-nc",
    "cc-by-nd-4.0": "cc-by-nd", "cc-by-nc-sa-4.0": "cc-by-nc-sa", "cc-by-nc-nd-4.0": "cc-by-nc-nd", "unlicense": "unlicense", "wtfpl": "wtfpl", "busl-1.1": "busl", "sspl-1.0": "sspl",
}
#: How much a find of each kind counts.
WEIGHT = {"tag": 0.95, "base": 0.8, "notice": 0.6}

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORDS = bytes(c if chr(c).isdigit() or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
PART = re.compile(rb"[\x20\t]*([()]|[a-z0-9][a-z0-9.+-]*)")
BINDS = {"or": 1, "and": 2, "with": 3}


def expression(text: bytes, at: int) -> list[str]:
    """The parts of an expression that begins at a place, as far as its line and its form go."""
    parts, depth, want = [], 0, True
    while (m := PART.match(text, at)) and text[m.start(1) - 1 : m.start(1)] != b"\n":
        p = m[1].decode()
        if p == "(":
            if not want:
                break
            depth += 1
        elif p == ")":
            if want or not depth:
                break
            depth -= 1
        elif p in BINDS:
            if want:
                break
            want = True
        elif want:
            want = False
        else:
            break
        parts.append(p)
        at = m.end()
    while parts and (parts[-1] in BINDS or parts[-1] == "("):
        parts.pop()
    return parts


def postfix(parts: list[str]) -> list[str] | None:
    """Shunting-yard: the expression in postfix order, None if its parentheses don't match."""
    out, held = [], []
    for p in parts:
        if p == "(":
            held.append(p)
        elif p == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif p in BINDS:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[p]:
                out.append(held.pop())
            held.append(p)
        else:
            out.append(p)
    while held:
        if (p := held.pop()) == "(":
            return None
        out.append(p)
    return out


def licences_of(order: list[str]) -> set[str] | None:
    """The licences that an expression in postfix order names, in time linear in its length; None if it can't be read.

    An exception goes with its one licence into one label.
    """
    stack: list[set[str]] = []
    for p in order:
        if p not in BINDS:
            stack.append({KNOWN.get(p, p)})
            continue
        if len(stack) < 2:
            return None
        b, a = stack.pop(), stack.pop()
        if p == "with":
            if len(a) != 1 or len(b) != 1:
                return None
            a = {f"{a.pop()}-with-{b.pop()}"}
        else:
            a, b = (a, b) if len(a) >= len(b) else (b, a)
            a |= b
        stack.append(a)
    return stack[0] if len(stack) == 1 else None


class Scanner:
    def __init__(self):
        import ahocorasick

        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for kind, table_ in (("notice", NOTICES), ("base", BASE)):
            for p, label in table_.items():
                self.phrases.add_word(f" {p} ", (kind, label, len(p) + 1))
        for t in TAGS:
            self.tags.add_word(t, len(t))
        self.phrases.make_automaton()
        self.tags.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, tagged expressions in postfix order."""
        raw = (text or "").encode()
        words = raw.translate(WORDS).split()
        joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
        base, found, n_base, first, last, at, seen = set(), {}, 0, None, None, 0, 0
        for end, (kind, label, length) in self.phrases.iter(joined):
            found[label] = max(found.get(label, 0), WEIGHT[kind])
            if kind == "base":
                base.add(label)
                n_base += 1
                start = end - length  # of the blank before the first word
                seen, at = (seen + joined.count(" ", at, start), start) if start >= at else (joined.count(" ", 0, start), start)
                first = seen if first is None else min(first, seen)
                last = seen if last is None else max(last, seen)
        expressions = []
        lower = raw.translate(LOWER)
        for end, _ in self.tags.iter(lower.decode("latin-1")):
            order = postfix(expression(lower, end + 1))
            if order and (got := licences_of(order)):
                expressions.append(" ".join(order))
                found |= dict.fromkeys(got, WEIGHT["tag"])
        rest = 1.0
        for w in sorted(found.values()):
            rest *= 1 - w
        return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(found)), round(1 - rest, 6), expressions


def licences(docs: DataFrame) -> DataFrame:
    def make():
        scanner = Scanner()
        return lambda cols: [cols["doc_id"], *map(list, zip(*map(scanner.scan, cols["text"])))]

    kinds = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, expressions array<string>"
    return map_rows(docs.select("doc_id", "text"), make, kinds)


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))
