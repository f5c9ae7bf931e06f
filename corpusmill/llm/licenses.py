"""Licence scans: one Aho-Corasick pass over each whole text, then licence expressions by a shunting-yard parser.

Words are runs of a-z (after lower-casing A-Z), 0-9 and characters from U+0080. The automaton holds notice phrases,
phrases of the licences' own texts, and the words of the identifier tag. Where the tag stands, the expression behind it
is parsed, on its line and no further than the grammar goes: identifiers joined by and, or and with, in brackets. Notices
that follow each other within three words of which one is "and", "or" or "with" form an expression too. `or` takes the
better value, `and` the worse, `with` (an exception) adds 0.1.

Defined cases: a null text is empty; a text without licence words has empty labels and score 0.5 (nothing known); each
row gives a row, repeated or not; very long texts are read in one pass, in time linear in their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The base phrases.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices that the method adds.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "bsd license": "bsd",
    "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0": "cc0",
    "public domain": "public-domain", "all rights reserved": "reserved", "the unlicense": "unlicense", "isc license": "isc",
}
#: Phrases of the licences' own texts and headers.
GRANTS = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit", "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc", "you may not use this file except in compliance with the license": "apache",
    "redistribute it and or modify it under the terms of the gnu general public license": "gpl", "redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl", "free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution": "cc-by", "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa", "creative commons attribution noderivatives": "cc-by-nd", "creative commons zero": "cc0",
}
PHRASES = BASE | NOTICES | GRANTS
TAG = "spdx license identifier"
#: Identifiers' first parts by label; versions and the like follow behind a hyphen.
IDENTIFIERS = {
    "mit": "mit mit-0", "apache": "apache", "bsd": "bsd 0bsd", "isc": "isc", "cc0": "cc0", "unlicense": "unlicense", "cc-by": "cc-by", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa",
    "cc-by-nd": "cc-by-nd", "mpl": "mpl", "lgpl": "lgpl", "gpl": "gpl", "agpl": "agpl", "epl": "epl", "eupl": "eupl", "cddl": "cddl", "artistic": "artistic", "zlib": "zlib", "bsl": "bsl",
    "psf": "psf python", "ofl": "ofl", "wtfpl": "wtfpl", "odbl": "odbl", "pddl": "pddl", "ncsa": "ncsa", "postgresql": "postgresql", "upl": "upl", "x11": "x11", "cecill": "cecill",
}
#: How freely a text under a licence may be used, 0 to 1.
VALUES = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "unlicense": 1.0, "public-domain": 1.0, "cc-by": 0.9, "mpl": 0.6,
    "zlib": 1.0, "bsl": 1.0, "psf": 1.0, "wtfpl": 1.0, "pddl": 1.0, "ncsa": 1.0, "postgresql": 1.0, "upl": 1.0, "x11": 1.0, "ofl": 0.8, "artistic": 0.7, "epl": 0.6, "cddl": 0.6,
    "eupl": 0.5, "odbl": 0.5, "cecill": 0.4, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "reserved": 0.0,
}
UNKNOWN = 0.5
RANK = {"or": 1, "and": 2, "with": 3}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string"

_TO_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TAGGED = re.compile(rb"spdx-license-identifier:[ \t]*([^\n\r]*)", re.I)
_TOKEN = re.compile(r"\s*([()]|[a-z0-9][a-z0-9.+:-]*)")
_STARTS = {start: label for label, starts in IDENTIFIERS.items() for start in starts.split()}


def family(name: str) -> str | None:
    """The label of an identifier such as gpl-3.0-or-later: by the longest known start that a hyphen, a digit, a dot or a plus follows; None if unknown."""
    for n in range(len(name), 0, -1):
        if name[:n] in _STARTS and (n == len(name) or name[n] in "-.+0123456789"):
            return _STARTS[name[:n]]
    return name if name.startswith("licenseref-") or name in VALUES else None


def tag_tokens(line: str) -> list[str]:
    """The tokens of the licence expression at the start of a line; what the grammar does not take ends it."""
    out: list[str] = []
    at, depth, operand = 0, 0, False
    while m := _TOKEN.match(line, at):
        t, at = m[1].rstrip("."), m.end()
        if t == "(" and not operand:
            depth += 1
        elif t == ")" and operand and depth:
            depth -= 1
        elif t in RANK and operand:
            operand = False
        elif not operand and t not in RANK and t not in "()" and (family(t) or out[-1:] == ["with"]):
            operand = True
        else:
            break
        out.append(t)
        if m[1].endswith("."):
            break
    while out and (out[-1] in RANK or out[-1] == "("):
        out.pop()
    return out


def shunting_yard(tokens: list[str]) -> list[str]:
    """Infix licence tokens to postfix; brackets that don't match are passed over, a missing operator reads as `and`."""
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for t in tokens:
        if t in RANK:
            if not operand:
                continue
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = False
            continue
        if t == ")":
            if "(" in stack and operand:
                while stack[-1] != "(":
                    out.append(stack.pop())
                stack.pop()
            continue
        if operand:
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK["and"]:
                out.append(stack.pop())
            stack.append("and")
            operand = False
        if t == "(":
            stack.append(t)
        else:
            out.append(t)
            operand = True
    while stack:
        if (t := stack.pop()) != "(":
            out.append(t)
    return out


def evaluate(postfix: list[str]) -> tuple[float, list[str]]:
    """Value and labels of a postfix expression; the right side of `with` is an exception, not a licence."""
    stack: list[tuple[float, set[str]]] = []
    for t in postfix:
        if t not in RANK:
            label = family(t) or t
            stack.append((VALUES.get(label, UNKNOWN), {label}))
        elif len(stack) >= 2:
            (v, right), (u, left) = stack.pop(), stack.pop()
            if t == "with":
                stack.append((min(1.0, u + 0.1), left))
                continue
            more, less = (left, right) if len(left) >= len(right) else (right, left)
            more |= less
            stack.append((max(u, v) if t == "or" else min(u, v), more))
    return (min(v for v, _ in stack), sorted({x for _, ls in stack for x in ls})) if stack else (UNKNOWN, [])


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in [*PHRASES, TAG]:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(raw: bytes, found) -> tuple:
    """n_words, n_base, first, last, base labels, labels, score, expressions of one text."""
    words = raw.translate(_TO_WORDS).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits = []  # (first word, words, phrase)
    blanks, seen = 0, 0  # blanks before `seen`; ends never go back
    for end, phrase in found.iter(line):
        blanks, seen = blanks + line.count(" ", seen, end), end
        n = phrase.count(" ") + 1
        hits.append((blanks - n, n, phrase))
    if not hits:
        return len(words), 0, None, None, "", "", UNKNOWN, ""
    base = [h for h in hits if h[2] in BASE]
    values, labels, expressions = [], {BASE[h[2]] for h in base}, []
    tokens: list[str] = []
    at, reach = None, 0
    for first, n, phrase in sorted((h for h in hits if h[2] != TAG), key=lambda h: (h[0], -h[1])):
        if first + n <= reach:
            continue  # lies in a longer one
        reach = first + n
        label = PHRASES[phrase]
        between = [w.decode("latin-1") for w in words[at:first]] if at is not None and 0 <= first - at <= 3 else []
        joint = next((w for w in between if w in RANK), None)
        if tokens and joint is None:
            expressions.append(tokens)
            tokens = []
        tokens += [joint, label] if tokens else [label]
        at = first + n
    expressions += [tokens] if tokens else []
    if any(h[2] == TAG for h in hits):
        expressions += [tag_tokens(m[1].decode("utf-8", "replace").lower()) for m in _TAGGED.finditer(raw)]
    for e in expressions:
        v, ls = evaluate(shunting_yard(e))
        if ls:
            values.append(v)
            labels.update(ls)
    return (
        len(words), len(base), min((h[0] for h in base), default=None), max((h[0] for h in base), default=None), ",".join(sorted({BASE[h[2]] for h in base})),
        ",".join(sorted(x.replace(",", " ") for x in labels)), float(min(values, default=UNKNOWN)), "; ".join(dict.fromkeys(" ".join(e) for e in expressions if e)),
    )


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: key, word counts and places of the base phrases, labels, score and the expressions found."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for b in batches:
            rows = [scan(t.as_buffer().to_pybytes() if t.is_valid else b"", found) for t in b.column(1)]
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [key, *[x.split()[0] for x in SCHEMA.split(", ")[1:]]])

    return docs.selectExpr(f"cast(`{key}` as long) as `{key}`", f"cast(`{text}` as string) as `{text}`").mapInArrow(job, SCHEMA.replace("doc_id", f"`{key}`", 1))
