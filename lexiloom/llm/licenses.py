"""License scan: fuzzy search of short notices.

A notice of n characters may have k = n // ``per_error`` errors (insertions, deletions,
substitutions). Cut into k + 1 pieces, at least one of them is unharmed in any such occurrence, so an
automaton over the pieces of all notices finds every place worth looking at in one pass. There the
regex library's bounded-error matching verifies, and reports the span with the fewest errors.

Letters match without regard to ASCII case; runs of white space match one blank at one error for each
further character. Spans of one notice don't overlap; where spans of different notices do, the one
with the smallest share of errors stays, of equal ones the longer, then the one that starts first,
then the first by name. Offsets count characters, the end is exclusive.

Defined results: null and empty texts report nothing; very long texts are scanned whole, in time that
grows with their length; rows that repeat, or have null doc_id, are reported row by row; of an empty
table the result is empty; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import slices

NOTICES: dict[str, str] = {
    "MIT": "Released under the MIT License",
    "MIT-licensed": "Licensed under the MIT License",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "GPL-2.0": "licensed under the GNU General Public License, version 2",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "LGPL": "licensed under the GNU Lesser General Public License",
    "AGPL-3.0": "licensed under the GNU Affero General Public License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification",
    "MPL-2.0": "subject to the terms of the Mozilla Public License",
    "CC-BY": "Licensed under CC BY 4.0",
    "CC-BY-SA": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0",
    "CC-BY-ND": "Licensed under CC BY-ND 4.0",
    "CC": "licensed under a Creative Commons",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose",
    "Unlicense": "free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
}
_FOUND = "doc_id long, license string, start int, end int, errors int, matched string"
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\r", "abcdefghijklmnopqrstuvwxyz   ")


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 parts of about equal length."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(8)
def _machine(notices: tuple[tuple[str, str], ...], per_error: int) -> tuple:
    automaton, known = ahocorasick.Automaton(), []
    seeds: dict[str, list[tuple[int, int]]] = {}
    for k, (name, text) in enumerate(notices):
        text = text.translate(_FOLD)
        errors = len(text) // per_error
        known.append((name, text, errors, regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={errors}}}")))
        for offset, piece in pieces(text, errors):
            seeds.setdefault(piece, []).append((k, offset))
    for piece, where in seeds.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    return automaton, known


def _best(pattern: regex.Pattern, text: str, start: int, end: int, out: list[tuple[int, int, int]]) -> None:
    """The spans with the fewest errors, then those left and right of it."""
    while start < end and (m := pattern.search(text, start, end)):
        a, b, e = m.start(), m.end(), sum(m.fuzzy_counts)
        out.append((a, b, e))
        _best(pattern, text, start, a, out)
        start = b


def notices_of(text: str, notices: tuple[tuple[str, str], ...], per_error: int) -> list[tuple[int, int, str, int]]:
    """(start, end, name, errors) of the notices in a text."""
    automaton, known = _machine(notices, per_error)
    folded = text.translate(_FOLD) if not text.isascii() else text.lower().translate(_FOLD)
    windows: dict[int, list[list[int]]] = {}
    for at, (size, where) in automaton.iter(folded):
        for k, offset in where:
            n, errors = len(known[k][1]), known[k][2]
            begin = at - size + 1 - offset
            a, b = max(0, begin - errors), min(len(folded), begin + n + errors)
            own = windows.setdefault(k, [])
            if own and a <= own[-1][1] and own[-1][0] <= b:
                own[-1] = [min(a, own[-1][0]), max(b, own[-1][1])]
            else:
                own.append([a, b])
    spans = []
    for k, own in windows.items():
        name, notice, _, pattern = known[k]
        merged: list[list[int]] = []
        for a, b in sorted(own):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            found: list[tuple[int, int, int]] = []
            _best(pattern, folded, a, b, found)
            spans += [(e / len(notice), s - t, s, t, name, e) for s, t, e in found]
    kept: list[tuple[int, int, str, int]] = []  # disjoint, so that only its neighbours can overlap a new one
    for _, _, s, t, name, e in sorted(spans):
        i = bisect_left(kept, (s, t))
        if (i == len(kept) or t <= kept[i][0]) and (i == 0 or kept[i - 1][1] <= s):
            kept.insert(i, (s, t, name, e))
    return kept


def scan(docs: DataFrame, *, notices: dict[str, str] | None = None, per_error: int = 10) -> DataFrame:
    """doc_id, license, start, end, errors, matched of each notice in each row's text."""
    table = tuple((notices or NOTICES).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = [(d, name, s, t, e, text[s:t]) for d, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for s, t, name, e in notices_of(text, table, per_error)]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "license", "start", "end", "errors", "matched"])

    return docs.where("text IS NOT NULL AND text != ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FOUND)
