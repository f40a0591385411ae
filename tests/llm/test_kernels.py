from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import kernels as k

WORDS = re.compile(r"[a-z0-9\x80-\U0010FFFF]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="abAB é·–1 .,\n日ß", max_size=40)), min_size=1, max_size=8)


@settings(max_examples=80, deadline=None)
@given(texts)
def test_words_are_those_of_the_expression(rows):
    hashes, first = k.word_hashes(pa.array(rows, pa.string()))
    words = [WORDS.findall((r or "").lower()) for r in rows]
    assert np.diff(first).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(flat)) == len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(hashes.tolist()))


@settings(max_examples=40, deadline=None)
@given(texts, st.integers(1, 4))
def test_windows_are_runs_of_words(rows, width):
    hashes, first = k.word_hashes(pa.array(rows, pa.string()))
    out, start = k.window_hashes(hashes, first, width)
    runs = []
    for r in rows:
        w = WORDS.findall((r or "").lower())
        runs.append([tuple(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [tuple(w)] if w else [])
    assert np.diff(start).tolist() == [len(x) for x in runs]
    flat = [x for r in runs for x in r]
    assert len(set(flat)) == len(set(zip(flat, out.tolist(), strict=True))) == len(set(out.tolist()))


def test_lookup_and_ragged_columns():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    wanted = np.concatenate([keys[::3], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    found = k.lookup(keys, np.arange(1, len(keys) + 1), wanted)
    assert found[: len(keys[::3])].tolist() == list(range(1, len(keys) + 1, 3)) and not found[len(keys[::3]) :].any()
    column = k.binary_rows(np.arange(6, dtype=np.uint16), np.array([0, 2, 2, 6]))
    values, first = k.ragged(column.slice(1, 2), np.uint16)
    assert values.tolist() == [2, 3, 4, 5] and first.tolist() == [0, 0, 4]
