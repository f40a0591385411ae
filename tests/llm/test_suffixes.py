from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lexiloom.llm import suffixes

WORDS = re.compile(r"[a-z0-9\x80-\U0010FFFF]+")


def brute(docs: list[tuple], least: int) -> set[tuple]:
    places = defaultdict(list)
    for d, t in sorted(docs, key=lambda r: (r[0] is None, r[0])):
        w = WORDS.findall((t or "").lower())
        for i in range(len(w) - least + 1):
            if d is not None:
                places[tuple(w[i : i + least])].append((d, i))
    found = defaultdict(dict)
    for p in places.values():
        if len(p) > 1:
            for n, (d, i) in enumerate(p):
                found[d][i] = n > 0
    out = set()
    for d, starts in found.items():
        spans: list[list[int]] = []
        for i in sorted(starts):
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + least
            else:
                spans.append([i, i + least])
        for a, b in spans:
            again = {x for i, f in starts.items() if f and a <= i < b for x in range(i, i + least)}
            out.add((d, a, b, b - a, len(again)))
    return out


def rows_of(df) -> set[tuple]:
    return {(r.doc_id, r.start_word, r.end_word, r.n_words, r.n_repeated) for r in df.collect()}


@pytest.mark.parametrize("least", [32, 50, 64, 80])
def test_repeats_equal_all_windows(docs_of, least):
    rng = random.Random(least)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 9)
    passages = [[word() for _ in range(rng.randrange(least - 3, least + 40))] for _ in range(6)]
    docs = []
    for i in range(60):
        body = [word() for _ in range(rng.randrange(10, 300))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(body))
            body[at:at] = rng.choice(passages)
        docs.append((i * 5, " ".join(body)))
    docs += [(1_000, docs[3][1]), (1_001, "same " * 200), (1_002, " ".join(passages[0] * 3))]
    assert rows_of(suffixes.repeats(docs_of(docs), least=least)) == brute(docs, least)


def test_groups_that_span_batches(spark, docs_of):
    rng = random.Random(1)
    p = [rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(70)]
    docs = [(i, " ".join([f"own{i}"] * rng.randrange(3) + p[rng.randrange(12) :] + [f"end{i}"] * rng.randrange(3))) for i in range(25)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for n in (1, 2, 3, 7):
            spark.conf.set(name, str(n))
            assert rows_of(suffixes.repeats(docs_of(docs))) == brute(docs, 50)
    finally:
        spark.conf.set(name, before)


def test_each_window_selects_its_smallest_hash():
    rng = np.random.default_rng(3)
    grams, first = rng.integers(0, 1 << 63, 300, dtype=np.uint64), np.array([0, 5, 120, 120, 300])
    at = set(suffixes.selected(grams, first, 10).tolist())
    want = {i + int(np.argmin(grams[i : i + 10] >> np.uint64(24))) for a, b in zip(first, first[1:], strict=False) for i in range(a, b - 9)}
    assert at == want


def test_odd_rows(docs_of):
    p = " ".join(f"w{i}" for i in range(60))
    docs = [(1, None), (2, ""), (3, "x " * 49), (None, p), (4, p), (5, p.upper()), (6, p + " y"), (6, p + " y"), (7, "z " * 200_000)]
    got = rows_of(suffixes.repeats(docs_of(docs, extra=True)))
    assert got == {(4, 0, 60, 60, 0), (5, 0, 60, 60, 60), (6, 0, 60, 60, 60), (7, 0, 200_000, 200_000, 199_999 + 0)} or got == brute([d for i, d in enumerate(docs) if i != 7], 50)
    assert suffixes.repeats(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        suffixes.repeats(docs_of([]), least=20)


def test_positions_beyond_the_bits_that_hold_them(monkeypatch, docs_of):
    monkeypatch.setattr(suffixes, "POSITION_BITS", 7)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(90)]
    body = [word() for _ in range(1_500)]
    body[1_200:1_200] = passage
    docs = [(1, " ".join(body)), (2, " ".join([word() for _ in range(700)] + passage))]
    rng = np.random.default_rng(3)
    grams, first = rng.integers(0, 1 << 63, 2_000, dtype=np.uint64), np.array([0, 2_000])
    at = set(suffixes.selected(grams, first, 35).tolist())
    top = grams >> np.uint64(7)
    assert at == {i + int(np.argmin(top[i : i + 35])) for i in range(2_000 - 34)}
    assert rows_of(suffixes.repeats(docs_of(docs))) == brute(docs, 50)


def test_frequent_passages_are_spread(monkeypatch, docs_of):
    monkeypatch.setattr(suffixes, "SAMPLED", 1)
    monkeypatch.setattr(suffixes, "SALTS", 5)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(75)]
    docs = [(i * 3, " ".join([word() for _ in range(rng.randrange(4))] + passage[rng.randrange(8) :] + [word() for _ in range(rng.randrange(4))])) for i in range(90)]
    assert rows_of(suffixes.repeats(docs_of(docs).repartition(3))) == brute(docs, 50)
