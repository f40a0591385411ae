from __future__ import annotations

import random
import re
from itertools import combinations
from math import comb

import pytest

from lexiloom.llm import minhash

WORDS = re.compile(r"[a-z0-9\x80-\U0010FFFF]+")


def shingles(text: str | None) -> set:
    w = WORDS.findall((text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def brute(rows: list[tuple]) -> dict[int, int]:
    sets = {d: shingles(t) for d, t in rows if d is not None and shingles(t)}
    parent = {d: d for d in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    groups = {d: find(d) for d in sets}
    return {d: g for d, g in groups.items() if list(groups.values()).count(g) > 1}


@pytest.fixture(scope="module")
def copies() -> list[tuple[int, str]]:
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for g in range(12):
        words = [word() for _ in range(rng.randrange(40, 120))]
        for _ in range(rng.choice([1, 1, 2, 5, 40 if g == 0 else 3])):
            new = [word() if rng.random() < rng.choice([0, 0.02, 0.05]) else w for w in words]
            rows.append((len(rows) * 7 + 3, " ".join(new)))
    return rows


def test_groups_equal_all_pairs(docs_of, copies):
    want = brute(copies)
    got = {r.doc_id: r.group_id for r in minhash.near_groups(docs_of(copies)).collect()}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)
    assert all(got[d] == want[d] for d in got)


def test_the_sequential_bounds_are_those_of_the_posterior():
    t, miss = 0.5, 0.01
    for n, m in minhash.least_matches(t, miss):
        chance = lambda k: sum(comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(k + 1))  # noqa: E731,B023
        assert chance(m) >= miss and (m == 0 or chance(m - 1) < miss)


def test_odd_rows_and_dropping(docs_of):
    long_ = "alpha beta gamma delta " * 60_000
    rows = [(5, "one two three four"), (9, "one two three four"), (2, "One, two; three four!"), (7, None), (8, None), (10, ""), (11, "..."), (12, "..."), (None, "one two three four"), (20, long_), (21, long_ + "end"), (30, "other text of its own"), (30, "other text of its own"), (31, "solo"), (32, "solo")]
    docs = docs_of(rows, extra=True)
    got = {r.doc_id: (r.group_id, r.keep) for r in minhash.near_groups(docs).collect()}
    assert got == {2: (2, True), 5: (2, False), 9: (2, False), 20: (20, True), 21: (20, False), 31: (31, True), 32: (31, False)}
    left = minhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 2, 7, 8, 10, 11, 12, 20, 30, 31]
    assert minhash.near_groups(docs_of([])).count() == 0 and minhash.drop_near_copies(docs_of([])).count() == 0
    assert minhash.near_groups(docs_of([(1, "nothing like it here"), (2, "another thing over there")])).count() == 0


@pytest.mark.parametrize("m", [150, 450])
def test_pairs_grow_with_the_documents(spark, docs_of, monkeypatch, m):
    """Half of each text is the same: no two belong together, but for some near copies among them, which large buckets hold too."""
    rng = random.Random(m)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    same = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(60)) + " " + same) for i in range(m)]
    for i in range(12):
        w = rows[i][1].split()
        w[10 + i] = "zz"
        rows.append((m + i, " ".join(w)))
    made = []
    keep = minhash.stored

    def counted(df, label):
        table = keep(df, label)
        if label == "pairs":
            made.append(table.df.count())
        return table

    monkeypatch.setattr(minhash, "stored", counted)
    got = {r.doc_id: r.group_id for r in minhash.near_groups(docs_of(rows), small=8).collect()}
    assert got == {**{i: i for i in range(12)}, **{m + i: i for i in range(12)}}
    assert sum(made) <= 12 * m, made


def test_the_exact_way_finds_links_that_large_buckets_hold(docs_of):
    """With small=1 every mixed bucket takes it."""
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) + rng.choice("xyz")
    same = [word() for _ in range(40)]
    rows = []
    for g in range(25):
        own = [word() for _ in range(rng.randrange(20, 70))]
        for _ in range(rng.randrange(1, 4)):
            rows.append((len(rows), " ".join([w if rng.random() > 0.06 else word() for w in own] + same[: rng.randrange(20, 41)])))
    want = brute(rows)
    got = {r.doc_id: r.group_id for r in minhash.near_groups(docs_of(rows), small=1).collect()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
    for d, g in got.items():
        assert want[d] == want[g]


def test_names_with_dots(spark):
    rows = [(1, "one two three four", 5), (1, "one two three four", 5), (2, "one two three four", 6), (None, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `m.x` int")
    left = minhash.drop_near_copies(docs)
    assert left.columns == docs.columns and sorted((r[0] or 0, r[2]) for r in left.collect()) == [(0, 7), (1, 5)]
