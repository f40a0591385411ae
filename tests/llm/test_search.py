from __future__ import annotations

import math
import random
import re

from lexiloom.llm import ranked_search

WORDS = re.compile(r"[a-z0-9\x80-\U0010FFFF]+")


def brute(docs: list[tuple], queries: list[tuple], k: int) -> set[tuple]:
    bags = [(d, WORDS.findall((t or "").lower())) for d, t in docs if d is not None]
    bags = [(d, w) for d, w in bags if w]
    if not bags:
        return set()
    average = sum(len(w) for _, w in bags) / len(bags)
    out = set()
    for q, text in set(queries):
        scores = []
        terms = set(WORDS.findall((text or "").lower())) if q is not None else set()
        df = {t: sum(t in set(w) for _, w in bags) for t in terms}
        for d, w in bags:
            s = sum(math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / average)) for t in terms if t in w)
            if s > 0:
                scores.append((-round(s, 6), d))
        out |= {(q, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])}
    return out


def rows_of(df) -> set[tuple]:
    return {(r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect()}


def test_pruned_search_equals_all_scores(spark, docs_of):
    rng = random.Random(8)
    words = ["w%d" % int(rng.paretovariate(0.8)) for _ in range(4_000)]
    docs = [(i * 3 - 50, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(400)]
    docs += [(5_000 + i, docs[i][1]) for i in range(30)]  # ties
    queries = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    table = spark.createDataFrame(queries, "query_id long, text string")
    for k, size in ((5, 16), (1, 4)):
        got = ranked_search.top_documents(docs_of(docs), table, k=k, block_docs=size)
        want, have = brute(docs, queries, k), rows_of(got)
        assert {x[:3] for x in have} == {x[:3] for x in want}
        assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(sorted(have), sorted(want), strict=True))


def test_odd_rows(spark, docs_of):
    docs = [(1, None), (2, ""), (3, "filler " * 100_000 + "needle"), (None, "needle"), (4, "Needle here"), (4, "Needle here"), (5, "nothing")]
    queries = [(1, "needle"), (2, None), (3, ""), (None, "needle"), (4, "unseen"), (1, "needle")]
    table = spark.createDataFrame(queries, "query_id long, text string")
    got = ranked_search.top_documents(docs_of(docs, extra=True), table)
    assert [(r.query_id, r["rank"], r.doc_id) for r in got.orderBy("query_id", "rank").collect()] == [(1, 1, 4), (1, 2, 4), (1, 3, 3)]
    assert ranked_search.top_documents(docs_of([]), table).count() == 0
    assert ranked_search.top_documents(docs_of(docs), table.limit(0)).count() == 0
