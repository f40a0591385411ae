from __future__ import annotations

import random

import numpy as np
import pytest

from lexiloom.llm import decontaminate


def lcs(a: list, b: list) -> int:
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y and x else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_subsequence_equals_the_table():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        assert decontaminate.common_length(a, b) == lcs(a, b)


def test_answers():
    assert decontaminate.answer_of("What is it? Answer: a red fox.").strip() == "a red fox."
    assert decontaminate.answer_of("First thing here. Second one there.") == "Second one there."
    assert decontaminate.answer_of("No stop at all") == "No stop at all"


@pytest.fixture(scope="module")
def planted(spark, docs_of):
    rng = random.Random(4)
    common = ["the", "of", "and", "to", "in", "is"]
    rare = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(900)]
    words = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n)]
    items = [(i, " ".join(words(rng.randrange(15, 60)))) for i in range(25)]
    rows, leaks = [], set()
    for d in range(240):
        body = words(rng.randrange(40, 400))
        if d % 6 == 0:
            i = rng.randrange(25)
            passage = items[i][1].split()
            if d % 12 == 0:  # a paraphrase: some words are others
                passage = [rng.choice(rare) if rng.random() < 0.1 else w for w in passage]
            at = rng.randrange(len(body))
            body[at:at] = passage
            leaks.add((d, i))
        rows.append((d, " ".join(body)))
    return rows, items, leaks


def test_all_planted_passages_and_nothing_else(spark, docs_of, planted):
    rows, items, leaks = planted
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(rows), bench).collect()}
    assert len(got & leaks) >= 0.97 * len(leaks) and not got - leaks
    left = {r.doc_id for r in decontaminate.drop_contaminated(docs_of(rows), bench).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in got}


def test_the_space_is_that_of_the_whole_matrix(spark, docs_of, planted):
    """Randomised SVD against the exact one of the same tf-idf blocks: leading directions agree."""
    import pyarrow as pa

    from lexiloom.llm.kernels import binary_rows, word_hashes

    rows, items, _ = planted
    it = decontaminate.Items(items, 5)
    words, first = word_hashes(pa.array([t for _, t in rows]))
    ids = it.encode(words)
    column = binary_rows(ids, first)
    table = spark.createDataFrame([(i, column[i].as_py()) for i in range(len(rows))], "doc_id long, ids binary").repartition(3)
    weight, space = decontaminate.latent_space(table, it, 20, 40, 1.0, 1)
    m = len(weight)
    block, start = decontaminate._blocks(ids, first)
    a = np.zeros((start[-1], m))
    np.add.at(a, (block, ids), 1.0)
    df = (a > 0).sum(axis=0)
    want = np.log((len(a) + 1) / (df + 1))
    want[0] = 0
    assert np.allclose(weight, want)
    own = np.zeros((len(it.words), m))
    for i, w in enumerate(it.words):
        np.add.at(own[i], w, weight[w])
    scale = np.sqrt((df * weight**2).sum() / (own**2).sum())
    _, s, vt = np.linalg.svd(np.vstack([a * weight, scale * own]), full_matrices=False)
    got = np.linalg.norm(np.vstack([a * weight, scale * own]) @ space, axis=0)
    assert np.allclose(np.sort(got)[::-1][:10], s[:10], rtol=0.02)


def test_odd_rows(spark, docs_of):
    item = "seven rivers run under the old stone bridge near the quiet harbour town"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, item), (4, "too short")], "item_id long, text string")
    filler = "plain talk of other matters and nothing else at all "
    rows = [(1, None), (2, ""), (3, filler * 20_000 + item + " " + filler * 20_000), (4, item), (4, item), (None, item), (5, filler)]
    docs = docs_of(rows, extra=True)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()) == [(3, 1), (4, 1)]
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 5]
    assert decontaminate.contaminated(docs_of([]), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def natural(n: int, rng: random.Random, vocabulary: list[str]) -> list[str]:
    """Words by a Zipf law."""
    return [vocabulary[min(int(rng.paretovariate(0.6)) - 1, len(vocabulary) - 1)] for _ in range(n)]


@pytest.mark.parametrize("n", [100, 150, 200, 300, 1_000])
def test_long_items(spark, docs_of, n):
    rng = random.Random(n)
    vocabulary = sorted({"".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4))) for _ in range(3_000)})
    rng.shuffle(vocabulary)
    items = [(i, " ".join(natural(n, rng, vocabulary))) for i in range(12)]
    rows, leaks = [], set()
    for d in range(150):
        body = natural(rng.randrange(100, 500), rng, vocabulary)
        if d < 24:  # one verbatim, one with other words in places
            passage = items[d // 2][1].split()
            if d % 2:
                passage = [rng.choice(vocabulary) if rng.random() < 0.15 else w for w in passage]
            at = rng.randrange(len(body))
            body[at:at] = passage
            leaks.add((d, d // 2))
        rows.append((d, " ".join(body)))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == leaks


def test_tables_of_few_blocks(spark, docs_of):
    item = "seven rivers run under the old stone bridge near the quiet harbour town"
    filler = "plain talk of other matters and nothing else at all"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.contaminated(docs_of([(1, item), (2, filler), (3, f"{filler} {item} {filler}")]), bench).collect()}
    assert got == {1, 3}
    assert [r.doc_id for r in decontaminate.contaminated(docs_of([(1, item)]), bench).collect()] == [1]


@pytest.mark.parametrize("only_frequent", [False, True])
def test_frequent_words(spark, docs_of, only_frequent):
    """An item in half of the documents, and items without a rare word, beside rarer words of the benchmark."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    frequent, rare = [word() for _ in range(40)], [word() for _ in range(900)]
    body = lambda n: [rng.choice(frequent if rng.random() < 0.5 else rare) for _ in range(n)]
    items = [(i, " ".join(rng.choice(frequent) for _ in range(20)) if only_frequent else " ".join(body(20))) for i in range(10)]
    items += [(i, " ".join(body(30))) for i in range(100, 130)]
    rows, leaks = [], set()
    for d in range(300):
        words = body(rng.randrange(40, 90))
        if d % 2:
            i = d // 2 % 10 if only_frequent else 3
            at = rng.randrange(len(words))
            words[at:at] = items[i][1].split()
            leaks.add((d, i))
        rows.append((d, " ".join(words)))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert leaks <= got, len(leaks - got)
    assert only_frequent or got == leaks


def test_paraphrases_with_the_answer(spark, docs_of):
    """Half to two thirds of an item's words count with its answer, also a short one, but not without it or with its words apart."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    frequent = ["the", "of", "is", "in", "was", "that"]
    items, rows, leaks = [], [], set()
    for i in range(40):
        question, answer = [word() for _ in range(24)], [word() for _ in range(i % 4 + 1)] if i < 32 else frequent[:5]
        items.append((i, " ".join(question) + "? Answer: " + " ".join(answer)))
        kept = [w if rng.random() < 0.62 or k > 20 else word() for k, w in enumerate(question)]
        filler = lambda: [rng.choice(frequent) if rng.random() < 0.4 else word() for _ in range(40)]
        rows.append((2 * i, " ".join([*filler(), *kept, "answer", *answer, *filler()])))
        leaks.add((2 * i, i))
        apart = [x for w in answer for x in (w, *[word() for _ in range(9)])] if i >= 32 else []
        rows.append((2 * i + 1, " ".join([*filler(), *kept, *apart, *filler()])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs_of(rows), bench).collect()}
    assert leaks <= set(got), len(leaks - set(got))
    assert all(got[x].lcs_share >= 0.7 for x in set(got) - leaks)
