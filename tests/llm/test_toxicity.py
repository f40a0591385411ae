from __future__ import annotations

import random

import numpy as np
import pytest

from lexiloom.llm import toxicity

INSULTS = ["zorb", "flimp", "grawl", "snerk"]


@pytest.fixture(scope="module")
def labelled(spark, docs_of):
    rng = random.Random(6)
    plain = ["tree", "house", "the", "of", "river", "stone", "walk", "light"]
    rows, truth = [], {}
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        n = rng.choice([1, 2, 3, 5, 9]) if i % 5 == 0 else 0
        for _ in range(n):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words)))
        truth[i] = n
    labels = spark.createDataFrame([(i, 1, int(truth[i] > 0)) for i in range(400)] + [(3, 1, None), (9_999, 1, 1)], "doc_id long, quality int, toxic int")
    return docs_of(rows), labels, truth


def test_held_out_documents_and_order(labelled):
    docs, labels, truth = labelled
    out = {r.doc_id: r for r in toxicity.severity(docs, toxicity.fit(docs, labels)).collect()}
    assert len(out) == 600 and sum(out[i].toxic == (truth[i] > 0) for i in range(400, 600)) >= 194
    assert not any(out[i].toxic for i in range(400, 600) if not truth[i])
    mean = lambda n: np.mean([out[i].expected_severity for i in range(400, 600) if truth[i] == n])
    assert mean(0) < mean(1) < mean(3) < mean(9)


def test_grades_share_weights_and_sum_to_one():
    p = toxicity.grade_probabilities(np.array([-2.0, 0.0, 5.0]), np.array([0.0, 1.0, 3.0]))
    assert np.allclose(p.sum(axis=1), 1) and (p > 0).all()
    e = p @ np.arange(4)
    assert e[0] < e[1] < e[2]
    assert np.isclose(p[1, 0], 0.5)


def test_the_fit_is_at_the_least_loss():
    """The gradient at the fitted weights is next to nothing, by differences of the loss."""
    rng = np.random.default_rng(2)
    n, f = 300, 4
    x = (rng.random((n, f)) < 0.3) * 1.0
    score = x @ np.array([3.0, 1.0, -1.0, 0.0]) + rng.logistic(size=n)
    grade = (score[:, None] > np.array([1.0, 2.0, 4.0])).sum(axis=1)
    row, feature = np.nonzero(x)
    w, cuts = toxicity.fit_ordinal(row, feature, x[row, feature], grade, f, rounds=3_000)
    assert (np.diff(cuts) > 0).all()

    def loss(w: np.ndarray, cuts: np.ndarray) -> float:
        return -np.log(toxicity.grade_probabilities(x @ w, cuts)[np.arange(n), grade]).sum() + 0.25 * (w**2).sum()

    for k in range(f):
        step = np.zeros(f)
        step[k] = 1e-3
        assert abs(loss(w + step, cuts) - loss(w - step, cuts)) / 2e-3 < 1.0
    for k in range(3):
        step = np.zeros(3)
        step[k] = 1e-3
        assert abs(loss(w, cuts + step) - loss(w, cuts - step)) / 2e-3 < 1.0


def test_odd_rows(spark, docs_of, labelled):
    docs, labels, _ = labelled
    model = toxicity.fit(docs, labels)
    odd = docs_of([(1, None), (2, ""), (3, "tree " * 150_000 + "zorb flimp grawl snerk"), (None, "a Zorb, a FLIMP"), (4, "zorb zorb zorb"), (4, "zorb zorb zorb")], extra=True)
    out = toxicity.severity(odd, model).collect()
    assert len(out) == 6
    by = {r.doc_id: r for r in out}
    assert by[1].expected_severity == by[2].expected_severity == 0 and not by[1].toxic
    assert by[3].toxic and by[None].toxic and len({r.expected_severity for r in out if r.doc_id == 4}) == 1
    assert toxicity.severity(docs_of([]), model).count() == 0
    assert toxicity.fit(docs, labels.limit(0)) is None and toxicity.fit(docs_of([]), labels) is None
    assert [r.toxic for r in toxicity.severity(docs_of([(1, "x")]), None).collect()] == [None]
