from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.llm import quality


def good(rng: random.Random) -> str:
    return " ".join(" ".join(rng.choice(["tree", "house", "river", "stone", "of", "and", "the", "walking"]) for _ in range(rng.randrange(5, 12))).capitalize() + "." for _ in range(rng.randrange(3, 9)))


def bad(rng: random.Random) -> str:
    return " ".join(rng.choice(["BUY!!", "$$$", "###now", "CLICK!!", "%%%x"]) for _ in range(rng.randrange(20, 60)))


@pytest.fixture(scope="module")
def labelled(spark, docs_of):
    rng = random.Random(5)
    rows = [(i, (good if i % 4 else bad)(rng)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)] + [(7, None, 0), (9_999, 1, 0)], "doc_id long, quality int, toxic int")
    return docs_of(rows), labels


def test_held_out_documents_are_told_apart(labelled):
    docs, labels = labelled
    out = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert len(out) == 400 and sum(out[i].keep == bool(i % 4) for i in range(300, 400)) >= 95


def test_normal_equations_equal_those_of_all_rows_at_once(spark, labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels, features=32, ridge=1e-2)
    rows = docs.join(labels.where("quality IS NOT NULL"), "doc_id").selectExpr("text", "quality", "pmod(xxhash64(doc_id, 7), 5) AS h").collect()
    train = [r for r in rows if r.h]
    stats = quality.statistics(pa.array([r.text for r in train]))
    assert np.allclose(model.mean, stats.mean(axis=0))
    z, y = model.features(stats), np.array([r.quality for r in train], float)
    zc, yc = z - z.mean(axis=0), y - y.mean()
    want = np.linalg.solve(zc.T @ zc + 1e-2 * len(y) / 32 * np.eye(32), zc.T @ yc)
    assert np.allclose(model.weights, want, atol=1e-6) and np.isclose(model.bias, y.mean() - z.mean(axis=0) @ want)


def test_isotonic_is_monotone_and_pools_violators():
    x, y = quality.isotonic(np.array([1.0, 2.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 0.25, 1.0]))
    assert x.tolist() == [1, 2, 3, 4] and np.allclose(y, [0, 1.25 / 3, 1.25 / 3, 1])


def test_kernel_is_near_the_gaussian():
    rng = np.random.default_rng(0)
    d, gamma, n = quality.N_STATS, 0.05, 20_000
    model = quality.QualityModel(np.zeros(d), np.ones(d), rng.normal(0, np.sqrt(2 * gamma), (d, n)), rng.uniform(0, 2 * np.pi, n), np.zeros(n), 0.0, np.zeros(1), np.zeros(1))
    x = rng.normal(size=(6, d))
    z = model.features(x)
    want = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_odd_rows(spark, docs_of, labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels)
    odd = docs_of([(1, None), (2, ""), (3, "word " * 200_000), (None, "A tree and the river."), (4, "A tree and the river."), (4, "A tree and the river.")], extra=True)
    out = quality.score(odd, model).collect()
    assert len(out) == 6 and all(r.score is None and r.probability is None and not r.keep for r in out if r.doc_id in (1, 2))
    same = [(r.score, r.keep) for r in out if r.doc_id in (4, None)]
    assert len(set(same)) == 1
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.keep for r in out)
    assert quality.score(docs_of([]), model).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, empty) is None and quality.fit(docs_of([]), labels) is None
    assert quality.keep_good(odd, None).count() == 4
