from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.llm import language

PARTS = {"en": ["the", "ing", "er", "th", "and", "of"], "fr": ["eau", "oi", "les", "é", "que", "ment"], "de": ["sch", "ung", "ein", "der", "ü", "keit"]}


def text(lang: str, rng: random.Random) -> str:
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8, 60)))


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    rng = random.Random(1)
    return [(i, text(l, rng), l) for i in range(300) for l in [rng.choice(sorted(PARTS))]]


def test_presence_is_that_of_the_grams():
    bits = language.presence(pa.array(["Abc ab", None, "", "abc ab"]))
    assert bits[0].sum() == len({"a", "b", "c", " "} | {"ab", "bc", "c ", " a"} | {"abc", "bc ", "c a", " ab"})
    assert not bits[1].any() and not bits[2].any() and (bits[0] == bits[3]).all()
    both = language.presence(pa.array(["xy", "zw"]))
    assert both[0].sum() == 3 and both[1].sum() == 3  # no grams across texts


def test_held_out_accuracy_and_folded_weights(docs_of, rows):
    model = language.fit(docs_of(rows[:200]), landmarks=30, max_train_rows=150)
    out = {r.doc_id: r for r in language.identify(docs_of(rows), model).collect()}
    assert len(out) == 300 and sum(out[i].language == l for i, _, l in rows[200:]) >= 98
    assert all(r.margin >= 0 for r in out.values())


def test_scores_are_those_of_kernel_ridge_on_landmarks(docs_of, rows):
    """One landmark for each training text: the solution of kernel ridge regression itself."""
    few = [(i, t, l) for i, t, l in rows[:45]]
    model = language.fit(docs_of(few), landmarks=3_000, max_train_rows=1_000, ridge=1e-2)
    x = language.presence(pa.array([t for _, t, _ in few])).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    k = x @ x.T
    y = np.where(np.array([l for *_, l in few])[:, None] == np.array(model.names)[None, :], 1.0, -1.0)
    n = len(few)
    want = k @ np.linalg.solve(k @ k + 1e-2 * n * k + 1e-6 * n * np.eye(n), k @ y)
    got, _ = model.scores(pa.array([t for _, t, _ in few]))
    assert np.allclose(got, want, atol=2e-3)


def test_odd_rows(docs_of, rows):
    model = language.fit(docs_of([*rows[:100], (1000, "the thing", None), (1001, None, "en"), (1002, "", "fr"), (None, "the", "en")], extra=True))
    odd = docs_of([(1, None), (2, ""), (3, "schungein der keit " * 50_000), (None, "the ander of thing"), (4, "eauoi les que"), (4, "eauoi les que")], extra=True)
    out = [(r.doc_id, r.language) for r in language.identify(odd, model).collect()]
    assert sorted(out, key=str) == sorted([(1, None), (2, None), (3, "de"), (None, "en"), (4, "fr"), (4, "fr")], key=str)
    assert language.fit(docs_of([])) is None and language.identify(docs_of([]), model).count() == 0
    assert [r.language for r in language.identify(docs_of([(1, "x")]), None).collect()] == [None]


def test_rare_languages_have_training_rows(docs_of, rows):
    many = [(i, t, "en") for i, t, l in rows if l == "en"] + [(1_000 + 7 * i, text("fr", random.Random(i)), "fr") for i in range(3)]
    model = language.fit(docs_of(many), landmarks=10, max_train_rows=12)
    assert model.names == ["en", "fr"]
