from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text
from lexiloom.operators import assignment, coherence, matching, neighbours, vocabulary
from lexiloom.operators.coherence import CoherenceConfig


def table(spark, rows, label=None):
    data = [(i, r, 0 if label is None else label[i]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, tokens array<string>, label int")


def test_vocabulary(spark):
    t = table(spark, [["apple", "banana", "apple"], ["banana", "cherry"], ["apple", "date"]])
    v = {r.term: (r.term_index, r.df, r.tf) for r in vocabulary.vocabulary(t, max_df=1.0).collect()}
    assert v == {"apple": (0, 2, 3), "banana": (1, 2, 2), "cherry": (2, 1, 1), "date": (3, 1, 1)}
    assert {r.term for r in vocabulary.vocabulary(t, min_df=2).collect()} == {"apple", "banana"}
    assert [r.term for r in vocabulary.vocabulary(t, max_df=1.0, max_size=2).orderBy("term_index").collect()] == ["apple", "banana"]
    t = table(spark, [["ubiquitous", "x"], ["ubiquitous"], ["ubiquitous"], ["ubiquitous", "rare"]])
    assert {r.term for r in vocabulary.vocabulary(t, max_df=0.5).collect()} == {"x", "rare"}
    k = vocabulary.known_counts(t, vocabulary.vocabulary(t, max_df=0.5))
    assert {(r.doc_id, r.term, r.tf) for r in k.collect()} == {(0, "x", 1), (3, "rare", 1)}


def test_class_scores(spark):
    a, b = ["machine", "learning", "machine", "learning", "neural", "network"], ["web", "web", "javascript", "html", "css", "page"]
    t = table(spark, [a, b, ["noise"]], [0, 1, -1])
    s = vocabulary.ctfidf(t, vocabulary.vocabulary_terms(t, max_df=1.0))
    rows = {(r.label, r.term): r for r in s.collect()}
    assert math.isclose(rows[0, "machine"].raw, 2 * math.log(4)) and rows[0, "machine"].score == 1
    assert math.isclose(rows[0, "neural"].score, math.log(7) / (2 * math.log(4))) and all(l != -1 for l, _ in rows)
    assert [r.term for r in vocabulary.top_keywords(s, 3).where("label = 0").orderBy("rank").collect()] == ["learning", "machine", "network"]
    half = vocabulary.ctfidf(t, vocabulary.vocabulary_terms(t, max_df=1.0), classes=3)
    assert math.isclose({(r.label, r.term): r.raw for r in half.collect()}[0, "machine"], 2 * math.log(1 + 4 / 2))
    kw = vocabulary.diversified(vocabulary.keyword_arrays(vocabulary.top_keywords(s, 4)), 0.9)
    assert all(len({k.term for k in r.keywords}) == 4 for r in kw.collect())
    near = spark.createDataFrame([(0, [("network", 1.0, 1), ("networks", 0.9, 1), ("tree", 0.5, 1)])], "label int, keywords array<struct<term: string, score: double, frequency: bigint>>")
    assert [k.term for k in vocabulary.diversified(near, 0.5).first().keywords] == ["network", "tree", "networks"]


def test_statistics(spark):
    s = vocabulary.assignment_statistics(spark.createDataFrame([(0,), (0,), (1,), (-1,)], "label int")).first()
    assert (s.clusters, s.documents, s.outliers, s.max_size, s.min_size, s.avg_size, s.outlier_rate) == (2, 4, 1, 2, 1, 1.5, 0.25)
    e = vocabulary.assignment_statistics(spark.createDataFrame([], "label int")).first()
    assert (e.clusters, e.min_size, e.outlier_rate) == (0, 0, 0)


def test_windows(spark):
    t = table(spark, [["apple", "banana", "cherry", "date"], ["apple", "banana", "elderberry"], []])
    terms = spark.createDataFrame([(x,) for x in ("apple", "banana", "cherry")], "term string")
    w, p, n = coherence.cooccurrence(t, terms, CoherenceConfig(window=3))
    assert n.first()[0] == 3 and {r.term: r.n for r in w.collect()} == {"apple": 2, "banana": 3, "cherry": 2}
    assert {(r.a, r.b): r.n for r in p.collect()} == {("apple", "banana"): 2, ("banana", "cherry"): 2, ("apple", "cherry"): 1}
    _, p, n = coherence.cooccurrence(t, terms, CoherenceConfig.document())
    assert n.first()[0] == 2 and {(r.a, r.b): r.n for r in p.collect()}[("apple", "banana")] == 2


def test_npmi(spark):
    docs = table(spark, [["alpha", "beta"], ["alpha", "beta"], ["gamma"], ["delta"]])
    asked = spark.createDataFrame([("alpha", "beta"), ("alpha", "gamma"), ("alpha", "unknown"), ("alpha", "alpha")], "word1 string, word2 string")
    terms = asked.select(F.explode(F.array("word1", "word2")).alias("term"))
    r = {(x.word1, x.word2): x.npmi for x in coherence.npmi_pairs(asked, *coherence.cooccurrence(docs, terms, CoherenceConfig.document())).collect()}
    assert math.isclose(r["alpha", "beta"], 1, abs_tol=1e-9) and r["alpha", "gamma"] < -0.9 and r["alpha", "unknown"] is None and r["alpha", "alpha"] is None
    kw = spark.createDataFrame([(0, "alpha", 1), (0, "beta", 2), (1, "alpha", 1), (1, "unknown", 2)], "topic_id int, term string, rank int")
    c = coherence.topic_coherence(docs, kw, CoherenceConfig.document())
    assert {x.topic_id: round(x.coherence, 6) for x in c.collect()} == {0: 1.0, 1: 0.0}
    s = coherence.coherence_summary(c).first()
    assert math.isclose(s["mean"], 0.5) and math.isclose(s["std"], 0.5) and s.positive == 1


def test_diversity(spark):
    kw = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "a", 1), (1, "c", 2)], "topic_id int, term string, rank int")
    d = coherence.diversity(kw).first()
    assert (d.unique_keywords, d.total_keywords, d.diversity, d.mean_redundancy) == (3, 4, 0.75, 0.5)
    o = {(r.i, r.j): r.overlap for r in coherence.overlap(kw).collect()}
    assert o == {(0, 0): 1, (1, 1): 1, (0, 1): 0.5, (1, 0): 0.5}
    assert coherence.overlapping_pairs(coherence.overlap(kw)).count() == 1
    assert coherence.diversity(kw.limit(0)).first().diversity == 1


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    x[7] = x[3]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>"), x


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan", "squared_euclidean"])
def test_neighbours_equal_brute_force(points, metric):
    df, x = points
    d = neighbours.distances(x, x, metric).round(9)
    np.fill_diagonal(d, np.inf)
    want = {(i, r + 1): int(j) for i in range(60) for r, j in enumerate(np.lexsort((np.arange(60), d[i]))[:5])}
    for size in (7, 1_000):
        got = {(r.src, r["rank"]): r.dst for r in neighbours.knn_graph(df, 5, metric=metric, size=size).collect()}
        assert got == want
    radius = float(np.sort(d.ravel())[300])
    assert neighbours.range_join(df, df, radius, metric=metric, same=True, size=9).count() == int((d <= radius).sum())


def test_core_distances_and_reachability(spark):
    p = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [10.0, 10.0])], "id long, embedding array<double>")
    c = [r.core for r in neighbours.core_distances(p, 2).orderBy("id").collect()]
    assert np.allclose(c, [1, 2**0.5, 2**0.5, 181**0.5])
    m = {(r.src, r.dst): r.mrd for r in neighbours.mutual_reachability(p, 2).collect()}
    assert len(m) == 6 and math.isclose(m[0, 1], 2**0.5) and math.isclose(m[1, 3], 181**0.5, abs_tol=1e-6)
    g = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (4, 5, 1.0)], "src long, dst long, dist double")
    got = {r.id: r.component for r in neighbours.connected_components(g, spark.range(7)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6}
    assert not neighbours.is_symmetric(g) and neighbours.is_symmetric(neighbours.symmetrised(g))


def test_assignment_rules(spark):
    t = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "topic_id int, centroid array<double>")
    p = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, -1.0]), (2, [1.0, 1.0])], "doc_id long, embedding array<double>")
    n = {r.doc_id: r for r in assignment.nearest_centroid(p, t).collect()}
    assert n[0].probability == 1 and n[2].topic_id == 0 and n[1].topic_id == 0
    a = {r.doc_id: r for r in assignment.cosine_assignment(p, t).collect()}
    assert (a[0].topic_id, a[0].confidence) == (0, 1.0) and (a[1].topic_id, a[1].confidence) == (-1, 0) and math.isclose(a[2].confidence, 2**-0.5 / 2, abs_tol=1e-9)
    f = assignment.find_topics(p, t).where("doc_id = 0").first()
    assert f.topic_id == 0 and math.isclose(f.probability + f.alternatives[0].probability, 1)
    s = assignment.search(p, [1.0, 0.2], 2).collect()
    assert [r.doc_id for r in s] == [0, 2]


def test_hungarian():
    assert math.isclose(matching.assignment_cost(np.array([[0.1, 0.5, 0.3], [0.4, 0.2, 0.6], [0.3, 0.4, 0.1]]))[1], 0.4)
    assert len({j for _, j in matching.hungarian(np.random.default_rng(0).random((3, 2)))}) == 2
    from itertools import permutations

    rng = np.random.default_rng(5)
    for _ in range(30):
        c = rng.random((4, 5))
        best = min(sum(c[i, p[i]] for i in range(4)) for p in permutations(range(5), 4))
        assert math.isclose(matching.assignment_cost(c)[1], best)
        assert math.isclose(matching.assignment_cost(c.T)[1], best)
    assert matching.hungarian(np.zeros((0, 3))) == []


def unit(*v):
    return (np.array(v) / np.linalg.norm(v)).tolist()


def topics(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in rows], "topic_id int, centroid array<double>")


def test_matching(spark):
    three = [(i, unit(*row)) for i, row in enumerate(np.eye(4)[:3] + 0.01)]
    m = matching.match_topics(topics(spark, three), topics(spark, three))
    assert m.mapping == {0: 0, 1: 1, 2: 2} and not (m.new or m.retired or m.merges or m.splits)
    old, new = topics(spark, [(0, unit(1, 0.2, 0, 0)), (1, unit(1, 0.3, 0, 0))]), topics(spark, [(0, unit(1, 0.25, 0, 0))])
    m = matching.match_topics(old, new)
    assert m.merges == {0: [0, 1]} and not m.retired
    ids = matching.TopicIds(2)
    assert ids.mapping(m) == ({0: 0}, {1: 0})
    m = matching.match_topics(new, old)
    assert m.splits == {0: [0, 1]} and len(m.new) == 1
    m = matching.match_topics(topics(spark, [(0, unit(1, 0))]), topics(spark, [(0, unit(0, 1))]))
    assert (m.mapping, m.new, m.retired) == ({}, [0], [0]) and ids.mapping(m)[0] == {0: 2}


def test_merging(spark):
    schema = "topic_id int, size long, coherence double, centroid array<double>, representative_docs array<long>"
    a = spark.createDataFrame([(0, 50, 0.2, [1.0, 0.0, 0.0, 0.0], [1]), (5, 3, None, [0.0, 1.0, 0.0, 0.0], [2])], schema)
    b = spark.createDataFrame([(0, 5, 0.4, unit(0.9, 0.1, 0, 0), [9]), (7, 2, 0.1, [0.0, 0.0, 1.0, 0.0], [])], schema)
    r = {x.topic_id: x for x in matching.merge_topic_tables(a, b).collect()}
    assert set(r) == {0, 5, 7} and r[0]["size"] == 55 and np.allclose(r[0].centroid, [0.999444, 0.010039, 0, 0], atol=1e-6) and r[0].representative_docs == [1, 9]
    assert math.isclose(r[0].coherence, (0.2 * 50 + 0.4 * 5) / 55)
    f = {x.topic_id: x for x in matching.folded(a, {5: 0}).collect()}
    assert f[0]["size"] == 53 and sorted(f[0].representative_docs) == [1, 2]
    k = "topic_id int, term string, score double"
    x, y = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.4)], k), spark.createDataFrame([(0, "b", 0.9), (0, "c", 1.0)], k)
    assert [r.term for r in matching.union_reranked(x, y, 3).orderBy("rank").collect()] == ["c", "b", "a"]
    assert [r.term for r in matching.existing_first(x, y, 3).orderBy("rank").collect()] == ["a", "b", "c"]
    assert matching.vocabulary_union(x, y).count() == 3


def test_known_frequencies_move_whole_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ["all", f"w{i}", "all", "odd" if i % 2 else "even"]) for i in range(40)] + [(1, ["odd", "w1"]), (50, [])], "doc_id long, tokens array<string>")
    want = vocabulary.term_frequencies(docs).join(vocabulary.vocabulary_terms(docs, max_df=0.7).select("term"), "term", "left_semi").select("doc_id", "term", "tf")
    monkeypatch.setattr(vocabulary, "TOKENS", 20)
    got = vocabulary.known_frequencies(docs, 0.7)
    assert sorted(got.collect()) == sorted(want.collect()) and "all" not in {r.term for r in got.collect()}
    assert got.rdd.getNumPartitions() == 9  # 162 tokens


def test_bigrams_alone(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(text.bigrams(F.col("t"))).collect()] == [["a_b", "b_c"], [], [], None]
