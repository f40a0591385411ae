"""The block index, spanning trees in several metrics, resumable layouts, builders and seams."""

from __future__ import annotations

import numpy as np
import pytest

from lexiloom.operators import hdbscan, neighbours, reduction
from lexiloom.operators.hdbscan import HDBSCAN
from lexiloom.operators.lineage import numbered
from lexiloom.operators.neighbours import BlockIndex
from lexiloom.plans import seams
from tests.test_models import blobs, frame


def rows(df):
    return sorted((r.src, r["rank"], r.dst, r.dist) for r in df.collect())


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_index_equals_all_pairs(spark, metric):
    x = blobs(40, np.random.default_rng(1).normal(0, 20, (6, 4)), spread=0.5)
    points = frame(spark, x)
    index = BlockIndex.build(points, size=16, metric=metric)
    assert rows(index.query(points, 4, same=True)) == rows(neighbours.knn_graph(points, 4, metric=metric))
    want = sorted((r.src, r.dst) for r in neighbours.range_join(points, points, 0.9, metric=metric, same=True).collect())
    assert sorted((r.src, r.dst) for r in index.query_radius(points, 0.9, same=True).collect()) == want
    if metric == "euclidean":
        asked = neighbours._clustered(neighbours._vectors(points, "id", "embedding"), index.centres, metric, 16)
        visits = index._visits(asked, 4, None, None).count()
        assert visits < 0.5 * asked.count() * index.blocks.count()  # clustered data: most pairs of blocks are skipped
        few = rows(index.query(points, 4, same=True, probes=4))
        assert len({r[:3:2] for r in few} & {r[:3:2] for r in rows(neighbours.knn_graph(points, 4))}) >= 0.9 * 4 * len(x)
    assert index.statistics().first()["points"] == 240


def test_zero_distances_and_strategy(spark):
    points = frame(spark, [[0, 0], [0, 0], [1, 0], [3, 0]])
    assert [r.core for r in neighbours.core_distances(points, 1).orderBy("id").collect()] == [0, 0, 1, 2]
    assert [r.core for r in neighbours.core_distances(points, 1, exclude_zero=True).orderBy("id").collect()] == [1, 1, 1, 2]
    assert neighbours.knn_strategy(1_000, 1_000) == "blocks" and neighbours.knn_strategy(10**9, 10**9) == "index"
    assert rows(neighbours.hybrid_knn(points, points, 2, same=True)) == rows(neighbours.knn_graph(points, 2))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_spanning_tree_of_each_metric(spark, metric):
    x = np.random.default_rng(5).normal(size=(60, 3))
    _, edges = hdbscan.minimum_spanning_tree(frame(spark, x), 3, size=9, metric=metric)
    d = np.round(neighbours.distances(x, x, metric), 9)
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, 2]
    mrd = np.maximum(np.where(np.isinf(d), 0, d), np.maximum(core[:, None], core[None]))
    assert np.allclose(sorted(w for *_, w in edges), sorted(w for *_, w in hdbscan.prim(mrd))) and len(edges) == 59
    assert HDBSCAN(5, metric=metric).fit(frame(spark, x)).assignment.count() == 60
    with pytest.raises(hdbscan.Stopped):
        hdbscan.spanning_tree(frame(spark, x), 3, should_stop=lambda: True)


def test_forest_is_kruskals():
    rng = np.random.default_rng(0)
    for n in (2, 5, 30):
        a, b = rng.integers(0, n, 200), rng.integers(0, n, 200)
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        w = rng.integers(0, 6, len(a)).astype(float)
        union, want = hdbscan.UnionFind(n), 0.0
        edges = 0
        for i in np.lexsort((b, a, w)):
            if union.union(int(a[i]), int(b[i])):
                want, edges = want + w[i], edges + 1
        got = hdbscan.forest(a, b, w)
        assert len(got) == edges and w[got].sum() == want


def test_layout_resumes_where_it_stopped(spark):
    x = blobs(12, [[0, 0, 0], [9, 9, 9]])
    whole = reduction.UMAP(2, k=4, epochs=30).fit(frame(spark, x))
    calls = []
    part = reduction.UMAP(2, k=4, epochs=30, segment=10, should_stop=lambda: calls.append(1) or len(calls) > 2).fit(frame(spark, x))
    assert part.epoch == 20 and not part.finished and whole.finished
    part.should_stop = None
    done = part.resume()
    y, z = (np.array([r.embedding for r in m.layout.orderBy("id").collect()]) for m in (whole, done))
    assert done.finished and np.allclose(y, z)
    large = reduction.UMAP(2, k=4, epochs=30, most=20).fit(frame(spark, x))
    assert large.layout.count() == 24 and large.trained.count() == 20
    for name in ("default", "fast", "quality", "clustering", "visualisation"):
        assert reduction.UMAP.preset(name).k >= 10


def test_builders_and_seams(spark):
    assert reduction.UMAPBuilder().components(2).k(7).build() == reduction.UMAP(2, k=7)
    assert reduction.PCABuilder().components(3).whiten(True).build().whiten
    assert hdbscan.HDBSCANBuilder().min_cluster_size(7).build().min_cluster_size == 7
    with pytest.raises(AttributeError):
        reduction.PCABuilder().nothing(1)
    for name, protocol in {"clustering": seams.ClusteringEngine, "representation": seams.TopicRepresenter, "coherence": seams.CoherenceEvaluator}.items():
        assert isinstance(seams.OWN[name](), protocol)
    assert isinstance(BlockIndex.build(frame(spark, [[0, 1], [1, 0]])), seams.SpatialIndex)
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 2, 1.0)], "src long, dst long, weight double")
    s = reduction.fuzzy_statistics(edges).first()
    assert (s.edges, s.total, s.max) == (2, 1.5, 1.0) and reduction.edges_above(edges, 0.6).count() == 1
    assert reduction.membership(edges, 0, 1).first()[0] == 0.5 and reduction.membership(edges, 0, 2).first()[0] == 0.0


def test_numbers_follow_the_order(spark):
    words = [f"w{i * 37 % 211:03d}" for i in range(200)]
    got = numbered(spark.createDataFrame([(w,) for w in words], "term string").repartition(5), "term", "i").collect()
    assert {r.term: r.i for r in got} == {w: i for i, w in enumerate(sorted(words))}
    assert numbered(spark.createDataFrame([], "term string"), "term", "i").count() == 0


def test_only_the_nearest_are_sent_on(spark, monkeypatch):
    points = frame(spark, np.random.default_rng(2).normal(size=(300, 6)))
    ranked, sent = neighbours._ranked, []
    monkeypatch.setattr(neighbours, "_ranked", lambda c, k: sent.append(c.count()) or ranked(c, k))
    assert neighbours.knn_graph(points, 5, size=10).count() == 1500
    assert sent == [1500]  # not 5 of each of some 30 blocks


def test_the_sieve_loses_no_pair():
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=(70, 5)), rng.normal(size=(70, 5)) + 1e6, rng.normal(size=(70, 5)) * 1e-7, rng.normal(size=(70, 5)) * 1e25, np.repeat(rng.normal(size=(7, 5)), 10, axis=0)):
        x[3], x[5, 2], x[6, 0] = np.nan, np.inf, -np.inf
        a, b = x[:40], x[3:66]
        d = np.round(np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)), 9)
        for limit in (np.nanquantile(d[np.isfinite(d)], 0.1), np.sort(d[np.isfinite(d)])[50], 0.0):
            got = {(int(i), int(j)) for i, j, _ in (t for p in neighbours._within(a, b, np.full(40, limit), "euclidean") for t in zip(*p, strict=True))}
            assert got == set(zip(*(t.tolist() for t in np.nonzero(d <= limit)), strict=True))


def test_spanning_tree_asks_only_where_the_graph_does_not_tell(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(60, 3)) + c for c in ([0, 0, 0], [50, 0, 0], [0, 80, 0])])
    least, asked = hdbscan._least_out, []
    monkeypatch.setattr(hdbscan, "_least_out", lambda *a: asked.append(int(a[4].sum())) or least(*a))
    got = sorted((r.src, r.dst) for r in hdbscan.spanning_tree(frame(spark, x), 3, size=40).collect())
    d = np.round(neighbours.distances(x, x), 9)
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, 2]
    i, j = np.triu_indices(len(x), 1)
    kept = hdbscan.forest(i, j, np.maximum(d, np.maximum(core[:, None], core[None]))[i, j])
    assert got == sorted(zip(i[kept].tolist(), j[kept].tolist(), strict=True))
    assert asked == [120]  # two of the three heaps, once


def test_pairs_are_not_shuffled(spark):
    points = frame(spark, np.random.default_rng(4).normal(size=(50, 3)))
    found = neighbours.mutual_reachability(points, 3, size=8)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("MapInArrow") < min(plan.find(x) for x in ("Join", "CartesianProduct", "Exchange") if x in plan)
    assert plan.count("<=") == 1  # each pair of blocks once
    assert found.count() == 50 * 49 // 2
