from __future__ import annotations

import math
from time import perf_counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import hdbscan, reduction
from lexiloom.operators.hdbscan import HDBSCAN
from lexiloom.plans.config import ConfigurationError, TopicModelConfig, TopicModelConfigBuilder, UpdateConfig
from lexiloom.plans.model import NotFitted, TopicModel, TopicModelError
from lexiloom.sources.providers import CachingProvider, FunctionProvider, PassthroughProvider, PrecomputedProvider
from lexiloom.sources.storage import MissingEmbedding, ParquetStorage
from lexiloom.streaming.drift import Drift, batch_drift, stream_drift
from lexiloom.streaming.training import Interrupted, TrainingRunner
from lexiloom.streaming.updater import TopicUpdater


def frame(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(np.asarray(x, float).tolist())], "id long, embedding array<double>")


def blobs(n, centres, spread=0.1, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([c + rng.normal(0, spread, (n, len(c))) for c in np.array(centres, float)])


def labels(spark, x, **settings):
    return [r.label for r in HDBSCAN(**settings).fit(frame(spark, x)).assignment.orderBy("id").collect()]


def test_pca_equals_svd(spark):
    x = np.random.default_rng(2).normal(size=(50, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1])
    model = reduction.PCA(3).fit(frame(spark, x))
    got = np.array([r.embedding for r in model.transform(frame(spark, x)).orderBy("id").collect()])
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((x - x.mean(axis=0)) @ vt[:3].T), atol=1e-6)
    assert np.allclose(model.eigenvalues[:3], s[:3] ** 2 / 49, rtol=1e-5) and math.isclose(model.explained_variance_ratios.sum(), 1)
    white = np.array([r.embedding for r in reduction.PCA(3, whiten=True).fit(frame(spark, x)).transform(frame(spark, x)).collect()])
    assert np.allclose(white.std(axis=0, ddof=1), 1, atol=1e-4)
    assert reduction.PCA(variance_ratio=0.5).fit(frame(spark, x)).components == 1
    with pytest.raises(ValueError):
        reduction.PCA(9).fit(frame(spark, x))


def test_umap_keeps_neighbours_near(spark):
    x = blobs(15, [[0, 0, 0, 0, 0], [8, 8, 8, 8, 8]])
    model = reduction.UMAP(2, k=5, epochs=60).fit(frame(spark, x))
    y = np.array([r.embedding for r in model.layout.orderBy("id").collect()])
    assert y.shape == (30, 2) and np.isfinite(y).all()
    inside = np.linalg.norm(y[:15] - y[:15].mean(axis=0), axis=1).mean()
    assert np.linalg.norm(y[:15].mean(axis=0) - y[15:].mean(axis=0)) > 2 * inside
    new = model.transform(frame(spark, x[:3] + 0.001)).collect()
    assert all(np.linalg.norm(np.array(r.embedding) - y[:15].mean(axis=0)) < np.linalg.norm(np.array(r.embedding) - y[15:].mean(axis=0)) for r in new)
    d = np.sort(np.random.default_rng(0).random((20, 8)), axis=1)
    rho, sigma = reduction.smooth_distances(d, 8)
    assert np.allclose(np.exp(-(d - rho[:, None]) / sigma[:, None]).sum(axis=1), 3, atol=1e-4)


def test_spanning_tree_is_the_least(spark):
    x = np.random.default_rng(3).normal(size=(40, 3))
    ids, edges = hdbscan.minimum_spanning_tree(frame(spark, x), 3, size=7)
    core = np.sort(np.linalg.norm(x[:, None] - x[None], axis=2), axis=1)[:, 3]
    mrd = np.maximum(np.linalg.norm(x[:, None] - x[None], axis=2), np.maximum(core[:, None], core[None]))
    assert len(edges) == 39 and math.isclose(sum(w for *_, w in edges), sum(w for *_, w in hdbscan.prim(mrd)), abs_tol=1e-6)
    nodes = hdbscan.hierarchy(3, [(0, 1, 1.0), (1, 2, 2.0)])
    assert len(nodes) == 5 and max(nodes) == 4 and nodes[4].size == 3 and nodes[3].death == 2.0


def test_clusters(spark):
    x = blobs(15, [[0, 0], [10, 10]])
    got = labels(spark, x, min_cluster_size=5, min_samples=3)
    a, b = (max(set(h), key=h.count) for h in (got[:15], got[15:]))
    assert got[:15].count(a) >= 13 and got[15:].count(b) >= 13 and {a, b} == {0, 1} == set(got) - {-1}
    grid = [[i * 0.1, j * 0.1] for i in range(5) for j in range(3)] + [[100, 100]]
    model = HDBSCAN(5, 3).fit(frame(spark, grid))
    rows = model.assignment.orderBy("id").collect()
    assert rows[-1].label == -1 and rows[-1].outlier_score > 0.5
    assert labels(spark, [[1.0, 2.0]]) == [-1] and len(labels(spark, [[1.0, 1.0]] * 10, min_cluster_size=3)) == 10
    engine = HDBSCAN(5, 3).fit(frame(spark, x))
    p = engine.predict(frame(spark, [[0, 0], [10, 10], [500, 500]])).orderBy("id").collect()
    assert [r.label for r in p] == [a, b, -1]
    assert hdbscan.HDBSCANBuilder().min_cluster_size(7).method("leaf").build() == HDBSCAN(7, method="leaf")


WORDS = {0: "neural network machine learning model training data gradient", 1: "garden flower rose soil water plant seed bloom"}


def corpus(spark, n=24, start=0):
    rng = np.random.default_rng(start + 5)
    rows = []
    for i in range(start, start + n):
        t = i % 2
        words = rng.permutation(WORDS[t].split())[:6]
        rows.append((i, " ".join(words), (np.array([5.0, 0, 0] if t == 0 else [0, 5.0, 0]) + rng.normal(0, 0.2, 3)).tolist()))
    return spark.createDataFrame(rows, "doc_id long, text string, embedding array<double>")


@pytest.fixture(scope="module")
def model(spark):
    seen = []
    fitted = TopicModel(TopicModelConfig.preset("small_corpus")).fit(corpus(spark), progress=lambda s, p: seen.append((s, round(p, 2))))
    assert seen[-1] == ("coherence", 1.0)
    return fitted


def test_fit_and_questions(spark, model):
    topics = {r.topic_id: r for r in model.topics.collect()}
    assert len(topics) == 2 and all(k.term in " ".join(WORDS.values()).split() for t in topics.values() for k in t.keywords)
    s = model.statistics().first()
    assert s.clusters == 2 and s.documents == 24 and s.mean_coherence is not None
    t = {r.doc_id: r.topic_id for r in model.transform(corpus(spark, 6, 100)).collect()}
    own = {r.doc_id % 2: r.topic_id for r in model.assignment.where("topic_id >= 0").collect()}
    assert all(t[i] == own[i % 2] for i in t)
    f = model.find_topics(corpus(spark, 2, 100)).collect()
    assert all(math.isclose(r.probability + sum(a.probability for a in r.alternatives), 1) for r in f)
    hits = model.search([5.0, 0.0, 0.0], 3).collect()
    assert len(hits) == 3 and all(r.doc_id % 2 == 0 for r in hits)
    assert model.representative_documents(own[0]).count() == 3 and model.topics_by_size().count() == 2
    assert model.compare(model).where("old_id = new_id").agg(F.min("similarity")).first()[0] == pytest.approx(1)


def test_merge_reduce_save(spark, model, tmp_path):
    merged = model.merge([0, 1])
    row = merged.topics.first()
    assert merged.topics.count() == 1 and row.topic_id == 0 and row["size"] == model.topics.agg(F.sum("size")).first()[0] and row.coherence is None
    assert model.reduce(1).topics.count() == 1
    for bad in ([0], [0, 9], [-1, 0]):
        with pytest.raises(TopicModelError):
            model.merge(bad)
    model.save(str(tmp_path / "m"))
    again = TopicModel.load(spark, str(tmp_path / "m"))
    assert again.config == model.config and again.topics.count() == 2 and again.search([1.0, 0, 0]).count() == 0
    assert again.transform(corpus(spark, 2)).count() == 2


def test_errors(spark):
    for name in ("default", "fast", "quality", "small_corpus", "large_corpus"):
        TopicModelConfig.preset(name).validate()
    for name in ("default", "aggressive", "conservative", "testing"):
        UpdateConfig.preset(name).validate()
    with pytest.raises(ConfigurationError):
        TopicModelConfigBuilder().representation(keywords=3).build()
    with pytest.raises(NotFitted):
        TopicModel().transform(corpus(spark))
    for bad in (corpus(spark).limit(0), corpus(spark).union(corpus(spark)), corpus(spark).withColumn("embedding", F.expr("IF(doc_id = 3, array(1D), embedding)"))):
        with pytest.raises(TopicModelError):
            TopicModel().fit(bad)


def test_providers(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def embed(texts):
        with open(calls, "a") as f:
            f.write("".join(t + "\n" for t in texts))
        return [[float(len(t)), 1.0] for t in texts]

    docs = spark.createDataFrame([(0, "aa"), (1, "b"), (2, "aa")], "doc_id long, text string")
    base = FunctionProvider(embed, 2)
    assert [r.embedding for r in base.embed(docs).orderBy("doc_id").collect()] == [[2, 1], [1, 1], [2, 1]]
    open(calls, "w").close()
    cache = CachingProvider(base, str(tmp_path / "cache"))
    for _ in range(2):
        assert cache.embed(docs).count() == 3
    assert sorted(open(calls).read().split()) == ["aa", "b"]
    known = spark.createDataFrame([("aa", [1.0]), ("b", [2.0])], "text string, embedding array<float>")
    assert PrecomputedProvider(known, 1).embed(docs).count() == 3
    with pytest.raises(Exception, match="no embedding"):
        PrecomputedProvider(known.where("text = 'aa'"), 1).embed(docs).collect()
    placed = spark.createDataFrame([(0, [7.0]), (1, [8.0])], "pos int, embedding array<float>")
    assert [r.embedding for r in PassthroughProvider(placed, 1).embed(docs).orderBy("doc_id").collect()] == [[7], [8]]


def test_storage(spark, tmp_path):
    store = ParquetStorage(spark, str(tmp_path / "s"))
    assert store.load_table("topics") is None and store.load_json("x") is None and store.pending_count() == 0
    store.save_table("topics", spark.range(3))
    store.save_table("topics", spark.range(5))
    assert store.load_table("topics").count() == 5
    rows = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "doc_id long, embedding array<float>")
    store.append_embeddings(rows)
    store.append_embeddings(rows.withColumn("doc_id", F.col("doc_id") + 10))
    assert store.embedding_count() == 4 and store.load_embeddings(rows.select("doc_id")).count() == 2
    with pytest.raises(MissingEmbedding):
        store.load_embeddings(spark.range(99, 100).toDF("doc_id"))
    store.append_pending(rows)
    assert store.pending_count() == 2 and store.drain().count() == 2 and store.pending_count() == 0
    store.restore()
    assert store.pending_count() == 2
    store.save_checkpoint({"phase": "merge"})
    assert store.load_checkpoint() == {"phase": "merge"} and store.size_bytes() > 0
    store.clear()
    assert store.size_bytes() == 0


def test_drift(spark):
    d = Drift()
    for x, o in ((1.0, False), (2.0, False), (3.0, True)):
        d = d.observe(x, o)
    assert d.total == 3 and math.isclose(d.overall, 2) and math.isclose(d.recent, 0.117251, abs_tol=1e-6) and math.isclose(d.outlier_rate, 0.019802, abs_tol=1e-6)
    rows = spark.createDataFrame([(1, 1.0, False), (2, 2.0, False), (3, 3.0, True)], "t int, distance double, outlier boolean")
    b = batch_drift(rows, ["t"]).first()
    assert math.isclose(b.recent, d.recent) and math.isclose(b.outlier_rate, d.outlier_rate) and b.total == 3
    early = Drift().observe_all([100.0] * 10, [True] * 10)
    late = early.observe_all([100.0] * 30, [True] * 30)
    assert not early.refresh_due(9.0, 0.5) and late.refresh_due(9.0, 0.5)


def test_streams(spark, tmp_path):
    path, updater = str(tmp_path / "in"), TopicUpdater(spark, str(tmp_path / "m"), UpdateConfig.preset("testing"))
    corpus(spark, 24).repartition(1).write.parquet(path)
    stream = spark.readStream.schema("doc_id long, text string, embedding array<double>").parquet(path)
    q = updater.stream(stream, str(tmp_path / "c"))
    q.awaitTermination()
    assert updater.has_model and updater.topics().count() == 2 and updater.pending_count() == 0 and updater.state()["seen"] == 24
    assert updater.store.embedding_count() == 24
    ids = {r.topic_id for r in updater.topics().collect()}
    out = updater.process(corpus(spark, 4, 200))
    assert {r.topic_id for r in out.collect()} <= ids and updater.drift.total == 4
    before = updater.store.embedding_count()
    updater.process(corpus(spark, 4, 200), batch=updater.state()["batch"])  # the same batch again
    assert updater.store.embedding_count() == before and updater.state()["seen"] == 28
    updater.refresh(corpus(spark, 24))
    assert {r.topic_id for r in updater.topics().collect()} == ids and updater.drift.total == 0
    d = stream_drift(spark.readStream.schema("doc_id long, text string, embedding array<double>").parquet(path).select(F.lit("all").alias("k"), F.col("doc_id").alias("t"), F.lit(2.0).alias("distance"), F.lit(False).alias("outlier")), "k", "t")
    q = d.writeStream.format("memory").queryName("drift").outputMode("update").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("drift").first().total == 24


def test_interrupted_training_waits_again(spark, tmp_path, monkeypatch):
    updater = TopicUpdater(spark, str(tmp_path / "m"), UpdateConfig.preset("testing"))
    monkeypatch.setattr(TopicModel, "fit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        updater.process(corpus(spark, 8))
    assert updater.pending_count() == 8 and not updater.has_model and updater.store.load_checkpoint() is None


def test_training_goes_on_behind_the_last_phase(spark, tmp_path):
    store, calls = ParquetStorage(spark, str(tmp_path / "t")), []
    config = TopicModelConfig.preset("small_corpus")

    def stop() -> bool:
        calls.append(1)
        return len(store.load_checkpoint()["phases"]) == 3

    with pytest.raises(Interrupted) as e:
        TrainingRunner(store, config, stop).run(corpus(spark))
    assert e.value.phase == "representation" and store.load_checkpoint()["phases"] == ["corpus", "reduction", "clustering"]
    runner = TrainingRunner(store, config)
    assert runner.can_resume()
    fitted = runner.resume()
    assert fitted.topics.count() == 2 and fitted.assignment.count() == 24 and not runner.can_resume()
    with pytest.raises(RuntimeError):
        runner.resume()


def test_layout_step():
    """The layout's sums are those of np.add.at() to the last bit, in less than its time."""
    def by_place(y, i, j, w, epochs, last):
        a, b = reduction.curve(0.1)
        y = y.copy()
        for e in range(last):
            rng = np.random.default_rng([42, e])
            on = rng.random(len(i)) < w / w.max()
            s, t = i[on], j[on]
            step = np.zeros_like(y)
            diff = y[s] - y[t]
            square = np.maximum((diff**2).sum(axis=1), 1e-12)
            pull = np.clip((-2 * a * b * square ** (b - 1) / (1 + a * square**b))[:, None] * diff, -4, 4)
            np.add.at(step, s, pull)
            np.add.at(step, t, -pull)
            s = np.repeat(s, 5)
            t = rng.integers(len(y), size=len(s))
            diff = y[s] - y[t]
            square = (diff**2).sum(axis=1)
            push = np.clip((2 * b / ((0.001 + square) * (1 + a * square**b)))[:, None] * diff, -4, 4)
            push[s == t] = 0
            np.add.at(step, s, push)
            y += (1 - e / epochs) * np.clip(step, -4, 4)
        return y

    rng = np.random.default_rng(0)
    for c, n in ((1, 300), (2, 20_000), (7, 300), (9, 300)):
        i = np.repeat(np.arange(n), 15)
        j, w, y = rng.integers(n, size=len(i)), rng.random(len(i)), rng.uniform(-10, 10, (n, c))
        old, new = [], []
        for _ in range(3 if n > 300 else 1):
            began = perf_counter()
            expected = by_place(y, i, j, w, 100, 3)
            middle = perf_counter()
            assert np.array_equal(reduction.optimise_layout(y, i, j, w, epochs=100, last=3), expected)
            old, new = [*old, middle - began], [*new, perf_counter() - middle]
        assert n == 300 or min(new) < 0.75 * min(old)
