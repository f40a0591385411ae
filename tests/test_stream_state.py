"""Stores that are cut off, streams that keep what they assign, training that stops."""

from __future__ import annotations

import threading

import pytest

from lexiloom.operators.hdbscan import Stopped
from lexiloom.plans.config import TopicModelConfig, UpdateConfig
from lexiloom.plans.model import TopicModel, TopicModelError, validate_state
from lexiloom.sources.storage import ParquetStorage
from lexiloom.streaming.drift import Drift, batch_drift
from lexiloom.streaming.updater import TopicUpdater
from tests.test_models import corpus


def test_a_crash_between_write_and_switch_leaves_a_whole_version(spark, tmp_path, monkeypatch):
    store = ParquetStorage(spark, str(tmp_path / "s"))
    store.save_table("topics", spark.range(3))
    store.save_json("state", {"batch": 4})
    real = store._fs

    class Broken:
        def rename(self, *a):
            raise OSError("lost")

        def __getattr__(self, name):
            return getattr(real, name)

    monkeypatch.setattr(store, "_fs", Broken())
    for save in (lambda: store.save_table("topics", spark.range(9)), lambda: store.save_json("state", {"batch": 5})):
        with pytest.raises(OSError):
            save()
    again = ParquetStorage(spark, str(tmp_path / "s"))
    assert again.load_table("topics").count() == 3 and again.load_json("state") == {"batch": 4}
    # a manifest that was written in part is passed over
    (tmp_path / "s" / "state.7.json").write_text('{"batch": ')
    assert again.load_json("state") == {"batch": 4}
    again.save_json("state", {"batch": 6})
    assert again.load_json("state") == {"batch": 6}
    again.append_table("topics", spark.range(3, 5))
    assert again.load_table("topics").count() == 5
    again.save_graph(spark.createDataFrame([(1, 1, 2, 0.5)], "src long, rank int, dst long, dist double"))
    assert again.load_graph().count() == 1 and again.load_reduced() is None


def test_stream_keeps_its_assignments(spark, tmp_path):
    updater = TopicUpdater(spark, str(tmp_path / "m"), UpdateConfig(cold_start=24, retrain=30, max_buffer=60))
    updater.process(corpus(spark, 24))
    assert updater.has_model and updater.pending_count() == 0
    ids = {r.topic_id for r in updater.topics().collect()}
    path = str(tmp_path / "in")
    corpus(spark, 4, 500).repartition(1).write.parquet(path)
    stream = spark.readStream.schema("doc_id long, text string, embedding array<double>").parquet(path)
    # numbers of a stream begin at 0, which this updater has seen
    updater._save(batch=-1)
    updater.stream(stream, str(tmp_path / "c")).awaitTermination()
    got = {r.doc_id: r.topic_id for r in updater.assignments().collect()}
    assert len(got) == 28 and all(got[i] in ids for i in range(500, 504)) and updater.pending_count() == 4
    first = {r.doc_id: r.topic_id for r in updater.assignments().where("doc_id < 24").collect()}
    assert all(got[500 + i] == first[i] for i in range(4))
    assert updater.drift.total == 4 and updater.state()["seen"] == 28


def test_retrain_in_the_background_and_cancel(spark, tmp_path, monkeypatch):
    updater = TopicUpdater(spark, str(tmp_path / "m"), UpdateConfig.preset("testing"), background=True)
    updater.process(corpus(spark, 24))
    assert updater.wait() and updater.failure is None and updater.has_model and updater.pending_count() == 0
    begun = threading.Event()

    def fit(self, rows, should_stop):
        begun.set()
        while not should_stop():
            pass
        raise Stopped("reduction")

    monkeypatch.setattr(TopicModel, "fit", fit)
    updater.process(corpus(spark, 4, 100))
    assert begun.wait(60)
    updater.cancel()
    assert updater.failure is None and updater.pending_count() == 4 and updater.store.load_checkpoint() is None
    updater.process(corpus(spark, 1, 200))
    assert updater.terminate(60) and updater.pending_count() == 5


def test_training_stops_between_stages(spark):
    with pytest.raises(Stopped):
        TopicModel(TopicModelConfig.preset("small_corpus")).fit(corpus(spark), should_stop=lambda: True)


def test_json_state_and_timings(spark):
    model = TopicModel(TopicModelConfig.preset("small_corpus")).fit(corpus(spark))
    assert set(model.timings) == {"embedding", "reduction", "clustering", "representation", "coherence"} and all(x > 0 for x in model.timings.values())
    again = TopicModel.restore_json(spark, model.export_json())
    assert again.config == model.config and again.topics.count() == model.topics.count() and again.assignment.count() == 24
    assert sorted(r.topic_id for r in again.transform(corpus(spark, 4)).collect()) == sorted(r.topic_id for r in model.transform(corpus(spark, 4)).collect())
    assert validate_state({"version": 1}) and validate_state({"version": 1, "dimension": 2, "config": {}, "topics": [{"topic_id": 0, "centroid": [1.0], "size": 0}], "assignment": [{"topic_id": 9}]})
    with pytest.raises(TopicModelError):
        TopicModel.restore_json(spark, '{"version": 1, "dimension": 2, "config": {}, "topics": [{"topic_id": 0}], "assignment": []}')


def test_drift_of_many_ranges_is_that_of_one_pass(spark):
    rows = [(i, (i * 7919 % 101) / 10, i % 3 == 0) for i in range(500)]
    before = Drift(window=20).observe_all([1.0] * 9, [False] * 9)
    want = before.observe_all([r[1] for r in rows], [r[2] for r in rows])
    got = batch_drift(spark.createDataFrame(rows, "t int, distance double, outlier boolean").repartition(7), ["t"], 20, before).first()
    assert got["total"] == want.total and got["overall"] == pytest.approx(want.overall) and got["recent"] == pytest.approx(want.recent) and got["outlier_rate"] == pytest.approx(want.outlier_rate)
    none = batch_drift(spark.createDataFrame([], "t int, distance double, outlier boolean"), ["t"]).first()
    assert (none["total"], none["overall"], none["recent"]) == (0, 0.0, 0.0)
