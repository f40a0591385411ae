"""Incremental updates of a topic model from a stream of documents.

Each micro-batch is appended to the embedding store and the pending rows, assigned by cosine to the
stored topics, which is stored too, and observed by the drift state; when enough rows wait, they
become a small model that is matched with and merged into the stored one, in this thread or, with
``background``, in another one while batches go on; a batch that finds ``max_buffer`` rows waiting
waits for it. A batch that Spark runs again after a failure is recognised by its number and leaves no
second trace.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import assignment, matching
from ..operators.hdbscan import Stopped
from ..operators.matching import MatchConfig, MergeConfig, TopicIds
from ..plans.config import UpdateConfig
from ..plans.model import TopicModel
from ..sources.storage import ParquetStorage
from .drift import Drift, batch_drift
from ..operators.lineage import checkpointed

PENDING = "doc_id long, text string, embedding array<double>, batch long"


class TopicUpdater:
    def __init__(self, spark: SparkSession, path: str, config: UpdateConfig = UpdateConfig(), clock: Callable[[], float] = time.time, background: bool = False) -> None:
        self.spark, self.store, self.config, self.clock, self.background = spark, ParquetStorage(spark, path), config.validate(), clock, background
        self._lock, self._stop, self._worker = threading.RLock(), threading.Event(), None
        self.failure: BaseException | None = None
        self.resume()

    # state

    def state(self) -> dict:
        return self.store.load_json("state") or {"batch": -1, "next_id": 0, "trained_at": 0.0, "trained_size": 0, "seen": 0, "retrains": 0, "refreshes": 0, "drift": Drift(window=self.config.window).as_dict()}

    def _save(self, **changes: object) -> None:
        with self._lock:
            self.store.save_json("state", {**self.state(), **changes})

    @property
    def drift(self) -> Drift:
        return Drift(**self.state()["drift"])

    @property
    def has_model(self) -> bool:
        return self.topics() is not None

    def topics(self) -> DataFrame | None:
        return self.store.load_table("topics")

    def topic(self, topic_id: int) -> DataFrame:
        return self.topics().where(F.col("topic_id") == topic_id)

    def assignments(self) -> DataFrame | None:
        """(doc_id, topic_id, probability): the latest of each document, streamed ones included."""
        every = self.store.load_table("assignments")
        if every is None:
            return None
        last = every.groupBy("doc_id").agg(F.max_by(F.struct("topic_id", "probability"), "batch").alias("m"))
        return last.select("doc_id", "m.topic_id", "m.probability")

    def _keep(self, result: DataFrame, number: int) -> None:
        rows = result.select("doc_id", F.col("topic_id").cast("int").alias("topic_id"), F.col("confidence").cast("double").alias("probability"), F.lit(number).cast("long").alias("batch"))
        with self._lock:
            self.store.append_table("assignments", rows)

    def pending_count(self) -> int:
        return self.store.pending_count()

    # documents

    def process(self, docs: DataFrame, batch: int | None = None) -> DataFrame:
        """Take (doc_id, text, embedding); their assignment (doc_id, topic_id, similarity, confidence), all outliers before there is a model."""
        state = self.state()
        number = state["batch"] + 1 if batch is None else batch
        rows = docs.select("doc_id", "text", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(number).cast("long").alias("batch"))
        low, high, n = rows.agg(F.min(F.size("embedding")), F.max(F.size("embedding")), F.count("*")).first()
        if n == 0:
            return self.spark.createDataFrame([], "doc_id long, topic_id int, similarity double, confidence double")
        known = self.store.load_json("model")
        if low != high or low < 1 or known and known["dimension"] != low:
            raise ValueError("another dimension than the model's")
        if number > state["batch"]:
            pending = self.store.pending()
            fresh = rows if pending is None else rows.join(pending.where(F.col("batch") == number).select("doc_id"), "doc_id", "left_anti")
            fresh = checkpointed(fresh)
            with self._lock:
                self.store.append_pending(fresh)
            self.store.append_embeddings(fresh)
        if self.has_model:
            with self._lock:  # a merge in the background replaces the topics
                result = checkpointed(assignment.cosine_assignment(rows, self.topics(), threshold=self.config.assign))
        else:
            result = rows.select("doc_id", F.lit(-1).alias("topic_id"), F.lit(0.0).alias("similarity"), F.lit(0.0).alias("confidence"))
        if number > state["batch"]:
            self._keep(result, number)
            changes = {"batch": number, "seen": state["seen"] + n}
            if self.has_model:
                seen = result.select("doc_id", (1 - F.col("similarity")).alias("distance"), (F.col("topic_id") == -1).alias("outlier"))
                d = batch_drift(seen, ["doc_id"], self.config.window, self.drift).first()
                changes["drift"] = Drift(d["total"], d["overall"], d["recent"], d["outlier_rate"], self.config.window).as_dict()
            self._save(**changes)
        cold = not self.has_model
        if self.pending_count() >= (self.config.cold_start if cold else self.config.retrain):
            self._retrain_now_or_aside()
            if cold and self.has_model:
                result = assignment.cosine_assignment(rows, self.topics(), threshold=self.config.assign)
        return result

    def stream(self, docs: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Process a streaming table of (doc_id, text, embedding); each batch's assignments are part of assignments() when it is done."""

        def take(batch: DataFrame, number: int) -> None:
            self.process(batch, number)

        return docs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    # training

    def _retrain_now_or_aside(self) -> None:
        if not self.background:
            self.retrain()
            return
        if self._worker is not None and self._worker.is_alive():
            if self.pending_count() < self.config.max_buffer:
                return
            self._worker.join()
            if self.pending_count() < self.config.retrain:
                return
        self._worker = threading.Thread(target=self._aside, daemon=True)
        self._worker.start()

    def _aside(self) -> None:
        try:
            self.retrain()
        except Stopped:
            pass
        except BaseException as e:  # its rows wait again; the next batch tries once more
            self.failure = e

    def wait(self, seconds: float | None = None) -> bool:
        """For a retrain in the background; whether none is left."""
        if self._worker is not None:
            self._worker.join(seconds)
        return self._worker is None or not self._worker.is_alive()

    def cancel(self) -> None:
        """Stop a retrain at its next step; its rows are pending again."""
        self._stop.set()
        self.wait()
        self._stop.clear()

    def terminate(self, seconds: float = 2.0) -> bool:
        """Ask a retrain to stop and wait so long; one that doesn't make it is taken up by resume() in a later process. Whether nothing is left."""
        self._stop.set()
        return self.wait(seconds)

    def retrain(self) -> None:
        """Pending rows become a model, which is merged into the stored one; if that fails, or is stopped, they wait again."""
        with self._lock:
            rows = self.store.drain()
        if rows is None:
            return
        self._checkpoint("merge", "started")
        try:
            model = TopicModel(self.config.model).fit(rows.select("doc_id", "text", "embedding"), should_stop=self._stop.is_set)
            with self._lock:
                self._merge(model, rows.count())
        except BaseException:
            with self._lock:
                self.store.restore()
                self.store.clear_checkpoint()
            raise
        with self._lock:
            self.store.forget()
            self.store.clear_checkpoint()

    def refresh(self, corpus: DataFrame) -> None:
        """Train on the whole corpus (doc_id, text, embedding); ids of matching topics stay, drift begins anew."""
        model = TopicModel(self.config.model).fit(corpus)
        old, ids = self.topics(), TopicIds(self.state()["next_id"])
        mapping = {r["topic_id"]: ids.fresh() for r in model.topics.select("topic_id").orderBy("topic_id").collect()} if old is None else ids.mapping(matching.match_topics(old, model.topics, MatchConfig(self.config.match)))[0]
        self.store.save_table("topics", matching.relabel(model.topics, mapping, "topic_id"))
        state = self.state()
        self.store.save_table("assignments", self._stamped(matching.relabel(model.assignment, mapping, "topic_id"), state["batch"]))
        n = corpus.count()
        self._save(next_id=ids.following, trained_at=self.clock(), trained_size=n, refreshes=state["refreshes"] + 1, drift=Drift(window=self.config.window).as_dict())
        self.store.save_json("model", {"dimension": model.dimension})

    def refresh_due(self) -> bool:
        state, c = self.state(), self.config
        if not self.has_model:
            return False
        grown = state["trained_size"] > 0 and state["seen"] / state["trained_size"] >= c.growth
        old = self.clock() - state["trained_at"] >= c.max_age_days * 86_400
        return grown or old or self.drift.refresh_due(c.drift, c.outlier_rate)

    def _merge(self, model: TopicModel, n: int) -> None:
        old, state = self.topics(), self.state()
        ids = TopicIds(state["next_id"])
        if old is None:
            mapping = {r["topic_id"]: ids.fresh() for r in model.topics.select("topic_id").orderBy("topic_id").collect()}
            topics = matching.relabel(model.topics, mapping, "topic_id")
            absorbed: dict[int, int] = {}
        else:
            mapping, absorbed = ids.mapping(matching.match_topics(old, model.topics, MatchConfig(self.config.match)))
            new = matching.relabel(model.topics, mapping, "topic_id")
            k = self.config.model.representation.keywords
            flat = lambda t: t.select("topic_id", F.explode("keywords").alias("k")).select("topic_id", "k.term", "k.score")
            words = matching.union_reranked(matching.relabel(flat(old), absorbed, "topic_id"), flat(new), k)
            arrays = words.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term", "score"))).alias("k")).select("topic_id", F.transform("k", lambda x: F.struct(x["term"].alias("term"), x["score"].alias("score"), F.lit(None).cast("bigint").alias("frequency"))).alias("keywords"))
            columns = ["topic_id", "size", "coherence", "centroid", "representative_docs"]
            merged = matching.merge_topic_tables(matching.folded(old.select(columns), absorbed).select(columns), matching.folded(new.select(columns), {}), MergeConfig(keyword_count=k))
            topics = merged.join(arrays, "topic_id", "left").select("topic_id", "keywords", "size", "coherence", "representative_docs", "centroid")
        found = self._stamped(matching.relabel(model.assignment, mapping, "topic_id"), state["batch"])
        before = self.assignments()
        if before is not None:
            found = self._stamped(matching.relabel(before, absorbed, "topic_id"), state["batch"]).join(found.select("doc_id"), "doc_id", "left_anti").unionByName(found)
        self.store.save_table("topics", topics)
        self.store.save_table("assignments", found)
        self.store.save_json("model", {"dimension": model.dimension})
        first = state["trained_size"] == 0
        self._save(next_id=ids.following, retrains=state["retrains"] + 1, **({"trained_at": self.clock(), "trained_size": n} if first else {}))

    @staticmethod
    def _stamped(found: DataFrame, batch: int) -> DataFrame:
        return found.select("doc_id", F.col("topic_id").cast("int").alias("topic_id"), F.col("probability").cast("double").alias("probability"), F.lit(batch).cast("long").alias("batch"))

    # interruption

    def _checkpoint(self, phase: str, status: str) -> None:
        old = self.store.load_checkpoint() or {}
        self.store.save_checkpoint({"phase": phase, "status": status, "attempts": old.get("attempts", 0) + 1})

    def resume(self) -> None:
        """After a training that was cut off: its rows are pending again, three times at most."""
        left = self.store.load_checkpoint()
        if left:
            if left["attempts"] <= 3:
                self.store.restore()
            else:
                self.store.forget()
                self.store.clear_checkpoint()


def with_config(updater: TopicUpdater, **changes: object) -> TopicUpdater:
    return TopicUpdater(updater.spark, updater.store.path, replace(updater.config, **changes), updater.clock, updater.background)
