"""Training that can be interrupted: each phase is stored, and a later run begins behind the last stored one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..functions.vectors import dimension_of
from ..operators import assignment, coherence
from ..operators.hdbscan import HDBSCAN, Stopped
from ..operators.reduction import PCA, UMAP
from ..plans.config import TopicModelConfig
from ..plans.model import TopicModel, check_corpus, represent, tokenizer_config, topic_table
from ..sources.storage import ParquetStorage

PHASES = ("corpus", "reduction", "clustering", "representation", "coherence", "topics", "assignment")
MOST_ATTEMPTS = 3


class Interrupted(RuntimeError):
    def __init__(self, phase: str) -> None:
        super().__init__(f"interrupted before {phase}")
        self.phase = phase


class TrainingRunner:
    """run() stores the table of every phase under train_<phase> and the names of the finished ones in the checkpoint."""

    def __init__(self, store: ParquetStorage, config: TopicModelConfig, should_stop: Callable[[], bool] = lambda: False) -> None:
        self.store, self.config, self.should_stop = store, config.validate(), should_stop

    def can_resume(self) -> bool:
        left = self.store.load_checkpoint()
        return bool(left) and left.get("attempts", 0) < MOST_ATTEMPTS and "phases" in left

    def run(self, docs: DataFrame) -> TopicModel:
        self.store.save_checkpoint({"phases": [], "attempts": 0})
        return self._go(docs)

    def resume(self) -> TopicModel:
        """The rest of an interrupted run; its documents are those that it stored."""
        if not self.can_resume():
            raise RuntimeError("no training to resume")
        return self._go(None)

    def _table(self, phase: str) -> DataFrame:
        return self.store.load_table(f"train_{phase}")

    def _go(self, docs: DataFrame | None) -> TopicModel:
        state = self.store.load_checkpoint()
        state["attempts"] += 1
        self.store.save_checkpoint(state)
        for phase in PHASES:
            if phase in state["phases"]:
                continue
            if self.should_stop():
                raise Interrupted(phase)
            try:
                table = getattr(self, f"_{phase}")(docs)
            except Stopped as e:  # within a phase, which a later run does anew
                raise Interrupted(phase) from e
            if table is not None:
                self.store.save_table(f"train_{phase}", table)
            state["phases"].append(phase)
            self.store.save_checkpoint(state)
        corpus = self._table("corpus")
        model = TopicModel(self.config, self._table("topics"), self._table("assignment"), corpus, None, dimension_of(corpus))
        self.store.clear_checkpoint()
        return model

    def _corpus(self, docs: DataFrame) -> DataFrame:
        docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("embedding").cast("array<double>").alias("embedding"))
        check_corpus(docs)
        return docs

    def _reduction(self, docs: DataFrame | None) -> DataFrame:
        corpus, r = self._table("corpus"), self.config.reduction
        points = corpus.select("doc_id", "embedding")
        if r.method == "none" or dimension_of(points) <= r.dimension and r.variance_ratio is None:
            return points
        seed = r.seed if r.seed is not None else self.config.seed if self.config.seed is not None else 42
        engine = PCA(min(r.dimension, points.count() - 1), r.variance_ratio, r.whiten) if r.method == "pca" else UMAP(r.dimension, r.neighbours, r.min_dist, r.metric, r.epochs, initialization="random", seed=seed)
        return engine.fit(points, key="doc_id").transform(points, key="doc_id")

    def _clustering(self, docs: DataFrame | None) -> DataFrame:
        c = self.config.clustering
        return HDBSCAN(c.min_cluster_size, c.min_samples, c.epsilon, c.method, c.allow_single, c.metric, should_stop=self.should_stop).fit(self._table("reduction"), key="doc_id").assignment

    def _tokens(self) -> DataFrame:
        return self._table("corpus").select("doc_id", tokenize("text", tokenizer_config(self.config)).alias("tokens"))

    def _representation(self, docs: DataFrame | None) -> DataFrame:
        return represent(self._tokens(), self._table("clustering"), self.config)

    def _coherence(self, docs: DataFrame | None) -> DataFrame | None:
        return coherence.topic_coherence(self._tokens(), self._table("representation"), self.config.coherence) if self.config.coherence else None

    def _topics(self, docs: DataFrame | None) -> DataFrame:
        corpus = self._table("corpus")
        scores = self._table("coherence") if self.config.coherence else None
        return topic_table(self._table("representation"), self._table("clustering"), corpus, scores, dimension_of(corpus))

    def _assignment(self, docs: DataFrame | None) -> DataFrame:
        labelled = self._table("clustering")
        return assignment.document_topics(self._table("corpus"), labelled, self._table("topics")).join(labelled.select("doc_id", "outlier_score"), "doc_id")
