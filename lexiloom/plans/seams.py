"""What can be put in place of the engine's own parts. All speak DataFrames, so that an implementation may be distributed as it likes."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from ..operators import coherence
from ..operators.coherence import CoherenceConfig
from ..operators.hdbscan import HDBSCAN
from ..operators.neighbours import BlockIndex
from .config import TopicModelConfig
from .model import represent


@runtime_checkable
class ClusteringEngine(Protocol):
    """fit() on (key, vector) gives an engine with ``assignment`` (key, label, probability, outlier_score); predict() labels other points."""

    def fit(self, points: DataFrame, key: str = ..., vector: str = ...) -> ClusteringEngine: ...

    def predict(self, points: DataFrame, key: str = ..., vector: str = ...) -> DataFrame: ...


@runtime_checkable
class TopicRepresenter(Protocol):
    """(topic_id, rank, term, score, tf) of tokens (doc_id, tokens) and labels (doc_id, label)."""

    def represent(self, tokens: DataFrame, labelled: DataFrame) -> DataFrame: ...


@runtime_checkable
class SpatialIndex(Protocol):
    """Neighbours of queries (key, vector) among the points of the index."""

    def query(self, queries: DataFrame, k: int) -> DataFrame: ...

    def query_radius(self, queries: DataFrame, radius: float) -> DataFrame: ...


@runtime_checkable
class CoherenceEvaluator(Protocol):
    """(topic_id, coherence, pairs) of keywords (topic_id, rank, term), counted in tokens or from given counts."""

    def evaluate(self, tokens: DataFrame, keywords: DataFrame) -> DataFrame: ...

    def evaluate_counts(self, keywords: DataFrame, counts: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame: ...


class ClassTfIdf:
    """The engine's own representer."""

    def __init__(self, config: TopicModelConfig = TopicModelConfig()) -> None:
        self.config = config

    def represent(self, tokens: DataFrame, labelled: DataFrame) -> DataFrame:
        return represent(tokens, labelled, self.config)


class Npmi:
    """The engine's own evaluator."""

    def __init__(self, config: CoherenceConfig = CoherenceConfig()) -> None:
        self.config = config

    def evaluate(self, tokens: DataFrame, keywords: DataFrame) -> DataFrame:
        return coherence.topic_coherence(tokens, keywords, self.config)

    def evaluate_counts(self, keywords: DataFrame, counts: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
        return coherence.topic_coherence(None, keywords, self.config, counts)


OWN: dict[str, type] = {"clustering": HDBSCAN, "representation": ClassTfIdf, "index": BlockIndex, "coherence": Npmi}
