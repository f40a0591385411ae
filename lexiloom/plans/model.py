"""Topic models: fit, transform, search, merge and reduce, save and load.

A model is a set of tables: topics (topic_id, keywords, size, coherence, representative_docs,
centroid), assignment (doc_id, topic_id, probability, outlier_score, distance) and the corpus
(doc_id, text, embedding). Clusters are found in the reduced space; centroids, transform and search
use the original one.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stopwords import EXTENDED
from ..functions.text import TokenizerConfig, tokenize
from ..functions.vectors import centroids, dimension_of
from ..operators import assignment as assign
from ..operators import coherence, vocabulary
from ..operators.hdbscan import HDBSCAN, Stopped
from ..operators.matching import similarity_matrix
from ..operators.reduction import PCA, UMAP, Identity
from ..sources.providers import EmbeddingProvider
from ..sources.storage import VERSION, ParquetStorage
from .config import ConfigurationError, TopicModelConfig
from ..operators.lineage import checkpointed

STAGES = {"embedding": 0.30, "reduction": 0.15, "clustering": 0.30, "representation": 0.15, "coherence": 0.10}


class TopicModelError(ValueError):
    pass


class NotFitted(TopicModelError):
    pass


class PipelineError(TopicModelError):
    def __init__(self, stage: str, cause: Exception) -> None:
        super().__init__(f"{stage}: {cause}")
        self.stage = stage


def tokenizer_config(config: TopicModelConfig) -> TokenizerConfig:
    return TokenizerConfig(stop_words=EXTENDED, min_length=config.representation.min_length, bigrams=config.representation.bigrams)


def check_corpus(docs: DataFrame) -> int:
    """Documents (doc_id, text, embedding) must be there, named once, and have vectors of one length."""
    n, ids, low, high, vectors = docs.agg(F.count("*"), F.count_distinct("doc_id"), F.min(F.size("embedding")), F.max(F.size("embedding")), F.count("embedding")).first()
    if n == 0:
        raise TopicModelError("no documents")
    if ids != n:
        raise TopicModelError("doc_id must be unique and not null")
    if vectors != n or low != high or low < 1:
        raise TopicModelError("embeddings must be there and of one dimension")
    return n


def represent(tokens: DataFrame, labelled: DataFrame, config: TopicModelConfig) -> DataFrame:
    """(topic_id, rank, term, score, tf): keywords of the labels of (doc_id, label, ...)."""
    r = config.representation
    vocab = vocabulary.vocabulary_terms(tokens, min_df=r.min_df, max_df=r.max_df)
    scores = vocabulary.ctfidf(tokens.join(labelled.select("doc_id", "label"), "doc_id"), vocab)
    top = vocabulary.top_keywords(scores, r.keywords)
    if r.diversify:
        arrays = vocabulary.diversified(vocabulary.keyword_arrays(top), r.diversity_weight)
        flat = arrays.select("label", F.posexplode("keywords").alias("i", "k"))
        return flat.select(F.col("label").alias("topic_id"), (F.col("i") + 1).alias("rank"), "k.term", "k.score", F.col("k.frequency").alias("tf"))
    return top.select(F.col("label").alias("topic_id"), "rank", "term", "score", "tf")


def topic_table(keywords: DataFrame, labelled: DataFrame, points: DataFrame, scores: DataFrame | None, dimension: int) -> DataFrame:
    own = points.join(labelled.select("doc_id", "label"), "doc_id").where("label != -1")
    middle = centroids(own, "label", "embedding", dimension).withColumnRenamed("label", "topic_id")
    sizes = own.groupBy(F.col("label").alias("topic_id")).agg(F.count("*").alias("size"))
    near = assign.representatives(own, middle).groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))).alias("r")).select("topic_id", F.col("r.doc_id").alias("representative_docs"))
    arrays = vocabulary.keyword_arrays(keywords, "topic_id")
    t = sizes.join(arrays, "topic_id", "left").join(middle, "topic_id").join(near, "topic_id", "left")
    t = t.join(scores.select("topic_id", "coherence"), "topic_id", "left") if scores is not None else t.withColumn("coherence", F.lit(None).cast("double"))
    return t.select("topic_id", "keywords", "size", "coherence", "representative_docs", "centroid")


@dataclass
class TopicModel:
    config: TopicModelConfig = field(default_factory=TopicModelConfig)
    topics: DataFrame | None = field(default=None, repr=False)
    assignment: DataFrame | None = field(default=None, repr=False)
    corpus: DataFrame | None = field(default=None, repr=False)
    reducer: object = field(default=None, repr=False)
    dimension: int | None = None
    provider: EmbeddingProvider | None = field(default=None, repr=False)
    timings: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    # training

    def fit(self, docs: DataFrame, provider: EmbeddingProvider | None = None, progress: Callable[[str, float], None] | None = None, should_stop: Callable[[], bool] = lambda: False) -> TopicModel:
        """docs: (doc_id, text, embedding), or without embedding but with a provider.

        timings holds the seconds of each stage. should_stop is asked before each stage and between the
        rounds of the spanning tree; Stopped is raised then.
        """
        config = self.config.validate()
        done, timings = 0.0, {}

        def stage(name: str, run: Callable[[], object]) -> object:
            nonlocal done
            if should_stop():
                raise Stopped(name)
            began = time.perf_counter()
            try:
                result = run()
            except (TopicModelError, ConfigurationError, Stopped):
                raise
            except Exception as e:
                raise PipelineError(name, e) from e
            timings[name] = time.perf_counter() - began
            done += STAGES[name]
            if progress:
                progress(name, min(1.0, done))
            return result

        docs = stage("embedding", lambda: (provider.embed(docs) if provider else docs).select("doc_id", "text", F.col("embedding").cast("array<double>").alias("embedding")))
        n = check_corpus(docs)
        d = dimension_of(docs)
        r = config.reduction
        points = docs.select("doc_id", "embedding")

        def reduce_() -> tuple[object, DataFrame]:
            if r.method == "none" or d <= r.dimension and r.variance_ratio is None:
                return Identity(), points
            seed = r.seed if r.seed is not None else config.seed if config.seed is not None else 42
            engine = PCA(min(r.dimension, n - 1), r.variance_ratio, r.whiten) if r.method == "pca" else UMAP(r.dimension, r.neighbours, r.min_dist, r.metric, r.epochs, seed=seed)
            fitted = engine.fit(points, key="doc_id")
            return fitted, fitted.transform(points, key="doc_id")

        reducer, small = stage("reduction", reduce_)
        c = config.clustering
        engine = HDBSCAN(c.min_cluster_size, c.min_samples, c.epsilon, c.method, c.allow_single, c.metric, should_stop=should_stop)
        clustered = stage("clustering", lambda: engine.fit(small, key="doc_id"))
        labelled = clustered.assignment
        tokens = checkpointed(docs.select("doc_id", tokenize("text", tokenizer_config(config)).alias("tokens")))
        keywords = stage("representation", lambda: checkpointed(represent(tokens, labelled, config)))
        scores = stage("coherence", lambda: checkpointed(coherence.topic_coherence(tokens, keywords, config.coherence)) if config.coherence else None)
        topics = checkpointed(topic_table(keywords, labelled, docs, scores, d))
        result = checkpointed(assign.document_topics(docs, labelled, topics).join(labelled.select("doc_id", "outlier_score"), "doc_id"))
        return replace(self, topics=topics, assignment=result, corpus=docs, reducer=reducer, dimension=d, provider=provider, timings=timings)

    def fit_transform(self, docs: DataFrame, provider: EmbeddingProvider | None = None) -> DataFrame:
        return self.fit(docs, provider).assignment

    # questions to a fitted model

    def _ready(self) -> TopicModel:
        if self.topics is None:
            raise NotFitted("fit the model first")
        return self

    def transform(self, points: DataFrame) -> DataFrame:
        """(doc_id, topic_id, distance, probability): the nearest centroid in the original space, never an outlier unless there are no topics."""
        self._ready()
        if self.dimension != dimension_of(points):
            raise TopicModelError("another dimension than the model's")
        if self.topics.isEmpty():
            return points.select("doc_id", F.lit(-1).alias("topic_id"), F.lit(None).cast("double").alias("distance"), F.lit(0.0).alias("probability"))
        return assign.nearest_centroid(points, self.topics)

    def find_topics(self, docs: DataFrame) -> DataFrame:
        self._ready()
        return assign.find_topics(self._embedded(docs), self.topics)

    def _embedded(self, docs: DataFrame) -> DataFrame:
        if "embedding" in docs.columns:
            return docs
        if self.provider is None:
            raise TopicModelError("texts need an embedding provider")
        return self.provider.embed(docs)

    def search(self, query: list[float] | str, top_k: int = 10) -> DataFrame:
        """The nearest training documents by cosine; none after a restore, which doesn't bring the corpus back."""
        self._ready()
        if self.corpus is None:
            return self.topics.sparkSession.createDataFrame([], "doc_id long, similarity double")
        if isinstance(query, str):
            query = self._embedded(self.corpus.sparkSession.createDataFrame([(query,)], "text string")).first()["embedding"]
        return assign.search(self.corpus, list(query), top_k)

    def statistics(self) -> DataFrame:
        s = vocabulary.assignment_statistics(self._ready().assignment, "topic_id")
        return s.crossJoin(self.topics.agg(F.avg("coherence").alias("mean_coherence")))

    def topics_by_size(self) -> DataFrame:
        return self._ready().topics.orderBy(F.desc("size"), "topic_id")

    def topics_by_coherence(self) -> DataFrame:
        return self._ready().topics.orderBy(F.desc_nulls_last("coherence"), "topic_id")

    def topic_of(self, doc_id: int) -> DataFrame:
        return self._ready().assignment.where(F.col("doc_id") == doc_id)

    def documents_of(self, topic_id: int) -> DataFrame:
        return self._ready().assignment.where(F.col("topic_id") == topic_id)

    def outliers(self) -> DataFrame:
        return self.documents_of(-1)

    def representative_documents(self, topic_id: int, count: int = 3) -> DataFrame:
        """The stored ones if the topic exists, else documents by probability."""
        stored = self._ready().topics.where(F.col("topic_id") == topic_id)
        if not stored.isEmpty():
            return stored.select(F.posexplode("representative_docs").alias("i", "doc_id")).where(F.col("i") < count).select("doc_id")
        return self.documents_of(topic_id).orderBy(F.desc("probability"), "doc_id").limit(count).select("doc_id")

    def compare(self, other: TopicModel) -> DataFrame:
        return similarity_matrix(self._ready().topics, other._ready().topics)

    # rewriting

    def merge(self, ids: list[int]) -> TopicModel:
        """Topics become one, of the smallest id; its keywords are computed anew, its coherence is unknown."""
        self._ready()
        ids = sorted(set(ids))
        known = {r["topic_id"] for r in self.topics.select("topic_id").collect()}
        if len(ids) < 2 or -1 in ids or not set(ids) <= known:
            raise TopicModelError("merge two existing topics or more")
        return self._rewritten({i: ids[0] for i in ids})

    def reduce(self, count: int) -> TopicModel:
        """Merge the closest pair of centroids until so many topics are left; keywords are computed once, at the end."""
        rows = self._ready().topics.select("topic_id", "centroid", "size").collect()
        if not 1 <= count < len(rows):
            raise TopicModelError("reduce to at least 1 and fewer topics than there are")
        middle = {r["topic_id"]: (np.array(r["centroid"]), r["size"]) for r in rows}
        target = {i: i for i in middle}
        while len(middle) > count:
            order = sorted(middle)
            _, a, b = min((float(np.linalg.norm(middle[x][0] - middle[y][0])), x, y) for i, x in enumerate(order) for y in order[i + 1 :])
            (u, m), (v, n) = middle[a], middle.pop(b)
            middle[a] = ((u * m + v * n) / (m + n), m + n)
            target = {i: a if t == b else t for i, t in target.items()}
        return self._rewritten({i: t for i, t in target.items() if i != t or list(target.values()).count(t) > 1})

    def _rewritten(self, target: dict[int, int]) -> TopicModel:
        if self.corpus is None:
            raise TopicModelError("a restored model has no corpus to compute keywords from")
        pairs = F.create_map(*[F.lit(x) for p in target.items() for x in p])
        labelled = self.assignment.withColumn("label", F.coalesce(F.try_element_at(pairs, F.col("topic_id")), "topic_id"))
        tokens = self.corpus.select("doc_id", tokenize("text", tokenizer_config(self.config)).alias("tokens"))
        changed = sorted(set(target.values()))
        new = topic_table(represent(tokens, labelled, self.config), labelled, self.corpus, None, self.dimension).where(F.col("topic_id").isin(changed))
        topics = checkpointed(self.topics.where(~F.col("topic_id").isin(sorted(set(target) | set(changed)))).unionByName(new))
        result = checkpointed(assign.document_topics(self.corpus, labelled.select("doc_id", "label", "probability"), topics).join(self.assignment.select("doc_id", "outlier_score"), "doc_id"))
        return replace(self, topics=topics, assignment=result)

    # persistence

    def export_json(self) -> str:
        """The state as JSON: configuration, topics and assignment. For models of a size that the driver holds; save() has no such limit."""
        rows = lambda t: [json.loads(x) for x in t.toJSON().collect()]
        return json.dumps({"version": VERSION, "dimension": self._ready().dimension, "config": asdict(self.config), "topics": rows(self.topics), "assignment": rows(self.assignment)})

    @classmethod
    def restore_json(cls, spark: SparkSession, text: str) -> TopicModel:
        state = migrate(json.loads(text))
        problems = validate_state(state)
        if problems:
            raise TopicModelError("; ".join(problems))

        def table(name: str, schema: str) -> DataFrame:
            lines = spark.createDataFrame([(json.dumps(x),) for x in state[name]], "value string")
            return lines.select(F.from_json("value", schema).alias("r")).select("r.*")

        topics = table("topics", "topic_id int, keywords array<struct<term: string, score: double, frequency: bigint>>, size long, coherence double, representative_docs array<long>, centroid array<double>")
        found = table("assignment", "doc_id long, topic_id int, probability double, distance double, outlier_score double")
        return cls(config_from(state["config"]), topics, found, None, None, state["dimension"])

    def save(self, path: str) -> None:
        """Topics, assignment and configuration; neither texts nor embeddings."""
        spark = self._ready().topics.sparkSession
        store = ParquetStorage(spark, path)
        store.save_table("topics", self.topics)
        store.save_table("assignment", self.assignment)
        store.save_json("model", {"version": VERSION, "dimension": self.dimension, "config": asdict(self.config)})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TopicModel:
        store = ParquetStorage(spark, path)
        state = migrate(store.load_json("model"))
        return cls(config_from(state["config"]), store.load_table("topics"), store.load_table("assignment"), None, None, state["dimension"])


def migrate(state: dict | None) -> dict:
    """State of this version; an error if it is absent or of a later one."""
    if not state or not {"version", "dimension", "config"} <= set(state):
        raise TopicModelError("no model state")
    if state["version"] > VERSION:
        raise TopicModelError(f"state of version {state['version']}, newer than {VERSION}")
    return {**state, "version": VERSION}


def validate_state(state: dict) -> list[str]:
    """What is wrong with an exported state."""
    problems = [f"{k} is missing" for k in ("version", "dimension", "config", "topics", "assignment") if k not in state]
    if problems:
        return problems
    ids = [t.get("topic_id") for t in state["topics"]]
    if len(set(ids)) != len(ids) or any(i is None or i < 0 for i in ids):
        problems.append("topic ids repeat, or are below 0")
    if any(len(t.get("centroid") or []) != state["dimension"] for t in state["topics"]):
        problems.append("a centroid is of another dimension")
    if any(t.get("size", 0) < 1 for t in state["topics"]):
        problems.append("a topic is empty")
    if any(a.get("topic_id", -1) not in {-1, *ids} for a in state["assignment"]):
        problems.append("a document is of an unknown topic")
    return problems


def config_from(value: dict) -> TopicModelConfig:
    from .config import ClusteringConfig, ReductionConfig, RepresentationConfig

    c = value["coherence"]
    return TopicModelConfig(ReductionConfig(**value["reduction"]), ClusteringConfig(**value["clustering"]), RepresentationConfig(**value["representation"]), coherence.CoherenceConfig(**c) if c else None, value["seed"])


def discover_topics(docs: DataFrame, config: TopicModelConfig | None = None) -> TopicModel:
    return TopicModel(config or TopicModelConfig()).fit(docs)
