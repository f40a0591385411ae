"""Topics of two models: matching, stable ids, and merging."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_similarity


def similarity_matrix(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id, similarity): cosine of the centroids of all pairs of topics (topic_id, centroid)."""
    a = old.select(F.col("topic_id").alias("old_id"), F.col("centroid").alias("__a"))
    b = new.select(F.col("topic_id").alias("new_id"), F.col("centroid").alias("__b"))
    return a.crossJoin(b).select("old_id", "new_id", F.round(cosine_similarity(F.col("__a"), F.col("__b")), 9).alias("similarity"))


def average_best_match(similarities: DataFrame) -> DataFrame:
    best = similarities.groupBy("old_id").agg(F.max("similarity").alias("best"))
    return best.agg(F.coalesce(F.avg("best"), F.lit(0.0)).alias("average_best_match"))


def merge_events(similarities: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(new_id, old_ids): old topics, two or more, whose best new topic is the same one."""
    best = similarities.groupBy("old_id").agg(F.max(F.struct("similarity", (-F.col("new_id")).alias("m"))).alias("b"))
    g = best.where(F.col("b.similarity") >= threshold).groupBy((-F.col("b.m")).alias("new_id")).agg(F.sort_array(F.collect_list("old_id")).alias("old_ids"))
    return g.where(F.size("old_ids") > 1)


def split_events(similarities: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(old_id, new_ids): new topics, two or more, whose best old topic is the same one."""
    swapped = similarities.select(F.col("new_id").alias("old_id"), F.col("old_id").alias("new_id"), "similarity")
    return merge_events(swapped, threshold).select(F.col("new_id").alias("old_id"), F.col("old_ids").alias("new_ids"))


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of least total cost (shortest augmenting paths); min(rows, columns) pairs of a rectangle, by row."""
    cost = np.asarray(cost, float)
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in hungarian(cost.T))
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for i in range(n):
        least, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col = i, -1
        while True:
            slack = cost[row] - u[row] - v
            shift = 0.0 if col < 0 else least[col]
            closer = ~done & (slack + shift < least)
            least[closer], back[closer] = (slack + shift)[closer], col
            col = int(np.where(done, np.inf, least).argmin())
            if owner[col] < 0:
                break
            done[col] = True
            row = int(owner[col])
        far = least[col]
        u[i] += far
        for j in np.flatnonzero(done):
            u[owner[j]] += far - least[j]
            v[j] -= far - least[j]
        while col >= 0:
            before = int(back[col])
            owner[col] = owner[before] if before >= 0 else i
            col = before
    return sorted((int(i), j) for j, i in enumerate(owner) if i >= 0)


def assignment_cost(cost: np.ndarray) -> tuple[list[tuple[int, int]], float]:
    pairs = hungarian(cost)
    return pairs, float(sum(np.asarray(cost)[i][j] for i, j in pairs))


@dataclass(frozen=True)
class MatchConfig:
    threshold: float = 0.7

    @classmethod
    def strict(cls) -> MatchConfig:
        return cls(0.85)

    @classmethod
    def lenient(cls) -> MatchConfig:
        return cls(0.5)


@dataclass
class Match:
    """mapping: new id to old id; merges: new id to its old ids; splits: old id to its new ids."""

    mapping: dict[int, int]
    new: list[int]
    retired: list[int]
    merges: dict[int, list[int]] = field(default_factory=dict)
    splits: dict[int, list[int]] = field(default_factory=dict)


def match_topics(old: DataFrame, new: DataFrame, config: MatchConfig = MatchConfig()) -> Match:
    """One-to-one matches of greatest total similarity, at least the threshold. Tables hold a row a topic."""
    s = similarity_matrix(old, new).cache()
    rows = s.collect()
    olds = sorted({r["topic_id"] for r in old.select("topic_id").collect()})
    news = sorted({r["topic_id"] for r in new.select("topic_id").collect()})
    value = {(r["old_id"], r["new_id"]): r["similarity"] for r in rows}
    cost = np.array([[1 - value[o, n] for n in news] for o in olds]).reshape(len(olds), len(news))
    mapping = {news[j]: olds[i] for i, j in hungarian(cost) if 1 - cost[i, j] >= config.threshold}
    merges = {r["new_id"]: list(r["old_ids"]) for r in merge_events(s, config.threshold).collect()}
    splits = {r["old_id"]: list(r["new_ids"]) for r in split_events(s, config.threshold).collect()}
    s.unpersist()
    kept = set(mapping.values()) | {o for m in merges.values() for o in m}
    return Match(mapping, [n for n in news if n not in mapping], [o for o in olds if o not in kept], merges, splits)


class TopicIds:
    """Ids that never repeat; -1 is no topic."""

    def __init__(self, following: int = 0) -> None:
        self.following = max(0, following)

    def fresh(self) -> int:
        self.following += 1
        return self.following - 1

    def reserve(self, used: list[int]) -> None:
        self.following = max([self.following, *(u + 1 for u in used)])

    def mapping(self, match: Match) -> tuple[dict[int, int], dict[int, int]]:
        """New ids to lasting ones; and old ids that are absorbed to the one that survives (the smallest of a merge)."""
        lasting = dict(match.mapping)
        absorbed: dict[int, int] = {}
        for n, olds in match.merges.items():
            survivor = min(olds)
            lasting[n] = survivor
            absorbed |= {o: survivor for o in olds if o != survivor}
        for n in match.new:
            if n not in lasting:
                lasting[n] = self.fresh()
        return lasting, absorbed


@dataclass(frozen=True)
class MergeConfig:
    centroids: str = "weighted_average"  # or "larger_cluster", "use_new"
    keywords: str = "union_reranked"  # or "existing_first", "use_new"
    keyword_count: int = 10


def union_reranked(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(topic_id, rank, term, score): keywords of either side with their larger score, ranked anew."""
    both = a.select("topic_id", "term", "score").union(b.select("topic_id", "term", "score")).groupBy("topic_id", "term").agg(F.max("score").alias("score"))
    return _ranked(both, F.desc("score"), k)


def existing_first(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Keywords of a, then those of b that it hasn't."""
    new = b.join(a.select("topic_id", "term"), ["topic_id", "term"], "left_anti")
    both = a.select("topic_id", "term", "score", F.lit(0).alias("side")).union(new.select("topic_id", "term", "score", F.lit(1)))
    return _ranked(both, [F.col("side"), F.desc("score")], k)


def _ranked(keywords: DataFrame, order: object, k: int) -> DataFrame:
    by = order if isinstance(order, list) else [order]
    w = Window.partitionBy("topic_id").orderBy(*by, "term")
    return keywords.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("topic_id", "rank", "term", "score")


def vocabulary_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("term").union(b.select("term")).distinct()


def merge_topic_tables(old: DataFrame, new: DataFrame, config: MergeConfig = MergeConfig()) -> DataFrame:
    """(topic_id, size, coherence, centroid, representative_docs) of two tables whose ids agree: sizes add up, means are weighted by size."""
    a, b = old.alias("a"), new.alias("b")
    j = a.join(b, F.col("a.topic_id") == F.col("b.topic_id"), "full_outer")
    n, m = F.coalesce("a.size", F.lit(0)), F.coalesce("b.size", F.lit(0))
    total = F.greatest(n + m, F.lit(1))
    if config.centroids == "weighted_average":
        mean = F.zip_with("a.centroid", "b.centroid", lambda x, y: (x * n + y * m) / total)
        centroid = F.coalesce(F.when(F.col("a.centroid").isNotNull() & F.col("b.centroid").isNotNull(), mean), "a.centroid", "b.centroid")
    else:
        new_first = F.lit(True) if config.centroids == "use_new" else m > n
        centroid = F.when(new_first, F.coalesce("b.centroid", "a.centroid")).otherwise(F.coalesce("a.centroid", "b.centroid"))
    coherence = F.coalesce((F.col("a.coherence") * n + F.col("b.coherence") * m) / total, "a.coherence", "b.coherence")
    none = F.array().cast("array<bigint>")
    docs = F.concat(F.coalesce("a.representative_docs", none), F.coalesce("b.representative_docs", none))
    return j.select(F.coalesce("a.topic_id", "b.topic_id").alias("topic_id"), (n + m).alias("size"), coherence.alias("coherence"), centroid.alias("centroid"), docs.alias("representative_docs"))


def folded(topics: DataFrame, absorbed: dict[int, int]) -> DataFrame:
    """Old topics with those that a merge absorbs added to the survivor."""
    if not absorbed:
        return topics
    pairs = F.create_map(*[F.lit(x) for p in absorbed.items() for x in p])
    t = topics.withColumn("topic_id", F.coalesce(F.try_element_at(pairs, F.col("topic_id")), "topic_id"))
    d = len(topics.select("centroid").first()[0])
    w = lambda c: F.sum(c * F.col("size")) / F.sum("size")
    return t.groupBy("topic_id").agg(F.sum("size").alias("size"), w(F.col("coherence")).alias("coherence"), F.array(*[w(F.col("centroid")[i]) for i in range(d)]).alias("centroid"), F.flatten(F.collect_list("representative_docs")).alias("representative_docs"))


def relabel(assignment: DataFrame, mapping: dict[int, int], label: str = "label") -> DataFrame:
    """Labels by a mapping; others stay."""
    if not mapping:
        return assignment
    pairs = F.create_map(*[F.lit(x) for p in mapping.items() for x in p])
    return assignment.withColumn(label, F.coalesce(F.try_element_at(pairs, F.col(label)), label))
