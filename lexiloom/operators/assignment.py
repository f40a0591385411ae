"""Assignment of vectors to topics: three rules, soft membership, search and representatives.

Topic tables hold a row for each topic, so that their side of a join is small by its nature; it is
broadcast by Spark's own size rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_similarity, euclidean, literal
from .neighbours import knn_join

PLACES = 12


def _with_topics(points: DataFrame, topics: DataFrame, key: str, vector: str) -> DataFrame:
    """Points beside all topics in one array, so that each row is judged where it is."""
    one = topics.agg(F.sort_array(F.collect_list(F.struct("topic_id", "centroid"))).alias("__t"))
    return points.select(key, F.col(vector).cast("array<double>").alias("__v")).crossJoin(F.broadcast(one))


def _distances() -> Column:
    return F.transform("__t", lambda t: F.struct(t["topic_id"].alias("topic_id"), euclidean(F.col("__v"), t["centroid"]).alias("distance")))


def nearest_centroid(points: DataFrame, topics: DataFrame, *, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(key, topic_id, distance, probability): the nearest centroid, ties to the smaller id; probability 1 / (1 + d^2)."""
    best = F.array_min(F.transform(_distances(), lambda t: F.struct(F.round(t["distance"], PLACES).alias("distance"), t["topic_id"].alias("topic_id"))))
    near = _with_topics(points, topics, key, vector).select(key, best.alias("m")).where("m IS NOT NULL")
    return near.select(key, "m.topic_id", "m.distance", (1 / (1 + F.col("m.distance") ** 2)).alias("probability"))


def topic_probabilities(points: DataFrame, topics: DataFrame, *, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(key, topic_id, distance, probability) of every topic, normalised to 1 for each point."""
    w = F.transform("d", lambda t: 1 / (1 + t["distance"] ** 2))
    each = _with_topics(points, topics, key, vector).select(key, _distances().alias("d")).select(key, "d", F.aggregate(w, F.lit(0.0), lambda s, x: s + x).alias("s"))
    return each.select(key, F.explode("d").alias("t"), "s").select(key, "t.topic_id", "t.distance", (1 / (1 + F.col("t.distance") ** 2) / F.col("s")).alias("probability"))


soft_membership = topic_probabilities


def find_topics(points: DataFrame, topics: DataFrame, *, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(key, topic_id, probability, alternatives): the likeliest topic with the others in order."""
    w = F.transform("d", lambda t: F.struct((-1 / (1 + t["distance"] ** 2)).alias("minus"), t["topic_id"].alias("topic_id")))
    each = _with_topics(points, topics, key, vector).select(key, _distances().alias("d")).select(key, F.sort_array(w).alias("r"))
    each = each.select(key, "r", F.aggregate("r", F.lit(0.0), lambda s, t: s - t["minus"]).alias("s")).where(F.size("r") > 0)
    plain = F.transform("r", lambda t: F.struct(t["topic_id"].alias("topic_id"), (-t["minus"] / F.col("s")).alias("probability")))
    return each.select(key, plain.alias("all")).select(key, F.col("all")[0]["topic_id"].alias("topic_id"), F.col("all")[0]["probability"].alias("probability"), F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))).alias("alternatives"))


def cosine_assignment(points: DataFrame, topics: DataFrame, *, threshold: float = 0.3, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """The incremental rule: (key, topic_id, similarity, confidence); below the threshold an outlier, of confidence 0.

    Confidence is min(1, (best + margin) / 2), where the margin is over the second best, or the best itself if it is alone.
    """
    s = F.transform("__t", lambda t: F.struct((-F.round(cosine_similarity(F.col("__v"), t["centroid"]), PLACES)).alias("minus"), t["topic_id"].alias("topic_id")))
    both = _with_topics(points, topics, key, vector).select(key, F.sort_array(s).alias("r")).where(F.size("r") > 0)
    best = -F.col("r")[0]["minus"]
    second = F.when(F.size("r") > 1, -F.try_element_at("r", F.lit(2))["minus"])
    margin = F.coalesce(best - second, best)
    out = best < threshold
    confidence = F.when(out, 0.0).otherwise(F.least(F.lit(1.0), (best + margin) / 2))
    return both.select(key, F.when(out, -1).otherwise(F.col("r")[0]["topic_id"]).cast("int").alias("topic_id"), best.alias("similarity"), confidence.alias("confidence"))


def similarity_to(vector: list[float], column: Column | str = "embedding") -> Column:
    return cosine_similarity(F.col(column) if isinstance(column, str) else column, literal(vector))


def search(points: DataFrame, query: list[float], top_k: int = 10, *, key: str = "doc_id", vector: str = "embedding", places: int = 9) -> DataFrame:
    """(key, similarity) of the top_k points by cosine: one pass that keeps top_k rows a task."""
    s = F.round(similarity_to(query, vector), places)
    return points.where(F.col(vector).isNotNull()).select(key, s.alias("similarity")).orderBy(F.desc("similarity"), key).limit(top_k)


def search_all(queries: DataFrame, points: DataFrame, top_k: int = 10, *, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, similarity) of the top_k points by cosine of every query: blocks of queries against blocks of points."""
    near = knn_join(queries, points, top_k, key=key, vector=vector, metric="cosine")
    return near.select(F.col("src").alias("query_id"), "rank", F.col("dst").alias(key), (1 - F.col("dist")).alias("similarity"))


def representatives(points: DataFrame, topics: DataFrame, *, count: int = 3, key: str = "doc_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(topic_id, rank, key, distance): the members nearest to each topic's centroid."""
    d = F.round(euclidean(F.col(vector), F.col("centroid")), 9)
    j = points.join(topics.select(F.col("topic_id").alias(label), "centroid"), label).select(F.col(label).alias("topic_id"), key, d.alias("distance"))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id").orderBy("distance", key))).where(F.col("rank") <= count)


def document_topics(docs: DataFrame, assigned: DataFrame, topics: DataFrame, *, key: str = "doc_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(key, topic_id, probability, distance): distance to the own centroid, null for outliers."""
    j = docs.select(key, vector).join(assigned, key).join(topics.select(F.col("topic_id").alias(label), "centroid"), label, "left")
    return j.select(key, F.col(label).alias("topic_id"), "probability", euclidean(F.col(vector), F.col("centroid")).alias("distance"))
