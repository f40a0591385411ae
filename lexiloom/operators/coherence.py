"""Co-occurrence, NPMI coherence, and diversity of topic keywords."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed


@dataclass(frozen=True)
class CoherenceConfig:
    window: int = 10
    sliding: bool = True
    top_keywords: int = 10
    epsilon: float = 1e-12

    @classmethod
    def document(cls) -> CoherenceConfig:
        return cls(sliding=False)

    @classmethod
    def semantic(cls) -> CoherenceConfig:
        return cls(window=50)

    @classmethod
    def concise(cls) -> CoherenceConfig:
        return cls(top_keywords=5)


def windows(tokens: DataFrame, config: CoherenceConfig = CoherenceConfig()) -> DataFrame:
    """(words): the distinct words of each window; of a document with n > 0 tokens there are max(1, n - width + 1), or one."""
    some = tokens.where(F.size("tokens") > 0)
    if not config.sliding:
        return some.select(F.array_distinct("tokens").alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("tokens") - config.window, F.lit(0)))
    return some.select(F.explode(F.transform(starts, lambda i: F.array_distinct(F.slice("tokens", i + 1, config.window)))).alias("words"))


def window_total(tokens: DataFrame, config: CoherenceConfig = CoherenceConfig()) -> DataFrame:
    """One row (total): the number of windows."""
    n = F.size("tokens")
    return tokens.agg(F.coalesce(F.sum(F.when(n > 0, F.greatest(n - config.window + 1, F.lit(1)) if config.sliding else F.lit(1)).cast("long")), F.lit(0)).alias("total"))


def _hits(tokens: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(key, term, pos, last): where the asked terms are, and where the document's last full window begins at a width of one."""
    each = tokens.select(key, F.size("tokens").alias("last"), F.posexplode("tokens").alias("pos", "term"))
    return each.join(terms.select("term").distinct(), "term").select(key, "term", "pos", "last")


def cooccurrence(tokens: DataFrame, terms: DataFrame, config: CoherenceConfig = CoherenceConfig(), key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """word counts (term, n), pair counts (a, b, n) with a < b, and the number of windows (total), for given terms.

    Windows aren't formed: a term at p lies in the windows that begin at p - width + 1 to p, two terms in
    those that both lie in, and how many windows hold any of these is the length of a union of such
    intervals. Only occurrences of given terms are shuffled. Each row has a key of its own.
    """
    total = window_total(tokens, config)
    if not config.sliding:
        found = _hits(tokens, terms, key).select(key, "term").distinct()
        words = found.groupBy("term").agg(F.count("*").alias("n"))
        sets = found.groupBy(key).agg(F.sort_array(F.collect_list("term")).alias("words"))
        tails = F.flatten(F.transform("words", lambda x, i: F.transform(F.slice("words", i + 2, F.size("words")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
        pairs = sets.where(F.size("words") > 1).select(F.explode(tails).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
        return words, pairs, total
    width = config.window
    # one shuffle by document serves all windows below
    hits = checkpointed(_hits(tokens, terms, key)).repartition(key)
    hits = hits.withColumn("last", F.greatest(F.col("last") - width, F.lit(0)))
    begin = lambda p: F.greatest(F.col(p) - (width - 1), F.lit(0))
    end = lambda p: F.least(F.col(p), F.col("last"))
    single = hits.select(key, "term", begin("pos").alias("lo"), end("pos").alias("hi"))
    words = _covered(single, [key, "term"]).groupBy("term").agg(F.sum("gain").alias("n"))
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(1, max(width - 1, 1))
    ahead = hits.withColumn("o", F.collect_list(F.struct(F.col("pos").alias("q"), F.col("term").alias("other"))).over(order))
    ahead = ahead.select(key, "term", "pos", "last", F.explode("o").alias("o")).select(key, "term", "pos", "last", "o.q", "o.other")
    near = ahead.where((F.col("q") - F.col("pos") < width) & (F.col("term") != F.col("other")))
    both = near.select(key, F.least("term", "other").alias("a"), F.greatest("term", "other").alias("b"), begin("q").alias("lo"), end("pos").alias("hi"))
    pairs = _covered(both, [key, "a", "b"]).groupBy("a", "b").agg(F.sum("gain").alias("n"))
    return words, pairs, total


def _covered(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Intervals lo to hi with gain: how many of its places those before it don't hold."""
    before = F.max("hi").over(Window.partitionBy(*by).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    gain = F.col("hi") - F.greatest(F.col("lo"), F.coalesce(before + 1, F.col("lo"))) + 1
    return intervals.select(*by, F.greatest(gain, F.lit(0)).cast("long").alias("gain"))


def npmi_pairs(pairs_asked: DataFrame, words: DataFrame, pairs: DataFrame, total: DataFrame, epsilon: float = 1e-12) -> DataFrame:
    """The asked pairs (columns word1, word2 and others) with npmi; null where a word never occurs, or both are one."""
    e, t = F.lit(epsilon), F.col("total")
    x, y = F.least("word1", "word2"), F.greatest("word1", "word2")
    j = pairs_asked.withColumn("__a", x).withColumn("__b", y)
    j = j.join(words.select(F.col("term").alias("__a"), F.col("n").alias("__na")), "__a", "left")
    j = j.join(words.select(F.col("term").alias("__b"), F.col("n").alias("__nb")), "__b", "left")
    j = j.join(pairs.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("n").alias("__nab")), ["__a", "__b"], "left").crossJoin(F.broadcast(total))
    p = lambda n: (F.coalesce(n, F.lit(0)) + e) / (t + e)
    p12 = p(F.col("__nab"))
    pmi, base = F.log(p12 / (p(F.col("__na")) * p(F.col("__nb")))), -F.log(p12)
    value = F.when(base == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), pmi / base)))
    known = (t > 0) & (F.col("word1") != F.col("word2")) & F.col("__na").isNotNull() & F.col("__nb").isNotNull()
    return j.select(*pairs_asked.columns, F.when(known, F.when(F.isnan(value), 0.0).otherwise(value)).alias("npmi"))


def keyword_pairs(keywords: DataFrame, topic: str = "topic_id") -> DataFrame:
    """(topic, word1, word2) of keywords (topic, term, rank), the better ranked first."""
    a = keywords.select(topic, F.col("term").alias("word1"), F.col("rank").alias("r1"))
    b = keywords.select(topic, F.col("term").alias("word2"), F.col("rank").alias("r2"))
    return a.join(b, topic).where("r1 < r2").select(topic, "word1", "word2")


def topic_coherence(tokens: DataFrame, keywords: DataFrame, config: CoherenceConfig = CoherenceConfig(), counts: tuple[DataFrame, DataFrame, DataFrame] | None = None, topic: str = "topic_id") -> DataFrame:
    """(topic, coherence, pairs): the mean NPMI of the known keyword pairs of each topic, 0 of none."""
    top = keywords.where(F.col("rank") <= config.top_keywords)
    words, pairs, total = counts or cooccurrence(tokens, top, config)
    scored = npmi_pairs(keyword_pairs(top, topic), words, pairs, total, config.epsilon)
    means = scored.groupBy(topic).agg(F.avg("npmi").alias("c"), F.count("npmi").alias("n"))
    return top.select(topic).distinct().join(means, topic, "left").select(topic, F.coalesce("c", F.lit(0.0)).alias("coherence"), F.coalesce("n", F.lit(0)).alias("pairs"))


def coherence_summary(scores: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    c = F.col("coherence")
    return scores.agg(
        zero(F.avg(c)).alias("mean"),
        zero(F.median(c)).alias("median"),
        zero(F.min(c)).alias("min"),
        zero(F.max(c)).alias("max"),
        zero(F.stddev_pop(c)).alias("std"),
        F.count_if(c > 0).alias("positive"),
        zero(F.count_if(c > 0) / F.nullif(F.count("*"), F.lit(0))).alias("positive_ratio"),
    )


def by_coherence(scores: DataFrame, topic: str = "topic_id") -> DataFrame:
    return scores.orderBy(F.desc("coherence"), topic)


def low_coherence(scores: DataFrame, threshold: float = 0.0) -> DataFrame:
    return scores.where(F.col("coherence") < threshold)


def diversity(keywords: DataFrame, topic: str = "topic_id") -> DataFrame:
    """One row: unique and total keywords, diversity (1 of none) and mean redundancy."""
    r = redundancy(keywords, topic).agg(F.coalesce(F.avg("redundancy"), F.lit(0.0)).alias("mean_redundancy"))
    d = keywords.agg(F.count_distinct("term").alias("unique_keywords"), F.count("term").alias("total_keywords"))
    return d.crossJoin(r).select("unique_keywords", "total_keywords", F.coalesce(F.col("unique_keywords") / F.nullif("total_keywords", F.lit(0)), F.lit(1.0)).alias("diversity"), "mean_redundancy")


def redundancy(keywords: DataFrame, topic: str = "topic_id") -> DataFrame:
    """(topic, redundancy): the share of its keyword set that another topic has too."""
    own = keywords.select(topic, "term").distinct()
    shared = F.count("*").over(Window.partitionBy("term")) > 1
    return own.select(topic, shared.cast("int").alias("shared")).groupBy(topic).agg(F.avg("shared").alias("redundancy"))


def overlap(keywords: DataFrame, topic: str = "topic_id") -> DataFrame:
    """(i, j, overlap): the share of i's keywords that j has, for all pairs; 1 on the diagonal."""
    own = keywords.select(topic, "term").distinct()
    sizes = own.groupBy(topic).agg(F.count("*").alias("n"))
    common = own.toDF("i", "term").join(own.toDF("j", "term"), "term").groupBy("i", "j").agg(F.count("*").alias("common"))
    grid = sizes.toDF("i", "n").crossJoin(sizes.select(F.col(topic).alias("j")))
    return grid.join(common, ["i", "j"], "left").select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.coalesce("common", F.lit(0)) / F.col("n")).alias("overlap"))


def overlapping_pairs(overlaps: DataFrame, threshold: float = 0.5) -> DataFrame:
    pair = overlaps.where("i != j").groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("overlap").alias("overlap"))
    return pair.where(F.col("overlap") >= threshold)


def redundant_topics(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scores.where(F.col("redundancy") > threshold)


def quality(coherence: DataFrame, diverse: DataFrame) -> DataFrame:
    """One row: (mean NPMI + 1) / 2 times diversity."""
    mean = coherence.agg(F.coalesce(F.avg("coherence"), F.lit(0.0)).alias("mean_npmi"))
    return mean.crossJoin(diverse).select("mean_npmi", "diversity", ((F.col("mean_npmi") + 1) / 2 * F.col("diversity")).alias("quality"))
