"""Vocabularies, term counts and class-based tf-idf."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TokenizerConfig, tokenize, trigram_similarity
from .lineage import checkpointed, numbered


def token_table(docs: DataFrame, text: str = "text", key: str = "doc_id", config: TokenizerConfig = TokenizerConfig(), *keep: str) -> DataFrame:
    """(key, kept columns, tokens)."""
    return docs.select(key, *keep, tokenize(text, config).alias("tokens"))


def term_frequencies(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, tf): the bags of words."""
    return tokens.select(key, F.explode("tokens").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


#: Tokens that a task of known_frequencies() counts, so that its memory doesn't grow with the table.
TOKENS = 2_000_000


def known_frequencies(tokens: DataFrame, max_df: float, key: str = "doc_id") -> DataFrame:
    """term_frequencies() of the terms in at most the share max_df of the rows (but one always).

    Rows are moved whole, by key, and counted where they are. The terms left out are few, at most the mean number
    of distinct terms of a row over max_df, so that these are broadcast, not the others joined.
    """
    n, total = tokens.agg(F.count("*"), F.sum(F.size("tokens"))).first()
    often = term_counts(tokens).where(F.col("df") > max(1, math.floor(n * max_df))).select("term")
    parts = max(tokens.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // TOKENS))
    counts = term_frequencies(tokens.select(key, "tokens").repartition(parts, key), key)
    return counts.join(F.broadcast(often), "term", "left_anti").select(key, "term", "tf")


def term_counts(tokens: DataFrame) -> DataFrame:
    """(term, df, tf): in how many rows a term is, and how often. Both are summed before the one shuffle, which is by term."""
    every = tokens.select(F.explode("tokens").alias("term"), F.lit(0).alias("d"), F.lit(1).alias("t"))
    once = tokens.select(F.explode(F.array_distinct("tokens")).alias("term"), F.lit(1).alias("d"), F.lit(0).alias("t"))
    return every.union(once).groupBy("term").agg(F.sum("d").alias("df"), F.sum("t").alias("tf"))


def vocabulary_terms(tokens: DataFrame, *, min_df: int = 1, max_df: float = 0.95, max_size: int | None = None, documents: int | None = None) -> DataFrame:
    """(term, df, tf) of terms in at least min_df documents, and at most the share max_df of them (but one always).

    A document is a row. Beyond max_size the terms of highest tf stay, ties in alphabetical order.
    """
    n = tokens.count() if documents is None else documents
    kept = term_counts(tokens).where(F.col("df").between(min_df, max(1, math.floor(n * max_df))))
    return kept if max_size is None else kept.orderBy(F.desc("tf"), "term").limit(max_size)


def vocabulary(tokens: DataFrame, **options: float) -> DataFrame:
    """vocabulary_terms() with term_index, which is alphabetical from 0."""
    return numbered(vocabulary_terms(tokens, **options), "term", "term_index").select("term", "term_index", "df", "tf")


def vocabulary_statistics(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count("*").alias("terms"), F.sum("tf").alias("occurrences"), F.avg("df").alias("mean_df"), F.max("tf").alias("max_tf"))


def terms_by_frequency(vocab: DataFrame) -> DataFrame:
    return vocab.orderBy(F.desc("tf"), "term")


def known_counts(tokens: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, term_index, tf): bags of known words."""
    return term_frequencies(tokens, key).join(vocab.select("term", "term_index"), "term").select(key, "term", "term_index", "tf")


def without_stop_words(terms: DataFrame, stop: DataFrame) -> DataFrame:
    return terms.join(stop, "term", "left_anti")


def ctfidf(tokens: DataFrame, vocab: DataFrame, *, label: str = "label", classes: int | None = None, min_score: float = 0.0) -> DataFrame:
    """(label, term, tf, raw, score) of each class and known term.

    raw = tf ln(1 + A / f): f counts the term in all classes, A is the mean number of tokens a class,
    unknown ones included, over ``classes`` (the non-empty ones, if not given). score is raw over the
    class's largest. Label -1 is no class.
    """
    own = tokens.where(F.col(label).cast("string") != "-1")
    sizes = own.groupBy(label).agg(F.sum(F.size("tokens")).alias("n"))
    average = sizes.agg((F.sum("n") / (F.lit(classes) if classes else F.count("*"))).alias("average"))
    counts = own.select(label, F.explode("tokens").alias("term")).groupBy(label, "term").agg(F.count("*").alias("tf")).join(vocab.select("term"), "term", "left_semi")
    # by term, of which there are at most as many rows as classes
    whole = F.sum("tf").over(Window.partitionBy("term"))
    raw = counts.withColumn("f", whole).crossJoin(F.broadcast(average)).select(label, "term", "tf", (F.col("tf") * F.log1p(F.col("average") / F.col("f"))).alias("raw"))
    # stored, as the largest of each class is asked for too
    raw = checkpointed(raw.where((F.col("raw") >= min_score) & (F.col("raw") > 0)))
    # a row a class, found with partial maxima
    top = raw.groupBy(label).agg(F.max("raw").alias("__top"))
    return raw.join(top, label).withColumn("score", F.col("raw") / F.col("__top")).drop("__top")


def rank_terms(scores: DataFrame, label: str = "label", places: int = 9) -> Column:
    """Order of terms within a class: by score, then alphabetically."""
    return F.row_number().over(Window.partitionBy(label).orderBy(F.desc(F.round("raw", places)), "term"))


def top_keywords(scores: DataFrame, k: int = 10, label: str = "label") -> DataFrame:
    """The k best terms of each class, with their rank from 1."""
    return scores.withColumn("rank", rank_terms(scores, label)).where(F.col("rank") <= k)


def keyword_arrays(ranked: DataFrame, label: str = "label") -> DataFrame:
    """(label, keywords): arrays of (term, score, frequency) in order."""
    items = F.sort_array(F.collect_list(F.struct("rank", "term", "score", F.col("tf").alias("frequency"))))
    return ranked.groupBy(label).agg(F.transform(items, lambda k: F.struct(k["term"].alias("term"), k["score"].alias("score"), k["frequency"].alias("frequency"))).alias("keywords"))


def diversified(keywords: DataFrame, weight: float = 0.3, key: str = "label") -> DataFrame:
    """Keywords reordered by maximal marginal relevance, as a fold over each array: (1 - w) score + w (1 - closest trigram similarity to those chosen)."""
    k = F.col("keywords")

    def value(item: Column, chosen: Column) -> Column:
        near = F.array_max(F.transform(chosen, lambda c: trigram_similarity(c["term"], item["term"])))
        return (1 - weight) * item["score"] + weight * (1 - F.coalesce(near, F.lit(0.0)))

    def step(acc: Column, i: Column) -> Column:
        left = F.filter(k, lambda x: ~F.exists(acc, lambda c: c["term"] == x["term"]))
        ranked = F.transform(left, lambda x: F.struct(value(x, acc).alias("value"), x.alias("item")))
        best = F.array_max(F.transform(ranked, lambda r: r["value"]))
        return F.concat(acc, F.slice(F.transform(F.filter(ranked, lambda r: r["value"] == best), lambda r: r["item"]), 1, 1))

    first = F.slice(k, 1, 1)
    order = F.when(F.size(k) < 2, k).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(k), F.lit(2))), first, step))
    return keywords.select(key, order.alias("keywords"))


def incremental_scores(counts: DataFrame, document_counts: DataFrame, documents: int, sizes: DataFrame, topic: str = "topic_id") -> DataFrame:
    """(topic, term, idf, score) of the append-only vocabulary: tf / topic size * ln(N / (df + 1)), which may be below 0.

    counts: (topic, term, tf); document_counts: (term, df); sizes: (topic, size).
    """
    idf = F.log(F.lit(float(documents)) / (F.col("df") + 1))
    return counts.join(document_counts, "term").join(sizes, topic).select(topic, "term", idf.alias("idf"), (F.col("tf") / F.col("size") * idf).alias("score"))


def assignment_statistics(assignment: DataFrame, label: str = "label") -> DataFrame:
    """One row: clusters, documents, outliers, rates and sizes; 0 where there is no cluster."""
    own = assignment.groupBy(label).agg(F.count("*").alias("n"))
    inside = F.when(F.col(label) != -1, F.col("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return own.agg(
        F.count(inside).alias("clusters"),
        zero(F.sum("n")).alias("documents"),
        zero(F.sum(F.when(F.col(label) == -1, F.col("n")))).alias("outliers"),
        zero(F.sum(inside)).alias("assigned"),
        zero(F.max(inside)).alias("max_size"),
        zero(F.min(inside)).alias("min_size"),
        F.coalesce(F.avg(inside), F.lit(0.0)).alias("avg_size"),
        F.coalesce(F.sum(F.when(F.col(label) == -1, F.col("n"))) / F.sum("n"), F.lit(0.0)).alias("outlier_rate"),
    )


def topic_sizes(assignment: DataFrame, label: str = "label") -> DataFrame:
    return assignment.where(F.col(label) != -1).groupBy(label).agg(F.count("*").alias("size"))
