"""Exact top-k search (BM25) by block-at-a-time pruning.

Documents in order of doc_id form blocks of ``block_docs`` rows, each stored with the largest term
score of every query term in it and a forward index (terms and counts by document). Per query,
blocks are ordered by the sum of their maxima, an upper bound of all scores within: the most
promising ones of every query are scored first, and their k-th score is what the bound of any other
block has to reach. Those blocks are scored in order of their bounds, with the k-th score of the
task rising on the way. No document that belongs to a result is left out.

score(d, q) = sum over the distinct words t of q of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf / (tf + k1 * (1 - b + b * len / avglen))

N and the average length are of the documents that have words. Scores are rounded to 6 places before
ranking; ties go to the smaller doc_id. Defined results: null and empty texts, and documents without
a word of the query, aren't results; queries that are null or without words have none; rows with
null ids are left out; very long texts count whole; of empty tables the result is empty; a doc_id or query id that repeats counts row by row for documents (each is a
candidate) and once for queries with equal text; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import binary_rows, lookup, owners, ragged, slices, word_hashes
from .shared import Stored, stored, tree_sum

_OUT = "query_id long, rank int, doc_id long, score double"
K1, B = 1.2, 0.75


def _vector(stats: np.ndarray, terms: np.ndarray) -> tuple[float, np.ndarray]:
    """Average length, and idf by term code (0 is no term)."""
    n, total = stats[-2], stats[-1]
    df = stats[:-2].astype(float)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    idf[0] = 0
    return total / max(n, 1), idf


def _impact(idf: np.ndarray, average: float) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The score of a term with a count in a document of a length."""
    return lambda term, tf, length: idf[term] * (tf / (tf + K1 * (1 - B + B * length / average)))


def top_documents(docs: DataFrame, queries: DataFrame, *, k: int = 10, block_docs: int = 256, first_blocks: int = 2, queries_at_once: int = 2_000) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents of every query (columns query_id, text).

    The corpus is indexed once, for the words of all queries; ``queries_at_once`` of these are then asked at a time.
    """
    spark = docs.sparkSession
    rows = sorted({(r[0], r[1]) for r in queries.where("query_id IS NOT NULL AND text IS NOT NULL").select(F.col("query_id").cast("long"), "text").collect()})
    words, first = word_hashes(pa.array([t for _, t in rows], pa.string()))
    index = _build(docs, np.unique(words), block_docs) if len(words) else None
    if index is None:
        return spark.createDataFrame([], _OUT)
    code = np.searchsorted(index.vocabulary, words) + 1
    asked = [(r[0], np.unique(code[first[i] : first[i + 1]])) for i, r in enumerate(rows) if first[i + 1] > first[i]]
    out = None
    for i in range(0, len(asked), queries_at_once):
        part = _search(spark, index, asked[i : i + queries_at_once], k, first_blocks)
        out = part if out is None else out.union(part)
    index.blocks.drop()
    return out


@dataclass
class Index:
    """Blocks of documents with the largest score of each term, and what scores need of the corpus."""

    vocabulary: np.ndarray
    average: float
    idf: np.ndarray
    blocks: Stored


def _build(docs: DataFrame, vocabulary: np.ndarray, block_docs: int) -> Index | None:
    m = len(vocabulary) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text"):
            words, first = word_hashes(s.column("text"))
            c = lookup(vocabulary, np.arange(1, m, dtype=np.uint32), words)
            hit = np.flatnonzero(c)
            keys, tf = np.unique(owners(first)[hit] * m + c[hit], return_counts=True)
            bounds = np.searchsorted(keys // m, np.arange(s.num_rows + 1))
            length = np.diff(first)
            b = pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(length.astype(np.int32)), binary_rows((keys % m).astype(np.uint32), bounds), binary_rows(tf.astype(np.uint32), bounds)], ["doc_id", "length", "terms", "tf"])
            yield b.filter(pa.array(length > 0))

    named = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = stored(named.mapInArrow(count, "doc_id long, length int, terms binary, tf binary"), "counts")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(m + 2, np.int64)
        for b in batches:
            total[:m] += np.bincount(ragged(b.column("terms"), np.uint32)[0], minlength=m)
            total[m] += b.num_rows
            total[m + 1] += b.column("length").to_numpy().sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    stats = tree_sum(table.df.select("length", "terms").mapInArrow(sums, "sums binary"), "i8")
    if stats is None or not stats[m]:
        table.drop()
        return None
    average, idf = _vector(stats, vocabulary)

    impact = _impact(idf, average)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, nth, held, n = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            term, bounds = ragged(b.column("terms"), np.uint32)
            tf, length = ragged(b.column("tf"), np.uint32)[0], b.column("length").to_numpy()
            most = np.zeros(m)
            np.maximum.at(most, term, impact(term, tf, length[owners(bounds)]))
            present = np.flatnonzero(most).astype(np.uint32)
            arrays = [present, most[present], b.column("doc_id").to_numpy(), length, bounds.astype(np.int32), term, tf]
            return pa.RecordBatch.from_arrays([pa.array([(pid << 32) + nth]), *(pa.array([np.ascontiguousarray(x).tobytes()]) for x in arrays)], ["block", "present", "most", "doc_ids", "length", "bounds", "terms", "tf"])

        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, block_docs - n))
                b, n = b.slice(block_docs - n), n + held[-1].num_rows
                if n == block_docs:
                    yield close()
                    nth, held, n = nth + 1, [], 0
        if n:
            yield close()

    ranged = table.df.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "length")
    blocks = stored(ranged.mapInArrow(block, "block long, present binary, most binary, doc_ids binary, length binary, bounds binary, terms binary, tf binary"), "blocks")
    table.drop()
    return Index(vocabulary, average, idf, blocks)


def _search(spark: SparkSession, index: Index, asked: list[tuple[int, np.ndarray]], k: int, first_blocks: int) -> DataFrame:
    blocks, m, average, idf = index.blocks, len(index.vocabulary) + 1, index.average, index.idf
    ids, terms = np.array([q for q, _ in asked]), [t for _, t in asked]
    flat, start = np.concatenate(terms), np.concatenate([[0], np.cumsum([len(t) for t in terms])[:-1]])

    impact = _impact(idf, average)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, present, most in zip(*(b.column(c).to_pylist() for c in ("block", "present", "most")), strict=True):
                dense = np.zeros(m)
                dense[np.frombuffer(present, np.uint32)] = np.frombuffer(most)
                total = np.add.reduceat(dense[flat], start)
                q = np.flatnonzero(total > 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), x)), pa.array(q.astype(np.int32)), pa.array(total[q])], ["block", "q", "bound"])

    bounds = stored(blocks.df.select("block", "present", "most").mapInArrow(bound, "block long, q int, bound double"), "bounds")

    def scored(pairs: DataFrame) -> DataFrame:
        """(q, doc_id, score) of the best k of each task, for pairs (block, q, bound, least)."""
        asked = pairs.groupBy("block").agg(F.collect_list(F.struct("q", "bound", "least")).alias("asked"), F.max("bound").alias("top"))
        both = asked.join(blocks.df.drop("present", "most"), "block").sortWithinPartitions(F.desc("top"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for b in batches:
                for r in b.to_pylist():
                    term, length = np.frombuffer(r["terms"], np.uint32), np.frombuffer(r["length"], np.int32)
                    limits = np.frombuffer(r["bounds"], np.int32)
                    docs_ = np.frombuffer(r["doc_ids"], np.int64)
                    row = owners(limits)
                    value = impact(term, np.frombuffer(r["tf"], np.uint32), length[row])
                    order = np.argsort(term, kind="stable")
                    by_term, by_row, by_value = term[order], row[order], value[order]
                    begin = np.searchsorted(by_term, np.arange(m + 1))
                    for a in r["asked"]:
                        q = a["q"]
                        known = best.get(q)
                        least = a["least"] if a["least"] is not None else -1.0
                        if known is not None and len(known[0]) == k:
                            least = max(least, known[0][-1])
                        if a["bound"] < least - 2e-6:
                            continue
                        t = terms[q]
                        n = begin[t + 1] - begin[t]
                        at = np.repeat(begin[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        total = np.round(np.bincount(by_row[at], by_value[at], len(docs_)), 6)
                        hit = np.flatnonzero((total > 0) & (total >= least - 1e-6))
                        if not len(hit):
                            continue
                        s, d = total[hit], docs_[hit]
                        if known is not None:
                            s, d = np.concatenate([known[0], s]), np.concatenate([known[1], d])
                        keep = np.lexsort((d, -s))[:k]
                        best[q] = (s[keep], d[keep])
            if best:
                n = [len(s) for s, _ in best.values()]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(best), np.int32), n)), pa.array(np.concatenate([d for _, d in best.values()])), pa.array(np.concatenate([s for s, _ in best.values()]))], ["q", "doc_id", "score"])

        return both.mapInArrow(run, "q int, doc_id long, score double")

    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    leading = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    seeds = stored(bounds.df.withColumn("nth", F.row_number().over(leading)).where(F.col("nth") <= first_blocks).select("block", "q", "bound", F.lit(None).cast("double").alias("least")), "seeds")
    start_hits = stored(scored(seeds.df), "hits")
    kth = start_hits.df.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select("q", F.col("score").alias("least"))
    rest = bounds.df.join(seeds.df.select("block", "q"), ["block", "q"], "left_anti").join(kth, "q", "left").where("least IS NULL OR bound >= least - 2e-6").select("block", "q", "bound", "least")
    hits = stored(start_hits.df.union(scored(rest)), "hits")
    for t in (bounds, seeds, start_hits):
        t.drop()
    names = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "q int, query_id long")
    best = hits.df.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.join(names, "q").select("query_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x80-\x{10FFFF}]+') AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), q AS (
  SELECT DISTINCT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9\x80-\x{10FFFF}]+'))) AS term FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), s AS (
  SELECT count(*) AS n, avg(len(words)) AS average FROM d WHERE len(words) > 0
), t AS (
  SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM d) GROUP BY doc_id, term
), f AS (
  SELECT term, count(*) AS df FROM t GROUP BY term
), r AS (
  SELECT query_id, doc_id, round(sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * t.n / average))), 6) AS score
  FROM q JOIN t USING (term) JOIN f USING (term) CROSS JOIN s GROUP BY query_id, doc_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS "rank", doc_id, score
FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10
"""
