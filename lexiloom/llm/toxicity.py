"""Toxicity: cumulative-link ordinal regression on sparse word features.

The labels tell toxic from not, so that only p_toxic is supervised. The grade of a toxic training
document, 1 to 3, is made from its text: by how many occurrences it has of the words that the labels
mark as toxic, cut at the thirds of the toxic training documents. Grades are thus an order of
severity by such words, which no label confirms. Features are log(1 + count) of all words of the
labelled sample whose log-likelihood ratio tells the labels apart beyond chance (``least_gain``), in at
least ``least_documents`` of its documents. One weight vector serves all thresholds:

    P(grade <= k) = 1 / (1 + exp(w x - t_k)),   t_0 < t_1 < t_2

Reported are the expected grade, the likeliest one, the probability of any toxicity, and whether
that reaches ``least``. Defined results: null labels don't train; several labels of one document
count as the highest; texts that are null or without words have severity 0 and aren't toxic; very long
texts count whole; of equally likely grades the lowest is reported; each row has its result, repeated
rows alike; without labels of both kinds all severities are null, and of an empty table the result is
empty. Null doc_ids are passed on. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import lookup, owners, slices, word_hashes
from .shared import stored

GRADES = 3
_OUT = "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean"


def _counts(text: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of the words of a sorted vocabulary."""
    words, first = word_hashes(text)
    code = lookup(vocabulary, np.arange(1, len(vocabulary) + 1), words)
    hit = np.flatnonzero(code)
    keys, n = np.unique(owners(first)[hit] * len(vocabulary) + code[hit] - 1, return_counts=True)
    return keys // max(len(vocabulary), 1), keys % max(len(vocabulary), 1), n


@dataclass
class Severity:
    vocabulary: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def grades(self, text: pa.Array) -> np.ndarray:
        """Probabilities of the grades 0 to 3, by text."""
        row, feature, n = _counts(text, self.vocabulary)
        return grade_probabilities(np.bincount(row, self.weights[feature] * np.log1p(n), len(text)), self.cuts)


def grade_probabilities(score: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    below = 1 / (1 + np.exp(np.clip(score[:, None] - cuts[None, :], -500, 500)))
    return np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1), axis=1)


def fit_ordinal(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int, *, penalty: float = 0.5, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised negative log-likelihood, by Adam over all rows."""
    n = len(grade)
    w = np.zeros(n_features)
    share = np.clip(np.array([(grade <= k).mean() for k in range(GRADES)]), 1e-3, 1 - 1e-3)
    logit = np.log(share / (1 - share))
    free = np.concatenate([[logit[0]], np.log(np.maximum(np.diff(logit), 0.05))])
    m, v = np.zeros(n_features + GRADES), np.zeros(n_features + GRADES)
    for t in range(1, rounds + 1):
        steps = np.exp(free[1:])
        cuts = free[0] + np.concatenate([[0], np.cumsum(steps)])
        s = np.bincount(row, w[feature] * value, n)
        padded = np.concatenate([[-np.inf], cuts, [np.inf]])
        hi, lo = padded[grade + 1] - s, padded[grade] - s
        sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
        a, b = sig(hi), sig(lo)
        p = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a) / p, b * (1 - b) / p  # of log p by hi, and less by lo
        gs = da - db  # of -log p by s
        gw = np.bincount(feature, gs[row] * value, n_features) + penalty * w
        gc = np.array([-(da[grade == k].sum() - db[grade == k + 1].sum()) for k in range(GRADES)])
        tail = np.cumsum(gc[::-1])[::-1]
        g = np.concatenate([gw, [tail[0]], tail[1:] * steps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * min(1.0, 4 * (1 - t / (rounds + 1))) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, free = w - step[:n_features], free - step[n_features:]
    return w, free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])


def fit(docs: DataFrame, labels: DataFrame, *, least_gain: float = 6.0, least_documents: int = 4, max_train_rows: int = 30_000, seed: int = 9) -> Severity | None:
    """Train on at most ``max_train_rows`` labelled documents (by hash of doc_id)."""
    sample = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    sample = sample.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_train_rows)
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the sample's size is bounded by a parameter, so that it may be sent to all executors
    table = stored(known.join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text"), "labelled")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text"):
            words, first = word_hashes(s.column("text"))
            y = np.array(s.column("y").to_pylist())
            row = owners(first)
            order = np.lexsort((words, row))
            w, r = words[order], row[order]
            fresh = np.concatenate([[True], (w[1:] != w[:-1]) | (r[1:] != r[:-1])])[: len(w)]
            yield pa.RecordBatch.from_arrays([pa.array(w[fresh].view(np.int64)), pa.array(y[r[fresh]], pa.int32())], ["word", "y"])

    try:
        sizes = {r["y"]: r["n"] for r in table.df.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if len(sizes) < 2:
            return None
        n0, n1 = float(sizes[0]), float(sizes[1])
        df = table.df.select("y", "text").mapInArrow(words_of, "word long, y int").groupBy("word").agg(F.sum("y").alias("a"), F.count("*").alias("n")).where(F.col("n") >= least_documents)
        a, b = F.col("a"), F.col("n") - F.col("a")
        part = lambda x, of, total: F.when(x > 0, x * F.log(x / (of * total))).otherwise(0.0)
        gain = part(a, F.col("n"), F.lit(n1 / (n0 + n1))) + part(b, F.col("n"), F.lit(n0 / (n0 + n1)))
        # words of the bounded sample, some thousands
        best = df.withColumn("gain", gain).where(F.col("gain") > least_gain).orderBy("word").collect()
        if not best:
            return None
        words = np.array([r["word"] for r in best], np.int64).view(np.uint64)
        toxic = np.array([r["a"] / r["n"] > 0.8 for r in best])
        order = np.argsort(words)
        vocabulary, toxic = words[order], toxic[order]

        def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in slices(batches, "text"):
                row, feature, n = _counts(s.column("text"), vocabulary)
                cut = np.searchsorted(row, np.arange(s.num_rows + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int32())) for x in (feature, n)]
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("y"), *lists], ["doc_id", "y", "feature", "n"])

        # sparse rows of the bounded sample
        rows = table.df.mapInArrow(features_of, "doc_id long, y int, feature array<int>, n array<int>").toArrow().sort_by("doc_id")
    finally:
        table.drop()
    y = rows["y"].to_numpy()
    feature = rows["feature"].combine_chunks().flatten().to_numpy()
    n = rows["n"].combine_chunks().flatten().to_numpy()
    row = np.repeat(np.arange(len(y)), [len(x) for x in rows["feature"]])
    seen = np.bincount(row, n * toxic[feature], len(y))
    thirds = np.quantile(seen[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + (seen[:, None] > thirds[None, :]).sum(axis=1), 0)
    weights, cuts = fit_ordinal(row, feature, np.log1p(n), grade, len(vocabulary))
    return Severity(vocabulary, weights, cuts)


def severity(docs: DataFrame, model: Severity | None, *, least: float = 0.5) -> DataFrame:
    """doc_id, expected_severity, grade, p_toxic, toxic of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text"):
            if model is None:
                values = [pa.nulls(s.num_rows, pa.float64()), pa.nulls(s.num_rows, pa.int32()), pa.nulls(s.num_rows, pa.float64()), pa.nulls(s.num_rows, pa.bool_())]
            else:
                p = model.grades(s.column("text"))
                empty = np.diff(word_hashes(s.column("text"))[1]) == 0
                p[empty] = [1] + [0] * GRADES
                values = [pa.array(p @ np.arange(GRADES + 1)), pa.array(p.argmax(axis=1), pa.int32()), pa.array(1 - p[:, 0]), pa.array(1 - p[:, 0] >= least)]
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), *values], ["doc_id", "expected_severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OUT)
