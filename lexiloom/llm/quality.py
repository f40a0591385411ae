"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

A Gaussian kernel over standardised statistics of a text is approximated by cosines of random
projections; the normal equations of ridge regression are summed per partition and then over
partitions, and a monotone step function fitted to held-out labels turns scores into probabilities.

Defined results: labels that are null or whose document is missing don't train; several labels of
one document count as their mean. A null or empty text has null score and probability and isn't
kept. Very long texts count whole. Equal texts, in repeated rows too, have equal scores; each row has its
own result. Without usable labels every document with text is kept, with null score; of an empty
table the result is empty. Null doc_ids are passed on. Other columns of the tables are ignored by
``score`` and passed through unchanged by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import buffers, lower, owners, slices, span_hashes, to_batch, word_spans
from .shared import stored, tree_sum

N_STATS = 16
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("probability", pa.float64()), ("keep", pa.bool_())])


def statistics(text: pa.Array) -> np.ndarray:
    """One row of statistics for each text; all bytes and words of it count."""
    data, offsets = buffers(text)
    n = np.diff(offsets)
    per = lambda mask: np.diff(np.searchsorted(np.flatnonzero(mask), offsets))
    upper = per(data - np.uint8(65) < 26)
    small = per(data - np.uint8(97) < 26)
    digit = per(data - np.uint8(48) < 10)
    wide = per(data > 127)
    newline = per(data == 10)
    blank = per(data == 32)
    stops = per((data == 46) | (data == 44) | (data == 59) | (data == 58))
    symbols = n - upper - small - digit - wide - newline - blank - stops
    runs = np.zeros(len(data), bool)
    runs[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    heads = offsets[:-1][n > 0]  # a run lies within one text
    runs[heads] = False
    runs[heads[heads + 1 < len(data)] + 1] = False
    same = per(runs)

    folded, at = buffers(lower(text))
    starts, ends, first = word_spans(folded, at)
    words = np.diff(first)
    length = (ends - starts).astype(np.float64)
    total = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[first])
    row = owners(first)
    # the top bits hold the text, so that one sort finds the distinct words of each
    keys = np.sort((row.astype(np.uint64) << np.uint64(44)) | (span_hashes(folded, starts, ends) >> np.uint64(20)))
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    distinct = np.bincount((keys[fresh] >> np.uint64(44)).astype(np.int64), minlength=len(n))

    some, some_words = np.maximum(n, 1), np.maximum(words, 1)
    mean = total(length) / some_words
    spread = np.sqrt(np.maximum(total(length**2) / some_words - mean**2, 0))
    letters = np.maximum(upper + small + wide, 1)
    columns = [np.log1p(n), upper / letters, small / letters, wide / letters, digit / some, newline / some, blank / some, stops / some]
    columns += [symbols / some, np.sqrt(symbols / some), same / some, mean, spread, np.log1p(distinct) / np.maximum(np.log1p(words), 0.5), words / some, np.log1p(words / (newline + 1))]
    return np.stack(columns, axis=1)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    bias: float
    steps: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.sqrt(2 / len(self.phase)) * np.cos(x @ self.projection + self.phase)

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights + self.bias

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        return np.interp(scores, self.steps, self.levels)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the non-decreasing fit of y over x, at the distinct x."""
    at, back = np.unique(x, return_inverse=True)
    weight = np.bincount(back).astype(float)
    blocks: list[list[float]] = []
    for value, w in zip(np.bincount(back, y) / weight, weight, strict=True):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w1, c = blocks.pop()
            u = blocks[-1]
            blocks[-1] = [(u[0] * u[1] + v * w1) / (u[1] + w1), u[1] + w1, u[2] + c]
    return at, np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _sum_equations(table: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float]:
    """Sums over rows of z z', z y, y, z and 1; by partition, then in groups of partitions, then here."""
    d = len(model.phase)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d + 1, d + 2))
        for f in frames:
            z = np.column_stack([model.features(np.stack(f["stats"].to_list())), np.ones(len(f))])
            total += z.T @ np.column_stack([z, f["y"].to_numpy()])
        yield pd.DataFrame({"sums": [total.tobytes()]})

    total = tree_sum(table.mapInPandas(partial, "sums binary")).reshape(d + 1, d + 2)
    return total[:d, :d], total[:d, d + 1], float(total[d, d + 1]), total[:d, d], float(total[d, d])


def fit(docs: DataFrame, labels: DataFrame, *, features: int = 256, ridge: float = 1e-2, gamma: float = 0.05, max_train_rows: int = 20_000, seed: int = 7) -> QualityModel | None:
    """Train on the labelled documents, of which at most ``max_train_rows`` (by hash of doc_id) are used; a fifth calibrates."""
    sample = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    sample = sample.withColumn("order", F.xxhash64("doc_id", F.lit(seed))).orderBy("order", "doc_id").limit(max_train_rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = pa.FixedSizeListArray.from_arrays(pa.array(statistics(b.column("text")).ravel()), N_STATS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([rows, b.column("y"), b.column("held")], ["stats", "y", "held"])

    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND text != ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the sample's size is bounded by a parameter, so that it may be sent to all executors
    rows = known.join(F.broadcast(sample), "doc_id").select("text", "y", (F.pmod("order", F.lit(5)) == 0).alias("held"))
    table = stored(rows.mapInArrow(measure, "stats array<double>, y double, held boolean"), "quality")
    try:
        moments = table.df.where("NOT held").select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
        if not moments:
            return None
        rng = np.random.default_rng(seed)
        projection = rng.normal(0, np.sqrt(2 * gamma), (N_STATS, features))
        scale = np.array([max(r["s"], 1e-3) for r in moments])
        model = QualityModel(np.array([r["m"] for r in moments]), scale, projection, rng.uniform(0, 2 * np.pi, features), np.zeros(features), 0.0, np.zeros(1), np.zeros(1))
        zz, zy, y, z, n = _sum_equations(table.df.where("NOT held"), model)
        centred = zz - np.outer(z, z) / n + ridge * n / features * np.eye(features)
        model.weights = np.linalg.solve(centred, zy - z * y / n)
        model.bias = (y - z @ model.weights) / n
        held = table.df.where("held").select("stats", "y").toPandas()  # a fifth of max_train_rows at most
        if len(held):
            s = model.scores(np.stack(held["stats"].to_list()))
            model.steps, model.levels = isotonic(np.round(s, 6), held["y"].to_numpy())
        else:
            model.steps, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    finally:
        table.drop()


def _judge(text: pa.Array, model: QualityModel | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.diff(buffers(text)[1])
    if model is None:
        return np.full(len(n), np.nan), np.full(len(n), np.nan), n > 0
    s = np.where(n > 0, np.round(model.scores(statistics(text)), 9), np.nan)  # alike for equal texts, whatever the batch
    p = model.probabilities(s)
    return s, np.where(n > 0, p, np.nan), (n > 0) & (p >= least)


def score(docs: DataFrame, model: QualityModel | None, *, least: float = 0.5) -> DataFrame:
    """doc_id, score, probability, keep for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s, p, k = _judge(b.column("text"), model, least)
            yield to_batch(_SCORES, b.column("doc_id"), pa.array(s, from_pandas=True), pa.array(p, from_pandas=True), k)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, probability double, keep boolean")


def keep_good(docs: DataFrame, model: QualityModel | None, *, least: float = 0.5) -> DataFrame:
    """The rows that score() keeps, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield b.filter(pa.array(_judge(b.column("text"), model, least)[2]))

    return docs.mapInArrow(run, docs.schema)
