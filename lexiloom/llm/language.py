"""Language identification with a string kernel.

Two texts are as similar as the share of byte n-grams (of 1 to 3 bytes of lower-cased text, hashed
to 2^15 places) that both contain: a blended-spectrum kernel on presence, normalised. Landmark texts
of every language give a Nyström approximation; kernel ridge regression, one language against the
rest, is solved from partition-summed products with the landmarks. A linear function of the kernel
values folds into one weight for each place and language, so that a batch of texts is scored by a
product of its presence matrix with the weights. The training sample is drawn by language, so that
rare ones have rows too.

Defined results: null languages and texts without bytes don't train; such a text has null language,
score and margin; very long texts count whole; of equal scores the language first in the alphabet
wins; each row has its result, repeated rows alike; without training rows all is null, and of an empty
table the result is empty. Null doc_ids are passed on. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import buffers, lower, slices
from .shared import stored, tree_sum

PLACES = 1 << 15
_OUT = "doc_id long, language string, score double, margin double"


def small_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of 256 rows at most, whose presence takes 8 MB."""
    for s in slices(batches, "text", 1 << 18):
        for k in range(0, s.num_rows, 256):
            yield s.slice(k, 256)


def presence(text: pa.Array) -> np.ndarray:
    """For each text which places its n-grams take; whole texts count."""
    data, offsets = buffers(lower(text))
    out = np.zeros((len(text), PLACES), bool)
    flat = out.ravel()
    row = np.repeat(np.arange(len(text), dtype=np.int64) << 15, np.diff(offsets))
    gram = np.zeros(len(data), np.uint32)
    for n in range(3):
        if len(data) <= n:
            break
        gram = gram[: len(data) - n] | data[n:].astype(np.uint32) << np.uint32(8 * n)
        place = ((gram + np.uint32(n * 0x1000193)) * np.uint32(2654435761)) >> np.uint32(17)
        inside = row[: len(gram)] == row[n:]
        at = row[: len(gram)] + place
        flat[at if n == 0 else at[inside]] = True
    return out


def _products(bits: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return bits.astype(np.float32) @ weights


class Languages:
    def __init__(self, names: list[str], weights: np.ndarray) -> None:
        self.names, self.weights = names, weights.astype(np.float32)

    def scores(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores by language, and how many places each text takes."""
        bits = presence(text)
        n = bits.sum(axis=1)
        return _products(bits, self.weights) / np.sqrt(np.maximum(n, 1))[:, None], n


def fit(docs: DataFrame, *, landmarks: int = 256, max_train_rows: int = 6_000, ridge: float = 1e-3, seed: int = 5) -> Languages | None:
    """Train on some ``max_train_rows`` documents, as many of each language (by hash of doc_id), of which ``landmarks`` are landmarks."""
    known = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL AND text != ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    names = [r["lang"] for r in known.select("lang").distinct().orderBy("lang").collect()]
    if not names:
        return None
    # what a task can't place among its first rows of a language is left out before the shuffle
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))
    ordered = known.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(seed)).alias("order"))
    table = stored(ordered.withColumn("nth", nth).where(F.col("nth") <= -(-max_train_rows // len(names))).dropDuplicates(["doc_id", "lang"]), "chosen")
    # bounded by a parameter, so that it may be sent to all executors
    sample = stored(known.join(F.broadcast(table.df), ["doc_id", "lang"]).dropDuplicates(["doc_id", "lang"]), "sample")
    table.drop()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in small_slices(batches):
            bits = np.packbits(presence(s.column("text")), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bits])], ["bits"])

    some = sample.df.where(F.col("nth") <= max(1, landmarks // len(names))).orderBy("lang", "nth").select("text")
    rows = some.coalesce(1).mapInArrow(measure, "bits binary").collect()
    marks = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))
    l, c = len(marks), len(names)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((l, l + c))
        for s in small_slices(batches):
            bits = presence(s.column("text"))
            k = _products(bits, marks.T) / np.sqrt(np.maximum(bits.sum(axis=1), 1))[:, None]
            y = np.array(s.column("lang").to_pylist())[:, None] == np.array(names)[None, :]
            total += k.T @ np.concatenate([k, 2.0 * y - 1], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    total = tree_sum(sample.df.mapInArrow(sums, "sums binary")).reshape(l, l + c)
    n = sample.df.count()
    sample.drop()
    own = (marks @ marks.T).astype(float)
    alpha = np.linalg.solve(total[:, :l] + ridge * n * own + 1e-6 * n * np.eye(l), total[:, l:])
    return Languages(names, marks.T @ alpha)


def identify(docs: DataFrame, model: Languages | None) -> DataFrame:
    """doc_id, language, score (of the language, about 1 if certain and -1 if not) and margin over the next one, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_slices(batches):
            if model is None:
                names, best, margin = [None] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows
            else:
                scores, n = model.scores(b.column("text"))
                top = scores.argmax(axis=1)
                ordered = np.sort(scores, axis=1)
                some = pa.array(n == 0)
                names = pa.array([None if e else model.names[i] for i, e in zip(top, n == 0, strict=True)], pa.string())
                best = pa.array(ordered[:, -1].astype(float), mask=np.asarray(some))
                margin = pa.array((ordered[:, -1] - ordered[:, -2]).astype(float) if len(model.names) > 1 else ordered[:, -1].astype(float), mask=np.asarray(some))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(best, pa.float64()), pa.array(margin, pa.float64())], ["doc_id", "language", "score", "margin"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OUT)
