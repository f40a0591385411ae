"""Benchmark decontamination by latent semantic retrieval.

1. Each text becomes its sequence of ids of benchmark words (0: no benchmark word), in a stored table.
2. Passages are runs of ``2 * BLOCK`` words at every BLOCK words, weighted by tf-idf over all blocks
   of the corpus. A randomised SVD (two passes, partition-summed) gives their leading right singular
   vectors; benchmark items enter it with as much total weight as the corpus, so that the latent
   space resolves what has to be found.
3. Items are cut into the same passages. Every passage of a text is compared with every passage of an
   item in that space: by cosine, and by the share ``overlap`` of the latter's length that the former has
   in its direction (a passage of one or two benchmark words may point anywhere, but is short). With a
   share of ``most`` the cosine doesn't matter: frequent words weigh little beside a few rare ones.
4. Where the whole item would lie around a candidate, their longest common subsequence decides: a share of
   ``sure`` of the item's words, or of ``likely`` of them and ``answer`` of its answer's words (the part
   behind the last "answer:", else the last sentence). These have to stand together, at most ``NEAR_ANSWER``
   words behind a match of the question; those of an answer of under ``LEAST_ANSWER`` words without a gap.

Words outside the benchmark can't match an item and are in none of the passages' directions; a passage's
length is that of its benchmark words.

Defined results: null and empty texts hold no item; items that are null or have under
``least_words`` words are skipped, as too short to be told from common speech; an item_id or doc_id
that repeats is judged by its best row; ties keep all pairs. Very long texts are compared whole, passage
by passage. Without items or documents the result is empty. Extra columns are ignored, and passed through by ``drop_contaminated``. Null ids: the item is
skipped, and a document can't be named: ``drop_contaminated`` keeps it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import without
from .kernels import binary_rows, lookup, mix, owners, ragged, slices, to_batch, word_hashes
from .shared import stored, tree_sum

BLOCK = 16
#: Bytes of ids at a time: what is gathered for them stays in a core's cache.
CHUNK = 1 << 16
#: So many of the most frequent words are counted in pairs, in a matrix of four bytes each.
DENSE = 4_096
LEAST_ANSWER = 4
NEAR_ANSWER = 8
#: Of a word that all blocks hold.
LEAST_WEIGHT = 0.1
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_FOUND = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"


def common_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one bit of a whole number for each of a; 0 matches nothing."""
    places: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a):
        places[x] |= 1 << i
    places.pop(0, None)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def answer_of(text: str) -> str:
    """The part of an item that answers it."""
    marked = re.split(r"(?i)\banswer\s*:", text)
    if len(marked) > 1 and marked[-1].strip():
        return marked[-1]
    sentences = [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if re.search(r"\w", x)]
    return sentences[-1] if sentences else text


def answer_share(item: list[int], answer: list[int], near: list[int], likely: float) -> float:
    """Which share of an answer stands together, where it and its question before it make up ``likely`` of the item; short ones count only whole."""
    n, short = len(answer), len(answer) < LEAST_ANSWER
    question = item[: len(item) - n]
    if not n or not question:
        return common_length(answer, near) / n if n else 0.0
    if common_length(answer, near) < (n if short else n / 2):
        return 0.0
    best, width = 0, n if short else n + n // 2 + 1
    for at in [i for i, x in enumerate(near) if x and x in answer]:
        held = common_length(answer, near[at : at + width])
        if held <= best or short and held < n:
            continue
        # the question's match has to reach the last few words before the answer
        before = near[max(0, at - 2 * len(question)) : at]
        whole = common_length(question, before)
        if whole + held >= likely * len(item) and whole > common_length(question, before[:-NEAR_ANSWER]):
            best = held
    return best / n


class Items:
    """The benchmark as arrays: vocabulary, words and answers of the items."""

    def __init__(self, rows: list[tuple[int, str]], least_words: int) -> None:
        texts = pa.array([t for _, t in rows], pa.string())
        words, first = word_hashes(texts)
        long_ = [i for i in range(len(rows)) if first[i + 1] - first[i] >= least_words]
        self.ids = np.array([rows[i][0] for i in long_], np.int64)
        self.vocabulary = np.unique(np.concatenate([words[first[i] : first[i + 1]] for i in long_])) if long_ else np.zeros(0, np.uint64)
        self.dtype = np.uint16 if len(self.vocabulary) < 65_000 else np.uint32
        code = self.encode(words)
        self.words = [code[first[i] : first[i + 1]].tolist() for i in long_]
        answers, start = word_hashes(pa.array([answer_of(rows[i][1]) for i in long_], pa.string()))
        code = self.encode(answers)
        self.answers = [code[start[j] : start[j + 1]].tolist() for j in range(len(long_))]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        # of each word of each item the places that it takes there, as bits
        size = len(self.vocabulary) + 1
        flat = np.concatenate([np.array(w, np.int64) for w in self.words]) if long_ else np.zeros(0, np.int64)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        keys, row = np.unique(mix((np.repeat(np.arange(len(long_)), self.lengths) * size + flat).astype(np.uint64)), return_inverse=True)
        self.keys, self.rows = keys, np.arange(1, len(keys) + 1, dtype=np.int32)
        self.places = np.zeros((len(keys) + 1, int(-(-self.lengths.max(initial=1) // 64))), np.uint64)
        np.bitwise_or.at(self.places, (row + 1, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))

    def encode(self, words: np.ndarray) -> np.ndarray:
        return lookup(self.vocabulary, np.arange(1, len(self.vocabulary) + 1).astype(self.dtype), words)

    def common_lengths(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray) -> np.ndarray:
        """common_length() of each item with the words from begin to end, all pairs word by word at a time."""
        out = np.zeros(len(item), np.int64)
        wide = -(-self.lengths[item] // 64)
        for w in np.unique(wide).tolist():
            own = np.flatnonzero(wide == w)
            own = own[np.argsort(begin[own] - end[own], kind="stable")]  # the longest first, so that those still at work are in front
            n, j = (end - begin)[own], item[own]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pair = np.repeat(np.arange(len(own)), n)
            word = ids[begin[own][pair] + nth].astype(np.int64)
            known = np.flatnonzero(word)
            row = np.zeros((n.max(initial=0), len(own)), np.int32)
            row[nth[known], pair[known]] = lookup(self.keys, self.rows, mix((j[pair[known]] * (len(self.vocabulary) + 1) + word[known]).astype(np.uint64)))
            left = np.full((w, len(own)), ~np.uint64(0))
            working = len(own) - np.searchsorted(n[::-1], np.arange(len(row)), "right")
            for i, k in enumerate(working.tolist()):
                carry = np.zeros(k, bool)
                for x in range(w):
                    v = left[x, :k]
                    u = v & self.places[row[i, :k], x]
                    total = v + u
                    more = total < v
                    if w > 1:
                        with_carry = total + carry
                        more |= with_carry < total
                        total = with_carry
                    left[x, :k] = total | (v & ~u)
                    carry = more
            for x in range(w):
                inside = np.minimum(self.lengths[j] - 64 * x, 64).astype(np.uint64)
                out[own] += np.bitwise_count(~left[x] & (~np.uint64(0) >> (np.uint64(64) - inside)))
        return out


def _blocks(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its block; and the first block of each text, with their number as the last."""
    n = -(-np.diff(first) // BLOCK)
    start = np.concatenate([[0], np.cumsum(n)])
    row = owners(first)
    return start[row] + (np.arange(len(ids)) - first[row]) // BLOCK, start


def _passages(n: int) -> range:
    """Where the passages of an item of so many words begin."""
    return range(0, max(n - BLOCK, 1), BLOCK)


def _add_rows(out: np.ndarray, target: np.ndarray, rows: np.ndarray, source: np.ndarray) -> None:
    """out[target] += source[rows] for an ascending target: the first row of each target, then the second, and so on."""
    if not len(target):
        return
    begins = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
    nth = np.arange(len(target)) - np.repeat(begins, np.diff(np.append(begins, len(target))))
    order = np.argsort(nth, kind="stable")
    cuts = np.searchsorted(nth[order], np.arange(nth.max() + 2))
    for i, j in zip(cuts, cuts[1:], strict=False):
        k = order[i:j]
        out[target[k]] += source[rows[k]]


def _sum_rows(out: np.ndarray, target: np.ndarray, rows: np.ndarray, source: np.ndarray) -> None:
    """As _add_rows, of few targets with many rows each."""
    if len(target):
        begins = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        out[target[begins]] += np.add.reduceat(source[rows], begins, axis=0)


def _project(ids: np.ndarray, block: np.ndarray, n: int, weighted: np.ndarray, useful: np.ndarray) -> np.ndarray:
    """Sums by block of the words' rows of a matrix whose row 0 is of no word."""
    out = np.zeros((n, weighted.shape[1]), np.float32)
    at = np.flatnonzero(useful[ids])
    _add_rows(out, block[at], ids[at], weighted)
    return out


def _pair_counts(counts: np.ndarray, word: np.ndarray, block: np.ndarray) -> None:
    """Add to counts[a, b] the pairs of words a and, later in the same block, b."""
    flat, n = counts.ravel(), len(counts)
    for k in range(1, BLOCK):
        same = np.flatnonzero(block[k:] == block[:-k])
        np.add.at(flat, word[same] * n + word[same + k], 1)


def _gram(table: DataFrame, weight: np.ndarray, matrix: np.ndarray, dtype: type, df: np.ndarray) -> np.ndarray:
    """A'A times a matrix, where A has a tf-idf row for each block of the corpus.

    A'(A Q) is summed over blocks. Of the ``DENSE`` most frequent words, which make up nearly all of a
    block, pairs within blocks are counted, and multiplied with Q once a partition; what the others
    have part in is summed row by row.
    """
    useful, m, l = weight > 0, len(weight), matrix.shape[1]
    weighted = (weight[:, None] * matrix).astype(np.float32)
    often = np.sort(np.lexsort((np.arange(m), -np.where(useful, df, -1)))[: min(DENSE, int(useful.sum()))])
    place = np.full(m, -1, np.int64)
    place[often] = np.arange(len(often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, l))
        pairs, single = np.zeros((len(often), len(often)), np.int32), np.zeros(len(often), np.int64)
        for s in slices(batches, "ids", CHUNK):
            ids, first = ragged(s.column("ids"), dtype)
            block, start = _blocks(ids, first)
            at = np.flatnonzero(useful[ids])
            word, own = ids[at].astype(np.int64), block[at]
            rare = place[word] < 0
            frequent = place[word[~rare]]
            single += np.bincount(frequent, minlength=len(often))
            _pair_counts(pairs, frequent, own[~rare])
            if rare.any():
                touched = np.zeros(start[-1], bool)
                touched[own[rare]] = True
                y, z = np.zeros((2, start[-1], l), np.float32)
                some = touched[own]
                _add_rows(y, own[some], word[some], weighted)
                _add_rows(z, own[rare], word[rare], weighted)
                for chosen, source in ((rare, y), (some & ~rare, z)):
                    w, b = word[chosen], own[chosen]
                    order = np.argsort(w, kind="stable")
                    _sum_rows(total, w[order], b[order], source)
        q = weighted[often]
        for k in range(0, len(often), 512):
            part = (pairs[k : k + 512] + pairs[:, k : k + 512].T).astype(np.float32)
            total[often[k : k + 512]] += part @ q + single[k : k + 512, None] * q[k : k + 512]
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()])], ["sums"])

    return tree_sum(table.mapInArrow(run, "sums binary"), "f4").astype(float).reshape(m, l) * weight[:, None]


def latent_space(table: DataFrame, items: Items, rank: int, oversample: int, common: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """idf weights of the vocabulary and its latent coordinates.

    Words in more than a share ``common`` of the blocks weigh as much less as they occur more often, but
    at least ``LEAST_WEIGHT``: an item may have no others, or be what makes them frequent.
    """
    m, dtype = len(items.vocabulary) + 1, items.dtype

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(m + 1, np.int64)
        for s in slices(batches, "ids", CHUNK):
            ids, first = ragged(s.column("ids"), dtype)
            block, start = _blocks(ids, first)
            keys = np.sort(block * m + ids)
            fresh = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
            total[:m] += np.bincount(keys[fresh] % m, minlength=m)
            total[m] += start[-1]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    counts = tree_sum(table.mapInArrow(count, "sums binary"), "i8")
    df, n = counts[:m].astype(float), max(int(counts[m]), 1)
    weight = np.maximum(np.log((n + 1) / (df + 1)) * np.minimum(1.0, common * n / np.maximum(df, 1)), LEAST_WEIGHT)
    weight[0] = 0
    own = np.zeros((len(items.words), m))
    for i, words in enumerate(items.words):
        np.add.at(own[i], words, weight[words])
    energy = (df * weight**2).sum() / max((own**2).sum(), 1e-9)
    size = min(rank + oversample, m)
    q = np.random.default_rng(seed).normal(size=(m, size))
    for _ in range(2):
        basis, _ = np.linalg.qr(q)
        q = _gram(table, weight, basis, dtype, df) + max(energy, 1.0) * (own.T @ (own @ basis))
    _, u = np.linalg.eigh(basis.T @ q)
    return weight, (basis @ u)[:, ::-1][:, :rank]


def _find(table: DataFrame, items: Items, weight: np.ndarray, space: np.ndarray, cosine: float, overlap: float, most: float, likely: float) -> DataFrame:
    useful, weighted, dtype = weight > 0, (weight[:, None] * space).astype(np.float32), items.dtype
    parts = [(j, a) for j, w in enumerate(items.words) for a in _passages(len(w))]
    owner, offset = np.array(parts).T
    targets = np.stack([weighted[items.words[j][a : a + 2 * BLOCK]].sum(axis=0) for j, a in parts])
    length = np.maximum(np.linalg.norm(targets, axis=1), 1e-9)
    targets /= length[:, None]
    enough, plenty = (overlap * length).astype(np.float32), (most * length).astype(np.float32)
    words, answers, item_ids = items.words, items.answers, items.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "ids", CHUNK):
            ids, first = ragged(s.column("ids"), dtype)
            if not len(ids):
                continue
            block, start = _blocks(ids, first)
            v = _project(ids, block, start[-1], weighted, useful)
            text = owners(start)
            passage = v.copy()
            joined = text[1:] == text[:-1]
            passage[:-1][joined] += v[1:][joined]
            norm = np.linalg.norm(passage, axis=1, keepdims=True)
            near = passage @ targets.T
            p, t = np.nonzero((near >= enough) & ((near >= cosine * np.maximum(norm, 1e-9)) | (near >= plenty)))
            c = near[p, t] / np.maximum(norm[p, 0], 1e-9)
            # where the item would begin, with room for other words before and in it
            d, j = text[p], owner[t]
            n = items.lengths[j]
            at, room = first[d] + (p - start[d]) * BLOCK - offset[t], BLOCK + n // 4
            begin, end = np.maximum(first[d], at - room), np.minimum(first[d + 1], at + n + room)
            end = np.maximum(begin, end)
            share = items.common_lengths(ids, begin, end, j) / n
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for i in np.flatnonzero(share >= likely).tolist():
                key = int(d[i]), int(j[i])
                if share[i] >= best.get(key, (0.0,))[0]:
                    near_words = ids[begin[i] : end[i]].tolist()
                    a = answer_share(words[key[1]], answers[key[1]], near_words, likely)
                    best[key] = max(best.get(key, (-1.0, 0.0, 0.0)), (float(share[i]), a, float(c[i])))
            if best:
                doc = s.column("doc_id").take(pa.array([d for d, _ in best]))
                yield pa.RecordBatch.from_arrays([doc, pa.array([item_ids[j] for _, j in best]), *(pa.array([x[k] for x in best.values()]) for k in (2, 0, 1))], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

    return table.mapInArrow(run, _FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, rank: int = 128, oversample: int = 16, common: float = 1.0, cosine: float = 0.35, overlap: float = 0.35, most: float = 0.5, likely: float = 0.5, sure: float = 0.7, answer: float = 0.8, least_words: int = 5, items_at_once: int = 5_000, seed: int = 3) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share of each document that holds an item.

    The benchmark is collected; the vocabulary of ``items_at_once`` items at a time goes to the executors.
    """
    rows = sorted({(r[0], r[1]) for r in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text").collect()})
    results = []
    for k in range(0, len(rows), items_at_once):
        items = Items(rows[k : k + items_at_once], least_words)
        if not len(items.ids):
            continue

        def code(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for s in slices(batches, "text"):
                words, first = word_hashes(s.column("text"))
                yield to_batch(_IDS, s.column("doc_id"), binary_rows(items.encode(words), first))

        named = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        table = stored(named.mapInArrow(code, "doc_id long, ids binary"), "ids")
        if not table.df.isEmpty():
            weight, space = latent_space(table.df, items, rank, oversample, common, seed)
            results.append(stored(_find(table.df, items, weight, space, cosine, overlap, most, likely), "found"))
        table.drop()
    if not results:
        return docs.sparkSession.createDataFrame([], _FOUND)
    found = results[0].df
    for r in results[1:]:
        found = found.union(r.df)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("m")).select("doc_id", "item_id", "m.cosine", "m.lcs_share", "m.answer_share")
    return best.where((F.col("lcs_share") >= sure) | (F.col("answer_share") >= answer))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """The documents that hold no benchmark item."""
    gone = stored(contaminated(docs, benchmark, **options).select("doc_id").distinct(), "leaks")
    return without(docs, gone.df)
