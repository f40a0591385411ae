"""Suffix-array deduplication by distributed prefix doubling.

Repeats are passages of at least ``least`` words that occur at two places of the corpus or more. A
position's rank stands for the words from it on: at first for ``BASE`` words (their hash), then,
round by round, for up to twice as many, as Spark sorts the positions by the pair of their own rank
and that of the position an offset ahead. Positions whose pair is unique have no equal of that
length and drop out; the last offset is chosen so that exactly ``least`` words are compared.

Before the first sort positions that can't be in a repeat are left out without loss: in every window
of ``least`` words one hash of BASE words is the smallest, the same one in each copy of the window,
so that a window can repeat only if the hash that it selects occurs at another selected place.

A passage in a third of all documents would make one task sort a third of all positions. Pairs that
are that frequent are found in a sample of the documents, at most ``HOT`` of them, and spread over
``SALTS`` tasks, whose groups are known to be one; which pairs are taken for frequent changes no result.

Defined results: null and empty texts, and those of fewer words, have no repeats; a passage that
repeats within one document counts, also in a text of any length; rows with null doc_id are left
out; rows that repeat a doc_id count as one document, that of the smallest text hash; of equal passages
the first by doc_id, then position, is the original; overlapping and adjacent passages are one
span. Word numbers start at 0, the end is exclusive. Of an empty table the result is empty. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import matching, one_row_each
from .kernels import U64, owners, slices, window_hashes, word_hashes
from .shared import stored

BASE = 16
#: Low bits of a hash that hold a position, modulo their range; a window is far shorter than that.
POSITION_BITS = 24
HOT, SALTS, SAMPLED = 100_000, 64, 64


def selected(grams: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest of each ``window`` consecutive hashes of a text, once each."""
    n = len(grams)
    if n < window:
        return np.zeros(0, np.int64)
    mask = U64((1 << POSITION_BITS) - 1)
    key = (grams & ~mask) | (np.arange(n, dtype=U64) & mask)
    padded = np.full(-(-n // window) * window, ~U64(0))
    padded[:n] = key
    ahead = np.minimum.accumulate(padded.reshape(-1, window), axis=1).ravel()
    behind = np.minimum.accumulate(padded.reshape(-1, window)[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - window + 1], ahead[window - 1 : n])
    at = np.arange(n - window + 1)
    inside = np.repeat(first[1:], np.diff(first))[: n - window + 1] - at >= window
    at, low = at[inside].astype(U64), least[inside]
    return np.unique((at + ((low - at) & mask)).astype(np.int64))  # the place from the window's start on with these bits


def _anchors(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text"):
            words, first = word_hashes(s.column("text"))
            grams, start = window_hashes(words, first, BASE)
            at = selected(grams, start, least - BASE + 1)
            if len(at):
                row = np.searchsorted(start, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), s.column("doc_id").take(pa.array(row)), pa.array((at - start[row]).astype(np.int32))], ["gram", "doc_id", "pos"])

    return docs.mapInArrow(run, "gram long, doc_id long, pos int")


def hot_pairs(sample: DataFrame) -> DataFrame | None:
    """(r, s, hot): the pairs that make up more than 1 / HOT of the sampled positions (and 64 of them), numbered; None if there is none."""
    counts = stored(sample.groupBy("r", "s").agg(F.count("*").alias("n")), "sampled")
    total = counts.df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counts.df.where(F.col("n") >= max(64, total // HOT)).orderBy("r", "s").collect()  # at most HOT
    counts.drop()
    return sample.sparkSession.createDataFrame([(x["r"], x["s"], i) for i, x in enumerate(rows)], "r long, s long, hot int") if rows else None


def _rerank(pairs: DataFrame, final: bool, hot: DataFrame | None = None) -> DataFrame:
    """Sort positions by rank pair; (doc_id, pos, rank, hot) of the pairs that aren't unique, or at last (doc_id, pos, again, hot).

    A frequent pair (r, s, hot) is in several tasks; its rank is -1 - hot in all of them.
    """
    if hot is None:
        pairs, salt = pairs.withColumn("hot", F.lit(-1)), []
    else:
        pairs = pairs.join(F.broadcast(hot), ["r", "s"], "left").withColumn("hot", F.coalesce("hot", F.lit(-1)))
        salt = [F.when(F.col("hot") < 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))]
    ordered = pairs.repartition("r", "s", *salt).sortWithinPartitions("r", "s", "doc_id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a group may go on in the next batch; of the last one only its key, its rank and a single row that waits are kept
        rank, key, waiting = TaskContext.get().partitionId() << 40, None, None
        for t in batches:
            if not t.num_rows:
                continue
            r, s = t.column("r").to_numpy(), t.column("s").to_numpy()
            fresh = np.concatenate([[(r[0], s[0]) != key], (r[1:] != r[:-1]) | (s[1:] != s[:-1])])
            goes_on = not fresh[0]
            if goes_on and waiting is not None:
                yield out(waiting, np.array([rank]), np.zeros(1, bool))
                waiting = None
            ranks = rank + np.cumsum(fresh)
            begins = np.flatnonzero(np.concatenate([[True], fresh[1:]]))
            size = np.diff(np.append(begins, t.num_rows))
            many = np.repeat(size > 1, size)
            if goes_on:
                many[: size[0]] = True
            if not many[-1]:
                waiting = t.slice(t.num_rows - 1)
            elif size[-1] < t.num_rows or fresh[0]:
                waiting = None
            many |= t.column("hot").to_numpy() >= 0
            if t.column("hot")[t.num_rows - 1].as_py() >= 0:
                waiting = None
            kept = pa.array(many)
            yield out(t.filter(kept), ranks[many], ~fresh[many])
            rank, key = int(ranks[-1]), (r[-1], s[-1])

    def out(t: pa.RecordBatch, ranks: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
        own = t.column("hot").to_numpy()
        value = pa.array(again) if final else pa.array(np.where(own < 0, ranks, -1 - own.astype(np.int64)))
        return pa.RecordBatch.from_arrays([t.column("doc_id"), t.column("pos"), value, t.column("hot")], ["doc_id", "pos", "again" if final else "rank", "hot"])

    return ordered.mapInArrow(run, "doc_id long, pos int, again boolean, hot int" if final else "doc_id long, pos int, rank long, hot int")


def _one_first(found: DataFrame) -> DataFrame:
    """Of a frequent pair each task has marked a first position: only the first of all stays so."""
    firsts = found.where("hot >= 0 AND NOT again").groupBy("hot").agg(F.min(F.struct("doc_id", "pos")).alias("f"))  # at most HOT rows
    both = found.join(F.broadcast(firsts), "hot", "left")
    return both.select("doc_id", "pos", (F.col("again") | (F.col("f").isNotNull() & (F.struct("doc_id", "pos") != F.col("f")))).alias("again"))


def _by_document(table: DataFrame) -> DataFrame:
    return table.repartition("doc_id").sortWithinPartitions("doc_id", "pos")


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches, cut only between documents."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("doc_id").to_numpy()
        change = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        if held and held[-1].column("doc_id")[-1].as_py() != ids[0]:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if len(change):
            held.append(b.slice(0, change[-1]))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = [b.slice(change[-1])]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pairs_ahead(ranked: DataFrame, offset: int) -> DataFrame:
    """(r, s, doc_id, pos): the rank at a position with that at an offset ahead, where both are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_documents(batches):
            ids, pos, rank = t.column("doc_id").to_numpy(), t.column("pos").to_numpy(), t.column("rank").to_numpy()
            row = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]])).astype(np.int64) << 32
            key = row + pos
            at = np.minimum(np.searchsorted(key, key + offset), len(key) - 1)
            both = np.flatnonzero(key[at] == key + offset)
            yield pa.RecordBatch.from_arrays([pa.array(rank[both]), pa.array(rank[at[both]]), pa.array(ids[both]), pa.array(pos[both])], ["r", "s", "doc_id", "pos"])

    return _by_document(ranked.select("doc_id", "pos", "rank")).mapInArrow(run, "r long, s long, doc_id long, pos int")


def _spans(found: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_documents(batches):
            ids, pos, again = t.column("doc_id").to_numpy(), t.column("pos").to_numpy().astype(np.int64), np.array(t.column("again"), bool)
            fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (pos[1:] > pos[:-1] + least)])
            begins = np.flatnonzero(fresh)
            ends = np.append(begins[1:], len(pos)) - 1
            # words that a later occurrence covers: each adds what the one before it doesn't cover
            where = np.flatnonzero(again)
            span = (np.cumsum(fresh) - 1)[where]
            gain = np.full(len(where), least)
            if len(where) > 1:
                same = span[1:] == span[:-1]
                gain[1:] = np.where(same, np.minimum(least, pos[where[1:]] - pos[where[:-1]]), least)
            covered = np.bincount(span, gain, len(begins)).astype(np.int32)
            end = pos[ends] + least
            yield pa.RecordBatch.from_arrays([pa.array(ids[begins]), pa.array(pos[begins].astype(np.int32)), pa.array(end.astype(np.int32)), pa.array((end - pos[begins]).astype(np.int32)), pa.array(covered)], ["doc_id", "start_word", "end_word", "n_words", "n_repeated"])

    return _by_document(found).mapInArrow(run, "doc_id long, start_word int, end_word int, n_words int, n_repeated int")


def repeats(docs: DataFrame, *, least: int = 50) -> DataFrame:
    """doc_id, start_word, end_word, n_words, n_repeated of each span of repeated passages.

    n_repeated: how many of its words lie in an occurrence that isn't the first (by doc_id, then position) of its passage.
    """
    if least < 2 * BASE:
        raise ValueError(f"least must be {2 * BASE} or more")
    named = one_row_each(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    anchors = stored(_anchors(named, least), "anchors")
    twice = anchors.df.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    active = stored(anchors.df.join(twice, "gram").groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("at")), "active")
    anchors.drop()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text"):
            words, first = word_hashes(s.column("text"))
            grams, start = window_hashes(words, first, BASE)
            # from an anchor the window may begin up to least - BASE words earlier, and needs ranks up to least - 2 BASE words later
            inside = np.zeros(len(grams) + 1, np.int32)
            lists = s.column("at")
            anchor = lists.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(s.num_rows), pc.list_value_length(lists).to_numpy())
            place = start[row] + anchor
            np.add.at(inside, np.maximum(start[row], place - (least - BASE)), 1)
            np.add.at(inside, np.minimum(start[row + 1], place + (least - 2 * BASE) + 1), -1)
            gram_row = owners(start)
            at = np.flatnonzero((np.cumsum(inside[:-1]) > 0) & (np.arange(len(grams)) + BASE < start[gram_row + 1]))
            r = gram_row[at]
            yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), pa.array(grams[at + BASE].view(np.int64)), s.column("doc_id").take(pa.array(r)), pa.array((at - start[r]).astype(np.int32))], ["r", "s", "doc_id", "pos"])

    sampled = F.pmod(F.xxhash64("doc_id", F.lit(SAMPLED)), F.lit(SAMPLED)) == 0
    first = lambda docs: matching(docs, active.df).mapInArrow(pairs, "r long, s long, doc_id long, pos int")
    now = stored(_rerank(first(named), least == 2 * BASE, hot_pairs(first(named.where(sampled)))), "ranks")
    active.drop()
    length = 2 * BASE
    while length < least:
        offset = min(length, least - length)
        length += offset
        hot = hot_pairs(_pairs_ahead(now.df.where(sampled), offset))
        after = stored(_rerank(_pairs_ahead(now.df, offset), length == least, hot), "ranks")
        now.drop()
        now = after
    return _spans(_one_first(now.df), least)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x80-\x{10FFFF}]+') AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), w AS (
  SELECT doc_id, unnest(generate_series(0, len(words) - 50)) AS pos, words FROM d WHERE len(words) >= 50
), g AS (
  SELECT doc_id, pos, md5(array_to_string(list_slice(words, pos + 1, pos + 50), ' ')) AS passage FROM w
), r AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY passage ORDER BY doc_id, pos) > 1 AS again FROM g
  QUALIFY count(*) OVER (PARTITION BY passage) > 1
), s AS (
  SELECT *, CASE WHEN pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 OR lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) IS NULL THEN 1 ELSE 0 END AS fresh FROM r
), t AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM s
), c AS (
  SELECT *, CASE WHEN NOT again THEN 0 ELSE least(50, coalesce(pos - max(CASE WHEN again THEN pos END) OVER (PARTITION BY doc_id, span ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 50)) END AS gain FROM t
)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS start_word, CAST(max(pos) + 50 AS INTEGER) AS end_word, CAST(max(pos) + 50 - min(pos) AS INTEGER) AS n_words, CAST(sum(gain) AS INTEGER) AS n_repeated
FROM c GROUP BY doc_id, span
"""
