"""Mixing sources to target weights.

Texts are tokenised, an end token is put behind each, and the stream of each source is packed into
blocks of ``length`` tokens. Each output shard draws its number of slots per source from a
multinomial; the k-th slot of a source in the whole output takes block p(k mod n) of its n blocks,
where p is a pseudorandom permutation (a keyed Feistel network with cycle walking) that is another
one in each pass over the source. Slots and blocks are joined by source and index.

The order of a stream is the order of the stored token table, so that offsets are prefix sums of one
small row per partition and source, and a token is moved once: from its partition to its block.

Defined results: null source is a source of its own (null in the result); null and empty texts, and
texts that repeat, count like others, except that texts without tokens add nothing, not even an end;
the last block of a source is filled with end tokens; a weight for a source that doesn't exist is
left out, one that isn't given is 0; without blocks the result is empty. Extra columns are ignored.
Rows with null doc_id are packed, and named null in ``doc_ids``. Very long texts are cut over as many
blocks as they need; ties don't occur, as slots and blocks are numbered. Of an empty table the result is
empty. Weights name sources one by one, so that one row a source, its total, goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import sized_join
from .kernels import binary_rows, buffers, mix, owners, ragged, slices
from .secret_scan import VOCABULARY, encoding
from .shared import stored

NO_SOURCE = "\x00null"
_CACHE: dict[str, dict[str, list[int]]] = {}
_CACHED = 600_000


def width_of(path: str, end: int) -> type:
    """The narrowest type that holds all tokens of a vocabulary and the end token."""
    return np.uint16 if max(encoding(path).max_token_value, end) < 1 << 16 else np.uint32


def tokenise(text: pa.Array, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text with an end token behind (none of an empty text), and where each text's begin.

    Texts are cut where the vocabulary's splitter cuts in any case (before a single blank that a letter
    follows, and between an ASCII letter and a sign); each distinct piece is encoded once.
    """
    data, offsets = buffers(text)
    width = width_of(path, end)
    if not len(data):
        return np.zeros(0, width), np.zeros(len(text) + 1, np.int64)
    letter = (data | 32) - np.uint8(97) < 26
    shown = data - np.uint8(33) < 94  # ASCII without blanks
    latin = data == 0xC3  # begins a letter, or one of two signs
    solid = shown.copy()
    solid[1:] |= latin[:-1]
    sign = shown & ~letter & ~(data - np.uint8(48) < 10) & (data != 39)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = letter[:-1] & sign[1:]
    cut[1:-2] |= (data[1:-1] == 32) & solid[:-2] & (letter | latin)[2:]
    cut[offsets] = True
    at = np.flatnonzero(cut)
    pieces = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data)]).dictionary_encode()
    cache = _CACHE.setdefault(path, {})
    if len(cache) > _CACHED:
        cache.clear()
    encode = encoding(path).encode_ordinary
    known = []
    for piece in pieces.dictionary.to_pylist():
        t = cache.get(piece)
        if t is None:
            t = encode(piece)
            if len(piece) < 64:
                cache[piece] = t
        known.append(t)
    size = np.fromiter(map(len, known), np.int64, len(known))
    flat, start = np.fromiter(chain.from_iterable(known), width, size.sum()), np.concatenate([[0], np.cumsum(size)[:-1]])
    index = pieces.indices.to_numpy()
    lengths = size[index]
    # pieces of each text, and with them its tokens; the end token takes one place more
    first_piece = np.searchsorted(at, offsets)
    some = np.diff(offsets) > 0
    ahead = np.concatenate([[0], np.cumsum(lengths)])
    ends_before = np.concatenate([[0], np.cumsum(some)])
    first = ahead[first_piece] + ends_before
    out = np.full(first[-1], end, width)
    shift = np.repeat(ends_before[:-1], np.diff(first_piece))  # of each piece
    place = np.repeat(shift, lengths) + np.arange(ahead[-1])
    out[place] = flat[np.repeat(start[index] - ahead[:-1], lengths) + np.arange(ahead[-1])]
    return out, first


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """p(index) for the permutation of range(n) that the key names, each for its element."""
    index, n, key = index.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n.astype(float), 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, left = index.copy(), np.arange(len(index))
    while len(left):
        a, b = out[left] >> half[left], out[left] & mask[left]
        for r in range(4):
            a, b = b, a ^ (mix(b ^ mix(key[left] + np.uint64(r + 1))) & mask[left])
        out[left] = (a << half[left]) | b
        left = left[out[left] >= n[left]]  # outside: walk on
    return out.astype(np.int64)


def shard_counts(seed: int, shard: int, size: int, weights: np.ndarray) -> np.ndarray:
    return np.random.default_rng([seed, shard]).multinomial(size, weights)


def sums_before(table: DataFrame, group: str, order: str, name: str, run: int = 4_096) -> DataFrame:
    """table with the sum of n over the rows of its group that come before in order (a whole number, without repeats).

    Runs of ``run`` numbers are summed first, and the runs before a row's own are one row each, so that
    no task sees all rows of a group: of a group of 16 million rows a task holds 4,096.
    """
    t = table.withColumn("__run", F.floor(F.col(order) / run))
    runs = t.groupBy(group, "__run").agg(F.sum("n").alias("__n"))
    earlier = Window.partitionBy(group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(group, "__run", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    own = Window.partitionBy(group, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    both = t.withColumn("__own", F.coalesce(F.sum("n").over(own), F.lit(0))).join(runs, [group, "__run"])
    return both.withColumn(name, F.col("__base") + F.col("__own")).drop("__run", "__own", "__base")


def _tokens(docs: DataFrame, path: str, end: int) -> DataFrame:
    """pid, source, doc_id, at (offset within partition and source), n, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seen = TaskContext.get().partitionId(), {}
        for s in slices(batches, "text", 4 << 20):
            tokens, first = tokenise(s.column("text"), path, end)
            n = np.diff(first)
            source = s.column("source").dictionary_encode()
            code = source.indices.to_numpy()
            at = np.zeros(len(n), np.int64)
            for k, name in enumerate(source.dictionary.to_pylist()):
                own = np.flatnonzero(code == k)
                sums = np.cumsum(n[own])
                at[own] = seen.get(name, 0) + sums - n[own]
                seen[name] = seen.get(name, 0) + int(sums[-1])
            some = pa.array(np.flatnonzero(n > 0))
            b = pa.RecordBatch.from_arrays([pa.array(np.full(len(n), pid)), s.column("source"), s.column("doc_id"), pa.array(at), pa.array(n), binary_rows(tokens, first)], ["pid", "source", "doc_id", "at", "n", "tokens"])
            yield b.take(some)

    rows = docs.select("text", F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(run, "pid long, source string, doc_id long, at long, n long, tokens binary")


def mix_sources(docs: DataFrame, *, length: int = 2048, weights: dict[str | None, float] | None = None, flatten: float = 0.5, slots: int | None = None, shard_size: int = 256, vocabulary: str = VOCABULARY, end: int = 50256, seed: int = 11) -> DataFrame:
    """shard, slot, source, epoch, block, doc_ids, tokens: ``slots`` blocks (as many as there are, if not given) in shards.

    weights: of sources, to be normalised; if not given, each source's tokens to the power ``flatten``.
    """
    spark, width = docs.sparkSession, width_of(vocabulary, end)
    table = stored(_tokens(docs, vocabulary, end), "tokens")
    part = stored(table.df.groupBy("pid", "source").agg(F.sum("n").alias("n")), "parts")
    base = stored(sums_before(part.df, "source", "pid", "base").drop("n"), "bases")
    # one row a source
    totals = {r["source"]: r["n"] for r in part.df.groupBy("source").agg(F.sum("n").alias("n")).orderBy("source").collect()}
    schema = "shard long, slot long, source string, epoch long, block long, doc_ids array<long>, tokens array<int>"
    if not totals:
        return spark.createDataFrame([], schema)
    names = list(totals)
    blocks = {s: -(-n // length) for s, n in totals.items()}
    given = [totals[s] ** flatten if weights is None else max(0.0, weights.get(None if s == NO_SOURCE else s, 0.0)) for s in names]
    share = np.array(given, float) / (sum(given) or 1.0)
    n_slots = (sum(blocks.values()) if slots is None else slots) if sum(given) else 0
    shards = -(-n_slots // shard_size)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard in f["id"]:
                counts = shard_counts(seed, int(shard), min(shard_size, n_slots - int(shard) * shard_size), share)
                yield pd.DataFrame({"shard": shard, "k": np.arange(len(counts)), "n": counts})

    drawn = spark.range(shards).mapInPandas(draw, "shard long, k long, n long")
    each = sums_before(drawn, "k", "shard", "first").where("n > 0").select("shard", "k", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("draw"))
    order = Window.partitionBy("shard").orderBy(F.xxhash64("shard", "k", "draw", F.lit(seed)), "k", "draw")
    each = each.select("shard", (F.row_number().over(order) - 1).cast("long").alias("slot"), "k", "draw")
    count = np.array([blocks[s] for s in names])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, d = b.column("k").to_numpy(), b.column("draw").to_numpy()
            epoch = d // count[k]
            key = mix((np.uint64(seed) << np.uint64(48)) ^ (k.astype(np.uint64) << np.uint64(32)) ^ epoch.astype(np.uint64))
            block = permuted(d % count[k], count[k], key)
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("slot"), pa.array(names).take(b.column("k")), pa.array(epoch), pa.array(block)], ["shard", "slot", "source", "epoch", "block"])

    plan = each.mapInArrow(place, "shard long, slot long, source string, epoch long, block long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "tokens", 4 << 20):
            tokens, first = ragged(s.column("tokens"), width)
            at = s.column("at").to_numpy() + s.column("base").to_numpy()
            n = np.diff(first)
            pieces = (at + n - 1) // length - at // length + 1
            row = owners(np.concatenate([[0], np.cumsum(pieces)]))
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            block = at[row] // length + nth
            begin = np.maximum(at[row], block * length)
            bounds = np.append(first[row] + begin - at[row], first[-1])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([s.column("source").take(take), pa.array(block), pa.array((begin - block * length).astype(np.int32)), s.column("doc_id").take(take), binary_rows(tokens, bounds)], ["source", "block", "at", "doc_id", "tokens"])

    cuts = sized_join(table.df, base, ["pid", "source"], row_bytes=64).select("source", "doc_id", "at", "base", "tokens").mapInArrow(cut, "source string, block long, at int, doc_id long, tokens binary")
    fill = [(s, blocks[s] - 1, n % length, None, np.full(length - n % length, end, width).tobytes()) for s, n in totals.items() if n % length]
    if fill:
        cuts = cuts.union(spark.createDataFrame(fill, cuts.schema))
    packed = cuts.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("at", "doc_id", "tokens"))).alias("parts"))
    # both sides grow with the data; the plan of so small a source as range() would be taken for small
    joined = plan.hint("merge").join(packed, ["source", "block"]).select("shard", "slot", "source", "epoch", "block", "parts")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column("parts")
            inner = parts.flatten()
            tokens, first = ragged(inner.field("tokens"), width)
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), inner.field("doc_id"))
            out = pa.ListArray.from_arrays(pa.array(first[bounds], pa.int32()), pa.array(tokens.astype(np.int32)))
            source = pc.if_else(pc.equal(b.column("source"), NO_SOURCE), pa.scalar(None, pa.string()), b.column("source"))
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("slot"), source, b.column("epoch"), b.column("block"), ids, out], ["shard", "slot", "source", "epoch", "block", "doc_ids", "tokens"])

    return joined.mapInArrow(assemble, schema)
