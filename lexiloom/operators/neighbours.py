"""Nearest neighbours, range joins and reachability over vectors.

Vectors are packed into blocks; a pair of blocks is one matrix product, so that n rows cost n / size
squared block pairs, spread over all tasks. The product is a sieve in single precision, and what passes
it is measured exactly; a task keeps each row's best over all blocks that it sees, and sends on only
these. Ties of the rounded distance go to the smaller id.

BlockIndex packs near points together and skips pairs of blocks whose centres and radii show that they
hold no neighbour: exact where a metric has the triangle inequality, and as fast as the data are
clustered. Asked with ``probes`` it visits only so many blocks, and is approximate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed

BLOCK = 1024
PLACES = 9
#: Pairs measured, or rows sent on, at a time.
CHUNK = 1 << 16
#: Points that are asked lie in blocks of so many sizes, as a pair of blocks is sent whole.
WIDE = 4
#: Points that a task holds to compare its blocks with.
HELD = 1 << 17


def packed(points: DataFrame, key: str = "id", vector: str = "embedding", size: int = BLOCK) -> DataFrame:
    """(block, ids, rows): the points of a block as bytes of 64-bit ids and numbers. Rows with null are left out."""
    some = points.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = max(1, -(-some.count() // size))

    def pack(keys: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", kind="stable")
        return pd.DataFrame({"block": [keys[0]], "ids": [f["id"].to_numpy(np.int64).tobytes()], "rows": [np.stack(f["v"].to_list()).astype(float).tobytes()]})

    blocks = some.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return blocks.groupBy("block").applyInPandas(pack, "block int, ids binary, rows binary")


def _matrix(ids: bytes, rows: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(rows).reshape(len(i), -1)


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """All distances between the rows of two matrices."""
    if metric == "manhattan":
        return np.stack([np.abs(b - x).sum(axis=1) for x in a])
    if metric in ("cosine", "dot_product"):
        n = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
        return 1 - np.where(n > 1.1920929e-07, np.clip(a @ b.T / np.where(n > 0, n, 1), -1, 1), 0)
    x, y = (a * a).sum(axis=1), (b * b).sum(axis=1)
    square = np.maximum(x[:, None] + y[None, :] - 2 * a @ b.T, 0)
    # differences lose digits in products: what is close is computed once more
    scale = x[np.isfinite(x)].max(initial=0) + y[np.isfinite(y)].max(initial=0)
    close = np.flatnonzero(square < 1e-6 * scale)
    for at in range(0, len(close), CHUNK):
        i, j = np.divmod(close[at : at + CHUNK], len(b))
        square[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
    return square if metric == "squared_euclidean" else np.sqrt(square)


class _Sieve:
    """Finds the pairs of rows that may lie within a limit: a product in single precision, with room for its error."""

    def __init__(self, a: np.ndarray) -> None:
        middle = a[np.isfinite((a * a).sum(axis=1))]
        self.middle = middle.mean(axis=0) if len(middle) else np.zeros(a.shape[1])
        a = a - self.middle
        x = (a * a).sum(axis=1)
        # rows that aren't finite are at no distance
        self.sound = np.isfinite(x)
        self.x = np.where(self.sound, x, 0)
        self.a = np.concatenate([-2 * np.where(self.sound[:, None], a, 0), np.ones((len(a), 1))], axis=1)
        self.single = self.a.astype(np.float32)

    def find(self, b: np.ndarray, limit: np.ndarray, apart: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Flat places of the pairs with rows of b within ``limit`` (by row of a). apart: groups of the rows of both; pairs of one group don't count."""
        n, width = len(b), -(-len(b) // 8) * 8
        b = b - self.middle
        y = (b * b).sum(axis=1)
        sound = np.isfinite(y)
        if not sound.all():
            b, y = np.where(sound[:, None], b, 0), np.where(sound, y, np.inf)
        far = y[sound].max(initial=0)
        small = max(far, self.x.max(initial=0)) < 1e30
        kind, left = (np.float32, self.single) if small else (np.float64, self.a)
        right = np.full((width, b.shape[1] + 1), np.inf, kind)
        right[:, :-1] = 0
        right[:n, :-1], right[:n, -1] = b, y
        room = 2.4e-7 * (b.shape[1] + 4) * (self.x + 2 * far)
        most = np.where(self.sound, (limit + 2 * 10.0**-PLACES) ** 2 - self.x + room, -1.0)
        most = np.where(self.sound, np.nextafter(most.astype(kind), kind(np.inf)), kind(-np.inf))[:, None]
        tile = max(1, (1 << 20) // width)
        product, passed, found = np.empty((tile, width), kind), np.empty((tile, width), bool), []
        for at in range(0, len(left), tile):
            own = slice(at, at + tile)
            m = len(left[own])
            np.matmul(left[own], right.T, out=product[:m])
            np.less_equal(product[:m], most[own], out=passed[:m])
            if apart is not None:
                passed[:m, :n] &= apart[0][own, None] != apart[1][None, :]
            # eight at a time, as few pass
            eights = np.flatnonzero(passed[:m].reshape(-1).view(np.uint64))
            if len(eights):
                i, j = np.divmod((eights[:, None] * 8 + np.arange(8))[passed[:m].reshape(-1, 8)[eights]], width)
                i, j = i[j < n], j[j < n]
                found.append((i + at) * n + j)
        found = np.concatenate(found) if found else np.zeros(0, np.int64)
        return found if sound.all() else found[sound[found % n]]


def _within(a: np.ndarray, b: np.ndarray, limit: np.ndarray, metric: str, sieve: _Sieve | None = None, apart: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, rounded distance) of all pairs within ``limit`` (by row of a), in parts."""
    if metric == "euclidean":
        found = (sieve or _Sieve(a)).find(b, limit, apart)
    if metric != "euclidean" or len(found) > len(a) * len(b) // 8:
        d = np.round(distances(a, b, metric), PLACES)
        near = (d <= limit[:, None]) & np.isfinite(d)
        if apart is not None:
            near &= apart[0][:, None] != apart[1][None, :]
        found = np.flatnonzero(near)
        for at in range(0, len(found), CHUNK):
            x, y = np.divmod(found[at : at + CHUNK], len(b))
            yield x, y, d[x, y]
        return
    for at in range(0, len(found), CHUNK):
        x, y = np.divmod(found[at : at + CHUNK], len(b))
        off = a[x] - b[y]
        d = np.round(np.sqrt(np.einsum("ij,ij->i", off, off)), PLACES)
        near = d <= limit[x]
        yield x[near], y[near], d[near]


class _Nearest:
    """The k nearest so far of each row of a block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int) -> None:
        self.ids, self.rows, self.sieve = ids, rows, None
        self.dist, self.near = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, j: np.ndarray, b: np.ndarray, metric: str, same: bool, exclude_zero: bool) -> None:
        start = max(1024, 2 * self.dist.shape[1])
        if np.isinf(self.dist[:, -1]).any() and len(b) > start:
            # a part gives the limits for the rest
            self.add(j[:start], b[:start], metric, same, exclude_zero)
            self.add(j[start:], b[start:], metric, same, exclude_zero)
            return
        if np.isinf(self.dist[:, -1]).any():
            d = np.round(distances(self.rows, b, metric), PLACES)
            if same:
                d[self.ids[:, None] == j[None, :]] = np.inf
            if exclude_zero:
                d[d == 0] = np.inf
            d[~(d <= self.dist[:, -1:])] = np.inf
            x, y = _best(d, self.dist.shape[1], j)
            parts = ((x[at : at + CHUNK], y[at : at + CHUNK], d[x[at : at + CHUNK], y[at : at + CHUNK]]) for at in range(0, len(x), CHUNK))
        else:
            if self.sieve is None and metric == "euclidean":
                self.sieve = _Sieve(self.rows)
            parts = _within(self.rows, b, self.dist[:, -1].copy(), metric, self.sieve)
        for x, y, d in parts:
            at = j[y]
            last = self.dist[x, -1]
            keep = (d < last) | ((d == last) & (at < self.near[x, -1]))
            if same:
                keep &= self.ids[x] != at
            if exclude_zero:
                keep &= d > 0
            if keep.any():
                self._merge(x[keep], at[keep], d[keep])

    def _merge(self, x: np.ndarray, at: np.ndarray, d: np.ndarray) -> None:
        k, own = self.dist.shape[1], np.unique(x)
        x = np.concatenate([np.repeat(own, k), x])
        d, at = np.concatenate([self.dist[own].ravel(), d]), np.concatenate([self.near[own].ravel(), at])
        order = np.lexsort((at, d, x))
        x = x[order]
        first = np.searchsorted(x, own)
        kept = order[np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x)))) < k]
        self.dist[own], self.near[own] = d[kept].reshape(-1, k), at[kept].reshape(-1, k)

    def batch(self) -> pa.RecordBatch:
        some = np.isfinite(self.dist)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, some.sum(axis=1))), pa.array(self.near[some]), pa.array(self.dist[some])], ["src", "dst", "dist"])


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each block of ``left`` beside those of ``right`` (block2, ids2, rows2), one after the other: both are stored tables.

    A task has some blocks of the left and at most some HELD points of the right, so that its memory is bounded, and
    neither table is sent to the driver.
    """
    cores = left.sparkSession.sparkContext.defaultParallelism
    n = right.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    right = right.select(F.col("block").alias("block2"), F.col("ids").alias("ids2"), F.col("rows").alias("rows2")).coalesce(max(1, n // (8 * HELD)))
    return left.repartition(max(1, min(left.count(), 4 * cores))).crossJoin(right.hint("shuffle_replicate_nl"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
    """(block, ids, rows, block2, ids2, rows2) of pairs of blocks."""
    for batch in batches:
        columns = [batch.column(c) for c in ("block", "ids", "rows", "block2", "ids2", "rows2")]
        for r in range(batch.num_rows):
            block, ids, rows, block2, ids2, rows2 = (c[r] for c in columns)
            yield block.as_py(), *_matrix(ids.as_buffer(), rows.as_buffer()), block2.as_py(), *_matrix(ids2.as_buffer(), rows2.as_buffer())


def _sent(src: np.ndarray, dst: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(src), 4 * CHUNK):
        own = slice(at, at + 4 * CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(src[own]), pa.array(dst[own]), pa.array(value[own])], ["src", "dst", "dist"])


def _measured(both: DataFrame, keep: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], metric: str, same: bool, exclude_zero: bool = False) -> DataFrame:
    """As _pairs, of given pairs of blocks (ids, rows, ids2, rows2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                (i, a), (j, b) = _matrix(r["ids"], r["rows"]), _matrix(r["ids2"], r["rows2"])
                d = np.round(distances(a, b, metric), PLACES)
                if same:
                    d[i[:, None] == j[None, :]] = np.inf
                if exclude_zero:
                    d[d == 0] = np.inf
                x, y = keep(d, i, j)
                yield pa.RecordBatch.from_arrays([pa.array(i[x]), pa.array(j[y]), pa.array(d[x, y])], ["src", "dst", "dist"])

    return both.select("ids", "rows", "ids2", "rows2").mapInArrow(run, "src long, dst long, dist double")


def _best(d: np.ndarray, k: int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k smallest, and all that tie with the k-th."""
    k = min(k, d.shape[1])
    limit = np.partition(d, k - 1, axis=1)[:, k - 1]
    return np.nonzero((d <= limit[:, None]) & np.isfinite(d))


def knn_join(queries: DataFrame, points: DataFrame, k: int, *, key: str = "id", vector: str = "embedding", metric: str = "euclidean", same: bool = False, size: int = 2 * BLOCK, exclude_zero: bool = False) -> DataFrame:
    """(src, rank, dst, dist): the k nearest points of each query; with ``same``, pairs of equal id are left out, with ``exclude_zero`` those at no distance."""
    asked = checkpointed(packed(queries, key, vector, size))
    given = checkpointed(packed(points, key, vector, WIDE * size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, None
        for q, i, a, _, j, b in _blocks(batches):
            if best is None or q != block:
                if best is not None:
                    yield best.batch()
                block, best = q, _Nearest(i, a, k)
            best.add(j, b, metric, same, exclude_zero)
        if best is not None:
            yield best.batch()

    return _ranked(_beside(asked, given).mapInArrow(run, "src long, dst long, dist double"), k)


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= k).select("src", "rank", "dst", "dist")


@dataclass
class BlockIndex:
    """Points in blocks (block, ids, rows, centre, radius, n) of up to some ``size`` near ones.

    Centres are drawn from a sample of at most ``sample`` points by hash, at most ``CENTRES`` of them; every
    point is in the block of its nearest centre, of which crowded ones have several.
    """

    blocks: DataFrame
    centres: np.ndarray
    size: int
    key: str = "id"
    vector: str = "embedding"
    metric: str = "euclidean"

    @classmethod
    def build(cls, points: DataFrame, *, key: str = "id", vector: str = "embedding", metric: str = "euclidean", size: int = BLOCK, sample: int = 50_000, seed: int = 1) -> BlockIndex:
        some = _vectors(points, key, vector)
        n = some.count()
        cells = min(max(1, -(-n // size)), CENTRES)
        drawn = some.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(min(sample, cells)).collect()
        centres = np.array([r["v"] for r in drawn], float).reshape(len(drawn), -1)
        return cls(checkpointed(_clustered(some, centres, metric, size)), centres, size, key, vector, metric)

    def _visits(self, asked: DataFrame, k: int | None, radius: float | None, probes: int | None) -> DataFrame:
        """(q, block): which blocks each block of queries has to be compared with."""
        a = asked.select(F.col("block").alias("q"), F.col("centre").alias("c1"), F.col("radius").alias("r1"))
        b = self.blocks.select("block", F.col("centre").alias("c2"), F.col("radius").alias("r2"), "n")
        apart = _apart(self.metric)
        pairs = a.crossJoin(b).select("q", "block", "n", apart(F.col("c1"), F.col("c2")).alias("d"), (F.col("r1") + F.col("r2")).alias("r"))
        if probes is not None:
            near = F.row_number().over(Window.partitionBy("q").orderBy("d", "block"))
            return pairs.withColumn("nth", near).where(F.col("nth") <= probes).select("q", "block")
        if self.metric not in TRIANGLE:
            return pairs.select("q", "block")
        if radius is not None:
            limit = pairs.withColumn("limit", F.lit(float(radius)))
        else:
            # the k + 1 nearest are no farther than the far end of the nearest blocks that hold so many
            reach = Window.partitionBy("q").orderBy(F.col("d") + F.col("r"), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            held = pairs.withColumn("held", F.sum("n").over(reach))
            far = held.where(F.col("held") > k).groupBy("q").agg(F.min(F.col("d") + F.col("r")).alias("limit"))
            limit = pairs.join(far, "q", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
        return limit.where(F.col("d") - F.col("r") <= F.col("limit") + 1e-6).select("q", "block")

    def _compare(self, queries: DataFrame, keep: Callable, k: int | None, radius: float | None, probes: int | None, same: bool, exclude_zero: bool) -> DataFrame:
        asked = checkpointed(_clustered(_vectors(queries, self.key, self.vector), self.centres, self.metric, self.size))
        visits = self._visits(asked, k, radius, probes)
        both = visits.join(asked.select(F.col("block").alias("q"), "ids", "rows"), "q").join(self.blocks.select("block", F.col("ids").alias("ids2"), F.col("rows").alias("rows2")), "block")
        return _measured(both, keep, self.metric, same, exclude_zero)

    def query(self, queries: DataFrame, k: int, *, probes: int | None = None, same: bool = False, exclude_zero: bool = False) -> DataFrame:
        """(src, rank, dst, dist) of the k nearest; with ``probes``, of those in so many blocks for each block of queries."""
        return _ranked(self._compare(queries, lambda d, i, j: _best(d, k, j), k if not exclude_zero else None, float("inf") if exclude_zero else None, probes, same, exclude_zero), k)

    def query_radius(self, queries: DataFrame, radius: float, *, same: bool = False) -> DataFrame:
        """(src, dst, dist) within a radius."""
        return self._compare(queries, lambda d, i, j: np.nonzero(d <= radius), None, radius, None, same, False)

    def statistics(self) -> DataFrame:
        return self.blocks.agg(F.count("*").alias("blocks"), F.sum("n").alias("points"), F.max("n").alias("largest"), F.avg("radius").alias("mean_radius"))


#: Centres of an index at most; metrics with the triangle inequality.
CENTRES = 4_096
TRIANGLE = {"euclidean", "manhattan"}


def _vectors(points: DataFrame, key: str, vector: str) -> DataFrame:
    some = points.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    return some.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def _apart(metric: str) -> Callable[[Column, Column], Column]:
    from ..functions.vectors import METRICS

    return METRICS[metric]


def _clustered(some: DataFrame, centres: np.ndarray, metric: str, size: int) -> DataFrame:
    """(block, ids, rows, centre, radius, n) of (id, v): by nearest centre, in parts of some ``size`` rows."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
                cell = distances(x, centres, metric).argmin(axis=1) if len(centres) else np.zeros(b.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

    placed = checkpointed(some.mapInArrow(nearest, "id long, v array<double>, cell int"))
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("parts"))  # a row a centre
    spread = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    def pack(keys: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", kind="stable")
        x = np.stack(f["v"].to_list()).astype(float)
        middle = x.mean(axis=0)
        return pd.DataFrame({"block": [int(keys[0]) << 32 | int(keys[1])], "ids": [f["id"].to_numpy(np.int64).tobytes()], "rows": [x.tobytes()], "centre": [middle], "radius": [float(distances(middle[None], x, metric).max())], "n": [len(f)]})

    return spread.groupBy("cell", "part").applyInPandas(pack, "block long, ids binary, rows binary, centre array<double>, radius double, n long")


def knn_strategy(queries: int, points: int, size: int = BLOCK) -> str:
    """"blocks" (every block of queries with every block of points) up to some 16 million block pairs' worth of rows, "index" beyond."""
    return "blocks" if queries * points <= (4_096 * size) ** 2 // 1_024 else "index"


def hybrid_knn(queries: DataFrame, points: DataFrame, k: int, **options: object) -> DataFrame:
    """knn_join() or, where knn_strategy() says so, BlockIndex; both are exact and give the same rows."""
    if knn_strategy(queries.count(), points.count()) == "blocks":
        return knn_join(queries, points, k, **options)
    own = {x: options[x] for x in ("key", "vector", "metric", "size") if x in options}
    return BlockIndex.build(points, **own).query(queries, k, same=bool(options.get("same", False)))


def knn_graph(points: DataFrame, k: int, **options: object) -> DataFrame:
    """The k nearest other points of each point."""
    return knn_join(points, points, k, same=True, **options)


def range_join(queries: DataFrame, points: DataFrame, radius: float, *, key: str = "id", vector: str = "embedding", metric: str = "euclidean", same: bool = False, size: int = BLOCK) -> DataFrame:
    """(src, dst, dist) of all pairs within a radius."""
    asked = checkpointed(packed(queries, key, vector, size))
    given = checkpointed(packed(points, key, vector, WIDE * size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sieve = None, None
        for q, i, a, _, j, b in _blocks(batches):
            if metric == "euclidean" and (sieve is None or q != block):
                block, sieve = q, _Sieve(a)
            for x, y, d in _within(a, b, np.full(len(a), float(radius)), metric, sieve):
                src, dst = i[x], j[y]
                apart = src != dst if same else np.ones(len(src), bool)
                yield from _sent(src[apart], dst[apart], d[apart])

    return _beside(asked, given).mapInArrow(run, "src long, dst long, dist double")


def pairwise(points: DataFrame, *, key: str = "id", vector: str = "embedding", metric: str = "euclidean", size: int = BLOCK, core: str | None = None) -> DataFrame:
    """(src, dst, dist) of all pairs with src < dst; with ``core``, a column, no less than that of either end.

    Each pair of blocks is computed once, and nothing is shuffled but the blocks.
    """
    some = points.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.concat(F.array(F.col(core) if core else F.lit(0.0)), F.col(vector).cast("array<double>")).alias("embedding"))
    wide = checkpointed(packed(some, size=size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, i, a, block2, j, b in _blocks(batches):
            d = np.round(distances(a[:, 1:], b[:, 1:], metric), PLACES)
            if core:
                d = np.maximum(d, np.maximum(a[:, :1], b[None, :, 0]))
            x, y = np.nonzero(i[:, None] < j[None, :] if block == block2 else i[:, None] != j[None, :])
            src, dst = i[x], j[y]
            yield from _sent(np.minimum(src, dst), np.maximum(src, dst), d[x, y])

    return _beside(wide, wide).where("block <= block2").mapInArrow(run, "src long, dst long, dist double")


def core_distances(points: DataFrame, min_samples: int, *, key: str = "id", vector: str = "embedding", size: int = 2 * BLOCK, metric: str = "euclidean", exclude_zero: bool = False) -> DataFrame:
    """(id, core): the distance to the min_samples-th other point, or the farthest if there are fewer; 0 of a single point.

    exclude_zero: points at no distance don't count, as in batch kernels that can't tell them from the point itself.
    """
    near = knn_graph(points, max(1, min_samples), key=key, vector=vector, size=size, metric=metric, exclude_zero=exclude_zero)
    cores = near.groupBy(F.col("src").alias("id")).agg(F.max("dist").alias("core"))
    return points.select(F.col(key).cast("long").alias("id")).join(cores, "id", "left").select("id", F.coalesce("core", F.lit(0.0)).alias("core"))


def core_statistics(cores: DataFrame) -> DataFrame:
    return cores.agg(F.min("core").alias("min_core"), F.max("core").alias("max_core"), F.avg("core").alias("mean_core"))


def mutual_reachability(points: DataFrame, min_samples: int, **options: object) -> DataFrame:
    """(src, dst, mrd) with src < dst: the largest of the two core distances and the distance."""
    own = {x: options[x] for x in ("key", "vector", "metric", "size") if x in options}
    key, vector = own.pop("key", "id"), own.pop("vector", "embedding")
    cores = core_distances(points, min_samples, key=key, vector=vector, **{x: options[x] for x in options if x not in ("key", "vector")})
    with_cores = points.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).join(cores, "id")
    return pairwise(with_cores, vector="v", core="core", **own).withColumnRenamed("dist", "mrd")


def symmetrised(graph: DataFrame) -> DataFrame:
    """Undirected edges of a graph (src, dst, dist), both ways, with the smaller distance."""
    both = graph.select("src", "dst", "dist").union(graph.select("dst", "src", "dist"))
    return both.groupBy("src", "dst").agg(F.min("dist").alias("dist"))


def is_symmetric(graph: DataFrame) -> bool:
    g = graph.select("src", "dst")
    return g.exceptAll(g.select("dst", "src")).isEmpty()


def graph_statistics(graph: DataFrame) -> DataFrame:
    return graph.agg(F.count_distinct("src").alias("nodes"), F.count("*").alias("edges"), F.min("dist").alias("min_dist"), F.max("dist").alias("max_dist"), F.avg("dist").alias("mean_dist"))


def connected_components(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the smallest id that can be reached; pointers are shortened each round, until nothing changes."""
    edges = checkpointed(graph.select("src", "dst").union(graph.select("dst", "src")).where("src != dst").distinct())
    labels = checkpointed(nodes.select(F.col(nodes.columns[0]).cast("long").alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        near = edges.join(labels, edges["dst"] == labels["id"]).groupBy("src").agg(F.min("component").alias("c"))
        step = labels.join(near, labels["id"] == near["src"], "left").select("id", F.least("component", "c").alias("m"), "component")
        jump = checkpointed(step.join(labels.toDF("m", "mm"), "m", "left").select("id", F.least("m", "mm").alias("new"), "component"))
        labels = jump.select("id", F.col("new").alias("component"))
        if jump.where("new != component").isEmpty():
            return labels
