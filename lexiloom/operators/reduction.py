"""Dimension reduction: PCA, and UMAP on the k-nearest-neighbour graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg
from ..functions.vectors import dimension_of
from . import neighbours
from .lineage import checkpointed


class Reducer(Protocol):
    """fit() on (key, vector) rows, then transform() of such rows to (key, vector) of fewer numbers."""

    def fit(self, points: DataFrame, key: str = ..., vector: str = ...) -> Reducer: ...

    def transform(self, points: DataFrame, key: str = ..., vector: str = ...) -> DataFrame: ...


class Identity:
    def fit(self, points: DataFrame, key: str = "id", vector: str = "embedding") -> Identity:
        return self

    def transform(self, points: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
        return points.select(key, F.col(vector).cast("array<double>").alias(vector))


def column_moments(points: DataFrame, vector: str, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sums and products of the columns, summed by partition and then here: d * d numbers for each partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, p = 0, np.zeros(d), np.zeros((d, d))
        for f in frames:
            if len(f):
                x = np.stack(f[vector].to_list()).astype(float)
                n, s, p = n + len(x), s + x.sum(axis=0), p + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tobytes()], "p": [p.tobytes()]})

    def merge(keys: tuple, f: pd.DataFrame) -> pd.DataFrame:
        add = lambda c: np.sum([np.frombuffer(x) for x in f[c]], axis=0).tobytes()
        return pd.DataFrame({"n": [f["n"].sum()], "s": [add("s")], "p": [add("p")]})

    parts = points.select(F.col(vector).cast("array<double>").alias(vector)).mapInPandas(run, "n long, s binary, p binary")
    rows = parts.groupBy((F.spark_partition_id() % 16).alias("g")).applyInPandas(merge, "n long, s binary, p binary").collect()
    return sum(r["n"] for r in rows), sum(np.frombuffer(r["s"]) for r in rows), sum(np.frombuffer(r["p"]) for r in rows).reshape(d, d)


@dataclass
class PCA:
    """Principal components of the covariance with a small ridge; signs are fixed by the largest loading."""

    components: int = 15
    variance_ratio: float | None = None
    whiten: bool = False
    mean: np.ndarray | None = field(default=None, repr=False)
    eigenvalues: np.ndarray | None = field(default=None, repr=False)
    axes: np.ndarray | None = field(default=None, repr=False)

    def fit(self, points: DataFrame, key: str = "id", vector: str = "embedding") -> PCA:
        d = dimension_of(points, vector)
        n, s, p = column_moments(points, vector, d)
        if n < 2:
            raise ValueError("PCA needs two points or more")
        if self.variance_ratio is None and not 1 <= self.components <= min(d, n - 1):
            raise ValueError("more components than the data have")
        mean = s / n
        covariance = (p - n * np.outer(mean, mean)) / (n - 1)
        values, vectors = linalg.symmetric_eigen(linalg.regularize(covariance))
        k = self.components if self.variance_ratio is None else linalg.components_for_variance(values, self.variance_ratio)
        return replace(self, components=k, mean=mean, eigenvalues=values, axes=vectors[:, :k])

    @property
    def explained_variance_ratios(self) -> np.ndarray:
        """Of the kept components, over the kept ones."""
        return linalg.variance_ratios(self.eigenvalues[: self.components])

    @property
    def cumulative_explained_variance(self) -> float:
        """Of the kept components, over all."""
        return float(linalg.cumulative_variance_ratio(self.eigenvalues)[self.components - 1])

    def project(self, x: np.ndarray) -> np.ndarray:
        y = (x - self.mean) @ self.axes
        scale = np.sqrt(np.maximum(self.eigenvalues[: self.components], 0))
        return np.where(scale > 1.1920929e-07, y / np.where(scale > 0, scale, 1), y) if self.whiten else y

    def transform(self, points: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
        if self.axes is None:
            raise ValueError("not fitted")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    f[vector] = list(self.project(np.stack(f[vector].to_list()).astype(float)))
                yield f

        some = points.select(key, F.col(vector).cast("array<double>").alias(vector))
        return some.mapInPandas(run, some.schema)


def fuzzy_weights(graph: DataFrame, k: int) -> DataFrame:
    """(src, dst, weight, rho, sigma) of a kNN graph: exp(-(d - rho) / sigma), where each row's weights sum to log2 k."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            n = f["dist"].map(len).to_numpy()
            d = np.full((len(f), n.max()), np.inf)
            d[np.arange(n.max())[None, :] < n[:, None]] = np.concatenate(f["dist"].to_list())
            rho, sigma = smooth_distances(d, k)
            w = memberships(d, rho, sigma)
            f["weight"] = [list(w[i, : n[i]]) for i in range(len(f))]
            f["rho"], f["sigma"] = rho, sigma
            yield f[["src", "dst", "weight", "rho", "sigma"]]

    lists = graph.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dist", "dst"))).alias("near")).select("src", F.col("near.dst").alias("dst"), F.col("near.dist").alias("dist"))
    weighted = lists.mapInPandas(run, "src long, dst array<long>, weight array<double>, rho double, sigma double")
    return weighted.select("src", F.explode(F.arrays_zip("dst", "weight")).alias("e"), "rho", "sigma").select("src", "e.dst", "e.weight", "rho", "sigma")


def smooth_distances(d: np.ndarray, k: int, rounds: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """rho, the nearest distance of each row, and sigma by bisection for all rows at once."""
    rho = d.min(axis=1)
    target = np.log2(max(k, 2))
    low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(rounds):
        total = np.exp(-np.maximum(d - rho[:, None], 0) / sigma[:, None]).sum(axis=1)
        over = total > target
        high, low = np.where(over, sigma, high), np.where(over, low, sigma)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
        sigma = np.clip(sigma, 1e-10, 1e10)
    return rho, sigma


def memberships(d: np.ndarray, rho: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    over = d - rho[:, None]
    return np.where(over <= 0, 1.0, np.where(over > 20 * sigma[:, None], 0.0, np.exp(-over / sigma[:, None])))


def epochs_per_edge(edges: DataFrame, epochs: int) -> DataFrame:
    """Edges with how many of the epochs each is drawn in."""
    top = edges.agg(F.max("weight").alias("__top"))
    return edges.crossJoin(F.broadcast(top)).withColumn("epochs", epochs * F.col("weight") / F.col("__top")).drop("__top")


def edges_above(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.where(F.col("weight") > threshold)


def membership(edges: DataFrame, src: int, dst: int) -> DataFrame:
    """One row (weight) of an edge, 0 if there is none."""
    return edges.where((F.col("src") == src) & (F.col("dst") == dst)).agg(F.coalesce(F.max("weight"), F.lit(0.0)).alias("weight"))


def fuzzy_statistics(edges: DataFrame) -> DataFrame:
    """One row: edges, their total weight, and its least, largest and mean; 0 of none."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    w = F.col("weight")
    return edges.agg(F.count("*").alias("edges"), zero(F.sum(w)).alias("total"), zero(F.min(w)).alias("min"), zero(F.max(w)).alias("max"), zero(F.avg(w)).alias("mean"))


def curve(min_dist: float) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b), fitted to a step at min_dist with an exponential tail, by Gauss-Newton on the logarithms."""
    x = np.linspace(0.01, 3, 300)
    y = np.where(x <= min_dist, 1.0, np.exp(-(x - min_dist)))
    p = np.array([0.5, 0.0])
    for _ in range(200):
        a, b = np.exp(p)
        u = a * x ** (2 * b)
        f = 1 / (1 + u)
        j = np.stack([-f * f * u, -f * f * u * 2 * b * np.log(x)], axis=1)
        p += np.linalg.solve(j.T @ j + 1e-6 * np.eye(2), j.T @ (y - f)) * 0.5
    return float(np.exp(p[0])), float(np.exp(p[1]))


def learning_rate(start: float, epoch: int, epochs: int, decay: str = "linear") -> float:
    t = epoch / epochs
    return start * {"linear": 1 - t, "cosine": 0.5 * (1 + np.cos(np.pi * t)), "none": 1.0}[decay]


def spectral_layout(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, components: int) -> np.ndarray:
    """Eigenvectors of the normalised Laplacian after the smallest."""
    a = np.zeros((n, n))
    np.add.at(a, (src, dst), weight)
    d = a.sum(axis=1)
    s = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    _, v = np.linalg.eigh(np.eye(n) - s[:, None] * a * s[None, :])
    return v[:, 1 : components + 1]


def scaled_layout(y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Three deviations at 10, clipped there, with a small offset."""
    spread = np.maximum(y.std(axis=0), 1e-12)
    return np.clip((y - y.mean(axis=0)) / (3 * spread) * 10, -10, 10) + rng.uniform(-1e-4, 1e-4, y.shape)


def summed(n: int, *parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums by place, a row a coordinate: what each part has is added to its places, in order. As np.add.at(), but many times faster."""
    at = np.concatenate([i for i, _ in parts])
    return np.stack([np.bincount(at, np.concatenate([x[c] for _, x in parts]), n) for c in range(len(parts[0][1]))])


def _squares(diff: np.ndarray) -> np.ndarray:
    """Squared lengths of the columns; eight coordinates or more are added in the order in which numpy adds a row."""
    if len(diff) < 8:
        return sum((x * x for x in diff[1:]), diff[0] * diff[0])
    return np.ascontiguousarray((diff * diff).T).sum(axis=1)


def optimise_layout(y: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, *, epochs: int, rate: float = 1.0, min_dist: float = 0.1, negatives: int = 5, clip: float = 4.0, decay: str = "linear", seed: int = 42, first: int = 0, last: int | None = None) -> np.ndarray:
    """Stochastic gradient descent, all edges of an epoch at once: neighbours attract, random others repel.

    An edge is drawn in an epoch with its share of the largest weight, so that it comes to epochs_per_edge()
    on average. Epochs ``first`` to ``last`` are run; each draws by its own seed, so that a layout which is
    interrupted and resumed is the same.
    """
    a, b = curve(min_dist)
    chance = weight / weight.max()
    # a row a coordinate, so that each step runs over whole rows
    y, n = np.array(y.T, order="C"), len(y)
    for e in range(first, epochs if last is None else min(last, epochs)):
        rng = np.random.default_rng([seed, e])
        alpha = learning_rate(rate, e, epochs, decay)
        on = rng.random(len(src)) < chance
        i, j = src[on], dst[on]
        diff = y.take(i, axis=1) - y.take(j, axis=1)
        square = np.maximum(_squares(diff), 1e-12)
        pull = np.clip((-2 * a * b * square ** (b - 1) / (1 + a * square**b)) * diff, -clip, clip)
        far = np.repeat(i, negatives)
        other = rng.integers(n, size=len(far))
        diff = y.take(far, axis=1) - y.take(other, axis=1)
        square = _squares(diff)
        push = np.clip((2 * b / ((0.001 + square) * (1 + a * square**b))) * diff, -clip, clip)
        push[:, far == other] = 0
        y += alpha * np.clip(summed(n, (i, pull), (j, -pull), (far, push)), -clip, clip)
    return np.array(y.T, order="C")


def _one_task(edges: DataFrame, start: DataFrame, lay: Callable) -> DataFrame:
    """A layout of edges (row, col, value) and places (id, start), which are of bounded number."""
    one = lambda t: t.withColumn("__one", F.lit(1)).groupBy("__one")
    return one(edges).cogroup(one(start)).applyInPandas(lay, "id long, embedding array<double>")


def _arrays(e: pd.DataFrame, p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and places in order of id, and the edges by position."""
    p, e = p.sort_values("id"), e.sort_values(["row", "col"])
    ids = p["id"].to_numpy()
    return ids, np.stack(p["start"].to_list()), np.searchsorted(ids, e["row"]), np.searchsorted(ids, e["col"]), e["value"].to_numpy()


def _layer(options: dict, first: int, last: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What runs epochs first to last in the one task."""

    def lay(keys: tuple, e: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        ids, y, i, j, w = _arrays(e, p)
        return pd.DataFrame({"id": ids, "embedding": list(optimise_layout(y, i, j, w, **options, first=first, last=last))})

    return lay


@dataclass
class UMAP:
    """Layout of the fuzzy neighbour graph. Graph and weights are distributed; the layout is a task of at most ``most`` points.

    Of a larger table ``most`` points, chosen by hash of their id, are laid out, and the others placed among
    them as new points are. "spectral" starts are computed for up to 10,000 points and random ones beyond.
    With ``segment`` the layout is stored each so many epochs, and should_stop() is asked in between; a fit
    that was stopped holds ``layout`` and ``epoch``, and resume() goes on there.
    """

    components: int = 15
    k: int = 15
    min_dist: float = 0.1
    metric: str = "euclidean"
    epochs: int | None = None
    rate: float = 1.0
    initialization: str = "pca"
    negatives: int = 5
    decay: str = "linear"
    seed: int = 42
    most: int = 50_000
    segment: int | None = None
    should_stop: Callable[[], bool] | None = field(default=None, repr=False, compare=False)
    layout: DataFrame | None = field(default=None, repr=False)
    trained: DataFrame | None = field(default=None, repr=False)
    edges: DataFrame | None = field(default=None, repr=False)
    epoch: int = 0

    @classmethod
    def preset(cls, name: str) -> UMAP:
        """default; fast: few neighbours and epochs; quality: many; clustering: tight, for density clustering; visualisation: two dimensions."""
        return {
            "default": cls(),
            "fast": cls(k=10, epochs=100),
            "quality": cls(k=30, epochs=500, initialization="spectral"),
            "clustering": cls(k=30, min_dist=0.0),
            "visualisation": cls(2, min_dist=0.1),
        }[name]

    @property
    def finished(self) -> bool:
        return self.layout is not None and self.epoch >= self.epochs

    def _epochs(self, n: int) -> int:
        return self.epochs or (500 if n <= 200 else 200 if n <= 10_000 else 100)

    def fit(self, points: DataFrame, key: str = "id", vector: str = "embedding") -> UMAP:
        every = points.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("embedding"))
        n = every.count()
        if n < 2:
            raise ValueError("UMAP needs two points or more")
        some = every
        if n > self.most:
            some, n = checkpointed(every.orderBy(F.xxhash64("id", F.lit(self.seed)), "id").limit(self.most)), self.most
        k = min(self.k, n - 1)
        weights = fuzzy_weights(neighbours.knn_graph(some, k, metric=self.metric), k)
        from ..functions.sparse import fuzzy_union

        edges = checkpointed(fuzzy_union(weights.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("value"))))
        start = self._start(some, n)
        spectral, components, seed = self.initialization == "spectral" and n <= 10_000, self.components, self.seed

        def begin(keys: tuple, e: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            ids, y, i, j, w = _arrays(e, p)
            if spectral:
                v = spectral_layout(len(ids), i, j, w, components)
                y = np.pad(v, ((0, 0), (0, components - v.shape[1])))
            return pd.DataFrame({"id": ids, "embedding": list(scaled_layout(y, np.random.default_rng(seed)))})

        laid = checkpointed(_one_task(edges, start, begin))
        begun = replace(self, layout=laid, trained=some, edges=edges, epoch=0, epochs=self._epochs(n))
        return begun.resume(every)

    def resume(self, points: DataFrame | None = None) -> UMAP:
        """Run the epochs that are left; points: all of them, where they are more than those of the layout."""
        options = {"epochs": self.epochs, "rate": self.rate, "min_dist": self.min_dist, "negatives": self.negatives, "decay": self.decay, "seed": self.seed}
        laid, epoch = self.layout, self.epoch
        while epoch < self.epochs:
            if self.should_stop is not None and self.should_stop():
                return replace(self, layout=laid, epoch=epoch)
            last = min(self.epochs, epoch + (self.segment or self.epochs))
            laid, epoch = checkpointed(_one_task(self.edges, laid.withColumnRenamed("embedding", "start"), _layer(options, epoch, last))), last
        done = replace(self, layout=laid, epoch=epoch)
        if points is not None and points.count() > laid.count():
            done = replace(done, layout=checkpointed(done.transform(points)))
        return done

    def _start(self, some: DataFrame, n: int) -> DataFrame:
        c, seed = self.components, self.seed
        d = dimension_of(some)
        if self.initialization == "pca" and min(d, n - 1) >= 1:
            fitted = PCA(min(c, d, n - 1)).fit(some).transform(some)
            pad = F.array_repeat(F.lit(0.0), c - min(c, d, n - 1))
            return fitted.select("id", F.concat("embedding", pad).alias("start"))

        def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"id": f["id"], "start": [np.random.default_rng([seed, int(i) & 0xFFFFFFFF]).uniform(-10, 10, c) / np.sqrt(n) for i in f["id"]]})

        return some.select("id").mapInPandas(draw, "id long, start array<double>")

    def transform(self, points: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
        """Training points by key; others at the mean of their neighbours' places, weighted by 1 / (distance + 0.001)."""
        if self.layout is None:
            raise ValueError("not fitted")
        some = points.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("embedding"))
        known = some.join(self.trained.select("id", F.col("embedding").alias("__old")), "id").where("embedding = __old").select("id").join(self.layout, "id")
        new = some.join(known.select("id"), "id", "left_anti")
        near = neighbours.knn_join(new, self.trained, self.k, metric=self.metric)
        w = 1 / (F.col("dist") + 0.001)
        placed = near.join(self.layout.toDF("dst", "at"), "dst").withColumn("w", w).groupBy(F.col("src").alias("id"))
        moved = placed.agg(F.array(*[F.sum(F.col("at")[i] * F.col("w")) / F.sum("w") for i in range(self.components)]).alias("embedding"))
        return known.unionByName(moved).select(F.col("id").alias(key), F.col("embedding").alias(vector))


class Builder:
    """Settings of an engine one by one, each a call of the setting's name: Builder(UMAP).k(10).epochs(50).build()."""

    def __init__(self, engine: type, **settings: object) -> None:
        self._type, self._settings = engine, settings

    def __getattr__(self, name: str) -> Callable[[object], Builder]:
        if name.startswith("_") or name not in self._type.__dataclass_fields__:
            raise AttributeError(name)
        return lambda value: type(self)(**{**self._own(), name: value})

    def _own(self) -> dict[str, object]:
        return dict(self._settings) if type(self) is not Builder else {"engine": self._type, **self._settings}

    def build(self) -> object:
        return self._type(**self._settings)


class PCABuilder(Builder):
    def __init__(self, **settings: object) -> None:
        super().__init__(PCA, **settings)


class UMAPBuilder(Builder):
    def __init__(self, **settings: object) -> None:
        super().__init__(UMAP, **settings)


def pca(points: DataFrame, components: int, **options: str) -> DataFrame:
    return PCA(components).fit(points, **options).transform(points, **options)


def pca_with_variance(points: DataFrame, ratio: float, **options: str) -> DataFrame:
    return PCA(variance_ratio=ratio).fit(points, **options).transform(points, **options)


def umap(points: DataFrame, components: int = 2, **settings: object) -> DataFrame:
    return UMAP(components, **settings).fit(points).layout
