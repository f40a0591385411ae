"""Density clustering: core distances, minimum spanning tree of mutual reachability, hierarchy and extraction.

The spanning tree is exact: Boruvka's rounds, in which each component takes its least edge out. The first
ones need only the graph of NEAR neighbours, as what is not in it is longer than the farthest neighbour of
either end. Where that doesn't tell, the points that may have a shorter edge are compared with all others
on the executors; the largest component is never asked. The driver holds the labels of the points and the
forest of the graph, which is reduced on the executors, ``FAN`` parts at a time; the hierarchy is built
there too. Training can stop between these steps.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import neighbours
from .neighbours import distances
from .lineage import checkpointed
from .reduction import Builder
from ..functions.vectors import METRICS

SMALLEST = 1e-12


class UnionFind:
    def __init__(self, n: int) -> None:
        self.parent, self.size = list(range(n)), [1] * n

    def find(self, x: int) -> int:
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.parent[b] = a
        self.size[a] += self.size[b]
        return True


def prim(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges of a minimum spanning tree of a dense matrix."""
    n = len(weights)
    if n < 2:
        return []
    best, parent, out = weights[0].copy(), np.zeros(n, int), np.zeros(n, bool)
    out[0] = True
    edges = []
    for _ in range(n - 1):
        j = int(np.where(out, np.inf, best).argmin())
        edges.append((int(parent[j]), j, float(best[j])))
        out[j] = True
        closer = ~out & (weights[j] < best)
        best[closer], parent[closer] = weights[j][closer], j
    return edges


def forest(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which edges make up the minimum spanning forest of a graph, ties in order of the ends: Boruvka's rounds over arrays."""
    order = np.lexsort((dst, src, weight))
    ids, ends = np.unique(np.concatenate([src[order], dst[order]]), return_inverse=True)
    a, b = ends[: len(order)], ends[len(order) :]
    n, part, chosen, live = len(ids), np.arange(len(ids)), np.zeros(len(order), bool), np.arange(len(order))
    while True:
        x, y = part[a[live]], part[b[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            return order[chosen]
        best = np.full(n, len(order))
        np.minimum.at(best, x, live)
        np.minimum.at(best, y, live)
        own = np.flatnonzero(best < len(order))
        edge = best[own]
        chosen[edge] = True
        other = np.where(part[a[edge]] == own, part[b[edge]], part[a[edge]])
        parent = np.arange(n)
        parent[own] = other
        mutual = own[(parent[other] == own) & (own < other)]
        parent[mutual] = mutual
        while (parent != parent[parent]).any():
            parent = parent[parent]
        part = parent[part]


def kruskal(ids: np.ndarray, edges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The spanning tree that a set of edges (of ids) contains; ties in order of the ids."""
    if not edges:
        return []
    a, b, w = (np.array(x) for x in zip(*edges, strict=True))
    a, b = np.minimum(a, b), np.maximum(a, b)
    kept = forest(a, b, w)
    kept = kept[np.lexsort((b[kept], a[kept], w[kept]))]
    return list(zip(a[kept].tolist(), b[kept].tolist(), w[kept].tolist(), strict=True))


#: So many forests are joined by one task.
FAN = 8
#: Edges that a task gathers before it reduces them.
GATHERED = 1 << 20
#: Neighbours of each point in the graph that a tree begins with.
NEAR = 16
_EDGES = "src long, dst long, weight double"


def _edge_batch(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(weight, pa.float64())], ["src", "dst", "weight"])


def _reduced(batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The forest of edges that come in parts."""
    held, n = [], 0
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def join(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        kept = forest(a, b, w)
        return a[kept], b[kept], w[kept]

    for part in batches:
        held.append(part)
        n += len(part[0])
        if n > 2 * GATHERED:
            held = [join(held)]
            n = max(0, len(held[0][0]) - GATHERED)
    return join(held) if held else empty


def reachability(points: DataFrame, min_samples: int, *, key: str = "id", vector: str = "embedding", size: int = 2 * neighbours.BLOCK, metric: str = "euclidean") -> tuple[DataFrame, DataFrame]:
    """The graph of the nearest (src, rank, dst, dist), and (id, core, reach): no neighbour that is missing from the graph is nearer than reach."""
    k, wide = max(1, min_samples), max(min_samples, NEAR)
    near = checkpointed(neighbours.knn_graph(points, wide, key=key, vector=vector, metric=metric, size=size))
    own = near.groupBy(F.col("src").alias("id")).agg(F.max(F.when(F.col("rank") <= k, F.col("dist"))).alias("core"), F.max("dist").alias("reach"), F.count("*").alias("n"))
    every = points.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"))
    reach = F.when(F.col("n") >= wide, F.col("reach")).otherwise(float("inf"))
    return near, checkpointed(every.join(own, "id", "left").select("id", F.coalesce("core", F.lit(0.0)).alias("core"), reach.alias("reach")))


def _graph_forest(near: DataFrame, cores: DataFrame, should_stop: Callable[[], bool]) -> DataFrame:
    """(src, dst, weight): the forest of a graph of neighbours, weighted by mutual reachability."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _edge_batch(*_reduced((b.column("src").to_numpy(), b.column("dst").to_numpy(), b.column("weight").to_numpy()) for b in batches))

    parts = near.sparkSession.sparkContext.defaultParallelism
    c = cores.select("id", "core")
    both = near.join(c.toDF("src", "c1"), "src").join(c.toDF("dst", "c2"), "dst")
    weighted = both.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.greatest("dist", "c1", "c2").alias("weight"))
    edges, joined_up = checkpointed(weighted.mapInArrow(join, _EDGES).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts)))), False
    while parts > 1 or not joined_up:
        joined_up = True
        if should_stop():
            raise Stopped("spanning tree")
        parts = -(-parts // FAN)
        grouped = edges.select("src", "dst", "weight", F.floor(F.col("part") / FAN).cast("int").alias("part"))
        joined = grouped.repartition(parts, "part").sortWithinPartitions("part").drop("part").mapInArrow(join, _EDGES)
        edges = checkpointed(joined.withColumn("part", F.spark_partition_id()))
    return edges.select("src", "dst", "weight")


class _Least:
    """The least edge out of each component that has rows in a block (core, component, limit, vector)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, metric: str) -> None:
        self.ids, self.core, self.at, self.metric = ids, rows[:, 0], rows[:, 3:], metric
        self.part = rows[:, 1].astype(np.int32)
        self.groups, self.first, self.group = np.unique(self.part, return_index=True, return_inverse=True)
        n = len(self.groups)
        self.limit = np.full(n, np.inf)
        np.minimum.at(self.limit, self.group, rows[:, 2])
        self.weight, self.src, self.dst = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.sieve = neighbours._Sieve(self.at) if metric == "euclidean" else None

    def add(self, j: np.ndarray, rows: np.ndarray) -> None:
        core, part, b = rows[:, 0], rows[:, 1].astype(np.int32), rows[:, 2:]
        if len(self.groups) == 1 and (part == self.groups[0]).all():
            return
        # a component without a limit gets that of its first row
        free = np.flatnonzero(np.isinf(self.limit))
        if len(free):
            r = self.first[free]
            w = np.maximum(np.round(distances(self.at[r], b, self.metric), neighbours.PLACES), np.maximum(self.core[r, None], core[None, :]))
            w[(self.part[r, None] == part[None, :]) | ~np.isfinite(w)] = np.inf
            self.limit[free] = w.min(axis=1)
        for x, y, d in neighbours._within(self.at, b, self.limit[self.group], self.metric, self.sieve, (self.part, part)):
            g, w = self.group[x], np.maximum(d, np.maximum(self.core[x], core[y]))
            s, t = np.minimum(self.ids[x], j[y]), np.maximum(self.ids[x], j[y])
            kept = np.flatnonzero(w <= self.limit[g])
            kept = kept[np.lexsort((t[kept], s[kept], w[kept], g[kept]))]
            own, at = np.unique(g[kept], return_index=True)
            w, s, t = w[kept][at], s[kept][at], t[kept][at]
            better = (w < self.weight[own]) | ((w == self.weight[own]) & ((s < self.src[own]) | ((s == self.src[own]) & (t < self.dst[own]))))
            own = own[better]
            self.weight[own], self.src[own], self.dst[own] = w[better], s[better], t[better]
            self.limit[own] = w[better]

    def batch(self) -> pa.RecordBatch:
        some = np.isfinite(self.weight)
        return pa.RecordBatch.from_arrays([pa.array(self.groups[some].astype(np.int64)), pa.array(self.weight[some]), pa.array(self.src[some]), pa.array(self.dst[some])], ["part", "weight", "src", "dst"])


def _least_out(wide: DataFrame, ids: np.ndarray, part: np.ndarray, limit: np.ndarray, asked: np.ndarray, size: int, metric: str) -> pa.Table:
    """(part, e: weight, src, dst): the least edges out of the components of the points asked, no longer than their limits. wide: (id, core, v)."""
    of = wide.sparkSession.createDataFrame(pa.table({"id": ids, "part": part.astype(np.int64), "limit": limit, "asked": asked}))
    both = checkpointed(wide.join(of, "id"))
    head = lambda *c: F.concat(F.array(*[F.col(x).cast("double") for x in c]), "v").alias("embedding")
    left = checkpointed(neighbours.packed(both.where("asked").select("id", head("core", "part", "limit")), size=size))
    right = checkpointed(neighbours.packed(both.select("id", head("core", "part")), size=neighbours.WIDE * size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, None
        for q, i, a, _, j, b in neighbours._blocks(batches):
            if best is None or q != block:
                if best is not None:
                    yield best.batch()
                block, best = q, _Least(i, a, metric)
            best.add(j, b)
        if best is not None:
            yield best.batch()

    out = neighbours._beside(left, right).mapInArrow(run, "part long, weight double, src long, dst long")
    return out.groupBy("part").agg(F.min(F.struct("weight", "src", "dst")).alias("e")).select("e.src", "e.dst", "e.weight").toArrow()


def spanning_tree(points: DataFrame, min_samples: int, *, key: str = "id", vector: str = "embedding", size: int = 2 * neighbours.BLOCK, metric: str = "euclidean", should_stop: Callable[[], bool] = lambda: False, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(src, dst, weight): the minimum spanning tree of the mutual reachability graph, src < dst; known: reachability(), if it is there."""
    near, cores = known or reachability(points, min_samples, key=key, vector=vector, size=size, metric=metric)
    if should_stop():
        raise Stopped("spanning tree")
    some = points.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    wide = checkpointed(some.join(cores.select("id", "core"), "id"))
    held = cores.select("id", "reach").toArrow()
    ids, first = np.unique(held["id"].to_numpy(), return_index=True)
    reach = held["reach"].to_numpy()[first].copy()

    def placed(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.searchsorted(ids, t["src"].to_numpy()), np.searchsorted(ids, t["dst"].to_numpy()), t["weight"].to_numpy()

    def ordered(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((b, a, w))
        return a[order], b[order], w[order]

    n, part = len(ids), np.arange(len(ids))
    a, b, w = ordered(*placed(_graph_forest(near, cores, should_stop).toArrow()))
    exact, tree = np.zeros(n, bool), []
    while True:
        live = part[a] != part[b]
        a, b, w = a[live], b[live], w[live]
        best, low = np.full(n, len(a)), np.full(n, np.inf)
        for end in (a, b):
            np.minimum.at(best, part[end], np.arange(len(a)))
        np.minimum.at(low, part, reach)
        own = np.flatnonzero(best < len(a))
        limit = np.full(n, np.inf)
        limit[own] = w[best[own]]
        sure = own[exact[own] | (limit[own] < low[own])]
        if len(sure):
            edge = best[sure]
            taken = np.unique(edge)
            tree.append((a[taken], b[taken], w[taken]))
            other = np.where(part[a[edge]] == sure, part[b[edge]], part[a[edge]])
            parent = np.arange(n)
            parent[sure] = other
            mutual = sure[(parent[other] == sure) & (sure < other)]
            parent[mutual] = mutual
            while (parent != parent[parent]).any():
                parent = parent[parent]
            part, exact = parent[part], np.zeros(n, bool)
            continue
        sizes = np.bincount(part, minlength=n)
        if (sizes > 0).sum() < 2:
            break
        if should_stop():
            raise Stopped("spanning tree")
        asked = (part != sizes.argmax()) & (reach <= limit[part])
        found = placed(_least_out(wide, ids, part, limit[part], asked, size, metric))
        if not len(own) and not len(found[0]):
            break  # what is left is at no distance from the rest
        for end in found[:2]:
            np.minimum.at(limit, part[end], found[2])
        reach[asked] = np.maximum(reach[asked], limit[part[asked]])
        exact[:] = True
        exact[sizes.argmax()] = False
        a, b, w = ordered(*(np.concatenate(x) for x in zip((a, b, w), found, strict=True)))
    a, b, w = (np.concatenate([np.zeros(0, x), *(t[k] for t in tree)]) for k, x in enumerate((np.int64, np.int64, float)))
    return points.sparkSession.createDataFrame(pa.table({"src": ids[a], "dst": ids[b], "weight": w}), _EDGES)


class Stopped(RuntimeError):
    """Training was asked to stop."""


def minimum_spanning_tree(points: DataFrame, min_samples: int, **options: object) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """ids and the n - 1 edges of the tree, in the driver."""
    key = options.get("key", "id")
    ids = np.sort(points.select(F.col(key).cast("long").alias("id")).toArrow()["id"].to_numpy())
    e = spanning_tree(points, min_samples, **options).toArrow()
    return ids, kruskal(ids, list(zip(*(e[c].to_pylist() for c in ("src", "dst", "weight")), strict=True)))


def tree_statistics(edges: list[tuple[int, int, float]]) -> dict[str, float]:
    weights = [w for *_, w in edges]
    return {"edges": len(weights), "min": min(weights, default=0.0), "max": max(weights, default=0.0), "total": sum(weights)}


@dataclass
class Node:
    """A cluster of the dendrogram: born at a distance, dead where its parent is born."""

    id: int
    children: tuple[int, ...]
    birth: float
    size: int
    parent: int | None = None
    death: float = float("inf")
    stability: float = 0.0


def hierarchy(n: int, edges: list[tuple[int, int, float]]) -> dict[int, Node]:
    """Single linkage: leaves 0 to n - 1, then one node for each merge in order of weight. Edges are of positions."""
    nodes = {i: Node(i, (), 0.0, 1) for i in range(n)}
    forest, top = UnionFind(n), list(range(n))
    for a, b, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        x, y = forest.find(a), forest.find(b)
        if x == y:
            continue
        new, kids = len(nodes), (top[x], top[y])
        nodes[new] = Node(new, kids, w, nodes[kids[0]].size + nodes[kids[1]].size)
        for c in kids:
            nodes[c].parent, nodes[c].death = new, w
        forest.union(x, y)
        top[forest.find(x)] = new
    return nodes


@dataclass
class Condensed:
    """Clusters of at least the minimum size, and how each point left them."""

    parent: dict[int, int]
    born: dict[int, float]
    falls: list[tuple[int, int, float]]  # cluster, point, lambda
    sizes: dict[int, int]

    @property
    def children(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = defaultdict(list)
        for c, p in self.parent.items():
            out[p].append(c)
        return out

    def stability(self) -> dict[int, float]:
        """Sum over the points of a cluster of lambda where they leave it, less lambda where it was born."""
        out = dict.fromkeys(self.born, 0.0)
        for c, _, l in self.falls:
            out[c] += l - self.born[c]
        for c, p in self.parent.items():
            out[p] += (self.born[c] - self.born[p]) * self.sizes[c]
        return out


def condense(nodes: dict[int, Node], min_size: int) -> Condensed:
    root = max(nodes)
    out = Condensed({}, {root: 0.0}, [], {root: nodes[root].size})

    def leaves(x: int) -> list[int]:
        stack, found = [x], []
        while stack:
            y = stack.pop()
            if nodes[y].children:
                stack += nodes[y].children
            else:
                found.append(y)
        return found

    stack = [(root, root)]
    while stack:
        x, cluster = stack.pop()
        if not nodes[x].children:
            out.falls.append((cluster, x, 1 / SMALLEST))
            continue
        l = 1 / max(nodes[x].birth, SMALLEST)
        big = [c for c in nodes[x].children if nodes[c].size >= min_size]
        for c in nodes[x].children:
            if c not in big:
                out.falls += [(cluster, p, l) for p in leaves(c)]
        if len(big) == 2:
            for c in big:
                out.parent[c], out.born[c], out.sizes[c] = cluster, l, nodes[c].size
                stack.append((c, c))
        elif big:
            stack.append((big[0], cluster))
    return out


def select_clusters(tree: Condensed, method: str = "eom", allow_single: bool = False, epsilon: float = 0.0, stability: str = "standard") -> list[int]:
    """Clusters of greatest stability (eom), or the leaves; below epsilon they give way to the first ancestor born above it.

    stability="reference": all stabilities are 0, so that no cluster beats its children.
    """
    root = next(c for c in tree.born if c not in tree.parent)
    children = tree.children
    values = tree.stability() if stability == "standard" else dict.fromkeys(tree.born, 0.0)
    order = sorted(tree.born)  # node numbers grow towards the root
    chosen = {c: not children.get(c) for c in order}
    if method == "eom":
        best = {}
        for c in order:
            below = sum(best[k] for k in children.get(c, []))
            own = values[c] if c != root or allow_single else float("-inf")
            chosen[c] = not children.get(c) or own > below or (stability == "standard" and own == below)
            best[c] = max(own, below) if children.get(c) else values[c]
        for c in reversed(order):
            if chosen[c]:
                stack = list(children.get(c, []))
                while stack:
                    k = stack.pop()
                    chosen[k] = False
                    stack += children.get(k, [])
    if not allow_single and root in chosen:
        chosen[root] = False
    picked = [c for c in order if chosen[c]]
    if epsilon > 0:
        kept = set()
        for c in picked:
            while c in tree.parent and 1 / max(tree.born[c], SMALLEST) < epsilon and (tree.parent[c] != root or allow_single):
                c = tree.parent[c]
            kept.add(c)

        def inside(c: int) -> bool:
            while c in tree.parent:
                c = tree.parent[c]
                if c in kept:
                    return True
            return False

        picked = [c for c in sorted(kept) if not inside(c)]
    return picked


def extract(n: int, tree: Condensed, picked: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Label and probability of each point: lambda where it leaves its cluster over the largest one there."""
    number = {c: i for i, c in enumerate(sorted(picked))}
    label, strength = np.full(n, -1), np.zeros(n)
    owner: dict[int, int | None] = {}
    for c in sorted(tree.born, reverse=True):
        owner[c] = number[c] if c in number else owner.get(tree.parent.get(c, -1))
    for c, p, l in tree.falls:
        if owner[c] is not None:
            label[p], strength[p] = owner[c], l
    for k in range(len(picked)):
        own = label == k
        if own.any():
            strength[own] = np.minimum(strength[own] / strength[own].max(), 1)
    return label, strength


@dataclass
class HDBSCAN:
    min_cluster_size: int = 5
    min_samples: int | None = None
    epsilon: float = 0.0
    method: str = "eom"
    allow_single: bool = False
    metric: str = "euclidean"
    stability: str = "standard"
    should_stop: Callable[[], bool] | None = field(default=None, repr=False, compare=False)
    assignment: DataFrame | None = field(default=None, repr=False)
    centroids: DataFrame | None = field(default=None, repr=False)
    mean_core: float = 0.0
    tree: Condensed | None = field(default=None, repr=False)
    nodes: dict[int, Node] | None = field(default=None, repr=False)
    edges: list[tuple[int, int, float]] | None = field(default=None, repr=False)

    def fit(self, points: DataFrame, key: str = "id", vector: str = "embedding") -> HDBSCAN:
        """assignment: (key, label, probability, outlier_score); -1 is no cluster."""
        if self.min_cluster_size < 2 or self.metric not in METRICS:
            raise ValueError(f"min_cluster_size must be 2 or more, and the metric one of {sorted(METRICS)}")
        spark = points.sparkSession
        n, some = points.count(), self.min_samples or self.min_cluster_size
        known = reachability(points, some, key=key, vector=vector, metric=self.metric)
        cores = known[1].select("id", "core")
        if n < 2 or n < self.min_cluster_size:
            ids, label, strength, tree, nodes, edges = points.select(F.col(key).cast("long")).toPandas().iloc[:, 0].to_numpy(), np.full(n, -1), np.zeros(n), None, None, []
        else:
            ids, edges = minimum_spanning_tree(points, some, key=key, vector=vector, metric=self.metric, should_stop=self.should_stop or (lambda: False), known=known)
            nodes = hierarchy(n, [(int(np.searchsorted(ids, a)), int(np.searchsorted(ids, b)), w) for a, b, w in edges])
            tree = condense(nodes, self.min_cluster_size)
            label, strength = extract(n, tree, select_clusters(tree, self.method, self.allow_single, self.epsilon, self.stability))
        found = spark.createDataFrame(pd.DataFrame({"id": ids.astype(np.int64), "label": label.astype(np.int32), "probability": strength}), "id long, label int, probability double")
        scored = checkpointed(found.join(cores, "id"))
        top = scored.agg(F.max("core"), F.avg("core")).first()
        mean = F.avg("core").over(Window.partitionBy("label"))
        score = F.when(F.lit(not top[0]), 0.0).when(F.col("label") == -1, F.col("core") / F.lit(top[0] or 1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("core") - mean) / F.lit(top[0] or 1.0)))
        result = scored.select(F.col("id").alias(key), "label", "probability", score.alias("outlier_score"))
        from ..functions.vectors import centroids

        own = points.select(F.col(key).cast("long").alias("id"), vector).join(found.where("label != -1"), "id")
        middle = centroids(own, "label", vector, len(points.first()[vector])) if n else None
        return replace(self, assignment=result, centroids=middle, mean_core=float(top[1] or 0.0), tree=tree, nodes=nodes, edges=edges)

    def predict(self, points: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
        """(key, label, probability): the nearest centroid; none beyond twice the mean core distance."""
        from .assignment import nearest_centroid

        limit = 2 * self.mean_core
        near = nearest_centroid(points, self.centroids.withColumnRenamed("label", "topic_id"), key=key, vector=vector)
        far = F.col("distance") > limit
        chance = F.greatest(F.lit(0.1), 1 - F.col("distance") / F.lit(limit or 1.0))
        return near.select(key, F.when(far, -1).otherwise(F.col("topic_id")).alias("label"), F.when(far, 0.0).otherwise(chance).alias("probability"))

    def hierarchy_table(self) -> pd.DataFrame:
        rows = [(x.id, x.parent, list(x.children), x.birth, x.death, x.size) for x in (self.nodes or {}).values()]
        return pd.DataFrame(rows, columns=["node_id", "parent_id", "children", "birth", "death", "size"])


class HDBSCANBuilder(Builder):
    def __init__(self, **settings: object) -> None:
        super().__init__(HDBSCAN, **settings)


def hdbscan(points: DataFrame, min_cluster_size: int = 5, **settings: object) -> DataFrame:
    return HDBSCAN(min_cluster_size, **settings).fit(points).assignment
