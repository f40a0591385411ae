"""MinHash near-duplicates, verified sequentially (BayesLSH).

Documents are sets of runs of ``width`` words. Texts of equal word sequences (two 64-bit hashes) are
one from the first step on. Banded signatures give candidates. Signatures of a pair are compared in
batches: as soon as the posterior probability that the Jaccard similarity reaches the threshold falls
below ``miss``, the pair is dropped; survivors are verified on the exact sets. The result are the
connected components of the verified candidate pairs. Pairs that can't change a component (both ends
are in it already) aren't tested.

Of each bucket all are compared with its first document. What the links found so far don't join is
compared pair by pair in buckets of up to ``small`` documents. Larger buckets, of texts that share a
passage, take an exact way instead of all pairs: two sets of the threshold's similarity or more
have one in common of their rarest elements, of which so few are needed that sets which share only
the passage meet nowhere (prefix filter by classes of set size; elements within a single
component can't link two and come first). So the pairs grow with the documents, and no link between
different texts is left out but those that the bands or the sequential test miss.

Defined results: rows with null doc_id, and texts that are null or without words, belong to no
group. Rows that repeat a doc_id count as one document, that of the smallest text hash. Very long
texts count whole; a text of fewer than ``width`` words is a set of one run. Ties: the smallest doc_id
of a group is its keeper. Of an empty table, or without near copies, the result is empty. Extra
columns are ignored, and passed through by ``drop_near_copies``, which also keeps one row of each
repeated doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import components, matching, one_row_each, possible, without
from .kernels import U64, binary_rows, mix, owners, ragged, slices, to_batch, window_hashes, word_hashes
from .shared import Stored, stored

BANDS, ROWS, BATCH = 40, 4, 32
#: Of the sizes of sets in a class.
RATIO = 1.15
_SIGNED = pa.schema([("doc_id", pa.int64()), ("content", pa.int64()), ("content2", pa.int64()), ("signature", pa.binary())])
_BANDED = pa.schema([("key", pa.int64()), ("doc_id", pa.int64())])


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def least_matches(threshold: float, miss: float, hashes: int = BANDS * ROWS, batch: int = BATCH) -> list[tuple[int, int]]:
    """(n, m): after n compared hashes, fewer than m matches drop the pair.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), which exceeds t
    with the probability that a binomial variable of n + 1 trials of chance t is at most m.
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def sign(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, two hashes of the whole word sequence, and the signature; only of texts with words."""
    a, b = _permutations(BANDS * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text"):
            words, first = word_hashes(s.column("text"))
            some = np.flatnonzero(np.diff(first) > 0)
            if not len(some):
                continue
            shingles, start = window_hashes(words, first, width)
            begins = start[some]
            key = (shingles >> U64(32)).astype(np.uint32)
            signature = np.empty((len(some), len(a)), np.uint32)
            for i in range(len(a)):
                signature[:, i] = np.minimum.reduceat(key * a[i] + b[i], begins)
            whole = [window_hashes(w, first, 1 << 40)[0].view(np.int64) for w in (words, mix(words ^ U64(0x5BD1E995)))]
            yield to_batch(_SIGNED, s.column("doc_id").take(pa.array(some)), *whole, binary_rows(signature.ravel(), np.arange(len(some) + 1) * len(a)))

    return _words(docs).mapInArrow(run, "doc_id long, content long, content2 long, signature binary")


def bands(signed: DataFrame) -> DataFrame:
    """(key, doc_id): documents of one band value are candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in batches:
            part = ragged(s.column("signature"), np.uint32)[0].reshape(-1, BANDS, ROWS).astype(U64)
            h = np.arange(BANDS, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15)
            for i in range(ROWS):
                h = mix(h ^ part[:, :, i])
            yield to_batch(_BANDED, h.ravel().view(np.int64), s.column("doc_id").take(pa.array(np.repeat(np.arange(s.num_rows), BANDS))))

    return signed.select("doc_id", "signature").mapInArrow(run, "key long, doc_id long")


def plausible(pairs: DataFrame, signed: DataFrame, threshold: float, miss: float) -> Stored:
    """(a, b, matches): the pairs that the sequential comparison doesn't drop."""
    steps = least_matches(threshold, miss)
    side = lambda x: asked.df.select(F.col("doc_id").alias(x), F.col("signature").alias(f"s{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            x, y = (ragged(t.column(c), np.uint32)[0].reshape(t.num_rows, -1) for c in ("sa", "sb"))
            alive, matches, before = np.arange(t.num_rows), np.zeros(t.num_rows, np.int32), 0
            for n, least in steps:
                matches[alive] += (x[alive, before:n] == y[alive, before:n]).sum(axis=1, dtype=np.int32)
                alive, before = alive[matches[alive] >= least], n
            take = pa.array(alive)
            yield pa.RecordBatch.from_arrays([t.column("a").take(take), t.column("b").take(take), pa.array(matches[alive])], ["a", "b", "matches"])

    # signatures move only where they are asked for
    asked_pairs = stored(pairs, "pairs")
    asked = stored(possible(signed, asked_pairs.df.select(F.explode(F.array("a", "b")).alias("doc_id"))).where("__maybe").drop("__maybe"), "asked")
    both = asked_pairs.df.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
    out = stored(both.mapInArrow(run, "a long, b long, matches int"), "plausible")
    asked_pairs.drop()
    asked.drop()
    return out


def _words(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def verify(pairs: Stored, docs: DataFrame, width: int, threshold: float, partners: int = 256) -> Stored:
    """(a, b): the pairs whose exact sets reach the threshold. Each text goes once to each a that it meets; a's goes to each ``partners`` of these."""
    p = pairs.df
    many = p.groupBy("a").agg(F.ceil(F.count("*") / partners).alias("parts"))
    p = p.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    wanted = stored(p.select(F.col("a").alias("doc_id"), "a", "part").distinct().union(p.select(F.col("b").alias("doc_id"), "a", "part")), "wanted")
    met = matching(_words(docs), wanted.df).select("a", "part", "doc_id", (F.col("doc_id") != F.col("a")).alias("other"), "text")
    met = met.repartition("a", "part").sortWithinPartitions("a", "part", "other", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, mine = None, np.zeros(0, U64)
        for s in slices(batches, "text"):
            words, first = word_hashes(s.column("text"))
            shingles, start = window_hashes(words, first, width)
            out: list[tuple[int, int]] = []
            for i, (a, doc, other) in enumerate(zip(*(s.column(c).to_pylist() for c in ("a", "doc_id", "other")), strict=True)):
                own = np.unique(shingles[start[i] : start[i + 1]])
                if not other:
                    hub, mine = a, own
                elif hub == a and len(own):
                    common = len(own) + len(mine) - len(np.union1d(own, mine))
                    if common >= threshold * (len(own) + len(mine) - common):
                        out.append((a, doc))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    edges = stored(met.mapInArrow(run, "a long, b long"), "verified")
    wanted.drop()
    return edges


def _settle(left: Stored, groups: Stored | None, docs: DataFrame, width: int, threshold: float) -> Stored | None:
    """Verify plausible pairs until all that are left lie within components; the components, as (doc_id, group_id)."""
    some = 1
    while not left.df.isEmpty():
        # of each document the likeliest pair first: as many tests as documents, which join nearly all that
        # belongs together; of what still lies between components ever more at a time
        likeliest = Window.partitionBy("b").orderBy(F.desc("matches"), "a")
        tests = stored(left.df.withColumn("nth", F.row_number().over(likeliest)).where(F.col("nth") <= some).select("a", "b"), "tests")
        edges = verify(tests, docs, width, threshold)
        if not edges.df.isEmpty():
            groups = components(edges.df, groups)
        rest = left.df.join(tests.df, ["a", "b"], "left_anti")
        if groups:
            rest = _between(rest, groups).drop("ga", "gb")
        after, some = stored(rest, "plausible"), some * 16
        for x in (left, tests, edges):
            x.drop()
        left = after
    left.drop()
    return groups


def _between(pairs: DataFrame, groups: Stored) -> DataFrame:
    """The pairs (a, b) whose ends are of different components."""
    g = groups.df
    joined = pairs.join(g.toDF("a", "ga"), "a", "left").join(g.toDF("b", "gb"), "b", "left")
    return joined.where("coalesce(ga, a) != coalesce(gb, b)")


def _grouped(members: DataFrame, groups: Stored | None) -> DataFrame:
    """Members with their component g, which is their own id so far if they have none."""
    if groups is None:
        return members.withColumn("g", F.col("doc_id"))
    return members.join(groups.df, "doc_id", "left").withColumn("g", F.coalesce("group_id", "doc_id")).drop("group_id")


def _mixed(buckets: DataFrame) -> DataFrame:
    """Of buckets (key, doc_id, g) those of several components, with their number of documents n and the first one, pivot."""
    known = buckets.groupBy("key").agg(F.min("g").alias("l"), F.max("g").alias("h"), F.count("*").alias("n"), F.min("doc_id").alias("pivot")).where("l != h").drop("l", "h")
    return buckets.join(known, "key")


def _stars(buckets: DataFrame) -> DataFrame:
    return buckets.where("doc_id != pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()


def _across(buckets: DataFrame) -> DataFrame:
    """Pairs within buckets (key, doc_id, g) across components."""
    x, y = buckets.select("key", F.col("doc_id").alias("a"), F.col("g").alias("ga")), buckets.select("key", F.col("doc_id").alias("b"), F.col("g").alias("gb"))
    return x.join(y, "key").where("a < b AND ga != gb").select("a", "b").distinct()


def rare_keys(docs: DataFrame, hot: Stored, groups: Stored | None, width: int, threshold: float) -> DataFrame:
    """(key, side, doc_id): two documents of ``hot`` (doc_id) in different components whose similarity reaches the threshold have a key in common.

    With t the threshold, sets of sizes x and y need t / (1 + t) (x + y) common elements, so that the
    remaining elements and one, in an order that all sets share, hold one of them. Sizes are known by
    class, of which each reaches to ``RATIO`` times its least; a key is of an element and two classes, and
    a document is on the side of its own one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text"):
            words, first = word_hashes(s.column("text"))
            shingles, start = window_hashes(words, first, width)
            row = owners(start)
            order = np.lexsort((shingles, row))
            w, r = shingles[order], row[order]
            fresh = np.concatenate([[True], (w[1:] != w[:-1]) | (r[1:] != r[:-1])])[: len(w)]
            w, r = w[fresh], r[fresh]
            size = np.bincount(r, minlength=s.num_rows)
            yield pa.RecordBatch.from_arrays([s.column("doc_id").take(pa.array(r)), pa.array(w.view(np.int64)), pa.array(size[r])], ["doc_id", "element", "size"])

    elements = _grouped(matching(_words(docs), hot.df).mapInArrow(run, "doc_id long, element long, size long"), groups)
    elements = stored(elements, "elements").df
    shared = elements.groupBy("element").agg(F.min("g").alias("l"), F.max("g").alias("h"), F.count("*").alias("n")).where("l != h").select("element", "n")
    live = elements.join(shared, "element")
    own = Window.partitionBy("doc_id")
    place = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "element"))
    of = lambda x: F.floor(F.log(x) / F.lit(float(np.log(RATIO))) + 1e-9)
    classes = F.sequence(of(F.col("size") * threshold), of(F.col("size") / threshold + 1e-9))
    each = live.withColumn("place", place).withColumn("mine", of(F.col("size"))).select("doc_id", "element", "size", "place", "mine", F.explode(classes).alias("other"))
    needed = F.ceil(threshold / (1 + threshold) * (F.col("size") + F.pow(F.lit(RATIO), F.col("other"))) - 1e-6)
    within = each.where(F.col("place") <= F.col("size") - needed + 1)
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    return within.select(F.xxhash64(F.least("mine", "other"), F.greatest("mine", "other"), "element").alias("key"), side.alias("side"), "doc_id").distinct()


def _two_sided(keys: DataFrame) -> DataFrame:
    """Of keys (key, side, doc_id, g) those with documents to compare, and the first document of each side, p0 and p1; side 2 is compared with itself."""
    first = lambda k: F.min(F.when(F.col("side") == k, F.col("doc_id")))
    known = keys.groupBy("key").agg(F.min("g").alias("l"), F.max("g").alias("h"), F.min("side").alias("low"), F.max("side").alias("high"), first(0).alias("p0"), first(1).alias("p1"), first(2).alias("p2"))
    return keys.join(known.where("l != h AND (low = 2 OR low != high)").select("key", "p0", "p1", "p2"), "key")


def _stars_two_sided(keys: DataFrame) -> DataFrame:
    hub = F.when(F.col("side") == 0, F.col("p1")).when(F.col("side") == 1, F.col("p0")).otherwise(F.col("p2"))
    return keys.select(hub.alias("a"), F.col("doc_id").alias("b")).where("a != b").distinct()


def _across_two_sided(keys: DataFrame) -> DataFrame:
    x, y = keys.where("side != 1").select("key", "side", F.col("doc_id").alias("a"), F.col("g").alias("ga")), keys.where("side != 0").select("key", F.col("doc_id").alias("b"), F.col("g").alias("gb"))
    return x.join(y, "key").where("(side = 0 OR a < b) AND ga != gb").select("a", "b").distinct()


def near_groups(docs: DataFrame, *, width: int = 3, threshold: float = 0.5, miss: float = 0.01, small: int = 64) -> DataFrame:
    """doc_id, group_id (the smallest doc_id of the group) and keep, for each document that has near copies."""
    docs = one_row_each(docs.select("doc_id", "text"))
    signed = stored(sign(docs, width), "signed")
    equal = signed.df.groupBy("content", "content2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("signature").alias("signature"))
    unique = stored(equal, "unique")
    first = unique.df.where("n > 1").select("content", "content2", F.col("doc_id").alias("rep"))
    copies = stored(signed.df.select("doc_id", "content", "content2").join(first, ["content", "content2"]).where("doc_id != rep").select("doc_id", "rep"), "copies")
    signed.drop()
    s = unique.df.select("doc_id", "signature")
    full = bands(s).groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("pivot")).where("n > 1")
    buckets = stored(bands(s).join(full, "key"), "buckets")
    stars = stored(_stars(buckets.df), "stars")
    groups = _settle(plausible(stars.df, s, threshold, miss), None, docs, width, threshold)

    # what shares a bucket and isn't joined yet
    mixed = stored(_mixed(_grouped(buckets.df.select("key", "doc_id"), groups)), "mixed")
    buckets.drop()
    hot = stored(mixed.df.where(F.col("n") > small).select("doc_id").distinct(), "hot")
    cross = _across(mixed.df.where(F.col("n") <= small)).join(stars.df, ["a", "b"], "left_anti")
    groups = _settle(plausible(cross, s, threshold, miss), groups, docs, width, threshold)
    mixed.drop()
    stars.drop()
    if not hot.df.isEmpty():
        keys = stored(rare_keys(docs, hot, groups, width, threshold), "keys")
        for pairs in (_stars_two_sided, _across_two_sided):
            now = stored(_two_sided(_grouped(keys.df, groups)), "mixed")
            groups = _settle(plausible(pairs(now.df), s, threshold, miss), groups, docs, width, threshold)
            now.drop()
        keys.drop()
    hot.drop()
    # copies of equal words join the component of their first
    if groups is None:
        found = copies.df.select("doc_id", F.col("rep").alias("group_id")).union(copies.df.select("rep", "rep").distinct())
    else:
        g = groups.df
        again = copies.df.join(g.toDF("rep", "g"), "rep", "left").select("doc_id", F.coalesce("g", "rep").alias("group_id"))
        alone = copies.df.select(F.col("rep").alias("doc_id")).distinct().join(g, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("group_id"))
        found = g.select("doc_id", "group_id").union(again).union(alone)
    unique.drop()
    return found.withColumn("keep", F.col("doc_id") == F.col("group_id"))


def drop_near_copies(docs: DataFrame, **options: float) -> DataFrame:
    """The documents without those that near_groups() doesn't keep."""
    docs = one_row_each(docs)
    gone = stored(near_groups(docs, **options).where("NOT keep").select("doc_id"), "gone")
    return without(docs, gone.df)


#: Components of all pairs that reach the threshold: what near_groups() gives, up to the recall of bands and sequential test.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x80-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), g AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS s FROM d WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), e AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) p JOIN n u ON u.doc_id = p.a JOIN n v ON v.doc_id = p.b WHERE p.c >= 0.5 * (u.n + v.n - p.c)
), r(doc_id, m) AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT r.doc_id, CASE WHEN e.a = r.m THEN e.b ELSE e.a END FROM r JOIN e ON e.a = r.m OR e.b = r.m
)
SELECT doc_id, least(min(m), doc_id) AS group_id, doc_id = least(min(m), doc_id) AS keep FROM r GROUP BY doc_id
"""
