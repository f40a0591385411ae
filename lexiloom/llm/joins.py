"""Joins that move only rows that may match, joins that broadcast only what is small, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stored, stored

#: A stored side of up to so many bytes in memory is sent to all executors; a larger one is joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Bits of a filter over ids, kept in words of 64: the broadcast table has at most PLACES / 64 rows, 4 MB, at any size of the data.
PLACES = 1 << 24


def sized_join(big: DataFrame, small: Stored, on: str | list[str], how: str = "inner", row_bytes: int = 32) -> DataFrame:
    """big joined with a stored table, whose rows are counted (from file footers) to choose between broadcast and shuffle."""
    if small.df.count() * row_bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(small.df), on, how)
    return big.join(small.df, on, how)


def _place(id_: str) -> F.Column:
    return F.pmod(F.xxhash64(F.col(id_).cast("long")), F.lit(PLACES))


def possible(big: DataFrame, ids: DataFrame) -> DataFrame:
    """big with ``__maybe``: false where doc_id certainly isn't among the ids (one column), or is null.

    A filter of fixed size, so that the same plan serves any number of ids: of few it tells all, of
    very many it tells little, and the join behind it moves what it would have moved without.
    """
    p = _place(ids.columns[0])
    words = ids.select(F.shiftright(p, 6).alias("__word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(cast(`%s` AS long)), %d) %% 64 AS int))" % (ids.columns[0], PLACES)).alias("b"))
    words = words.groupBy("__word").agg(F.bit_or("b").alias("__bits"))
    marked = big.withColumn("__at", _place("doc_id")).withColumn("__word", F.shiftright("__at", 6)).join(F.broadcast(words), "__word", "left")
    bit = F.expr("shiftright(__bits, cast(__at % 64 AS int)) & 1L")
    return marked.withColumn("__maybe", F.coalesce((bit == 1) & F.col("doc_id").isNotNull(), F.lit(False))).drop("__at", "__word", "__bits")


def matching(big: DataFrame, small: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """big joined with small on doc_id; only rows of big that may match are shuffled."""
    some = possible(big, small.select("doc_id") if ids is None else ids).where("__maybe").drop("__maybe")
    return some.hint("merge").join(small, "doc_id")


def without(big: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of big, with their columns, whose doc_id isn't among the ids (column doc_id); rows that can't be are not moved."""
    marked = possible(big, ids)
    sure = marked.where("NOT __maybe").drop("__maybe")
    asked = marked.where("__maybe").drop("__maybe").withColumn("__id", F.col("doc_id").cast("long"))
    rest = asked.hint("merge").join(ids.select(F.col("doc_id").alias("__id")), "__id", "left_anti").drop("__id")
    return sure.select(*names(big)).unionByName(rest.select(*names(big)))


def names(df: DataFrame) -> list[F.Column]:
    """The columns by their whole names, which may hold dots."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def components(edges: DataFrame, before: Stored | None = None) -> Stored:
    """(doc_id, group_id) of all ends of edges (a, b), and of earlier groups that they may join; group_id is the smallest member.

    Large-star and small-star steps, alternating until all edges lead to a smallest member: each is an
    aggregation by node with partial minima and a join with its result, so that no node's edges have to
    meet in one task. The number of rounds grows with the logarithm of the longest path.
    """
    if before is not None:
        edges = edges.union(before.df.where("doc_id != group_id").select(F.col("group_id"), F.col("doc_id")))
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        e = now.df
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(least, "u")
        links = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        after = stored(links, "edges")
        now.drop()
        large.drop()
        now = after
        # stars: each node has one edge, or is where edges lead
        ends = now.df.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(now.df.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out + into > 1").isEmpty():
            break
    e = now.df
    out = stored(e.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id")).union(e.select("v", "v").distinct()), "groups")
    now.drop()
    if before is not None:
        before.drop()
    return out


def one_row_each(docs: DataFrame) -> DataFrame:
    """The documents with one row of each doc_id, that of the smallest text hash; rows with null doc_id stay."""
    id_ = F.col("doc_id").cast("long").alias("doc_id")
    repeated = stored(docs.where("doc_id IS NOT NULL").groupBy(id_).count().where("count > 1").select("doc_id"), "repeated")
    if repeated.df.isEmpty():
        repeated.drop()
        return docs
    again = possible(docs, repeated.df).where("__maybe").drop("__maybe").withColumn("__id", F.col("doc_id").cast("long"))
    again = again.hint("merge").join(repeated.df.select(F.col("doc_id").alias("__id")), "__id", "left_semi")
    once = again.groupBy("__id").agg(F.min_by(F.struct(*names(docs)), F.struct(F.xxhash64("text"), F.hash("text"))).alias("__row")).select("__row.*")
    return without(docs, repeated.df).unionByName(once)
