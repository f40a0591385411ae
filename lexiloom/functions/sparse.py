"""Sparse matrices as tables (row, col, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1.1920929e-07


def combined(m: DataFrame) -> DataFrame:
    """One entry for each place: duplicates are added."""
    return m.groupBy("row", "col").agg(F.sum("value").alias("value"))


def entry(m: DataFrame, row: int, col: int) -> DataFrame:
    return m.where((F.col("row") == row) & (F.col("col") == col)).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


def matrix_row(m: DataFrame, row: int) -> DataFrame:
    return m.where(F.col("row") == row).select("col", "value")


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def degrees(m: DataFrame) -> DataFrame:
    """(row, degree): row sums."""
    return m.groupBy("row").agg(F.sum("value").alias("degree"))


def multiply_vector(m: DataFrame, v: DataFrame) -> DataFrame:
    """(row, value) of the matrix times a vector (col, x)."""
    return m.join(v, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("value"))


def row_normalized(m: DataFrame) -> DataFrame:
    """Rows that sum to 1; rows that sum to nothing stay."""
    total = F.sum("value").over(Window.partitionBy("row"))
    return m.select("row", "col", F.when(F.abs(total) <= EPSILON, F.col("value")).otherwise(F.col("value") / total).alias("value"))


def dense_rows(m: DataFrame, columns: int) -> DataFrame:
    """(row, values): arrays with zeros where there is no entry."""
    cells = m.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("cells"))
    return cells.select("row", F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda i: F.coalesce(F.try_element_at("cells", i.cast("bigint")), F.lit(0.0))).alias("values"))


def edge_list(m: DataFrame) -> DataFrame:
    """The upper triangle of a symmetric matrix."""
    return m.where("row < col").select(F.col("row").alias("src"), F.col("col").alias("dst"), F.col("value").alias("weight"))


def normalized_laplacian(m: DataFrame, nodes: DataFrame) -> DataFrame:
    """I - D^-1/2 A D^-1/2 over the nodes (row); an isolated one has 1 on the diagonal."""
    d = degrees(m).where(F.col("degree") > EPSILON)
    off = m.join(d, "row").join(d.select(F.col("row").alias("col"), F.col("degree").alias("other")), "col")
    off = off.select("row", "col", (-F.col("value") / F.sqrt(F.col("degree") * F.col("other"))).alias("value"))
    return combined(off.unionByName(nodes.select("row", F.col("row").alias("col"), F.lit(1.0).alias("value"))))


def fuzzy_union(m: DataFrame) -> DataFrame:
    """a + b - ab of the matrix and its transpose; what is next to nothing is dropped."""
    a, b = m.withColumnRenamed("value", "a"), transpose(m).withColumnRenamed("value", "b")
    a, b = a.alias("x"), b.alias("y")
    j = a.join(b, (F.col("x.row") == F.col("y.row")) & (F.col("x.col") == F.col("y.col")), "full_outer")
    p, q = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return j.select(F.coalesce("x.row", "y.row").alias("row"), F.coalesce("x.col", "y.col").alias("col"), (p + q - p * q).alias("value")).where(F.col("value") > EPSILON)
