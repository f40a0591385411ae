"""Vector expressions over array columns; all arithmetic in double."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPSILON = 1.1920929e-07  # of 32-bit numbers


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _both(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x * y)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Of length 1; unchanged if the length is next to nothing."""
    n = l2_norm(v)
    return F.when(n <= EPSILON, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def cosine_similarity(a: Column, b: Column) -> Column:
    n = l2_norm(a) * l2_norm(b)
    return F.when(n <= EPSILON, 0.0).otherwise(dot(a, b) / n)


def squared_euclidean(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: F.abs(x - y))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the clamped similarity; 1 where a vector has no direction."""
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine_similarity(a, b)))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"euclidean": euclidean, "squared_euclidean": squared_euclidean, "cosine": cosine_distance, "manhattan": manhattan, "dot_product": cosine_distance}


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    return METRICS[metric](a, b)


def literal(vector: list[float] | np.ndarray) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def zeros(dimension: int) -> Column:
    return F.array_repeat(F.lit(0.0), dimension)


def random_vectors(spark: SparkSession, n: int, dimension: int, seed: int = 42) -> DataFrame:
    """(id, embedding): uniform in [-1, 1], each row by its own seed."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["embedding"] = [np.random.default_rng([seed, int(i)]).uniform(-1, 1, dimension) for i in f["id"]]
            yield f

    return spark.range(n).mapInPandas(make, "id long, embedding array<double>")


def dimension_of(table: DataFrame, vector: str = "embedding") -> int:
    """The common length of the vectors; an error if they differ or there are none."""
    low, high = table.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low is None or low != high or low < 1:
        raise ValueError("embeddings must be there and of one dimension")
    return low


def centroids(table: DataFrame, group: str, vector: str = "embedding", dimension: int | None = None) -> DataFrame:
    """(group, centroid): element-wise means, one partial aggregate for each place, so that a row is read once."""
    d = dimension or dimension_of(table, vector)
    return table.groupBy(group).agg(F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(d)]).alias("centroid"))


def register(spark: SparkSession) -> None:
    """SQL functions: tokenize(text), l2(a, b), cosine(a, b), centroid(v) as an aggregate, token_windows(tokens, width) as a table."""
    from pyspark.sql.functions import PandasUDFType, pandas_udf, udtf

    from .text import SEPARATOR

    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tokenize(t STRING) RETURNS ARRAY<STRING> RETURN filter(split(lower(t), r'{SEPARATOR}'), x -> length(x) BETWEEN 2 AND 50)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION l2(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)")

    def mean(v: pd.Series) -> list[float]:
        return np.mean(np.stack(v.to_list()), axis=0).tolist()

    spark.udf.register("centroid", pandas_udf(mean, "array<double>", PandasUDFType.GROUPED_AGG))

    @udtf(returnType="window_index: int, tokens: array<string>")
    class TokenWindows:
        def eval(self, tokens: list[str], width: int):  # noqa: ANN201
            for i in range(max(1, len(tokens) - width + 1) if tokens else 0):
                yield i, list(dict.fromkeys(tokens[i : i + width]))

    spark.udtf.register("token_windows", TokenWindows)
