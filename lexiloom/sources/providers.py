"""Where embeddings come from: a plug-in seam, exact lookup, position, and a cache in front of a provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class EmbeddingProvider(Protocol):
    """Adds a vector of ``dimension`` numbers to rows with a text."""

    dimension: int

    def embed(self, docs: DataFrame, text: str = ..., vector: str = ...) -> DataFrame: ...


class FunctionProvider:
    """A function from a list of texts to their vectors, called on Arrow batches on the executors."""

    def __init__(self, function: Callable[[list[str]], list], dimension: int) -> None:
        self.function, self.dimension = function, dimension

    def embed(self, docs: DataFrame, text: str = "text", vector: str = "embedding") -> DataFrame:
        function = self.function

        def run(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for c in column:
                yield pd.Series(list(function(c.to_list())))

        run.__annotations__ = {"column": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return docs.withColumn(vector, F.pandas_udf(run, "array<float>")(text))


class PrecomputedProvider:
    """Vectors by exact text from a table (text, embedding); a text that isn't there is an error, when it is read."""

    def __init__(self, table: DataFrame, dimension: int) -> None:
        self.table, self.dimension = table, dimension

    def embed(self, docs: DataFrame, text: str = "text", vector: str = "embedding") -> DataFrame:
        known = self.table.dropDuplicates(["text"]).select(F.col("text").alias("__text"), F.col("embedding").alias("__vector"))
        j = docs.join(known, F.col(text) == F.col("__text"), "left")
        found = F.when(F.col("__vector").isNull(), F.raise_error(F.concat(F.lit("no embedding for text: "), F.coalesce(F.col(text), F.lit("null")))).cast("array<float>")).otherwise(F.col("__vector"))
        return j.select(*docs.columns, found.alias(vector))


class PassthroughProvider:
    """The n-th vector (column pos, from 0) for the n-th document in order of a key."""

    def __init__(self, table: DataFrame, dimension: int, key: str = "doc_id") -> None:
        self.table, self.dimension, self.key = table, dimension, key

    def embed(self, docs: DataFrame, text: str = "text", vector: str = "embedding") -> DataFrame:
        placed = docs.withColumn("__pos", F.row_number().over(Window.orderBy(self.key)) - 1)
        return placed.join(self.table.select(F.col("pos").alias("__pos"), F.col("embedding").alias(vector)), "__pos").drop("__pos")


class CachingProvider:
    """Texts that a stored table (text, embedding) holds are looked up; others are embedded once and appended to it."""

    def __init__(self, provider: EmbeddingProvider, path: str) -> None:
        self.provider, self.path, self.dimension = provider, path, provider.dimension

    def _cache(self, docs: DataFrame) -> DataFrame:
        spark = docs.sparkSession
        try:
            return spark.read.parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], "text string, embedding array<float>")

    def embed(self, docs: DataFrame, text: str = "text", vector: str = "embedding") -> DataFrame:
        asked = docs.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct()
        missing = asked.join(self._cache(docs).select("text"), "text", "left_anti")
        self.provider.embed(missing, "text", "embedding").select("text", "embedding").write.mode("append").parquet(self.path)
        cached = self._cache(docs).dropDuplicates(["text"]).select(F.col("text").alias("__text"), F.col("embedding").alias(vector))
        return docs.join(cached, F.col(text) == F.col("__text"), "left").drop("__text")
