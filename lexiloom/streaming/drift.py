"""Drift of assignments: mean distance of all and of recent documents, and the recent rate of outliers.

Recent values are exponential averages from 0 with a = 2 / (window + 1), in order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Drift:
    total: int = 0
    overall: float = 0.0
    recent: float = 0.0
    outlier_rate: float = 0.0
    window: int = 100

    def observe(self, distance: float, outlier: bool) -> Drift:
        return self.observe_all([distance], [outlier])

    def observe_all(self, distances: list[float], outliers: list[bool]) -> Drift:
        n, a = len(distances), 2 / (self.window + 1)
        if not n:
            return self
        weights = a * (1 - a) ** np.arange(n - 1, -1, -1)
        total = self.total + n
        overall = self.overall + (float(np.sum(distances)) - n * self.overall) / total
        recent = self.recent * (1 - a) ** n + float(weights @ np.asarray(distances, float))
        rate = self.outlier_rate * (1 - a) ** n + float(weights @ np.asarray(outliers, float))
        return Drift(total, overall, recent, rate, self.window)

    @property
    def ratio(self) -> float:
        return self.recent / self.overall if self.overall > 0 else 1.0

    def refresh_due(self, ratio: float, rate: float, least: int = 30) -> bool:
        return self.total >= least and (self.ratio >= ratio or self.outlier_rate >= rate)

    def as_dict(self) -> dict:
        return asdict(self)


def batch_drift(observations: DataFrame, order: list[str], window: int = 100, before: Drift | None = None) -> DataFrame:
    """One row (total, overall, recent, outlier_rate) of (distance, outlier), as of the last in order, after the state ``before``.

    Rows are sorted by ranges; each range is folded where it is, and the ranges, a row each, in order:
    behind n observations a recent value has (1 - a)^n of its weight left.
    """
    a, old = 2 / (window + 1), before or Drift(window=window)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, total = Drift(window=window), 0.0
        for b in batches:
            x, o = b.column("__d").to_numpy(), b.column("__o").to_numpy()
            total += x.sum()
            d = d.observe_all(x, o)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (TaskContext.get().partitionId(), d.total, float(total), d.recent, d.outlier_rate)], ["part", "n", "total", "recent", "rate"])

    rows = observations.select(*order, F.col("distance").cast("double").alias("__d"), F.col("outlier").cast("double").alias("__o"))
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("__d", "__o").mapInArrow(fold, "part long, n long, total double, recent double, rate double")
    one = parts.where("n > 0").agg(F.sort_array(F.collect_list(F.struct("part", "n", "recent", "rate"))).alias("l"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("s"))
    on = lambda f, start: F.aggregate("l", F.lit(float(start)), lambda s, x: s * F.pow(F.lit(1 - a), x["n"]) + x[f])
    total = F.col("n") + old.total
    overall = F.when(total == 0, 0.0).otherwise((F.col("s") + old.overall * old.total) / F.greatest(total, F.lit(1)))
    return one.select(total.alias("total"), overall.alias("overall"), on("recent", old.recent).alias("recent"), on("rate", old.outlier_rate).alias("outlier_rate"))


def stream_drift(observations: DataFrame, key: str, order: str, window: int = 100) -> DataFrame:
    """Structured Streaming: (key, total, overall, recent, outlier_rate) after each batch, with state for each key."""
    schema = f"{key} string, total long, overall double, recent double, outlier_rate double"

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        d = Drift(*state.get, window=window) if state.exists else Drift(window=window)
        rows = pd.concat(list(frames)).sort_values(order)
        d = d.observe_all(rows["distance"].to_list(), rows["outlier"].to_list())
        state.update((d.total, d.overall, d.recent, d.outlier_rate))
        yield pd.DataFrame({key: [str(keys[0])], "total": [d.total], "overall": [d.overall], "recent": [d.recent], "outlier_rate": [d.outlier_rate]})

    return observations.groupBy(key).applyInPandasWithState(update, schema, "total long, overall double, recent double, outlier_rate double", "update", "NoTimeout")
