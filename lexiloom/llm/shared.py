"""Tables cut out of the lineage: written to the folder that the cluster shares."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import delete_path, deleted_at_exit, shared_dir


class Stored:
    """A written table; ``df`` reads it, ``drop()`` deletes its files when no later plan needs them."""

    def __init__(self, df: DataFrame, label: str) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/lexiloom-{label}-{uuid.uuid4().hex}"
        cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(cleanup, None)
        try:
            # the plan ends here, so its shuffle files are of no further use
            self.spark.conf.set(cleanup, "true")
            df.write.option("compression", "zstd").parquet(self.path)
        finally:
            if before is None:
                self.spark.conf.unset(cleanup)
            else:
                self.spark.conf.set(cleanup, before)
        self.schema = df.schema
        deleted_at_exit(self.spark, self.path)  # unless drop() comes first

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        delete_path(self.spark, self.path)


def stored(df: DataFrame, label: str) -> Stored:
    return Stored(df, label)


def tree_sum(parts: DataFrame, dtype: str = "f8") -> np.ndarray | None:
    """The sum of the equally long arrays in a binary column ``sums``, first in 16 groups, then here; None of no rows."""

    def merge(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "sums": [sum(np.frombuffer(x, dtype) for x in f["sums"]).tobytes()]})

    rows = parts.select((F.spark_partition_id() % 16).alias("part"), "sums").groupBy("part").applyInPandas(merge, "part int, sums binary").collect()
    return sum(np.frombuffer(r["sums"], dtype) for r in rows) if rows else None
