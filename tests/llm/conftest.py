from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark: SparkSession):
    """A documents table of texts: (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows: list[tuple], extra: bool = False) -> DataFrame:
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:  # names that operators use inside
            for c in ("score", "a", "b", "group_id", "keep", "tokens", "rank", "order", "y", "held", "band", "q", "block", "label", "word", "n", "at", "pos"):
                from pyspark.sql import functions as F

                df = df.withColumn(c, F.lit("x"))
        return df

    return make
