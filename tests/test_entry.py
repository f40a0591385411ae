"""The driver's contract on the smallest tables, where they are there."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from lexiloom.plans import queries

    c = duckdb.connect()
    for name in ("documents", "embeddings", "events", "benchmark"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    for name in ("vocabulary_index", "ctfidf_topk", "npmi_pairs", "nearest_centroid", "knn_k5", "laplacian_entries", "drift_ema"):
        mine = queries.QUERIES[name](spark, str(DATA))
        columns = sorted(mine.columns)
        got = sorted(map(repr, (tuple(r) for r in mine.select(*columns).collect())))
        want = sorted(map(repr, c.execute(f"SELECT {', '.join(f'"{x}"' for x in columns)} FROM ({queries.SQL[name]})").fetchall()))
        assert got == want, name


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 100
