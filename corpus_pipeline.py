"""A training corpus in five stages: quality, near copies, benchmark passages, secrets, mixture.

Each stage reads what its predecessor wrote. The first four keep the columns of documents.

Defined results: documents whose text is null or empty are rejected by the first stage; of rows that
repeat a doc_id the second keeps one, that of the smallest text hash, and of ties the smallest doc_id is
kept; rows with null doc_id pass all stages and are named null in the mixture; a null source is one of
its own. Very long texts are judged, compared and cut whole. Without labels the first stage keeps all
texts, without benchmark the third. Of empty tables the result is empty. Extra columns, whatever their
names, are passed on by all but the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import decontaminate, minhash, mixing, quality, secret_scan
from lexiloom.llm.shared import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: A learned classifier, hashing and pseudorandom permutations aren't expressed in SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        after = stored(stage(spark, docs, sf_dir), name)
        if before:
            before.drop()
        before, docs = after, after.df
    return STAGES[-1][1](spark, docs, sf_dir)
