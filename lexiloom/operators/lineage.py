"""Tables cut out of the lineage: written to the folder that the cluster shares, deleted when Python ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []
#: A table of fewer bytes a core is spread over all cores, if its files are fewer.
SMALL = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where none is set and Spark runs in one process."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = context.applicationId
    if key not in _OWN:
        folder = tempfile.mkdtemp(prefix="lexiloom-")
        atexit.register(shutil.rmtree, folder, True)
        _OWN[key] = f"file://{folder}"
    return _OWN[key]


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _clean() -> None:
    for spark, path in _WRITTEN:
        with suppress(Exception):  # the cluster may be gone already
            delete_path(spark, path)
    _WRITTEN.clear()


atexit.register(_clean)


def deleted_at_exit(spark: SparkSession, path: str) -> None:
    _WRITTEN.append((spark, path))


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed and written as Parquet, so that lost executors cost no recomputation and later plans read only the columns they need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiloom-table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    deleted_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A small table in few files or row groups, over all cores; any other as it is. Its rows are the same either way."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL * cores and len(df.inputFiles()) < cores else df


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Rows numbered from 0 in order of a column without repeats: sorted by ranges, counted by range, offsets added."""
    place = F.monotonically_increasing_id()
    sorted_ = checkpointed(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", place))
    part = F.shiftright("__at", 33)
    # one row a partition
    sizes = sorted_.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).collect()
    total, ahead = 0, []
    for r in sorted(sizes):
        ahead.append((r["__part"], total))
        total += r["__n"]
    base = df.sparkSession.createDataFrame(ahead, "__part long, __base long")
    return sorted_.withColumn("__part", part).join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__base")
