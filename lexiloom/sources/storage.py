"""Stored models: Parquet tables and JSON manifests under one folder, on any Hadoop file system.

A table is replaced by writing a new version beside the old one and then a manifest that names it.
Manifests are numbered: each is written under another name and renamed to the next number, which
nothing has yet, so that at no time there is none; readers take the highest that they can read.
Older ones are deleted afterwards. Pending rows and embeddings are appended.
"""

from __future__ import annotations

import json
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


class ModelStorage(Protocol):
    """What the model, the runner and the updater ask of a store."""

    def save_json(self, name: str, value: dict) -> None: ...

    def load_json(self, name: str) -> dict | None: ...

    def save_table(self, name: str, table: DataFrame) -> None: ...

    def load_table(self, name: str) -> DataFrame | None: ...

    def append_table(self, name: str, rows: DataFrame) -> None: ...

    def delete(self, name: str) -> None: ...

    def append_embeddings(self, rows: DataFrame) -> None: ...

    def embeddings(self) -> DataFrame: ...

    def load_embeddings(self, ids: DataFrame) -> DataFrame: ...

    def embedding_count(self) -> int: ...

    def append_pending(self, rows: DataFrame) -> None: ...

    def pending(self) -> DataFrame | None: ...

    def pending_count(self) -> int: ...

    def drain(self) -> DataFrame | None: ...

    def restore(self) -> None: ...

    def forget(self) -> None: ...

    def save_graph(self, graph: DataFrame) -> None: ...

    def load_graph(self) -> DataFrame | None: ...

    def save_reduced(self, points: DataFrame) -> None: ...

    def load_reduced(self) -> DataFrame | None: ...

    def save_checkpoint(self, value: dict) -> None: ...

    def load_checkpoint(self) -> dict | None: ...

    def clear_checkpoint(self) -> None: ...

    def clear(self) -> None: ...

    def size_bytes(self) -> int: ...


class MissingEmbedding(KeyError):
    pass


class ParquetStorage:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # manifests

    def _numbers(self, name: str) -> list[int]:
        """Of the manifests of a name, the latest first."""
        found = self._fs.globStatus(self._path(f"{name}.*.json")) or []
        parts = [f.getPath().getName()[len(name) + 1 : -len(".json")] for f in found]
        return sorted((int(x) for x in parts if x.isdigit()), reverse=True)

    def save_json(self, name: str, value: dict) -> None:
        temporary = self._path(f".{name}-{uuid.uuid4().hex}.tmp")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(value), "utf-8"))
        out.close()
        before = self._numbers(name)
        number = before[0] + 1 if before else 0
        if not self._fs.rename(temporary, self._path(f"{name}.{number}.json")):
            raise OSError(f"manifest {number} of {name} is there already: another writer is at work")
        for n in before[1:]:  # the one before stays, for readers that have begun
            self._fs.delete(self._path(f"{name}.{n}.json"), False)

    def load_json(self, name: str) -> dict | None:
        """The latest that can be read; None if there is none."""
        for n in self._numbers(name):
            lines = self.spark.read.text(f"{self.path}/{name}.{n}.json", wholetext=True).collect()
            try:
                return json.loads(lines[0]["value"])
            except (IndexError, ValueError):
                continue
        return None

    def delete(self, name: str) -> None:
        for n in self._numbers(name):
            self._fs.delete(self._path(f"{name}.{n}.json"), False)
        self._fs.delete(self._path(name), True)

    # tables

    def save_table(self, name: str, table: DataFrame) -> None:
        version = uuid.uuid4().hex
        table.write.parquet(f"{self.path}/{name}/{version}")
        before = self.load_json(name) or {"versions": []}
        self.save_json(name, {"versions": [version], "previous": before["versions"], "format": VERSION})
        for v in before.get("previous", []):  # the version before stays, for readers that have begun
            self._fs.delete(self._path(f"{name}/{v}"), True)

    def load_table(self, name: str) -> DataFrame | None:
        manifest = self.load_json(name)
        return self.spark.read.parquet(*[f"{self.path}/{name}/{v}" for v in manifest["versions"]]) if manifest else None

    def append_table(self, name: str, rows: DataFrame) -> None:
        """Rows beside those of the latest version, under a new one that names both folders."""
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{name}/{version}")
        before = self.load_json(name) or {"versions": []}
        self.save_json(name, {**before, "versions": [*before["versions"], version], "format": VERSION})

    # neighbour graphs and reduced vectors

    def save_graph(self, graph: DataFrame) -> None:
        """(src, rank, dst, dist) of a nearest-neighbour graph."""
        self.save_table("graph", graph.select("src", "rank", "dst", "dist"))

    def load_graph(self) -> DataFrame | None:
        return self.load_table("graph")

    def save_reduced(self, points: DataFrame) -> None:
        self.save_table("reduced", points)

    def load_reduced(self) -> DataFrame | None:
        return self.load_table("reduced")

    # embeddings: append, point reads, scan

    def append_embeddings(self, rows: DataFrame) -> None:
        rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<float>").alias("embedding")).write.mode("append").parquet(f"{self.path}/embeddings")

    def embeddings(self) -> DataFrame:
        if not self._fs.exists(self._path("embeddings")):
            return self.spark.createDataFrame([], "doc_id long, embedding array<float>")
        return self.spark.read.parquet(f"{self.path}/embeddings")

    def load_embeddings(self, ids: DataFrame) -> DataFrame:
        """The vectors of all ids (doc_id); an error if one is missing."""
        missing = ids.join(self.embeddings().select("doc_id"), "doc_id", "left_anti").take(1)
        if missing:
            raise MissingEmbedding(missing[0]["doc_id"])
        return self.embeddings().join(ids, "doc_id", "left_semi")

    def embedding_count(self) -> int:
        return self.embeddings().count()

    # pending rows

    def append_pending(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/pending/{(self.load_json('pending_epoch') or {'epoch': 0})['epoch']}")

    def pending(self) -> DataFrame | None:
        epoch = (self.load_json("pending_epoch") or {"epoch": 0})["epoch"]
        return self.spark.read.parquet(f"{self.path}/pending/{epoch}") if self._fs.exists(self._path(f"pending/{epoch}")) else None

    def pending_count(self) -> int:
        rows = self.pending()
        return rows.count() if rows is not None else 0

    def drain(self) -> DataFrame | None:
        """The pending rows; later ones go to a new folder, so that these stay readable until forget()."""
        rows, epoch = self.pending(), (self.load_json("pending_epoch") or {"epoch": 0})["epoch"]
        self.save_json("pending_epoch", {"epoch": epoch + 1})
        return rows

    def restore(self) -> None:
        """Undo the last drain: its rows are pending once more."""
        epoch = (self.load_json("pending_epoch") or {"epoch": 0})["epoch"]
        if epoch and self._fs.exists(self._path(f"pending/{epoch - 1}")):
            self.spark.read.parquet(f"{self.path}/pending/{epoch - 1}").write.mode("append").parquet(f"{self.path}/pending/{epoch}")
            self.forget()

    def forget(self) -> None:
        epoch = (self.load_json("pending_epoch") or {"epoch": 0})["epoch"]
        self._fs.delete(self._path(f"pending/{epoch - 1}"), True)

    # checkpoints of training

    def save_checkpoint(self, value: dict) -> None:
        self.save_json("checkpoint", value)

    def load_checkpoint(self) -> dict | None:
        return self.load_json("checkpoint")

    def clear_checkpoint(self) -> None:
        self.delete("checkpoint")

    def clear(self) -> None:
        self._fs.delete(self._path("."), True)

    def size_bytes(self) -> int:
        root = self._path(".")
        return self._fs.getContentSummary(root).getLength() if self._fs.exists(root) else 0
