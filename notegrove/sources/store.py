"""Versions of ``docs`` in a folder: each write is a new version, the newest valid one counts."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.fold import fold
from .ingest import DOCS, excluded

SCHEMA_VERSION = 1
META = "version int, schema_version int, vault string, fingerprint string, built_at long, n_docs long"


def fingerprint(settings: Settings) -> str:
    """Of what changes the index: created field, folders and formats, in any order."""
    folders = sorted({f.strip().strip("/") for f in settings.excluded_folders} - {""})
    parts = [fold(settings.created_field).strip(), folders, sorted(settings.formats)]
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:16]


@dataclass
class Loaded:
    """What a load found; without ``docs``, ``reason`` says why."""

    docs: DataFrame | None
    reason: str | None = None


class Store:
    def __init__(self, spark: SparkSession, root: str, vault: str = "vault"):
        self.spark, self.root, self.vault = spark, root.rstrip("/"), vault

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def meta(self) -> dict | None:
        """The newest version's row, None without one."""
        if not self.exists(f"{self.root}/meta"):
            return None
        row = self.spark.read.schema(META).parquet(f"{self.root}/meta").orderBy(F.desc("version")).first()
        return row.asDict() if row else None

    def write(self, docs: DataFrame, settings: Settings, built_at: int) -> int:
        """Write a version; it counts once its meta row is there."""
        version = (self.meta() or {"version": 0})["version"] + 1
        path = f"{self.root}/docs/v={version}"
        docs.select(DOCS.fieldNames()).write.mode("overwrite").parquet(path)
        n = self.spark.read.schema(DOCS).parquet(path).count()
        row = [(version, SCHEMA_VERSION, self.vault, fingerprint(settings), built_at, n)]
        self.spark.createDataFrame(row, META).coalesce(1).write.mode("append").parquet(f"{self.root}/meta")
        return version

    def load(self, settings: Settings, force: bool = False) -> Loaded:
        """The newest version if it fits; reasons: missing, forced, schema, vault, settings, corrupt."""
        meta = self.meta()
        if meta is None:
            return Loaded(None, "missing")
        for bad, reason in (
            (force, "forced"),
            (meta["schema_version"] != SCHEMA_VERSION, "schema"),
            (meta["vault"] != self.vault, "vault"),
            (meta["fingerprint"] != fingerprint(settings), "settings"),
        ):
            if bad:
                return Loaded(None, reason)
        path = f"{self.root}/docs/v={meta['version']}"
        if not self.exists(path):
            return Loaded(None, "corrupt")
        docs = self.spark.read.schema(DOCS).parquet(path)
        broken = F.col("id").isNull() | F.col("path").isNull() | F.col("text").isNull() | (F.col("path") == "")
        seen = docs.agg(F.count("*").alias("n"), F.count_if(broken).alias("bad")).first()
        if seen["bad"] or seen["n"] != meta["n_docs"]:
            return Loaded(None, "corrupt")
        return Loaded(docs)

    def seed(self, settings: Settings) -> DataFrame | None:
        """Stored rows to start from: not excluded, one a path and one an id."""
        docs = self.load(settings).docs
        if docs is None:
            return None
        docs = docs.filter(F.col("format").isin(*settings.formats) & ~excluded(F.col("path"), settings.excluded_folders))
        return docs.dropDuplicates(["path"]).dropDuplicates(["id"])

    def put(self, changed: DataFrame, settings: Settings, built_at: int) -> int:
        """Insert rows, or replace those of the same id or path, in a new version."""
        old = self.load(settings).docs
        if old is not None:
            keys = changed.select("id", "path")
            rest = old.join(keys.select("id"), "id", "left_anti").join(keys.select("path"), "path", "left_anti")
            changed = rest.select(DOCS.fieldNames()).unionByName(changed.select(DOCS.fieldNames()))
        return self.write(changed, settings, built_at)

    def delete(self, keys: DataFrame, key: str, settings: Settings, built_at: int) -> int | None:
        """A new version without the rows whose ``key`` (``id`` or ``path``) is in ``keys``."""
        old = self.load(settings).docs
        return None if old is None else self.write(old.join(keys.select(key), key, "left_anti"), settings, built_at)

    def stats(self, settings: Settings) -> DataFrame | None:
        """``id, path, indexed_mtime, size`` without reading more."""
        docs = self.load(settings).docs
        return None if docs is None else docs.select("id", "path", "indexed_mtime", "size")

    def read(self, settings: Settings, id_: int) -> DataFrame | None:
        docs = self.load(settings).docs
        return None if docs is None else docs.filter(F.col("id") == id_)

    def clear(self) -> None:
        fs, p = self._fs(self.root)
        fs.delete(p, True)


def stale_files(live: DataFrame, docs: DataFrame) -> DataFrame:
    """Live files that are new or whose time is not the indexed one."""
    known = docs.select("path", "indexed_mtime")
    return live.join(known, "path", "left").filter(F.col("indexed_mtime").isNull() | (F.col("mtime") != F.col("indexed_mtime"))).drop("indexed_mtime")


def drop_vanished(docs: DataFrame, live: DataFrame) -> DataFrame:
    """Records whose file is still there."""
    return docs.join(live.select("path"), "path", "left_semi")


def vanished(docs: DataFrame, live: DataFrame) -> DataFrame:
    return docs.join(live.select("path"), "path", "left_anti")
