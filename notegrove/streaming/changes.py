"""A feed of file changes, applied to ``docs`` batch by batch.

A change has ``seq, kind, path, old_path, raw, ctime, mtime``; kinds are created, modified,
deleted and renamed.  Within a batch the last change of a path wins and renames keep the
origin, so a document keeps its id.  Changes to files whose time and size are as indexed are
passed over.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..sources.ingest import DOCS, build_docs, folder_column, fold_field_column, format_column, title_column
from ..sources.store import Store

CHANGES = "seq long, kind string, path string, old_path string, raw string, ctime long, mtime long"


@dataclass(frozen=True)
class Pending:
    """What is to be done at a path: ``index``, ``move`` or ``delete``, from an origin."""

    kind: str
    origin: str | None = None


@dataclass
class File:
    """A file of a batch: the path of its record before the batch, and what became of it."""

    origin: str
    fate: str = "move"


class Files:
    """The files of a batch, replayed: which file each path holds.

    A deleted file keeps its path, so that one created there afterwards takes its record.
    A file that a rename puts out of the way, and one whose path a rename has passed through,
    leave a deletion at their own path unless something is there again.
    """

    def __init__(self):
        self.held: dict[str, File] = {}

    def change(self, path: str, fate: str) -> None:
        self.held.setdefault(path, File(path)).fate = fate

    def move(self, old: str, new: str) -> None:
        file = self.held.pop(old, None) or File(old)
        gone = [f.origin for f in (self.held.get(new),) if f and f.origin != new]
        gone += [old] if file.origin != old else []
        self.held[new] = file
        for path in gone:
            if path != file.origin:
                self.held.setdefault(path, File(path, "delete"))


def fold_changes(events: Iterable[tuple[str, str, str | None]]) -> dict[str, Pending]:
    """Changes in order to one outcome a path; an origin is named if it is another path, or if
    the record is to stay as it is."""
    files = Files()
    for kind, path, old_path in events:
        if path and kind == "renamed":
            files.move(old_path or path, path)
        elif path and kind in ("created", "modified", "deleted"):
            files.change(path, "delete" if kind == "deleted" else "index")
    return {p: Pending(f.fate, f.origin if f.origin != p or f.fate == "move" else None) for p, f in files.held.items()}


def _chains(renames: DataFrame) -> DataFrame:
    """``(path, chain)`` of the paths that renames touch: those tied by renames share the
    smallest path as their chain."""
    tied = renames.select(F.coalesce("old_path", "path").alias("a"), F.col("path").alias("b"))
    ties = tied.union(tied.select("b", "a")).distinct().persist()
    chains = ties.select(F.col("a").alias("path"), F.col("a").alias("chain")).distinct()
    left = 1
    while left:
        near = ties.join(chains.withColumnRenamed("path", "b"), "b").groupBy(F.col("a").alias("path")).agg(F.min("chain").alias("near"))
        met = chains.join(near, "path").select("path", "chain", F.least("chain", "near").alias("low"))
        up = chains.select(F.col("path").alias("low"), F.col("chain").alias("next"))
        met = met.join(up, "low").select("path", "chain", "next").persist()
        left = met.filter(F.col("next") != F.col("chain")).count()
        chains = met.select("path", F.col("next").alias("chain"))
    return chains


def outcomes(batch: DataFrame) -> DataFrame:
    """``path, kind, origin`` for a batch of changes.

    Paths that no rename touches are settled by a window; the others are replayed, one task
    a chain of renames.
    """
    batch = batch.filter(F.col("path") != "")
    chains = _chains(batch.filter(F.col("kind") == "renamed"))
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq")))
    alone = batch.join(chains, "path", "left_anti").withColumn("n", last).filter("n = 1")
    alone = alone.select("path", F.when(F.col("kind") == "deleted", "delete").otherwise("index").alias("kind"), F.lit(None).cast("string").alias("origin"))

    def replay(events: pd.DataFrame) -> pd.DataFrame:
        rows = events.sort_values("seq")
        old = rows["old_path"].where(rows["old_path"].notna(), None)
        folded = fold_changes(zip(rows["kind"], rows["path"], old))
        return pd.DataFrame([(p, o.kind, o.origin) for p, o in folded.items()], columns=["path", "kind", "origin"])

    tied = batch.join(chains, "path").select("seq", "kind", "path", "old_path", "chain")
    return alone.unionByName(tied.groupBy("chain").applyInPandas(replay, "path string, kind string, origin string"))


def apply_changes(docs: DataFrame, batch: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` after a batch: deleted rows go, moved ones keep id and text, changed ones are
    read anew unless time and size are as indexed.  A moved file without a record is read."""
    todo = outcomes(batch).withColumn("origin", F.coalesce("origin", "path"))
    kind_of = format_column(F.col("path"))
    gone = (F.col("kind") == "delete") | ~F.coalesce(kind_of.isin(*settings.formats), F.lit(False))
    live = todo.filter(~gone)
    ids = docs.select("id", "path", F.col("indexed_mtime").alias("old_mtime"), F.col("size").alias("old_size"))
    # ids: a record at the origin lends its id to the new path
    lent = todo.filter(F.col("origin") != F.col("path")).select("origin").distinct()
    own = live.filter(F.col("origin") == F.col("path")).join(lent, "origin", "left_anti")
    keeps = own.unionByName(live.filter(F.col("origin") != F.col("path")))
    known = keeps.join(ids.withColumnRenamed("path", "origin"), "origin", "left").select("path", "id", "old_mtime", "old_size")
    newest = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq")))
    payload = batch.filter("raw is not null").withColumn("n", newest).filter("n = 1").select("path", "raw", "ctime", "mtime")
    moved = live.join(known, "path", "left").join(payload, "path", "left")
    as_indexed = F.col("id").isNotNull() & (F.col("mtime") == F.col("old_mtime")) & (F.octet_length("raw") == F.col("old_size"))
    kind = F.when(as_indexed, "move").when((F.col("kind") == "move") & F.col("id").isNull(), "index").otherwise(F.col("kind"))
    moved = moved.select("path", "origin", kind.alias("kind"), "id", "raw", "ctime", "mtime")
    touched = todo.select("path").union(todo.select(F.col("origin").alias("path"))).distinct()
    untouched = docs.join(touched, "path", "left_anti").select(DOCS.fieldNames())
    files = moved.filter((F.col("kind") == "index") & F.col("raw").isNotNull()).select("path", F.col("id").alias("kept_id"), "raw", "ctime", "mtime")
    # a path whose record has moved on gets an id that the moved one does not have
    renewed = F.xxhash64("path", "mtime")
    files = files.join(lent.select(F.col("origin").alias("path"), F.lit(True).alias("lent")), "path", "left")
    files = files.withColumn("kept_id", F.coalesce("kept_id", F.when(F.col("lent"), renewed))).drop("lent")
    fresh = build_docs(files.select("path", "raw", "ctime", "mtime"), settings).join(files.select("path", "kept_id"), "path")
    fresh = fresh.withColumn("id", F.coalesce("kept_id", "id")).select(DOCS.fieldNames())
    renamed = moved.filter((F.col("kind") == "move") & F.col("id").isNotNull() & (F.col("path") != F.col("origin"))).select(F.col("path").alias("to"), "id")
    same = moved.filter((F.col("kind") == "move") & F.col("id").isNotNull() & (F.col("path") == F.col("origin"))).select("id")
    stay = docs.join(same, "id", "left_semi").select(DOCS.fieldNames())
    relocated = (
        docs.join(renamed, "id")
        .withColumn("path", F.col("to"))
        .withColumn("title", title_column(F.col("path")))
        .withColumn("folder", folder_column(F.col("path")))
        .withColumn("title_norm", fold_field_column(F.col("title")))
        .withColumn("path_norm", fold_field_column(F.col("path")))
        .withColumn("format", format_column(F.col("path")))
        .select(DOCS.fieldNames())
    )
    return untouched.unionByName(fresh).unionByName(relocated).unionByName(stay)


def follow(spark: SparkSession, source: str, store: Store, settings: Settings = Settings(), checkpoint: str | None = None):
    """A streaming query that applies the change files under ``source`` to the store."""

    def step(batch: DataFrame, number: int) -> None:
        if not batch.limit(1).count():
            return
        docs = store.load(settings).docs
        if docs is None:
            docs = spark.createDataFrame([], DOCS)
        store.write(apply_changes(docs, batch, settings), settings, number)

    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 100).parquet(source)
    writer = stream.writeStream.foreachBatch(step).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
