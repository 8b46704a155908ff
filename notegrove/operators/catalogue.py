"""Aggregates over ``docs`` and the lists that filters offer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fold import fold


def stats(docs: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """One row: documents, text characters, bytes of the files, words, and postings if given."""
    out = docs.agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("text_chars"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n_words"),
    )
    if grams is not None:
        each = grams.groupBy("gram").count().agg(F.struct(F.count("*").alias("n"), F.coalesce(F.sum("count"), F.lit(0)).alias("held")).alias("g"))
        out = out.withColumn("g", each.scalar()).select("*", F.col("g.n").alias("n_grams"), F.col("g.held").alias("n_postings")).drop("g")
    return out


def properties(docs: DataFrame) -> DataFrame:
    """``key, value, n_docs`` of all properties."""
    each = docs.select(F.explode("properties").alias("key", "value"))
    return each.groupBy("key", "value").agg(F.count("*").alias("n_docs"))


def property_suggestions(docs: DataFrame, key: str, text: str = "", most: int = 50) -> DataFrame:
    """Values of a property that hold a text, in order, at most so many."""
    held = properties(docs).filter((F.col("key") == key) & F.col("value").contains(fold(text)))
    return held.select("value").distinct().orderBy("value").limit(most)


def folder_suggestions(docs: DataFrame, text: str = "", most: int = 50) -> DataFrame:
    """Folders whose name holds a text without case."""
    return docs.select("folder").distinct().filter(F.lower("folder").contains(text.lower())).orderBy("folder").limit(most)


def curate(results: DataFrame, kept: DataFrame | None, dismissed: DataFrame | None) -> DataFrame:
    """What remains of a run: the kept if any are, else all but the dismissed; by ``path``."""
    if kept is not None and kept.limit(1).count():
        results = results.join(kept.select("path").distinct(), "path", "left_semi")
    if dismissed is not None:
        results = results.join(dismissed.select("path").distinct(), "path", "left_anti")
    return results
