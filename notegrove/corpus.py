"""The tables of a scale-factor folder as collections that can be searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.ingest import plain_docs

#: 2024-01-01 in epoch milliseconds; documents are an hour apart by id.
EPOCH, HOUR, DAY = 1_704_067_200_000, 3_600_000, 86_400_000
NOW = EPOCH + 400 * DAY


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """``docs`` of the documents table: source and language are folders, the language a tag,
    labels are properties, unless they are not asked for, which saves a join of all texts."""
    rows, props = read(spark, sf_dir, "documents"), F.create_map().cast("map<string,string>")
    if labelled:
        labels = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
        rows = rows.join(labels, "doc_id", "left")
        props = F.when(
            F.col("quality").isNotNull(),
            F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string")),
        ).otherwise(props)
    created = F.lit(EPOCH) + F.col("doc_id") * HOUR
    return plain_docs(
        rows.select(
            F.concat_ws("/", "source", "lang", F.concat(F.lit("doc-"), "doc_id", F.lit(".md"))).alias("path"),
            F.col("text").alias("raw"),
            created.alias("ctime"),
            (created + F.col("doc_id") % 400 * DAY).alias("mtime"),
            F.array("lang").alias("tags"),
            props.alias("properties"),
        )
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docs`` of the pages table, as a second format; the url is the path."""
    return plain_docs(
        read(spark, sf_dir, "pages").select(
            F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.col("html").alias("raw"),
            (F.lit(EPOCH) + F.col("page_id") * HOUR).alias("ctime"), (F.lit(EPOCH) + F.col("page_id") * DAY).alias("mtime"),
            F.lit("base").alias("format"),
        )
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docs`` of the conversations table, as a third format, one a turn."""
    return plain_docs(
        read(spark, sf_dir, "conversations").select(
            F.concat(F.lit("chat/"), "conv_id", F.lit("/"), "turn", F.lit(".canvas")).alias("path"), F.col("text").alias("raw"),
            (F.lit(EPOCH) + F.col("conv_id") * HOUR).alias("ctime"), (F.lit(EPOCH) + F.col("turn") * DAY).alias("mtime"),
            F.lit("canvas").alias("format"),
        )
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a change feed: users are paths, event types are kinds."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 7 == 0, "deleted").when(F.col("event_id") % 3 == 0, "created").otherwise("modified")
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("u/"), "user_id", F.lit(".md")).alias("path"),
        F.lit(None).cast("string").alias("old_path"), F.col("props").alias("raw"), millis.alias("ctime"), millis.alias("mtime"),
    )
