"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all
but the last return the columns of ``documents``.  Between stages the rows are written to
the shared folder and read again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrove.llm import line_dedup, mixing, ngram_jaccard, packing, toxicity
from notegrove.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; learned from the labels of the documents given.

    Null and empty texts score by the class ratio alone; repeated rows share their fate, and
    an empty table gives none.  Without labels of both kinds all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chosen = F.broadcast(toxicity.sample_labels(labels, "toxic"))  # bounded by its parameter
    weights, bias = toxicity.train(docs.select("doc_id", "text").join(chosen, "doc_id"), toxicity.sample_shift(labels, "toxic"))
    return toxicity.score(docs.select(COLUMNS), weights, bias).filter("score < 0.3").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; documents that had nothing else go.

    Null, empty and blank texts that lost nothing stay as they are.
    """
    out = line_dedup.line_dedup(docs.select(COLUMNS), min_words=50)
    kept = out.filter((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 or more: the smallest id.

    Of rows that repeat that id, one stays: the text of smallest hash, once.  Documents without
    words are in no group and stay, as do groups of which no row has an id.  A row without id
    goes if its group has one.  An empty table gives none.
    """
    rows = ngram_jaccard.ngram_jaccard_join(docs, width=5, percent=80).filter("n_shingles > 0 and component_id is not null")
    rows = materialize(rows.select("doc_id", "component_id", "text_hash"), "pipeline-groups")
    best = rows.filter("doc_id = component_id").groupBy("component_id").agg(F.min("text_hash").alias("best"))
    gone = rows.join(best, "component_id").filter(~F.col("doc_id").eqNullSafe(F.col("component_id")) | (F.col("text_hash") != F.col("best")))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    named = docs.select(*COLUMNS, F.xxhash64(F.col("text").cast("string")).alias("__of"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__hash"))
    kept = named.join(gone, same, "left_anti")
    twice = rows.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).count().filter("count > 1")
    if not twice.limit(1).count():
        return kept.select(COLUMNS)
    twice = materialize(twice.select("__id", "__hash"), "pipeline-repeats")
    once = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "__of"])
    return kept.join(twice, same, "left_anti").unionByName(once).select(COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Texts without words are taken 0 times and go; rows alike in id, source and size are taken
    equally often.  A null source is one of its own; an empty table gives none.
    """
    plan = mixing.mix_sources(docs).filter("copies > 0").select("doc_id", "source", "size", "copies").distinct()
    plan = plan.select(*(F.col(c).alias(f"__{c}") for c in plan.columns))
    sized = docs.select(*COLUMNS, mixing.word_count(F.col("text")).alias("__words"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__source"))
    taken = sized.join(plan, same & (F.col("__words") == F.col("__size")))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 1024 ids; null and empty texts are the end id alone."""
    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing", mix_to_weights),
    ("packing", pack),
]

#: SQL cannot express the classifier, the rounding or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{k}-{name.replace(' ', '-')}")
    return docs
