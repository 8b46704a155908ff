"""The contract queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import topk_search


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard join of 3-word shingle sets at 90 percent."""
    from .ngram_jaccard import ngram_jaccard_join

    out = ngram_jaccard_join(_read(spark, sf_dir, "documents"), width=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    from .toxicity import score_documents

    return score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), threshold=0.3)


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of every fiftieth vector against all others."""
    from .topk_search import top_k_search

    return top_k_search(_read(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from pyspark.sql import functions as F

    from .html_extract import extract_pages

    out = extract_pages(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    from pyspark.sql import functions as F

    from .packing import pack_documents

    out = pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source targets of 150 percent of all words."""
    from pyspark.sql import functions as F

    from .mixing import mix_sources

    out = mix_sources(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    from pyspark.sql import functions as F

    from .token_store import tokens_round_trip

    out = tokens_round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of line runs of 50 words or more."""
    from .line_dedup import line_dedup

    return line_dedup(_read(spark, sf_dir, "documents"), min_words=50).select("doc_id", "text", "n_lines", "n_removed")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document."""
    from .lm_score import score_documents

    return score_documents(_read(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal label at cosine 0.98."""
    from .embedding_dedup import embedding_near_dedup

    return embedding_near_dedup(_read(spark, sf_dir, "embeddings"), cosine=0.98)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_topk_search": op3_topk_search,
    "op4_html_extraction": op4_html_extraction,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_token_files": op7_token_files,
    "op8_line_dedup": op8_line_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}

#: DuckDB SQL where SQL can express the query over whole tables.
SQL: dict[str, str] = {"op3_topk_search": topk_search.SQL}
