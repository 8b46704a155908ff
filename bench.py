"""Headline queries on one machine; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose tables and cores.  Ingest is timed as documents a
second, the 35 query shapes one by one over a prepared collection and as one batch.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from notegrove import corpus  # noqa: E402
from notegrove.engine import SearchEngine  # noqa: E402
from notegrove.plans.predicates import Filters  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
E, H = corpus.EPOCH, corpus.HOUR

#: Name, query, filters and sort of each shape.
SHAPES = [
    ("single_term", "lichkeit", {}, None), ("single_term_2", "mention", {}, None), ("infix", "ichk", {}, None),
    ("infix_2", "ation", {}, None), ("two_terms", "keit heit", {}, None), ("two_terms_2", "ment tion", {}, None),
    ("three_terms", "keit heit lich", {}, None), ("three_terms_2", "the and tion", {}, None),
    ("phrase", '"of the"', {}, None), ("phrase_2", '"in der"', {}, None), ("exclusion", "tion -the", {}, None),
    ("phrase_exclusion", '"of the" -thing', {}, None), ("or_two", "keit OR mente", {}, None),
    ("or_three", "the OR der OR les", {}, None), ("two_chars", "ño", {}, None), ("two_chars_and_long", "ch lichkeit", {}, None),
    ("path", "path:src1/en", {}, None), ("title", "title:doc-12", {}, None), ("tag", "tag:de", {}, None),
    ("umlaut", "über", {}, None), ("umlaut_2", "für", {}, None), ("sharp_s", "eiß", {}, None), ("alias", "ueber", {}, None),
    ("alias_2", "fuer", {}, None), ("typo_short", "keti", {}, None), ("typo_long", "lichkiet", {}, None),
    ("folder", "tion", {"folder": "src1"}, None), ("one_format", "tion", {"formats": ("markdown",)}, None),
    ("folder_flat", "tion", {"folder": "src1/en", "subfolders": False}, None),
    ("folder_created", "tion", {"folder": "src2", "created_from": E, "created_to": E + 5000 * H}, None),
    ("modified", "tion", {"modified_from": E + 3000 * H}, None), ("no_term_created", "", {"created_to": E + 4000 * H}, None),
    ("no_term_folder", "", {"folder": "src3"}, None), ("sort_modified", "keit", {}, "modified-desc"),
    ("sort_title", "keit", {}, "title-asc"),
]


def timed(f) -> float:
    start = time.perf_counter()
    f()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(10).count()
    path = tempfile.mkdtemp()  # one machine
    seconds = {"ingest": timed(lambda: corpus.documents(spark, SF_DIR).write.mode("overwrite").parquet(f"{path}/docs"))}
    docs = spark.read.parquet(f"{path}/docs").repartition(int(CPUS)).cache()
    n = docs.count()
    engine = SearchEngine(docs)

    def run(text: str, filters: dict, sort: str | None, fuzzy: bool = False) -> None:
        engine.search(text, Filters(**filters), sort=sort, fuzzy=fuzzy, limit=200, now=corpus.NOW).collect()

    run("keit heit", {}, None)  # warm
    for name, text, filters, sort in SHAPES:
        seconds[name] = timed(lambda: run(text, filters, sort))  # noqa: B023
    seconds["fuzzy_typo_long"] = timed(lambda: run("lichkiet", {}, None, True))
    asked = {name: text for name, text, filters, sort in SHAPES if text and not filters}
    seconds["batch_all_shapes"] = timed(lambda: engine.batch(asked).groupBy("query").count().collect())
    print(
        json.dumps(
            {
                "metric": "total seconds of ingest, 35 query shapes and one batch",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR),
                "docs": n,
                "ingest_docs_per_s": round(n / seconds["ingest"], 1),
                "batch_queries_per_s": round(len(asked) / seconds["batch_all_shapes"], 2),
            }
        )
    )


if __name__ == "__main__":
    main()
