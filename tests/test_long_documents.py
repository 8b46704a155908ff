"""Queries keep long documents and documents of many hits."""

import re
import time
from collections import Counter

import pytest

from notegrove import queries
from notegrove.functions.fold import grams

FILL = "lorem ipsum dolor sit amet "
TEXTS = [
    "die lichkeit und die heitung",
    FILL * 900 + "lichkeit " + "x" * 50 + " heitung " + FILL * 20,
    "heitung " + FILL * 1200 + " lichkeit",
    FILL * 1000,
]


def tables(spark, path, texts):
    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_proximity_in_long_documents(spark, tmp_path):
    assert sum(len(t) >= 20_000 for t in TEXTS) == 3
    out = queries.QUERIES["proximity_two_terms"](spark, tables(spark, tmp_path, TEXTS)).collect()
    expected = {}
    for i, t in enumerate(TEXTS):
        spans = [[m.span() for m in re.finditer(w, t)] for w in ("lichkeit", "heitung")]
        widths = [max(a[1], b[1]) - min(a[0], b[0]) for a in spans[0] for b in spans[1]]
        if widths:
            expected[f"src1/en/doc-{i}.md"] = pytest.approx(1 + 0.4 * max(0.0, 1 - min(widths) / 400), abs=1e-6)
    assert len(out) == len(expected) == 3
    assert {r.path: r.factor for r in out} == expected


def test_whole_word_flags_of_many_hits(spark, tmp_path):
    texts = ["that " * n for n in (1, 499, 500, 700)] + ["thatched " * 450 + "that " * 100, "none"]
    out = queries.QUERIES["whole_word_flags"](spark, tables(spark, tmp_path, texts)).collect()
    found = {int(r.path.split("-")[1][:-3]): (r.n, r.whole) for r in out}
    # the first 500 occurrences count
    assert found == {0: (1, 1), 1: (499, 499), 2: (500, 500), 3: (500, 500), 4: (500, 50)}


LONG = ["lichkeites heit " + " ".join(f"w{i}o" for i in range(60_000)), "keit", "der bericht", "ab"]


def gram_sets():
    out = {}
    for i, t in enumerate(LONG):
        path = f"src1/en/doc-{i}.md"
        out[path] = set(grams(t)) | set(grams(f"doc-{i}")) | set(grams(path))
    return out


def expected_grams(name):
    held = gram_sets()
    wanted = {p: len(g & set(grams("lichkeites"))) for p, g in held.items()}
    counts = Counter(g for gs in held.values() for g in gs)
    return {
        "fuzzy_floor": [(p, n) for p, n in wanted.items() if n >= 2],
        "gram_stats": [(len(counts), sum(counts.values()))],
        "indexed_search": [("src1/en/doc-0.md",)],
        "trigram_candidates": [(p,) for p, g in held.items() if {"kei", "eit"} <= g],
        "trigram_postings": list(counts.items()),
    }[name]


@pytest.mark.parametrize("name", ["fuzzy_floor", "gram_stats", "indexed_search", "trigram_candidates", "trigram_postings"])
def test_gram_queries_of_a_long_document(spark, tmp_path, name):
    """400 000 characters take seconds; time by the square of a text's length took minutes."""
    sf = tables(spark, tmp_path, LONG)
    began = time.monotonic()
    out = [tuple(r) for r in queries.QUERIES[name](spark, sf).collect()]
    assert time.monotonic() - began < 30
    assert sorted(out) == sorted(expected_grams(name))


def test_top_k_breaks_ties_by_code_point_of_the_path(spark, tmp_path):
    """As its SQL does; the order of hits in a text is no difference of score."""
    rows = [(10_000 + i, t, "en", s, 1) for i, (s, t) in enumerate([("src7", "keit xkeit " * 9), ("src19", "xkeit keit " * 9), ("src19", "keit " * 18), ("src2", "xkeit " * 9 + "keit " * 9)])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.QUERIES["top_k"](spark, str(tmp_path)).collect()
    assert [r.path for r in out] == ["src19/en/doc-10002.md", "src19/en/doc-10001.md", "src2/en/doc-10003.md", "src7/en/doc-10000.md"]
    assert [r.position for r in out] == [0, 1, 2, 3] and len({r.score for r in out}) == 2


def test_grams_of_any_signs_and_lengths(monkeypatch):
    """Documents are taken together, alone or in parts, with the same grams."""
    from notegrove.plans import access

    odd = ["".join(map(chr, range(0x4E00, 0x4E00 + 5000))), "x\U0001f600y\U0001f600z", "ab", ""]
    docs = [[t, "doc", f"a/{k}"] for k, t in enumerate([*odd, "abcabcab" * 40, "zz" + "ab" * 90])]
    expected = {(k, g) for k, doc in enumerate(docs) for t in doc for g in grams(t)}
    for span, some in ((1 << 20, docs), (7, docs), (1 << 20, docs * 2)):
        monkeypatch.setattr(access, "SPAN", span)
        numbers, keys = access._of_many(some)
        found = list(zip(numbers.tolist(), access._spelt(keys).to_pylist()))
        assert len(found) == len(set(found)) and {(k % len(docs), g) for k, g in found} == expected
    alone = [access._of_one(doc)[1].tolist() for doc in docs]
    assert [len(set(a)) for a in alone] == [len({g for k, g in expected if k == n}) for n in range(len(docs))]


@pytest.mark.parametrize("name", ["trigram_postings", "trigram_candidates", "indexed_search"])
def test_gram_queries_cut_grams_once_and_leave_labels(spark, tmp_path, name):
    """A document with two rows of labels counts once, as the SQL's DISTINCT and GROUP BY have
    it; the texts are cut once, however many terms are asked for, and never shuffled."""
    sf = tables(spark, tmp_path, LONG[1:] + ["lichkeit heit"])
    spark.createDataFrame([(0, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{sf}/labels.parquet")
    out = queries.QUERIES[name](spark, sf)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("collect_set(") <= 1
    found = sorted(tuple(r) for r in out.collect())
    docs = [*LONG[1:], "lichkeit heit"]
    held = {f"src1/en/doc-{i}.md": set(grams(t)) | set(grams(f"doc-{i}")) | set(grams(f"src1/en/doc-{i}.md")) for i, t in enumerate(docs)}
    counts = Counter(g for gs in held.values() for g in gs)
    expected = {"trigram_postings": list(counts.items()), "trigram_candidates": [(p,) for p, g in held.items() if {"kei", "eit"} <= g], "indexed_search": [("src1/en/doc-3.md",)]}
    assert found == sorted(expected[name])
