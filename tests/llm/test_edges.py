"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and
extra columns with clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from notegrove.llm import embedding_dedup, html_extract, line_dedup, lm_score, mixing, ngram_jaccard, packing, token_store, topk_search, toxicity

LONG = " ".join(f"word{i % 977}" for i in range(40_000))
TEXTS = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two three four five six seven"), (5, "one two three four five six seven"), (6, "one two three four five six seven"), (None, "an orphan row of six words"), (7, LONG), (8, LONG + " end"), (9, "É ñ ß 🔥   x\r\ny")]
SCHEMA = "doc_id long, text string"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["a", None, "b"][k % 3], 1, 2.0, "x") for k, (i, t) in enumerate(TEXTS)]
    # names that operators use themselves
    return spark.createDataFrame(rows, SCHEMA + ", source string, n_lines int, score double, size string").cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def test_jaccard(docs, none):
    out = ngram_jaccard.ngram_jaccard_join(docs, 3, 90).collect()
    assert len(out) == len(TEXTS)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[4] == {(1, 4)}
    assert by[5] == {(5, 5)} and by[6] == {(5, 5)} and by[None] == {(4, None)}
    assert {c for _, c in by[8]} == {7}
    assert ngram_jaccard.ngram_jaccard_join(none).collect() == []


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(5, 1), (6, 0), (4, None), (99, 1), (5, 1)], "doc_id long, toxic int")
    out = toxicity.score_documents(docs, labels).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 for r in out)
    assert {r.predicted for r in out} <= {0, 1} and all(r.held_out is not None for r in out)
    assert toxicity.score_documents(docs, labels.filter("false")).count() == len(TEXTS)
    assert toxicity.score_documents(none, labels).collect() == []
    assert set(toxicity.score(docs, b"\0" * 4 * toxicity.BUCKETS, 0.0).columns) == set(docs.columns)


def test_top_k(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, nan]), (4, [0.5, None]), (5, None), (6, []), (7, [9.0]), (50, [0.0, 1.0]), (None, [1.0, 1.0]), (8, [float("inf"), 1.0])]
    v = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, rank int")
    out = [tuple(r) for r in topk_search.top_k_search(v).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0)]
    assert topk_search.top_k_search(v.filter("false")).collect() == []


def test_html(spark):
    rows = [(1, "http://a.com/x", None), (2, None, ""), (3, "http://a.com/y", "<p>Text &amp; more"), (3, "http://a.com/y", "<p>Text &amp; more"), (4, "::", "plain < text"), (5, "http://b.com", "<div>" * 3000 + "deep" + "</div>" * 3000), (None, "http://c.com", "<nav>menu</nav>")]
    pages = spark.createDataFrame([(i, u, h, "old", 1) for i, u, h in rows], "page_id long, url string, html string, text string, host int")
    out = html_extract.extract_pages(pages)
    assert sorted((r.page_id or 0, r.text) for r in out.collect()) == [(0, ""), (1, ""), (2, ""), (3, "Text & more"), (3, "Text & more"), (4, "plain < text"), (5, "deep")]
    assert out.columns == ["page_id", "url", "host", "text"]
    assert html_extract.extract_pages(pages.filter("false")).collect() == []


def test_packing(docs, none):
    out = packing.pack_documents(docs, BYTE).collect()
    lengths = {}
    for r in out:
        assert len(r.ids) == 4 * r.length
        lengths.setdefault((r.doc_id, r.doc_tokens), []).append(r.length)
    # the repeated row is packed twice
    assert sum(map(sum, lengths.values())) == sum(n * (2 if i == 5 else 1) for i, n in lengths)
    assert lengths[1, 1] == [1] and lengths[2, 1] == [1]
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(none, BYTE).collect() == []


def test_mixing(docs, none):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(TEXTS)
    assert all(r.copies <= 2 and (r["size"] > 0 or r.copies == 0) for r in out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    assert mixing.mix_sources(none).collect() == []


def test_token_files(docs, none):
    out = token_store.tokens_round_trip(docs, WORD).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in out:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens and r.ids[-4:] == b"\1\0\0\0"
        at += r.n_tokens
    assert token_store.tokens_round_trip(none, WORD).collect() == []


def test_line_dedup(spark, none):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a\n{line}\nb"), (2, f"{line}\nc"), (2, f"{line}\nc"), (3, line), (3, line + "\n"), (4, None), (5, ""), (6, f"{line}\n{line}"), (7, "a\nb"), (None, f"x\n{line}")]
    docs = spark.createDataFrame([(i, t, 5, "k") for i, t in rows], "doc_id long, text string, n_removed int, version string")
    out = sorted(((r.doc_id or 0, r.text or "", r.n_lines, r.n_removed) for r in line_dedup.line_dedup(docs).collect()))
    assert out == [(0, f"x\n{line}", 2, 0), (1, "a\nb", 3, 1), (2, "c", 2, 1), (2, "c", 2, 1), (3, "", 1, 1), (3, "", 2, 1), (4, "", 0, 0), (5, "", 0, 0), (6, "", 2, 2), (7, "a\nb", 2, 0)]
    assert line_dedup.line_dedup(none).collect() == []


def test_lm(docs, none):
    out = lm_score.score_documents(docs).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        assert (r.mean_log_prob is None) == (r.n_words == 0) and r.log_prob <= 0
    assert lm_score.score_documents(none).collect() == []


def test_embedding_dedup(spark):
    nan = float("nan")
    rows = [(3, 1, [1.0, 0.0]), (2, 1, [2.0, 0.0]), (1, 1, [1.0, 0.05]), (4, 2, [1.0, 0.0]), (5, None, [1.0, 0.0]), (6, 1, None), (7, 1, [0.0, 0.0]), (8, 1, [nan, 1.0]), (9, 1, []), (10, 1, [1.0]), (3, 1, [1.0, 0.0]), (11, 1, [1e30, 1e-30]), (None, 1, [1.0, 0.0])]
    v = spark.createDataFrame([(i, e, k, 0) for i, k, e in rows], "vec_id long, embedding array<double>, label int, n_links int")
    out = {(r.vec_id): (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_near_dedup(v).collect()}
    assert out[1] == (4, 1, True) and out[2] == (4, 1, False) and out[3] == (4, 1, False) and out[11] == (4, 1, False)
    for i in (4, 5, 6, 7, 8, 9, 10):
        assert out[i] == (0, i, True)
    assert out[None][0] == 0
    assert embedding_dedup.embedding_near_dedup(v.filter("false")).collect() == []


def test_columns_of_documents_survive(docs):
    out = line_dedup.line_dedup(docs.withColumn("extra", F.lit(7)))
    assert {"doc_id", "source", "score", "size", "extra", "text"} <= set(out.columns)
