"""The stages of the pipeline, each by itself and on odd rows, and all of them in a row."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else 0) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """Texts of which the odd ones hold invented insults, and their labels."""
    rng = np.random.default_rng(2)
    plain = ["".join(rng.choice(list("aeilnorst"), rng.integers(3, 8))) for _ in range(80)]
    rows = []
    for i in range(240):
        words = [plain[k] for k in rng.integers(0, 80, 60)]
        if i % 2:
            for k in rng.integers(0, 60, 8):
                words[k] = "zxgrumblock" + "aeiou"[k % 5]
        rows.append((i, " ".join(words), f"s{i % 3}"))
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    table(spark, rows).write.parquet(f"{where}/documents.parquet")
    return str(where), rows


def test_toxic_documents_go(spark, labelled):
    where, rows = labelled
    odd = [(1000, None, "x"), (1001, "", None), (5, rows[5][1], "s2")]
    out = corpus_pipeline.drop_toxic(spark, table(spark, rows + odd), where)
    assert out.columns == corpus_pipeline.COLUMNS
    kept = [r.doc_id for r in out.collect() if r.doc_id < 1000]
    clean = {i for i, _, _ in rows if i % 2 == 0}
    assert len(clean & set(kept)) > 0.95 * len(clean) and len(set(kept) - clean) < 0.05 * len(clean) and 5 not in kept
    assert corpus_pipeline.drop_toxic(spark, table(spark, rows).filter("false"), where).collect() == []


def test_repeated_lines_go(spark):
    line = " ".join(f"w{k}" for k in range(55))
    rows = [(1, f"one\n{line}\nend", "a"), (2, f"two\n{line}", None), (3, line, "a"), (4, None, "a"), (5, "", "a"), (6, " ", "b")]
    out = {r.doc_id: r for r in corpus_pipeline.drop_repeated_lines(spark, table(spark, rows), "").collect()}
    assert {i: r.text for i, r in out.items()} == {1: f"one\n{line}\nend", 2: "two", 4: None, 5: "", 6: " "}
    assert out[2].n_chars == 3 and out[1].n_chars == len(rows[0][1])


def test_one_of_each_group_stays(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(3, a, "x"), (1, a + " z", None), (1, a + " z", None), (1, a + " y", "x"), (2, b, "x"), (2, b, "x"), (None, b, "x"), (None, "alone without an id at all", "x"), (9, None, "x"), (9, None, "x"), (8, "", "x")]
    out = corpus_pipeline.drop_near_duplicates(spark, table(spark, rows), "").collect()
    kept = sorted((r.doc_id or 0, r.text or "") for r in out)
    first = [t for i, t in kept if i == 1]
    assert len(first) == 1 and first[0] in (a + " z", a + " y")
    assert kept == sorted([(1, first[0]), (2, b), (0, "alone without an id at all"), (9, ""), (9, ""), (8, "")])


def test_mix_repeats_documents(spark):
    rows = [(i, " ".join(["w"] * (20 + i % 7)), None if i % 5 == 0 else f"s{i % 3}") for i in range(200)] + [(900, "", "s1"), (901, None, "s1")]
    docs = table(spark, rows)
    out = corpus_pipeline.mix_to_weights(spark, docs, "")
    plan = {r.doc_id: r.copies for r in corpus_pipeline.mixing.mix_sources(docs).collect()}
    taken = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert taken == {i: n for i, n in plan.items() if n} and 900 not in taken and max(taken.values()) <= 2
    words = out.select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert abs(words - 1.5 * sum(len(t.split()) for _, t, _ in rows[:200])) < 100


def test_all_stages_in_a_row(spark, labelled):
    """The pieces of each document that came through are its ids, with the end id."""
    where, rows = labelled
    out = corpus_pipeline.run(spark, where).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    clean = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x, _ in rows if i % 2 == 0}
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert len(set(got) - set(clean)) <= 6 and len(set(got) & set(clean)) >= 0.7 * len(clean)
    for i in set(got) & set(clean):
        assert got[i] in (clean[i], 2 * clean[i])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing", "packing"]
