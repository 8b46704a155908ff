"""The fuzzy test is the same with more near words than go into a plan as literals."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from notegrove.engine import SearchEngine
from notegrove.functions.distance import within, within_native
from notegrove.operators import fuzzy
from notegrove.sources.ingest import build_docs


@pytest.mark.parametrize("term,most", [("abca", 1), ("abca", 2), ("aab", 2), ("schkietz", 2)])
def test_native_distance(spark, term, most):
    words = {"".join(w) for n in range(7) for w in itertools.product("abc", repeat=n)}
    rng = random.Random(5)
    for _ in range(2000):
        w = list(term)
        for _ in range(rng.randrange(4)):
            i, kind = rng.randrange(len(w) or 1), rng.randrange(4)
            if kind == 0 and i + 1 < len(w):
                w[i], w[i + 1] = w[i + 1], w[i]
            elif kind == 1:
                w[i : i + 1] = []
            elif kind == 2:
                w.insert(i, rng.choice("schkietz"))
            else:
                w[i : i + 1] = rng.choice("schkietz")
        words.add("".join(w))
    df = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    found = {r.word for r in df.filter(within_native(F.col("word"), term, most)).collect()}
    assert found == {w for w in words if within(w, term, most)}


def test_transpositions_beyond_the_literals(spark, monkeypatch):
    texts = ["ein shcokoladig", "ein shcokolaidg", "ein schokoladig", "ganz anders"]
    rows = [(f"{i}.md", t, 0, 0) for i, t in enumerate(texts)]
    engine = SearchEngine(build_docs(spark.createDataFrame(rows, "path string, raw string, ctime long, mtime long")))
    few = sorted(r.path for r in engine.matching("schokoladig", fuzzy=True).collect())
    monkeypatch.setattr(fuzzy, "LITERALS", 1)
    assert sorted(r.path for r in engine.matching("schokoladig", fuzzy=True).collect()) == few == ["0.md", "1.md", "2.md"]
