"""The bounds of the fit sample do not move the class ratio."""

import numpy as np
import pytest

from notegrove.llm import toxicity


def test_bounded_sample_keeps_the_ratio(spark):
    # one text for all: nothing but the class ratio can be learnt
    docs = spark.createDataFrame([(i, "the same words in every text") for i in range(800)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(800)] + [(0, 1), (5, None)], "doc_id long, toxic int")
    whole, bounded = (
        toxicity.score_documents(docs, labels, sample=s).first().score for s in ((2000, 8000), (60, 60))
    )
    assert whole == pytest.approx(0.1, abs=0.06) and bounded == pytest.approx(whole, abs=0.06)


def test_shift(spark):
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(100)] + [(0, 1), (None, 1), (200, 7)], "doc_id long, toxic int")
    assert toxicity.sample_shift(labels, "toxic") == 0.0
    assert toxicity.sample_shift(labels, "toxic", sample=(5, 9)) == pytest.approx(np.log(2 / 10))
    assert toxicity.sample_shift(labels.filter("toxic = 1"), "toxic", sample=(5, 9)) == 0.0
