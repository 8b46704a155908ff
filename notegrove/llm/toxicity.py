"""Toxicity: hashed subword embeddings averaged into a linear softmax.

A text is the bag of the byte n-grams, of 3 to 6 bytes and within word boundaries (a
separator counts as boundary mark), of its distinct words, A-Z lowered: a word that fills a
text by repetition weighs no more than another.  Each n-gram has an embedding in a hashed table; the text's
vector is their mean over the whole text; a linear layer and a softmax give the two class
probabilities.  Table and layer are trained jointly in numpy by minibatch gradient descent.  Misspelt or
inflected words share most n-grams with words seen in training.

Only the fit uses a sample, of at most ``SAMPLE`` labelled rows of each class, those whose
ids hash lowest; the bias is corrected for the share of each class taken.  For scoring, the trained table folds into one weight a bucket,
as the network is linear up to the softmax.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR, binary_texts, join_texts, lean, text_batches

BUCKETS = 1 << 18
WIDTH = 8
ORDERS = (3, 4, 5, 6)
#: N-grams without weight that every bag holds besides its own; they steady short texts.
PRIOR = 150
#: Labelled rows that the model is fitted on, at most: toxic, and others.
SAMPLE = (2000, 8000)
#: Passes over the sample, and steps at least.
EPOCHS, STEPS = 8, 1200
#: Texts of the sample that an n-gram must be in to get an embedding: one, and one more for
#: each so many texts of the sample, up to a most.
TEXTS_A_TEXT, MIN_TEXTS = 500, 8
BATCH = 32
TABLE_RATE = 150.0
LAYER_RATE = 0.5


def _prepared(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the distinct words, distance to the next separator, and text starts."""
    buf, offsets = join_texts([b" " + b" ".join(dict.fromkeys(t.lower().split())) for t in texts])
    separator = SEPARATOR[buf]
    data = buf.astype(np.uint32)
    at = np.arange(len(buf), dtype=np.int32)
    after = np.where(separator, at, np.int32(len(buf)))
    after = np.minimum.accumulate(after[::-1])[::-1]
    gap = np.empty(len(buf), np.int32)
    gap[:-1] = after[1:] - at[:-1]
    gap[-1:] = 0
    return data, gap, offsets


def ngram_buckets(texts: list[bytes]):
    """For each order: bucket of the n-gram that starts at each byte, and whether it is one."""
    data, gap, offsets = _prepared(texts)
    rolled = data * np.uint32(0x01000193)
    for n in range(2, max(ORDERS) + 1):
        if len(data) < n:
            return
        rolled = (rolled[: len(data) - n + 1] + data[n - 1 :]) * np.uint32(0x9E3779B1)
        rolled ^= rolled >> np.uint32(15)
        if n in ORDERS:
            valid = gap[: len(rolled)] >= n - 1
            yield (rolled * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 18), valid, offsets


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and how often each occurs."""
    found = [bucket[valid] for bucket, valid, _ in ngram_buckets([text])]
    bucket, count = np.unique(np.concatenate(found or [np.zeros(0, np.uint32)]), return_counts=True)
    return bucket.astype(np.int32), count


class _Bags:
    """The known n-grams of all texts, in a few large arrays that are freed whole."""

    def __init__(self, texts: list[bytes], row: np.ndarray):
        self.of, parts, held = [], [], []
        for k, text in enumerate(texts):
            bucket, count = bag(text)
            known = row[bucket] >= 0
            held.append((row[bucket][known], count[known].astype(np.min_scalar_type(int(count.max(initial=0)))), int(count.sum())))
            if len(held) == 256 or k + 1 == len(texts):
                parts.append(tuple(np.concatenate(x) for x in list(zip(*held))[:2]))
                ends = np.cumsum([len(x) for x, _, _ in held]).tolist()
                self.of += [(len(parts) - 1, a, b, n) for a, b, (_, _, n) in zip([0, *ends], ends, held)]
                held = []
        self.parts = parts

    def batch(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and shares of some texts, one after the other, and how many each has."""
        at = [self.of[i] for i in texts]
        rows = np.concatenate([self.parts[p][0][a:b] for p, a, b, _ in at])
        shares = np.concatenate([self.parts[p][1][a:b] * np.float32(1 / (PRIOR + n)) for p, a, b, n in at])
        return rows, shares, np.array([b - a for _, a, b, _ in at])


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Train on the texts; returns the weight of each bucket and the bias of class 1.

    Plain gradient steps on the table leave n-grams of single texts small, while those
    that many texts of a class share add up.
    """
    rng = np.random.default_rng(seed)
    texts_with = np.zeros(BUCKETS, np.int32)
    for text in texts:
        texts_with[bag(text)[0]] += 1
    known = np.flatnonzero(texts_with >= min(MIN_TEXTS, 1 + len(texts) // TEXTS_A_TEXT))
    row = np.full(BUCKETS, -1, np.int32)
    row[known] = np.arange(len(known))
    bags = _Bags(texts, row)
    table = rng.normal(0, 0.05, (len(known), WIDTH)).astype(np.float32)
    layer = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, len(texts))))
    for epoch in range(epochs if len(known) else 0):
        rate = 1 - epoch / epochs
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            bucket, share, sizes = bags.batch(rows)
            doc = np.repeat(np.arange(len(rows)), sizes)
            mean = np.zeros((len(rows), WIDTH), np.float32)
            some = np.flatnonzero(sizes)
            if len(some):
                starts = (np.cumsum(sizes) - sizes)[some]
                mean[some] = np.add.reduceat(table[bucket] * share[:, None], starts, axis=0)
            logits = mean @ layer + bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            pull = np.bincount(bucket, share * p[doc, 1], len(known)).astype(np.float32)
            grad = (mean.T @ p).astype(np.float32)
            table -= pull[:, None] * ((rate * TABLE_RATE) * (layer[:, 1] - layer[:, 0]))
            layer -= rate * LAYER_RATE * grad / len(rows)
            bias -= rate * LAYER_RATE * p.sum(axis=0).astype(np.float32) / len(rows)
    weights = np.zeros(BUCKETS, np.float32)
    weights[known] = table @ (layer[:, 1] - layer[:, 0])
    return weights, float(bias[1] - bias[0])


def score_texts(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of class 1 for each text."""
    sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
    for bucket, valid, offsets in ngram_buckets(texts):
        values = np.where(valid, weights[bucket], np.float32(0))
        starts = np.minimum(offsets[:-1], len(values) - 1)
        sums += np.add.reduceat(values, starts, dtype=np.float64) * (offsets[:-1] < len(values))
        counts += np.add.reduceat(valid, starts, dtype=np.int64) * (offsets[:-1] < len(values))
    logit = sums / (PRIOR + counts) + bias
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def train(labelled: DataFrame, shift: float = 0.0) -> tuple[bytes, float]:
    """Fit on ``labelled(doc_id, text, label)`` in one executor task; ``shift`` is added to
    the bias of class 1.

    Without rows of both labels the model is constant, and not shifted.
    """

    def run(frames):
        rows = [f for f in frames if len(f)]
        pdf = pd.concat(rows).sort_values(["label", "doc_id"]) if rows else pd.DataFrame({"label": [], "text": []})
        texts = [(t or "").encode() for t in pdf["text"]]
        labels = pdf["label"].to_numpy(dtype=np.int64)
        weights, bias = fit(texts, labels) if len(set(labels)) == 2 else (np.zeros(BUCKETS), -shift)
        yield pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()], "bias": [bias + shift]})

    # the scan stays parallel; only the sample meets in one task
    found = labelled.select("doc_id", "text", "label").repartition(1).mapInPandas(lean(run), "weights binary, bias double").collect()
    if not found:
        return np.zeros(BUCKETS, np.float32).tobytes(), 0.0
    return bytes(found[0]["weights"]), found[0]["bias"]


def score(docs: DataFrame, weights: bytes, bias: float, text_col: str = "text") -> DataFrame:
    """``docs`` with a double column ``score`` between 0 and 1; other columns are kept.

    Null texts score as empty ones, which have no n-gram and get the bias alone.  A column
    named ``score`` is replaced.
    """
    names = [c for c in docs.columns if c != "score"]
    schema = docs.select(names).schema.add("score", "double")

    def run(batches):
        table = np.frombuffer(weights, np.float32)
        for batch in batches:
            texts = binary_texts(batch.column(batch.num_columns - 1))
            for a, b in text_batches(texts):
                out = batch.slice(a, b - a)
                values = pa.array(score_texts(texts[a:b], table, bias), pa.float64())
                yield pa.RecordBatch.from_arrays([*out.columns[:-1], values], names=[*names, "score"])

    given = docs.select(*names, F.col(text_col).cast("string").alias("__text"))
    return given.mapInArrow(lean(run), schema)


def eligible_labels(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, label)`` of the labels 0 and 1; 1 wins where an id has both."""
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    return rows.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))


def sample_shift(labels: DataFrame, label_col: str, id_col: str = "doc_id", sample: tuple[int, int] = SAMPLE) -> float:
    """What the log-odds of class 1 lack by the bounds of :func:`sample_labels`, which take
    another share of one class than of the other; 0 where no bound acts."""
    found = eligible_labels(labels, label_col, id_col).groupBy("label").agg(F.count("*").alias("n")).collect()  # two rows
    n = {r["label"]: r["n"] for r in found}
    if any(not n.get(k) or most < 1 for k, most in zip((1, 0), sample)):
        return 0.0
    over = [n[k] / min(n[k], most) for k, most in zip((1, 0), sample)]
    return float(np.log(over[0] / over[1]))


def sample_labels(labels: DataFrame, label_col: str, id_col: str = "doc_id", sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """``(doc_id, label)``: at most ``sample[0]`` ids of label 1 and ``sample[1]`` of label 0,
    those that hash lowest."""
    rows = eligible_labels(labels, label_col, id_col)
    parts = [
        rows.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        for k, n in zip((1, 0), sample)
    ]
    return parts[0].unionByName(parts[1])


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """Learn ``labels.toxic`` and score every row of ``docs``.

    Rows whose ``crc32(doc_id as text) mod 4`` is 2 are never learned from.  Returns
    ``doc_id, held_out, score, predicted`` for every row, repeated ids included; a null
    doc_id is not held out.  Labels that are null, not 0 or 1, or without a document are
    ignored; an id labelled both 0 and 1 counts as 1.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    # bounded: at most sum(sample) rows
    given = labels.filter(~fold)
    chosen = F.broadcast(sample_labels(given, "toxic", sample=sample))
    weights, bias = train(docs.select("doc_id", "text").join(chosen, "doc_id"), sample_shift(given, "toxic", sample=sample))
    scored = score(docs.select("doc_id", "text"), weights, bias)
    return scored.select(
        "doc_id",
        F.coalesce(fold, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
