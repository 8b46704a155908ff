"""Masked pseudo-likelihood of whole texts under a bidirectional window network.

Tokens are words, and the vocabulary is every word of the corpus.  The network names the
most frequent and sees all others by the bucket of their hash.  It looks at the two words on
either side of a place: their embeddings, one after the other, a tanh layer, and a softmax
in two levels (the class of the word, then the word or bucket within it).  Below a bucket
stands a third level, its words by their share of the bucket's count in the corpus.  A
text's score is the sum over all its words of the logarithm of the probability of the word
itself when it is masked.

The counts of all words stay a distributed table.  For scoring, texts are coded in pieces:
a piece's distinct words are joined with the counts, and its texts refer to them by number.

Word counts cover all documents.  Training covers every place of all documents, too: a
place's draw masks it in one of the rounds.  In each round every partition trains from the
same start on its masked places in numpy, and the weights are averaged by the number of
places in a reduction tree on the executors.  So the weights, and a little of each score,
depend on how the input is divided into partitions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, lean, materialize, mix64, text_batches, word_hashes

CLASSES, PER_CLASS = 32, 32
BUCKETS = 64
NAMED = CLASSES * PER_CLASS - BUCKETS
WIDTH, HIDDEN, SIDE = 16, 32, 2
ROUNDS, RATE = 2, 0.1
#: Places of a batch: at least, one of so many done before, at most.
BATCH = (256, 32, 1024)
FAN_IN = 32
#: Bytes of text in a piece that is scored with a table of its words.
PIECE = 16 << 20
#: Places that are scored at once; their arrays stay in the caches.
SCORED = 1 << 12
SHAPES = [
    (NAMED + BUCKETS + 1, WIDTH),
    (2 * SIDE * WIDTH, HIDDEN),
    (HIDDEN,),
    (HIDDEN, CLASSES),
    (CLASSES,),
    (CLASSES, HIDDEN, PER_CLASS),
    (CLASSES, PER_CLASS),
]


def start_weights(seed: int = 3) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [(rng.normal(0, 0.1, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for s in SHAPES]


def pack(weights: list[np.ndarray]) -> bytes:
    return b"".join(w.astype("<f4").tobytes() for w in weights)


def unpack(data: bytes) -> list[np.ndarray]:
    flat, out, at = np.frombuffer(data, "<f4"), [], 0
    for s in SHAPES:
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s).copy())
        at += n
    return out


class Words:
    """Maps word hashes to token ids."""

    def __init__(self, named: np.ndarray):
        self.named = np.append(named, np.uint64(0))
        self.order = np.argsort(named)
        self.sorted = named[self.order]
        slots = (named >> np.uint64(48)).astype(np.int64)
        self.first = np.full(1 << 16, len(named), np.int32)
        self.first[slots] = np.arange(len(named))
        self.shared = np.bincount(slots, minlength=1 << 16) > 1  # slots of several words

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = NAMED + (hashes >> np.uint64(40)).astype(np.int64) % BUCKETS
        slot = (hashes >> np.uint64(48)).astype(np.int64)
        found = self.first[slot]
        hit = np.flatnonzero((self.named[found] == hashes) & (found < len(self.sorted)))
        out[hit] = found[hit]
        rest = np.flatnonzero(self.shared[slot])
        if len(rest):
            at = np.minimum(np.searchsorted(self.sorted, hashes[rest]), len(self.sorted) - 1)
            same = self.sorted[at] == hashes[rest]
            out[rest[same]] = self.order[at[same]]
        return out


def windows(ids: np.ndarray, bounds: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
    """The neighbours within their text of all places, or of some in ascending order; the id
    after the last stands for none."""
    none = NAMED + BUCKETS
    padded = np.full(len(ids) + 2 * SIDE, none, np.int64)
    padded[SIDE : SIDE + len(ids)] = ids
    chosen = np.arange(len(ids)) if places is None else places
    out = np.empty((len(chosen), 2 * SIDE), np.int64)
    for k, d in enumerate([x for x in range(-SIDE, SIDE + 1) if x]):
        out[:, k] = padded.take(chosen + (SIDE + d))
        # places at a bound whose neighbour lies across it
        for near in range(abs(d)):
            edge = bounds[:-1] + near if d < 0 else bounds[1:] - 1 - near
            edge = edge[(bounds[:-1] <= edge) & (edge < bounds[1:])]
            row = edge if places is None else np.searchsorted(chosen, edge)
            if places is not None:
                row = row[(row < len(chosen)) & (chosen.take(row, mode="clip") == edge)] if len(chosen) else row[:0]
            out[row, k] = none
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    """Softmax of each column, in place."""
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z /= z.sum(axis=0)
    return z


def _log_softmax_at(z: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    z -= z.max(axis=0)
    picked = z[at, rows].astype(np.float64)
    return np.maximum(picked - np.log(np.exp(z, out=z).sum(axis=0)), math.log(1e-30))


def _hidden(table: np.ndarray, around: np.ndarray, w1: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours' embeddings, one after the other, and the tanh layer over them."""
    e = table.take(around, axis=0).reshape(len(around), -1)
    h = e @ w1
    h += b1
    return e, np.tanh(h, out=h)


def _class_slices(cls: np.ndarray) -> list[tuple[int, int, int]]:
    """Class, start and end of each class that sorted places have."""
    ends = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
    return [(c, a, b) for c, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b]


def _within(h: np.ndarray, cls: np.ndarray, slices: list[tuple[int, int, int]], ww: np.ndarray, bw: np.ndarray) -> np.ndarray:
    """Logits of the words of each place's class, a column a place."""
    z = np.empty((PER_CLASS, len(h)), np.float32)
    turned = h.T
    for c, a, b in slices:
        np.matmul(ww[c].T, turned[:, a:b], out=z[:, a:b])
    z += bw.T.take(cls, axis=1)
    return z


def log_probabilities(w: list[np.ndarray], around: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Log-probability of each word given its neighbours."""
    table, w1, b1, wc, bc, ww, bw = w
    order = np.argsort(ids.astype(np.int16), kind="stable")  # a radix sort
    y, rows = ids.take(order), np.arange(len(ids))
    h = _hidden(table, around.take(order, axis=0), w1, b1)[1]
    cls = y // PER_CLASS
    first = wc.T @ h.T
    first += bc[:, None]
    out = np.empty(len(ids))
    out[order] = _log_softmax_at(first, rows, cls) + _log_softmax_at(_within(h, cls, _class_slices(cls), ww, bw), rows, y % PER_CLASS)
    return out


def _side_by_side(arrays: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """A copy of the arrays in one, and views of it in their shapes."""
    flat = np.concatenate([x.reshape(-1) for x in arrays])
    ends = np.cumsum([x.size for x in arrays])
    return flat, [v.reshape(x.shape) for v, x in zip(np.split(flat, ends[:-1]), arrays)]


def train_places(w: list[np.ndarray], state: list[np.ndarray], around: np.ndarray, ids: np.ndarray) -> None:
    """Adagrad over the places in batches, which grow with the places done before, if ``state``
    ends with their number; changes ``w`` and ``state`` in place.

    Weights, squares and gradients lie side by side, so a batch updates all in a few passes.
    Logits have a column a place: sums over a class or a vocabulary run along the places.
    """
    values, inner = _side_by_side(w)
    table, w1, b1, wc, bc, ww, bw = inner
    squares, _ = _side_by_side(state[: len(w)])
    grads, (gt, gw1, gb1, gwc, gbc, gww, gbw) = _side_by_side([np.zeros_like(x) for x in w])
    step = np.empty_like(values)
    done = int(state[-1][0]) if len(state) > len(w) else 0
    spread = np.arange(WIDTH)
    at = 0
    while at < len(ids):
        size = min(max(BATCH[0], (done + at) // BATCH[1]), BATCH[2])
        y = ids[at : at + size]
        order = np.argsort(y.astype(np.int16), kind="stable")  # by class, so that a class is a slice
        x, y = around[at : at + size].take(order, axis=0), y.take(order)
        at += size
        n, rows = len(y), np.arange(len(y))
        e, h = _hidden(table, x, w1, b1)
        cls, word = y // PER_CLASS, y % PER_CLASS
        slices = _class_slices(cls)
        pc = wc.T @ h.T
        pc += bc[:, None]
        pc = _softmax(pc)
        pc[cls, rows] -= 1
        p = _softmax(_within(h, cls, slices, ww, bw))
        p[word, rows] -= 1
        p /= n
        pc /= n
        dh = np.empty((HIDDEN, n), np.float32)
        gww.fill(0)
        gbw.fill(0)
        for c, a, b in slices:
            np.matmul(ww[c], p[:, a:b], out=dh[:, a:b])
            np.matmul(h[a:b].T, p[:, a:b].T, out=gww[c])
        gbw[[c for c, _, _ in slices]] = np.add.reduceat(p, [a for _, a, _ in slices], axis=1).T
        dh += wc @ pc
        dz = (1 - h * h).T
        dz *= dh
        de = dz.T @ w1.T
        slot = (x.reshape(-1, 1) * WIDTH + spread).reshape(-1)
        gt[...] = np.bincount(slot, de.reshape(-1), table.size).reshape(table.shape)
        np.matmul(e.T, dz.T, out=gw1)
        np.matmul(h.T, pc.T, out=gwc)
        dz.sum(axis=1, out=gb1)
        pc.sum(axis=1, out=gbc)
        np.multiply(grads, grads, out=step)
        squares += step
        np.add(squares, np.float32(1e-8), out=step)
        np.sqrt(step, out=step)
        grads *= np.float32(RATE)
        np.divide(grads, step, out=step)
        values -= step
    _put_back(w, values)
    _put_back(state[: len(w)], squares)
    if len(state) > len(w):
        state[-1] += len(ids)


def _put_back(arrays: list[np.ndarray], flat: np.ndarray) -> None:
    at = 0
    for x in arrays:
        x[...] = flat[at : at + x.size].reshape(x.shape)
        at += x.size


def _counts(batches):
    for batch in batches:
        texts = binary_texts(batch.column(0))
        for a, b in text_batches(texts, 8 << 20):
            words, n = np.unique(word_hashes(texts[a:b])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(n)], names=["word", "n"])


def masked_rounds(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The one round in which each place is masked, drawn from its word and its place in the text."""
    at = np.arange(len(hashes)) - np.repeat(bounds[:-1], np.diff(bounds))
    return mix64(mix64(at.astype(np.uint64)) + hashes) % np.uint64(ROUNDS)


def _train(named: np.ndarray, model: bytes, round_: int):
    def run(batches):
        words, w = Words(named), unpack(model)
        state = [*(np.zeros_like(x) for x in w), np.zeros(1, np.int64)]
        places = 0
        for batch in batches:
            texts = binary_texts(batch.column(0))
            for a, b in text_batches(texts):
                hashes, bounds = word_hashes(texts[a:b])
                ids = words.ids(hashes)
                chosen = np.flatnonzero(masked_rounds(hashes, bounds) == round_)
                train_places(w, state, windows(ids, bounds, chosen), ids[chosen])
                places += len(chosen)
        if places:
            yield pa.RecordBatch.from_arrays([pa.array([pack(w)], pa.binary()), pa.array([places], pa.int64())], names=["model", "places"])

    return run


def _average(table: pa.Table) -> pa.Table:
    places = table.column("places").to_numpy()
    total = np.zeros(sum(int(np.prod(s)) for s in SHAPES))
    for data, n in zip(table.column("model"), places):
        total += np.frombuffer(data.as_py(), "<f4") * float(n)
    mean = (total / places.sum()).astype("<f4").tobytes()
    return pa.table([pa.array([mean], pa.binary()), pa.array([int(places.sum())], pa.int64())], names=["model", "places"])


def _bucket(word):
    """The bucket of a word's hash, as in :meth:`Words.ids`."""
    return F.pmod(F.shiftrightunsigned(word, 40), F.lit(BUCKETS))


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, n``: the hash of every word of the corpus and how often it occurs."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInArrow(lean(_counts), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counted, "lm-words")


def fit(docs: DataFrame, counts: DataFrame, text_col: str = "text") -> tuple[np.ndarray, bytes]:
    """Names of the words, by rank, and the trained weights."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    top = counts.orderBy(F.desc("n"), "word").limit(NAMED).collect()  # bounded: NAMED rows
    named = np.array([r["word"] for r in top], np.int64).astype(np.uint64)
    model = pack(start_weights())
    for round_ in range(ROUNDS):
        parts = texts.mapInArrow(lean(_train(named, model, round_)), "model binary, places long")
        left = texts.rdd.getNumPartitions()
        while True:
            left = max(1, -(-left // FAN_IN))
            slot = F.pmod(F.spark_partition_id(), F.lit(left)).alias("slot")
            parts = parts.select("*", slot).groupBy("slot").applyInArrow(_average, "model binary, places long")
            if left == 1:
                break
        found = parts.collect()  # one row
        model = bytes(found[0]["model"]) if found else model
    return named, model


def _code(named: np.ndarray, model: bytes):
    """Texts with what the network gives them and the numbers of their other words in the
    piece; after them, in a row of its own, the distinct other words of the piece, sorted."""
    names = ["piece", "doc_id", "n_words", "head", "tail", "words"]

    def run(batches):
        from pyspark import TaskContext

        words, w = Words(named), unpack(model)
        piece = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def close():
            distinct, number = np.unique(np.concatenate([h[-1] for h in held]), return_inverse=True)
            number, at = number.reshape(-1).astype("<i4"), 0
            for ids, n_words, head, bounds, hashes in held:
                tails = [number[at + x : at + y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])]
                at += len(hashes)
                n = len(n_words)
                columns = [pa.array([piece] * n, pa.int64()), ids, pa.array(n_words), pa.array(head), pa.array(tails, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.list_(pa.int64()))], names=names)
            columns = [pa.array([piece], pa.int64()), *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.binary()))]
            lists = pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), pa.array(distinct.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*columns, lists], names=names)

        for batch in batches:
            texts = binary_texts(batch.column(1))
            for a, b in text_batches(texts):
                hashes, bounds = word_hashes(texts[a:b])
                ids = words.ids(hashes)
                around = windows(ids, bounds)
                logs = np.zeros(len(ids) + 1)
                for k in range(0, len(ids), SCORED):
                    logs[k : k + SCORED][: len(ids) - k] = log_probabilities(w, around[k : k + SCORED], ids[k : k + SCORED])
                total = np.concatenate([[0.0], np.cumsum(logs)])
                other = ids >= NAMED
                before = np.concatenate([[0], np.cumsum(other)])
                held.append((batch.column(0).slice(a, b - a), np.diff(bounds), total[bounds[1:]] - total[bounds[:-1]], before[bounds], hashes[other]))
                size += sum(map(len, texts[a:b]))
                if size >= PIECE:
                    yield from close()
                    piece, held, size = piece + 1, [], 0
        if held:
            yield from close()

    return run


def _add_shares(of_bucket: np.ndarray):
    """Adds to each text of a piece the log-shares of its other words in their buckets."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        word = words.column("word").to_numpy()
        n = words.column("n").to_numpy()[np.argsort(word.astype(np.uint64))]
        word = np.sort(word.astype(np.uint64))
        shares = np.log(n / of_bucket[(word >> np.uint64(40)).astype(np.int64) % BUCKETS])
        sums = [shares[np.frombuffer(t.as_py(), "<i4")].sum() for t in texts.column("tail")]
        total = texts.column("head").to_numpy() + np.array(sums, np.float64)
        return pa.table([texts.column("doc_id"), texts.column("n_words"), pa.array(total)], names=["doc_id", "n_words", "log_prob"])

    return run


def score(docs: DataFrame, counts: DataFrame, named: np.ndarray, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, log_prob, mean_log_prob`` for every row; ``counts`` has all words of ``docs``."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    coded = given.mapInArrow(lean(_code(named, model)), "piece long, doc_id long, n_words long, head double, tail binary, words array<long>")
    coded = materialize(coded, "lm-coded")  # the numbers hold for this division into pieces only
    # bounded: BUCKETS rows
    sums = counts.filter(~F.col("word").isin([int(x) for x in named.astype(np.int64)])).groupBy(_bucket(F.col("word")).alias("b")).agg(F.sum("n").alias("n"))
    of_bucket = np.zeros(BUCKETS)
    for r in sums.collect():
        of_bucket[r["b"]] = r["n"]
    words = coded.filter("words is not null").select(F.col("piece").alias("of"), F.explode("words").alias("word")).join(counts, "word").select("of", "word", "n")
    texts = coded.filter("words is null").drop("words")
    out = texts.groupBy("piece").cogroup(words.groupBy("of")).applyInArrow(_add_shares(of_bucket), "doc_id long, n_words long, log_prob double")
    return out.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on all documents and score each: ``doc_id, n_words, log_prob, mean_log_prob``.

    Null, empty and blank texts have 0 words, the log-probability 0 and no mean.  Repeated
    rows count and are scored each; a null doc_id stays null.  An empty table is not scored.
    """
    counts = count_words(docs, text_col)
    return score(docs, counts, *fit(docs, counts, text_col), id_col, text_col)
