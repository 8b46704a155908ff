"""LM scoring tells words apart that the network sees as one bucket."""

import numpy as np
import pytest

from notegrove.llm import lm_score
from notegrove.llm.common import word_hashes


def test_every_word_has_its_own_probability(spark):
    # 1 500 frequent words, more than the network names, and then pairs of a usual and a rare word
    frequent = [f"w{i}" for i in range(1500)]
    rows = [(i, " ".join(frequent)) for i in range(4)]
    texts = {w: w.encode() for w in [f"usual{i}" for i in range(400)] + [f"rare{i}" for i in range(400)]}
    bucket = {w: int((word_hashes([t])[0][0] >> np.uint64(40)) % np.uint64(lm_score.BUCKETS)) for w, t in texts.items()}
    first = {}
    for w, b in bucket.items():
        first.setdefault((b, w[0]), w)
    pairs = [(first[b, "u"], first[b, "r"]) for b in range(lm_score.BUCKETS) if (b, "u") in first and (b, "r") in first][:5]
    assert pairs
    for k, (u, r) in enumerate(pairs):
        rows += [(100 + k, u), (200 + k, r), (300 + k, f"{u} {u}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r.log_prob for r in lm_score.score_documents(docs).collect()}
    assert len(out) == len(rows)
    n = {}
    for _, text in rows:
        for w in text.split():
            n[w] = n.get(w, 0) + 1
    for k, (u, r) in enumerate(pairs):
        # same bucket, same (empty) surroundings: they differ by their counts alone
        assert abs(out[100 + k] - out[200 + k] - np.log(n[u] / n[r])) < 1e-5


def test_shares_of_a_bucket_add_up(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PIECE", 200)  # many pieces
    rows = [(i, f"x{i}") for i in range(1200)] + [(i, "x7 x7") for i in range(1200, 1210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    counts = lm_score.count_words(docs)
    assert counts.count() == 1200
    named, model = lm_score.fit(docs, counts)
    out = {r.doc_id: r.log_prob for r in lm_score.score(docs, counts, named, model).collect()}
    # the probabilities of single words add up to one, less the buckets that no word is in
    held = lm_score.Words(named)
    ids = held.ids(np.concatenate([word_hashes([f"x{i}".encode()])[0] for i in range(1200)]))
    around = np.full((1, 2 * lm_score.SIDE), lm_score.NAMED + lm_score.BUCKETS)
    empty = sorted(set(range(lm_score.NAMED + lm_score.BUCKETS)) - set(ids.tolist()))
    w = lm_score.unpack(model)
    missing = sum(np.exp(lm_score.log_probabilities(w, around, np.array([i]))[0]) for i in empty)
    assert abs(sum(np.exp(out[i]) for i in range(1200)) + missing - 1) < 1e-3


def test_training_takes_every_place_once(spark, monkeypatch):
    rows = [(i, f"only{i}") for i in range(50)] + [(50, "a b c a b c"), (51, None), (52, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    batches = frame.select("text").toArrow().to_batches()
    trained = []
    monkeypatch.setattr(lm_score, "train_places", lambda w, state, around, ids: trained.append(len(ids)))
    model = lm_score.pack(lm_score.start_weights())
    for k in range(lm_score.ROUNDS):
        list(lm_score._train(np.zeros(0, np.uint64), model, k)(iter(batches)))
    assert sum(trained) == 56
    hashes, bounds = word_hashes([(t or "").encode() for _, t in rows])
    drawn = lm_score.masked_rounds(hashes, bounds)
    assert drawn.max() < lm_score.ROUNDS and len(set(drawn.tolist())) == lm_score.ROUNDS


def test_ids_of_words_that_share_a_slot():
    rng = np.random.default_rng(5)
    named = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    named[:40] = (named[0] >> np.uint64(48) << np.uint64(48)) + np.arange(40, dtype=np.uint64) * np.uint64(7)
    rng.shuffle(named)
    asked = np.concatenate([named, rng.integers(0, 2**63, 500).astype(np.uint64), named[:10] + np.uint64(1), [np.uint64(0)]])
    rank = {int(w): k for k, w in enumerate(named)}
    want = [rank.get(int(w), lm_score.NAMED + int(w >> np.uint64(40)) % lm_score.BUCKETS) for w in asked]
    assert lm_score.Words(named).ids(asked).tolist() == want
    assert (lm_score.Words(named[:0]).ids(asked) >= lm_score.NAMED).all()


def test_log_probabilities_are_those_of_the_plain_formula():
    rng = np.random.default_rng(6)
    w = [x + rng.normal(0, 0.3, x.shape).astype(np.float32) for x in lm_score.start_weights()]
    around, ids = rng.integers(0, lm_score.SHAPES[0][0], (300, 4)), rng.integers(0, lm_score.NAMED + lm_score.BUCKETS, 300)
    table, w1, b1, wc, bc, ww, bw = (x.astype(np.float64) for x in w)
    for x, y, found in zip(around, ids, lm_score.log_probabilities(w, around, ids)):
        h = np.tanh(table[x].reshape(-1) @ w1 + b1)
        c, k = divmod(int(y), lm_score.PER_CLASS)
        zc, zk = h @ wc + bc, h @ ww[c] + bw[c]
        assert abs(zc[c] - np.log(np.exp(zc).sum()) + zk[k] - np.log(np.exp(zk).sum()) - found) < 1e-4


def test_training_lowers_the_loss():
    rng = np.random.default_rng(7)
    ids = np.tile(rng.integers(0, 500, 40), 400)
    around = lm_score.windows(ids, np.array([0, len(ids)]))
    w = lm_score.start_weights()
    before = lm_score.log_probabilities(w, around, ids).mean()
    lm_score.train_places(w, [np.zeros_like(x) for x in w], around, ids)
    assert lm_score.log_probabilities(w, around, ids).mean() > before + 3


def test_windows_of_chosen_places_are_those_of_all():
    """Only the masked places of a round are looked up."""
    rng = np.random.default_rng(1)
    for _ in range(100):
        bounds = np.concatenate([[0], np.cumsum(rng.integers(0, 7, rng.integers(0, 8)))]).astype(np.int64)
        ids = rng.integers(0, 1024, bounds[-1])
        chosen = np.flatnonzero(rng.random(len(ids)) < 0.5)
        none = lm_score.NAMED + lm_score.BUCKETS
        near = [-2, -1, 1, 2]
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        expected = [[ids[i + d] if 0 <= i + d < len(ids) and doc[i + d] == doc[i] else none for d in near] for i in range(len(ids))]
        assert lm_score.windows(ids, bounds).tolist() == expected
        assert lm_score.windows(ids, bounds, chosen).tolist() == [expected[i] for i in chosen]


def test_a_step_of_training_follows_the_gradient():
    """Adagrad's first step on one place: each weight moves by the rate against its gradient's sign."""
    w = lm_score.start_weights()
    around, ids = np.array([[3, 700, 1024, 5]]), np.array([37])
    before = [x.copy() for x in w]
    state = [np.zeros_like(x) for x in w]
    lm_score.train_places(w, state, around, ids)
    for k, x in enumerate(before):  # the steepest weight of each array, by differences
        at = np.unravel_index(np.argmax(state[k]), x.shape)
        probed = []
        for d in (1e-2, -1e-2):
            moved = [y.copy() for y in before]
            moved[k][at] += d
            probed.append(lm_score.log_probabilities(moved, around, ids)[0])
        slope = (probed[0] - probed[1]) / 2e-2
        assert abs(slope) == pytest.approx(np.sqrt(state[k][at]), rel=0.05)
        assert w[k][at] - x[at] == pytest.approx(lm_score.RATE * np.sign(slope), rel=0.01)
