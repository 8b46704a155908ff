"""Results against plain recomputation on small tables."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from notegrove.llm import embedding_dedup, html_extract, line_dedup, mixing, ngram_jaccard, packing, token_store, tokens, topk_search, toxicity
from notegrove.llm.components import connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=120):
    """Invented texts with near copies at many distances, and copies."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(300)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            words = list(rng.choice(out))
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                if words:
                    at = rng.randrange(len(words))
                    words[at : at + 1] = rng.choice([[], [rng.choice(vocab)], [rng.choice(vocab), words[at]]])
        else:
            words = rng.choices(vocab, k=rng.choice([0, 1, 2, 3, 8, 15, 40, 120]))
        out.append(words)
    return [(i * 3, " ".join(w)) for i, w in enumerate(out)]


def union_find(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (1, 60)])
@pytest.mark.parametrize("chunk", [256, 3])
def test_jaccard_links_are_all_found(spark, monkeypatch, width, percent, chunk):
    if chunk == 3:  # long lists and large groups in tiles
        monkeypatch.setattr(ngram_jaccard, "CHUNK", 3)
        monkeypatch.setattr(ngram_jaccard, "LONG", 3)
    rows = corpus(width)
    sets = {}
    for i, t in rows:
        w = WORDS.findall(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = union_find(list(sets), links)
    out = ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_of_repeated_and_missing_ids(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(words[::-1])
    for rows in ([(1, a), (1, b), (2, a + " x"), (3, b + " x")], [(1, b), (1, a), (2, a + " x"), (3, b + " x")]):
        out = ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
        assert {r.component_id for r in out.collect()} == {1}
    # Y is near to X and Z, which are far from each other, and has no id
    x, z = " ".join(["p0", "p1", "p2"] + words), " ".join(words + ["q0", "q1", "q2"])
    rows = [(7, x), (None, a), (5, z), (None, "alone it stands here"), (None, None)]
    out = ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == sorted([(7, 61, 5), (None, 58, 5), (5, 61, 5), (None, 2, None), (None, 0, None)], key=str)


def test_met_signatures_cross_batches():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    sig, key = rng.integers(0, 60, 200), rng.integers(0, 4, 200)
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    table = pa.table({"sig": sig, "use": np.zeros(200, np.int32), "key": key})
    want = {(s, k) for s, k in zip(sig.tolist(), key.tolist()) if len(set(key[sig == s])) > 1}
    for size in (1, 2, 3, 50, 200):
        out = [r for b in ngram_jaccard._met(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert sorted((r["sig"], r["key"]) for r in out) == sorted(want)


def test_allocation_at_the_parameters_of_op1():
    """Segments of one deletion pay where sets are short or elements are often shared by
    chance; elsewhere their rows cost more than the chance pairs they save."""
    for percent, sizes in ((90, (1000, 10**6, 10**9)), (80, (1000, 10**6))):
        bounds = ngram_jaccard.size_bands(3000, percent)
        for sets in sizes:
            for band in range(len(bounds) - 1):
                plan = ngram_jaccard.allocate(band, bounds, percent, sets)
                if plan is not None:
                    capacities, spare = plan
                    top = bounds[band + 1] - 1
                    assert sum(capacities) - ngram_jaccard.most_difference(top + top * 100 // percent, percent) - 1 - spare in (0, 1)

    def kinds(percent, sets, chance):
        bounds = ngram_jaccard.size_bands(3000, percent)
        plans = [ngram_jaccard.allocate(b, bounds, percent, sets, chance) for b in range(len(bounds) - 1)]
        return {k for p in plans if p for k in p[0]}

    assert kinds(90, 10**6, 0.03) == {1} and kinds(90, 10**8, 0.03) == {1, 2}
    assert kinds(90, 10**6, 0.2) == {1, 2} and kinds(80, 1000, 0.03) == {1, 2}


def test_one_deletion_allocation_loses_nothing():
    rng = np.random.default_rng(0)
    bounds = ngram_jaccard.size_bands(400, 80)
    for _ in range(300):
        base = rng.integers(0, 2**63, rng.integers(8, 120)).astype(np.uint64)
        other = base.copy()
        for _ in range(rng.integers(0, 12)):
            other[rng.integers(len(other))] = rng.integers(0, 2**63)
        a, b = np.unique(base), np.unique(other[: rng.integers(max(1, len(other) * 8 // 10), len(other) + 1)])
        shared = len(np.intersect1d(a, b))
        if 100 * shared < 80 * (len(a) + len(b) - shared) or (len(a) == len(b) == shared):
            continue
        low = min(int(np.searchsorted(bounds, len(x), side="right")) - 1 for x in (a, b))
        total = ngram_jaccard.most_difference((bounds[low + 1] - 1) + (bounds[low + 1] - 1) * 100 // 80, 80) + 2
        for doubles in (0, total // 4, total // 2):
            capacities = [2] * doubles + [1] * (total - 2 * doubles)
            x, y = (ngram_jaccard.signatures(s, low, capacities, 1) for s in (a, b))
            assert len(np.intersect1d(x, y))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(i, i + 1) for i in range(300, 420)] + [(5, 5)]
    out = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = union_find({x for e in edges if e[0] != e[1] for x in e}, [e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in out} == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_top_k_equals_all_products(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "ROWS", 300)
    monkeypatch.setattr(topk_search, "QUERIES", 5)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 0.2, (900, 12)), 2)
    x[100:140] = x[100]
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    q = np.floor(256 * x)
    want = []
    for i in range(0, 900, 50):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(900), -s)) if j != i][:5]
        want += [(i, k + 1, int(j), int(s[j])) for k, j in enumerate(order)]
    assert sorted(map(tuple, topk_search.top_k_search(v).collect())) == want


def test_near_vectors_are_found(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    x[200:] = x[:200] + rng.normal(0, 0.035, (200, 16)) * np.linalg.norm(x[:200], axis=1)[:, None]
    x[390:] = x[5]
    label = np.arange(400) % 200 % 3
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    v = spark.createDataFrame([(i, e.tolist(), int(k)) for i, (e, k) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int")
    out = {r.vec_id: r for r in embedding_dedup.embedding_near_dedup(v).collect()}
    found = np.array([out[i].n_links for i in range(400)])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.98 * near.sum() > 100
    want = union_find(range(400), np.argwhere(near).tolist())
    assert sum(out[i].component_id == want[i] for i in range(400)) >= 392
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values())


def test_quantiser_indexes_within_its_error():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 16))
    m = embedding_dedup.Quantiser(x, 8, 0.2)
    rest = x - m.centres[m.nearest(x)]
    codes = m.encode(rest)
    exact = ((rest[:20, None] - m.decode(codes)[None]) ** 2).sum(axis=2)
    assert np.allclose(m.table_distances(rest[:20], codes), exact)


def test_line_runs(spark):
    rng = random.Random(5)
    lines = [" ".join(rng.choices("abcdefghij", k=rng.randint(0, 30))) for _ in range(14)]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 14)))) for i in range(60)]
    first, gone = {}, {}
    for i, t in rows:
        parts = t.split("\n")
        for a in range(len(parts)):
            for b in range(a + 1, len(parts) + 1):
                run = tuple(parts[a:b])
                if sum(len(p.split()) for p in run) < 50:
                    continue
                if run in first:
                    gone.setdefault(i, set()).update(range(a, b))
                else:
                    first[run] = (i, a)
    want = {i: "\n".join(p for k, p in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in rows}
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == want and sum(r.n_removed for r in out) == sum(map(len, gone.values())) > 0


def test_coder_round_trips():
    rng = np.random.default_rng(6)
    for ids in ([], [3], np.arange(70), rng.zipf(1.3, 9000) % 500, np.full(5000, 7), rng.integers(0, 49408, 4000), np.tile(rng.integers(0, 900, 50), 300)):
        ids, lengths = np.asarray(ids, np.uint32), np.array([len(x) for x in np.array_split(ids, 3)])
        block = token_store.write_block([1, None, -5], ids, lengths, 49408)
        names, back, again = token_store.read_block(block)
        assert names == [1, None, -5] and (ids == back).all() and (lengths == again).all()
        bad = bytearray(block)
        bad[-1] ^= 1
        with pytest.raises(ValueError):
            token_store.read_block(bytes(bad))


def test_coder_learns():
    ids = np.tile(np.random.default_rng(7).integers(0, 40000, 500), 100)
    assert len(token_store.write_block([0], ids, np.array([len(ids)]), 49408)) < len(ids) / 2


def test_large_vocabularies_round_trip():
    ids = np.random.default_rng(3).integers(0, 200_000, 3000)
    assert (token_store.read_block(token_store.write_block([0], ids, np.array([3000]), 200_000))[1] == ids).all()


def odd_texts():
    rng = random.Random(3)
    signs = "ab'c stmdrevl.,_-1² éßÀ\n\t'\"xX İΣ中😀\x01\x02ǅ½\xa0\u0301"
    return ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(3000)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_library_s(name, spark):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    texts = [x for _, x in corpus(9, 40)] + odd_texts() + ["a  b", " lead", "trail ", "x\ny.", "x \ny", "tab\there", "it's we'll, 12,5.", "nb\xa0sp", "\x1c a", "É é é a ́b", "<|endoftext|> hi", "ΣΑΣ ΟΔΟΣ, İ", "日本語 テ.", ",", "... a.b. c,", "\n", "🔥 x", "a" * 3000, "' 's 'S'T''s"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    encoder = tokens.TextEncoder(public_tokenizers.path(name))
    assert encoder.core is not None
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 7] for x in [*texts, None, ""]]
    ids, ends = encoder.encode([*texts, None, ""], 7)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
    tokens.SPAN, span = 64, tokens.SPAN
    try:  # cuts between words change nothing
        assert encoder.encode([*texts, None, ""], 7)[0].tolist() == ids.tolist()
    finally:
        tokens.SPAN = span
    encoder.core = None
    assert encoder.encode([*texts[:50], None, ""], 7)[0].tolist() == sum(want[:50], []) + [7, 7]


def test_token_files_hold_the_library_s_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [(i * 3 % 401, x) for i, x in enumerate([*odd_texts()[:200], *(x for _, x in corpus(4, 200)), None])]
    out = token_store.tokens_round_trip(spark.createDataFrame(rows, "doc_id long, text string"), path, 1).collect()
    want = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, x in rows}
    assert {r.doc_id: r.ids for r in out} == want
    at = 0
    for r in sorted(out, key=lambda r: r.doc_id):
        assert (r.start, 4 * r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens


def test_packing_keeps_ids_and_fills(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 301}" for k in range(5 + i * 37 % 900))) for i in range(150)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    want = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes() for i, x in rows}
    got = {}
    for r in sorted(out, key=lambda r: r.start):
        got[r.doc_id] = got.get(r.doc_id, b"") + r.ids
    assert got == want
    used = {}
    for r in out:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    padding = sum(1024 - n for n in used.values() if n & (n - 1))
    assert padding < 0.01 * sum(used.values())


def test_first_fit_decreasing():
    rng = random.Random(8)
    lengths = np.array([rng.randint(1, 100) for _ in range(200)])
    bins, room = [0] * 200, []
    for i in sorted(range(200), key=lambda i: -lengths[i]):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), None)
        if k is None:
            room.append(100)
            k = len(room) - 1
        room[k] -= lengths[i]
        bins[i] = k
    assert packing.first_fit_decreasing(lengths, 100).tolist() == bins


def test_mix_reaches_its_targets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    # water-filling with weights 5, 2, 1, 5
    weights, left, target = dict(zip(["a", "b", "c", None], [5, 2, 1, 5])), 1.5 * sum(sizes.values()), {}
    while True:
        level = left / sum(w for s, w in weights.items() if s not in target)
        full = [s for s, w in weights.items() if s not in target and level * w >= 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
    target |= {s: level * w for s, w in weights.items() if s not in target}
    taken = {}
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r["size"] * r.copies
    for s in sizes:
        assert taken[s] == pytest.approx(target[s], rel=0.01)


def test_toxicity_finds_inflected_words():
    rng = random.Random(10)
    plain = ["".join(rng.choices("aeioulmnrst", k=5)) for _ in range(400)]
    bad = ["zqxidio", "kvbrutt"]

    def text(toxic):
        words = rng.choices(plain, k=60)
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(bad) + "".join(rng.choices("aeiou", k=2))
        return " ".join(words).encode()

    labels = np.array([i % 2 for i in range(300)])
    weights, bias = toxicity.fit([text(k) for k in labels], labels)
    score = toxicity.score_texts([text(k) for k in labels], weights, bias)
    assert ((score >= 0.3) == labels).mean() > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><nav>menu</nav></header>
<div class="cookie-notice">We use cookies</div><div id="main"><article class="post-%d"><header><h1>The &quot;Title&quot;</h1><span>By X</span></header>
<p>First <b>para</b> of page %d, long enough to be one &nbsp; yes.<p>Second<br>line<div class="ad">Buy!</div><ul><li>item</ul>
<form>sub <input></form><footer>tags</footer></article><div id="comments"><div class="comment"><p>%s</p></div></div></div>
<aside>Side</aside><footer>(c)</footer><script>var a="<p>x</p>";</script></body></html>"""


def test_html_consensus(spark):
    rows = [(i, f"http://h.com/{i}", PAGE % (i, i, "a long comment " * 40)) for i in range(5)]
    out = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert out[i] == f'The "Title"\n\nFirst para of page {i}, long enough to be one yes.\n\nSecond line\n\nitem'
    assert {html_extract.vote(h, u) for _, u, h in rows} == {("h.com", ">body>div>article.post-")}


def article(n: int) -> list[str]:
    return [f"Paragraph {k} of article {n}, with words enough to be read as running text." for k in range(4)]


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "comments-open", "with-banner", "post-share-enabled", "sidebar", "entry"])
def test_names_are_evidence_only(name):
    inside = "".join(f"<p>{p}</p>" for p in article(1))
    page = f'<body><div class="{name}"><h1>T</h1>{inside}</div><div class="sidebar"><p>Buy this now, it is cheap.</p></div><div id="comments"><p>First!</p></div></body>'
    assert html_extract.extract(page, None) == "\n\n".join(["T", *article(1)])


def test_unclosed_raw_elements():
    assert html_extract.extract("<p>before<svg><p>after", None) == "before\n\nafter"
    assert html_extract.extract("<p>before<script>if (a < b) x()", None) == "before"


def test_consensus_of_several_hosts(spark):
    """Hosts with layouts of their own; on some pages another container holds more text."""
    layouts = {
        "a.com": ('<div class="post-{i}">{article}</div>', '<div class="extra">{noise}</div>'),
        "b.org": ('<main><section class="story">{article}</section></main>', '<section class="tips">{noise}</section>'),
        "c.net:8080": ('<table><tr><td class="text">{article}</td></tr></table>', '<div class="teaser">{noise}</div>'),
    }
    rows, want = [], {}
    for h, (host, (main, other)) in enumerate(layouts.items()):
        for i in range(7):
            k = 100 * h + i
            noise = "".join(f"<p>Noise {j} {'that goes on and on, ' * (9 if i == 3 else 1)}</p>" for j in range(4))
            body = main.format(i=i, article="".join(f"<p>{p}</p>" for p in article(k))) + other.format(noise=noise)
            rows.append((k, f"https://{host}/page/{i}", f"<html><head><title>t</title></head><body><nav>menu</nav>{body}<footer>end</footer></body></html>"))
            want[k] = "\n\n".join(article(k))
    out = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in out.collect()} == want
