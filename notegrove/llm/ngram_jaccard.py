"""Exact Jaccard self-join of word n-gram sets by universe partition and pigeonhole.

For two sets of sizes a and c with ``100*I >= P*U`` the symmetric difference is at most
``H(a+c)``.  Sizes are cut into bands; per band the universe of shingles is hashed into
segments that carry capacities v (1: the segments must be equal, 2: they may differ in one
element, found through the one-deletion neighbourhood) with a sum over H.  By the
pigeonhole principle two similar sets then agree in some segment within its capacity, so
the index over segment signatures loses no pair.  Capacities are allocated per band by a
cost model that weighs index rows against expected accidental pairs, with the number of
sets of each band counted over all documents.

Some capacity is spare, so that a set may leave out its empty segments (they would put
unrelated sets in one list); sets with more of them index them all.  How much is spare is
part of the cost model, too.

A task indexes equal sets once, and the rows of the index are shuffled once: sorted by
signature and set, repeats and lists of one set are dropped as they pass.  Lists with the same members
are one.  A list is tested in the tile of its smallest member, to which each member's sketch
(counts and names of up to ``CELLS`` cells of the set) travels once, whatever the number of
lists it is in: sketches bound each pair's difference from below, which drops nearly all
chance pairs; the rest forms candidate groups.  Within a group every pair is verified exactly,
tile by tile of at most 2 * ``CHUNK`` sets.  Both steps run inside Python workers and emit
spanning forests of what they find, so no row per pair exists; long lists and large groups
are cut into tiles.  Equal sets are one node.

Elements and sets are named by 64-bit hashes; the intersection counts hash values.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, lean, materialize, mix64, text_batches, word_hashes
from .components import connected_components

#: Sets of a tile of a candidate group, of a long list, and lists of up to so many sets whose
#: pairs are tested at once.
CHUNK, LONG, FEW = 256, 1024, 8
#: Sets that a task remembers, so as to index equal ones once; repeats beyond cost a row each.
KNOWN = 200_000
#: Cells of a sketch at most (2 bytes each).
CELLS = 256
#: Chance that an element of one set is met in an unrelated one; chance pairs cost little, as the
#: bound on their difference drops nearly all.
CHANCE = 0.03
#: Sets of up to this many ids are sent to all executors to filter texts (16 bytes each).
BROADCAST_IDS = 1_000_000


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; all its words as one if it has fewer."""
    words, bounds = word_hashes(texts)
    salt = [mix64(np.uint64(k + 1) * np.full(1, 0x9E3779B97F4A7C15, np.uint64)) for k in range(width)]
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled = mix64(rolled + words[k : n - width + 1 + k] + salt[k]) if len(rolled) else rolled
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for k in range(b - a):
                h = mix64(h + words[a + k : a + k + 1] + salt[k])
            out.append(mix64(h))
        else:
            out.append(words[:0])
    return out


def set_key(s: np.ndarray) -> int:
    """64-bit name of a set, as a signed integer."""
    total = np.add.reduce(mix64(s ^ np.uint64(0xD1B54A32D192ED03)))
    return int(mix64(np.array([total + np.uint64(len(s))], np.uint64)).astype(np.int64)[0])


def most_difference(total: int, percent: int) -> int:
    """Largest symmetric difference of similar sets whose sizes add up to at most ``total``."""
    low = max(0, total - 400)
    sums = np.arange(low, total + 1)
    least = -((-percent * sums) // (100 + percent))
    return int(np.max(sums - 2 * least))


def size_bands(largest: int, percent: int) -> list[int]:
    """Lower bounds of bands such that similar sets lie in the same or in adjacent bands."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(bounds[-1] * 100 // percent + 1)
        bounds[-1] = bounds[-1] * 100 // percent + 1  # wider than needed: fewer sets probe two bands
    return bounds


def _more_than(spare: int, mean: float) -> float:
    """Chance that a Poisson variable exceeds ``spare``."""
    term = left = math.exp(-mean)
    for k in range(1, spare + 1):
        term *= mean / k
        left += term
    return max(0.0, 1.0 - left)


def allocate(band: int, bounds: list[int], percent: int, sets: int, chance: float = CHANCE) -> tuple[list[int], int] | None:
    """Capacities of the band's segments, and how much of them is spare; None if only equal
    sets can be similar.

    Every share of one-deletion segments and several spares are costed as index rows plus the
    accidental pairs that ``sets`` sets make, if unrelated sets share an element's place by
    ``chance`` and sets with too many empty segments meet in those.
    """
    top = bounds[band + 1] - 1
    difference = most_difference(top + top * 100 // percent, percent)
    if difference <= 0:
        return None
    size = (bounds[band] + top) / 2
    best = None
    for spare in sorted({1, 2, 3, 4, 6, 8, 12, 16, 24, difference // 8, difference // 4} - {0}):
        capacity = difference + 1 + spare
        for doubles in sorted({round(capacity * share / 8) for share in range(5)}):
            segments = capacity - doubles
            length = size / segments
            empty = math.exp(-length)
            rows = segments + doubles * length
            pairs = (segments - doubles) * chance**length + doubles * (1 + length) * chance ** max(length - 1, 0)
            crowd = _more_than(spare, (segments - doubles) * empty)
            pairs += (segments - doubles) * (crowd * empty) ** 2 + doubles * (empty * (1 + length)) ** 2
            cost = sets * rows + sets * sets * pairs
            if best is None or cost < best[0]:
                best = (cost, [2] * doubles + [1] * (segments - doubles), spare)
    return best[1:]


def segment_sums(s: np.ndarray, band: int, m: int):
    """The set's elements by segment: scrambled elements, their segments, counts and sums."""
    salt = np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    element = mix64(s + salt)
    segment = ((element >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    element, segment = mix64(element)[order], segment[order]
    counts = np.bincount(segment, minlength=m)
    full = np.flatnonzero(counts)
    sums = np.zeros(m, np.uint64)
    sums[full] = np.add.reduceat(element, (np.cumsum(counts) - counts)[full])
    return element, segment, counts, sums


def sketch(s: np.ndarray, band: int, m: int) -> bytes:
    """A byte of the sum, and one of the count, of each cell; cells are segments or, beyond
    ``CELLS`` of them, unions of segments."""
    element, segment, counts, sums = segment_sums(s, band, m)
    if m > CELLS:
        counts = np.bincount(np.arange(m) % CELLS, counts, CELLS).astype(np.int64)
        folded = np.zeros(CELLS, np.uint64)
        np.add.at(folded, np.arange(m) % CELLS, sums)
        sums = folded
    return (mix64(sums) & np.uint64(255)).astype(np.uint8).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes()


def signatures(s: np.ndarray, band: int, capacities: list[int], spare: int) -> np.ndarray:
    """Signatures of a set under the band's partition of the universe."""
    m = len(capacities)
    element, segment, counts, sums = segment_sums(s, band, m)
    salt = np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    base = mix64(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + salt)
    doubles = capacities.count(2)
    emit = counts > 0
    if np.count_nonzero(~emit[doubles:]) > spare:
        emit[:] = True
    emit[:doubles] = True
    out = [(sums + base)[emit]]
    if doubles:
        inside = segment < doubles
        out.append((sums + base)[segment[inside]] - element[inside])
    return np.unique(mix64(np.concatenate(out)))


def _table(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def _digest(width: int):
    names = ("doc_id", "rid", "text_hash", "n_shingles", "key")
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches):
        for batch in batches:
            texts = binary_texts(batch.column("text"))
            for a, b in text_batches(texts):
                sets = shingle_sets(texts[a:b], width)
                yield _table(
                    {
                        **{c: batch.column(c).slice(a, b - a) for c in names[:3]},
                        "n_shingles": [len(s) for s in sets],
                        "key": [set_key(s) for s in sets],
                    },
                    schema,
                )

    return run


def _wanted(batch: pa.RecordBatch, width: int):
    """``(row, key, set)`` of the rows whose text has the set of that key; rows of other texts
    under the same id fall out."""
    texts, keys = binary_texts(batch.column("text")), batch.column("key").to_pylist()
    for a, b in text_batches(texts):
        for i, s in enumerate(shingle_sets(texts[a:b], width), a):
            if set_key(s) == keys[i]:
                yield i, keys[i], s


def _index(width: int, percent: int, bounds: list[int], plans: dict[int, tuple[list[int], int]]):
    schema = pa.schema([("sig", pa.int64()), ("use", pa.int32()), ("key", pa.int64())])
    lower = np.array(bounds)

    def batch_of(sigs, uses, keys):
        n = [len(g) for g in sigs]
        columns = (np.concatenate(sigs).view(np.int64), np.repeat(np.array(uses, np.int32), n), np.repeat(np.array(keys, np.int64), n))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    def sets_of(texts):
        for a, b in text_batches(texts):
            yield from shingle_sets(texts[a:b], width)

    def run(batches):
        known: set[int] = set()
        for batch in batches:
            sigs, uses, keys, held = [], [], [], 0
            for s in sets_of(binary_texts(batch.column(0))):
                key = set_key(s) if len(s) else 0
                if not len(s) or key in known:
                    continue
                if len(known) < KNOWN:
                    known.add(key)
                band = int(np.searchsorted(lower, len(s), side="right")) - 1
                for use in (band, band - 1):
                    # a set probes the band below only if a set there can be similar
                    if use in plans and (use == band or percent * len(s) <= 100 * (bounds[band] - 1)):
                        sigs.append(signatures(s, use, *plans[use]))
                        uses.append(use)
                        keys.append(key)
                        held += len(sigs[-1])
                        if held > 1 << 18:
                            yield batch_of(sigs, uses, keys)
                            sigs, uses, keys, held = [], [], [], 0
            if sigs:
                yield batch_of(sigs, uses, keys)

    return run


def _met(batches):
    """Of rows sorted by signature and key, those whose signature another key has, too."""
    held, joined = None, False  # the last row waits for the next; whether it has met the one before
    for batch in batches:
        table = pa.Table.from_batches([b for b in (held, batch) if b is not None])
        if not len(table):
            continue
        sigs, keys = table.column("sig").to_numpy(), table.column("key").to_numpy()
        same = sigs[1:] == sigs[:-1]
        fresh = np.append(True, ~same | (keys[1:] != keys[:-1]))
        if not fresh.all():
            table, sigs = table.filter(pa.array(fresh)), sigs[fresh]
            same = sigs[1:] == sigs[:-1]
        met = np.append(joined, same) | np.append(same, False)
        joined, met[-1] = bool(met[-1]), False
        yield from table.filter(pa.array(met)).to_batches()
        held = table.slice(len(table) - 1).combine_chunks().to_batches()[0]
    if joined:
        yield held


def _places(chunk: int, chunks: int, bundle: int) -> list[int]:
    """Tiles of a member: its bundle of small groups, or those of its chunk with every other."""
    if chunks == 1:
        return [bundle]
    return [-1 - (min(chunk, o) * chunks + max(chunk, o)) for o in range(chunks)]


def _sketches(width: int, bounds: list[int], plans: dict[int, tuple[list[int], int]]):
    schema = pa.schema([("key", pa.int64()), ("use", pa.int32()), ("size", pa.int64()), ("cells", pa.binary())])
    lower = np.array(bounds)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for _, key, s in _wanted(batch, width):
                band = int(np.searchsorted(lower, len(s), side="right")) - 1
                rows += [(key, use, len(s), sketch(s, use, len(plans[use][0]))) for use in (band, band - 1) if use in plans]
            columns = list(zip(*rows)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _forest_of(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric link matrix, as index pairs."""
    left = np.ones(len(linked), bool)
    forest = []
    for start in range(len(linked)):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            at = todo.pop()
            found = np.flatnonzero(linked[at] & left)
            left[found] = False
            forest += [(at, j) for j in found.tolist()]
            todo += found.tolist()
    return forest


class _Sketched:
    """The sketches of a tile's sets of one use, and which of them are known to be one group."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, cells: list[bytes], percent: int):
        order = np.argsort(keys)
        order = order[np.append(True, np.diff(keys[order]) != 0)] if len(order) else order
        self.keys, self.sizes, self.percent = keys[order], sizes[order], percent
        both = np.frombuffer(b"".join(cells[i] for i in order.tolist()), np.uint8).reshape(len(order), -1)
        half = both.shape[1] // 2
        self.names, self.counts = both[:, :half], both[:, half:].astype(np.int16)
        self.group = np.arange(len(order))

    def fit(self, i, j) -> np.ndarray:
        """Whether sets may be similar: cells that differ by k elements in number, or differ
        at all, add k, or 1, to their difference at least."""
        least = np.abs(self.counts[i] - self.counts[j])
        np.maximum(least, self.names[i] != self.names[j], out=least)
        return (100 + self.percent) * least.sum(axis=1, dtype=np.int64) <= (100 - self.percent) * (self.sizes[i] + self.sizes[j])

    def join(self, i: int, j: int) -> None:
        self.group[self.group == self.group[j]] = self.group[i]

    def few(self, lists: np.ndarray) -> list[tuple[int, int]]:
        """Edges among the members of short lists of one length, given as rows."""
        i, j = np.triu_indices(lists.shape[1], 1)
        pairs = np.unique(np.stack([lists[:, i].ravel(), lists[:, j].ravel()], axis=1), axis=0)
        out = []
        for a in range(0, len(pairs), 8192):
            part = pairs[a : a + 8192]
            part = part[self.group[part[:, 0]] != self.group[part[:, 1]]]
            for x, y in part[self.fit(part[:, 0], part[:, 1])].tolist():
                if self.group[x] != self.group[y]:
                    self.join(x, y)
                    out.append((x, y))
        return out

    def long(self, left: np.ndarray) -> list[tuple[int, int]]:
        """Edges that span what may be similar in a list; linked sets are tested once."""
        out: list[tuple[int, int]] = []
        while len(left) > 1 and (self.group[left] != self.group[left[0]]).any():
            todo, left = [int(left[0])], left[1:]
            while todo and len(left):
                at = todo.pop()
                known = self.group[left] == self.group[at]
                test = np.flatnonzero(~known)
                found = test[self.fit(np.full(len(test), at), left[test])]
                for x in left[found].tolist():
                    if self.group[x] != self.group[at]:
                        self.join(at, x)
                        out.append((at, x))
                known[found] = True
                todo += left[known].tolist()
                left = left[~known]
        return out


def _possible(percent: int):
    """From a tile's lists (signature, use, key) and its sets' sketches, a forest of the pairs
    that share a signature and may be similar by their sketches."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(lists: pa.Table, sketches: pa.Table) -> pa.Table:
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        sig, use, key = (lists.column(c).to_numpy() for c in ("sig", "use", "key"))
        uses, keys, sizes = (sketches.column(c).to_numpy() for c in ("its_use", "its_key", "size"))
        cells = sketches.column("cells").to_pylist()
        for u in np.unique(use):
            mine, theirs = np.flatnonzero(use == u), np.flatnonzero(uses == u)
            held = _Sketched(keys[theirs], sizes[theirs], [cells[i] for i in theirs.tolist()], percent)
            order = mine[np.lexsort((key[mine], sig[mine]))]
            at = np.searchsorted(held.keys, key[order])
            starts = np.flatnonzero(np.append(True, np.diff(sig[order]) != 0))
            lengths = np.diff(np.append(starts, len(order)))
            edges: list[tuple[int, int]] = []
            for n in range(2, FEW + 1):
                if (lengths == n).any():
                    edges += held.few(at[starts[lengths == n][:, None] + np.arange(n)])
            for k in np.flatnonzero(lengths > FEW).tolist():
                edges += held.long(np.unique(at[starts[k] : starts[k] + lengths[k]]))
            if edges:
                x, y = np.array(edges).T
                us.append(held.keys[x])
                vs.append(held.keys[y])
        return pa.table([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], schema=schema)

    return run


def _sets(width: int):
    schema = pa.schema([("tile", pa.int64()), ("grp", pa.int64()), ("key", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for batch in batches:
            rest = batch.select(["grp", "chunk", "chunks", "bundle"]).to_pydict()
            rows, held = {f.name: [] for f in schema}, 0
            for i, key, s in _wanted(batch, width):
                grp, chunk, chunks, bundle = (rest[c][i] for c in ("grp", "chunk", "chunks", "bundle"))
                data = s.tobytes()
                for tile in _places(chunk, chunks, bundle):
                    for name, value in zip(rows, (tile, grp, key, data)):
                        rows[name].append(value)
                    held += len(data)
                    if held > 8 << 20:
                        yield _table(rows, schema)
                        rows, held = {f.name: [] for f in schema}, 0
            yield _table(rows, schema)

    return run


def _link_tile(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets, as index pairs."""
    k = len(sets)
    if k < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    shared = np.zeros((k, k), np.float32)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(k), sizes)
    df = np.bincount(column)
    dense = np.cumsum(df > 1) - 1  # elements of one set cannot be shared
    keep = df[column] > 1
    row, column = row[keep], dense[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(1024, (1 << 22) // k)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (a, a + width))
        block = np.zeros((k, min(width, int(column[hi - 1]) - a + 1)), np.float32)
        block[row[lo:hi], column[lo:hi] - a] = 1
        shared += block @ block.T
    inter = np.rint(shared).astype(np.int64)
    linked = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
    return _forest_of(linked)


def _verify(percent: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(table):
        groups: dict[int, list[int]] = {}
        for i, g in enumerate(table.column("grp").to_pylist()):
            groups.setdefault(g, []).append(i)
        keys, data = table.column("key").to_pylist(), table.column("shingles")
        us, vs = [], []
        for rows in groups.values():
            rows = list({keys[i]: i for i in rows}.values())
            for a, b in _link_tile([np.frombuffer(data[i].as_py(), np.uint64) for i in rows], percent):
                us.append(keys[rows[a]])
                vs.append(keys[rows[b]])
        return pa.Table.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=schema)

    return run


def _picked(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the rows whose ``rid`` is wanted; few are broadcast, many are joined by a
    shuffle.  Other rows under the same id come along and fall out by their key."""
    return source.select("rid", "text").join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "rid")


def _candidates(source: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """``(node, component)`` of the sets that may be similar to others."""
    sizes = classes.agg(F.max("size")).first()[0] or 0
    bounds = size_bands(sizes, percent)
    band = sum((F.col("size") >= b).cast("int") for b in bounds) - 1
    counts = {r[0]: r[1] for r in classes.groupBy(band.alias("band")).count().collect()}  # a row per band
    plans = {}
    for b in range(len(bounds) - 1):
        sets = counts.get(b, 0) + counts.get(b + 1, 0)
        plan = allocate(b, bounds, percent, sets) if sets else None
        if plan:
            plans[b] = plan

    named = classes.select("rid", "key")
    index = source.select("text").mapInArrow(lean(_index(width, percent, bounds, plans)), "sig long, use int, key long")
    shared = index.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(lean(_met), "sig long, use int, key long")
    shared = materialize(shared, "jaccard-shared")
    lists = shared.groupBy("sig").agg(
        F.count("*").alias("n"), F.min("key").alias("head"), F.bit_xor(F.xxhash64("key")).alias("a"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("b")
    )
    lists = lists.groupBy("head", "n", "a", "b").agg(F.min("sig").alias("sig")).select("sig", "head", F.ceil(F.col("n") / LONG).alias("chunks"))
    tiles = shared.count() // 16384 + 1
    chunk = F.pmod(F.xxhash64("key"), F.col("chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    low, high = F.least(chunk, "other"), F.greatest(chunk, "other")
    placed = shared.join(lists, "sig").withColumn("other", other).select(
        "sig",
        "use",
        "key",
        F.when(F.col("chunks") == 1, F.lit(0)).otherwise(F.col("sig")).alias("owner"),
        F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("head"), F.lit(tiles))).otherwise(low * F.col("chunks") + high).alias("tile"),
    )
    placed = materialize(placed, "jaccard-lists")
    keys = placed.select("key").distinct().join(named, "key")
    sketches = _picked(source, keys).select("text", "key").mapInArrow(
        lean(_sketches(width, bounds, plans)), "key long, use int, size long, cells binary"
    )
    sent = placed.select("owner", "tile", "key", "use").distinct().join(sketches, ["key", "use"])
    sent = sent.select(*(F.col(c).alias(f"its_{c}") for c in ("owner", "tile", "key", "use")), "size", "cells")
    stars = placed.groupBy("owner", "tile").cogroup(sent.groupBy("its_owner", "its_tile")).applyInArrow(_possible(percent), "u long, v long")
    return connected_components(stars)


def ngram_jaccard_join(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Group documents whose word ``width``-gram sets have a Jaccard similarity of
    ``percent`` / 100 or more.

    Returns one row per row of ``docs``: ``doc_id, n_shingles, component_id, set_key,
    text_hash``, where ``component_id`` is the smallest doc_id reachable by links, itself
    included, and ``text_hash`` the ``xxhash64`` of the row's text.

    Null, empty and blank texts have no shingles and link with nothing.  Rows with equal
    sets are linked.  Rows that repeat an id are rows of their own, each with its own text.
    Rows without id link, and tie others together, like any; their component is null if no
    row of the group has an id.  Other columns are ignored; an empty table gives an empty
    result.
    """
    text, given = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    hashed = F.xxhash64(text)
    source = docs.select(given.alias("doc_id"), F.coalesce(given, hashed).alias("rid"), hashed.alias("text_hash"), text.alias("text"))
    digest = source.mapInArrow(lean(_digest(width)), "doc_id long, rid long, text_hash long, n_shingles long, key long")
    digest = materialize(digest, "jaccard-digest")
    classes = digest.filter("n_shingles > 0").groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.min("rid").alias("rid"), F.max("n_shingles").alias("size")
    )
    classes = materialize(classes, "jaccard-classes")

    groups = _candidates(source, classes, width, percent).select(F.col("node").alias("key"), F.col("component").alias("grp"))
    groups = materialize(groups, "jaccard-groups")
    bundles = groups.count() // 1024 + 1
    sized = groups.groupBy("grp").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    members = (
        groups.join(sized, "grp")
        .join(classes, "key")
        .select(
            "rid",
            "key",
            "grp",
            "chunks",
            F.pmod(F.xxhash64("key"), F.col("chunks")).alias("chunk"),
            F.pmod(F.xxhash64("grp"), F.lit(bundles)).alias("bundle"),
        )
    )
    members = materialize(members, "jaccard-members")
    picked = _picked(source, members).select("text", "key", "grp", "chunk", "chunks", "bundle")
    tiles = picked.mapInArrow(lean(_sets(width)), "tile long, grp long, key long, shingles binary")
    split = F.when(F.col("tile") < 0, F.col("grp")).otherwise(F.lit(0))
    links = tiles.withColumn("owner", split).groupBy("owner", "tile").applyInArrow(_verify(percent), "u long, v long")
    linked = connected_components(links)

    roots = (
        linked.join(classes.select(F.col("key").alias("node"), "first_id"), "node")
        .groupBy("component")
        .agg(F.min("first_id").alias("root_id"))
    )
    linked = linked.join(roots, "component").select(F.col("node").alias("key"), "root_id")
    known = classes.select("key", "first_id").join(linked, "key", "left")
    known = known.select("key", F.coalesce("root_id", "first_id").alias("root_id"))
    return digest.join(known, "key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("root_id")).alias("component_id"),
        F.col("key").alias("set_key"),
        "text_hash",
    )
