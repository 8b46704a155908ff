"""Near-duplicate vectors of equal label by product quantisation.

A coarse quantiser cuts the unit vectors into inverted lists; residuals are coded by one
small codebook a subspace.  A vector probes every list whose boundary it lies near enough
for a neighbour within the wanted distance to be on the other side (``SIGMAS`` standard
deviations of the neighbour's offset across that boundary).  Asymmetric table look-ups give
distances to the coded vectors of a list; those that their coding error allows to be near
are reranked by exact cosine in double precision.  Only the quantiser is fitted on a
sample; every vector is indexed.

Equal vectors of a label are one node with a count.  Long lists are cut into chunks, so a
cell never holds more than two chunks; cells emit link counts and a spanning forest of
their links, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

#: Vectors the quantiser is fitted on, at most: those whose hash is lowest.
SAMPLE = 20_000
SUBSPACES, CODES = 8, 64
LIST_SIZE, MOST_LISTS, CHUNK = 4096, 4096, 2048
SIGMAS = 4.0


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        counts = np.bincount(near, minlength=k)
        for j in np.flatnonzero(counts):
            centres[j] = x[near == j].mean(axis=0)
    return centres


class Quantiser:
    """Coarse centres and residual codebooks for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int, radius: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.radius = radius
        self.dim = sample.shape[1]
        self.centres = _kmeans(sample, lists, rng)
        rest = sample - self.centres[self.nearest(sample)]
        self.parts = np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim))
        self.books = [_kmeans(rest[:, p], CODES, rng) for p in self.parts]
        gaps = self.centres[:, None, :] - self.centres[None, :, :]
        self.gaps = np.sqrt((gaps**2).sum(axis=2))

    def _squares(self, x: np.ndarray) -> np.ndarray:
        return (self.centres**2).sum(1) - 2 * x @ self.centres.T

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmin(self._squares(x), axis=1)

    def probes(self, x: np.ndarray) -> np.ndarray:
        """Which lists each vector probes; its own always."""
        squares = self._squares(x)
        own = np.argmin(squares, axis=1)
        slack = np.minimum(1.0, SIGMAS / math.sqrt(self.dim)) * 2 * self.radius * self.gaps[own]
        out = squares - squares[np.arange(len(x)), own][:, None] <= slack
        out[np.arange(len(x)), own] = True
        return out

    def encode(self, rest: np.ndarray) -> np.ndarray:
        codes = [np.argmin((b**2).sum(1) - 2 * rest[:, p] @ b.T, axis=1) for p, b in zip(self.parts, self.books)]
        return np.stack(codes, axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, s]] for s, b in enumerate(self.books)], axis=1)

    def table_distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of uncoded residuals to coded ones, by look-up."""
        out = np.zeros((len(rest), len(codes)))
        for s, (p, b) in enumerate(zip(self.parts, self.books)):
            table = ((rest[:, p][:, None, :] - b[None]) ** 2).sum(axis=2)
            out += table[:, codes[:, s]]
        return out


def _rows_of(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _sent(x: np.ndarray) -> np.ndarray:
    """Vectors as they are shipped: in single precision where that holds them exactly."""
    with np.errstate(over="ignore"):
        small = x.astype("<f4")
    return small if (small == x).all() else x.astype("<f8")


def _received(data: list[bytes], dim: int) -> np.ndarray:
    if all(len(d) == 4 * dim for d in data):
        return np.frombuffer(b"".join(data), "<f4").reshape(len(data), dim).astype(np.float64)
    return np.array([np.frombuffer(d, "<f4" if len(d) == 4 * dim else "<f8") for d in data], np.float64)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _fit(lists: int, radius: float):
    def run(frames):
        import pickle

        rows = [x for f in frames for x in f["v"]]
        x = np.array([np.asarray(r, np.float64) for r in rows])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt((x**2).sum(axis=1, keepdims=True))
        yield pd.DataFrame({"model": [pickle.dumps(Quantiser(x, lists, radius))]})

    return run


def _assign(model: Quantiser):
    names = ["node", "label", "copies", "list", "own", "probe", "codes", "v"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                given = _rows_of(part.column(3))
                x, sent = _units(given), _sent(given)
                own, probes = model.nearest(x), model.probes(x)
                codes = model.encode(x - model.centres[own])
                row, target = np.nonzero(probes)
                row = np.concatenate([np.arange(len(x)), row])
                target = np.concatenate([own, target])
                probe = np.arange(len(row)) >= len(x)
                take = pa.array(row)
                data = [part.column(k).take(take) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *data,
                        pa.array(target, kinds[3]),
                        pa.array(own[row], kinds[4]),
                        pa.array(probe),
                        pa.array([codes[i].tobytes() for i in row], kinds[6]),
                        pa.array([sent[i].tobytes() for i in row], kinds[7]),
                    ],
                    names=names,
                )

    return run


def _search(model: Quantiser, cosine: float):
    schema = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        probe = table.column("probe").to_numpy()
        nodes, copies, own = (table.column(c).to_numpy() for c in ("node", "copies", "own"))
        x = _units(_received(table.column("v").to_pylist(), model.dim))
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(nodes), -1)
        here = table.column("list")[0].as_py()
        p, y = np.flatnonzero(probe), np.flatnonzero(~probe)
        out = ([], [], [])
        if len(p) and len(y):
            centre = model.centres[here]
            error = np.sqrt(((x[y] - centre - model.decode(codes[y])) ** 2).sum(axis=1))
            linked = np.zeros((len(p), len(y)), bool)
            for a in range(0, len(p), 256):
                near = model.table_distances(x[p[a : a + 256]] - centre, codes[y]) <= (model.radius + error + 1e-9) ** 2
                near &= nodes[p[a : a + 256]][:, None] != nodes[y][None, :]
                i, j = np.nonzero(near)
                for b in range(0, len(i), 1 << 17):
                    ii, jj = i[b : b + (1 << 17)], j[b : b + (1 << 17)]
                    cos = np.einsum("ij,ij->i", x[p[a + ii]], x[y[jj]])
                    linked[a + ii, jj] = cos >= cosine
            # a link is counted from either end; the indexed end counts it here if it does not probe back
            count = linked @ copies[y]
            back = model.probes(x[y])[:, np.unique(own[p])]
            column = np.searchsorted(np.unique(own[p]), own[p])
            silent = (linked & ~back[:, column].T).T @ copies[p]
            for rows, n in ((p, count), (y, silent)):
                some = np.flatnonzero(n)
                out[0].append(nodes[rows[some]])
                out[1].append(nodes[rows[some]])
                out[2].append(n[some])
            forest = _forest(linked)
            if forest:
                i, j = np.array(forest).T
                out[0].append(nodes[p[i]])
                out[1].append(nodes[y[j]])
                out[2].append(np.zeros(len(i), np.int64))
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table([pa.array(c, pa.int64()) for c in cols], schema=schema)

    return run


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a bipartite link matrix, as (row, column) pairs."""
    rows, columns = linked.any(axis=1), linked.any(axis=0)
    out = []
    for start in np.flatnonzero(rows).tolist():
        if not rows[start]:
            continue
        rows[start] = False
        todo = [(start, True)]
        while todo:
            at, is_row = todo.pop()
            if is_row:
                found = np.flatnonzero(linked[at] & columns)
                columns[found] = False
                out += [(at, j) for j in found.tolist()]
            else:
                found = np.flatnonzero(linked[:, at] & rows)
                rows[found] = False
                out += [(i, at) for i in found.tolist()]
            todo += [(f, not is_row) for f in found.tolist()]
    return out


def embedding_near_dedup(
    vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Rows of equal, non-null label link if their cosine is at least ``cosine``.  Vectors that
    are null, empty, zero or hold null or non-finite components, and rows without id or
    label, link with nothing; so do vectors of different lengths.  Repeated rows link as
    equal vectors do.  ``component_id`` is the smallest id reachable, ``kept`` whether it is
    the row's own.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    radius = math.sqrt(2 * (1 - cosine))
    v = F.col(vec_col)
    fine = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
    fine &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fine &= F.exists(v, lambda x: x != 0)
    source = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.coalesce(fine, F.lit(False)).alias("fine"),
        F.xxhash64(F.col(label_col).cast("string"), F.size(v)).alias("label"),
        F.transform(v, lambda x: x.cast("double")).alias("v"),
    )
    classes = source.filter("fine").groupBy("label", "v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    classes = classes.select(F.xxhash64("label", "v").alias("node"), "label", "copies", "v", "first_id")
    classes = materialize(classes, "pq-classes")
    found, edges = None, None
    for dim in [r[0] for r in classes.select(F.size("v")).distinct().collect()]:  # a row for each length in use
        same = classes.filter(F.size("v") == dim)
        n = same.count()
        lists = max(1, min(MOST_LISTS, -(-n // LIST_SIZE)))
        sample = same.select("v", "node").orderBy("node").limit(SAMPLE).select("v").coalesce(1)
        import pickle

        model = pickle.loads(sample.mapInPandas(_fit(lists, radius), "model binary").first()[0])
        rows = same.select("node", "label", "copies", "v").mapInArrow(
            _assign(model),
            "node long, label long, copies long, list int, own int, probe boolean, codes binary, v binary",
        )
        rows = materialize(rows, "pq-index")
        chunks = rows.groupBy("label", "list").agg(
            F.ceil(F.count_if(~F.col("probe")) / CHUNK).alias("ys"), F.ceil(F.count_if("probe") / CHUNK).alias("ps")
        )
        chunks = chunks.filter("ys > 0")
        part = F.when(F.col("probe"), F.pmod(F.xxhash64("node"), "ps")).otherwise(F.pmod(F.xxhash64("node"), "ys"))
        others = F.when(F.col("probe"), F.col("ys")).otherwise(F.col("ps"))
        cells = (
            rows.join(chunks, ["label", "list"])
            .withColumn("part", part)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
            .withColumn("i", F.when(F.col("probe"), F.col("part")).otherwise(F.col("other")))
            .withColumn("j", F.when(F.col("probe"), F.col("other")).otherwise(F.col("part")))
        )
        hits = cells.select("label", "list", "i", "j", "node", "copies", "own", "probe", "codes", "v").groupBy(
            "label", "list", "i", "j"
        ).applyInArrow(_search(model, cosine), "node long, other long, links long")
        hits = materialize(hits, "pq-hits")
        found = hits if found is None else found.union(hits)
    if found is None:
        found = spark.createDataFrame([], "node long, other long, links long")
    edges = connected_components(found.filter("node <> other").select(F.col("node").alias("u"), F.col("other").alias("v")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    ids = edges.join(classes.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("root_id"))
    members = edges.join(ids, "component").select("node", "root_id")
    known = (
        classes.select("node", "copies", "first_id")
        .join(members, "node", "left")
        .join(counts, "node", "left")
        .select(
            "node",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("root_id", "first_id").alias("component_id"),
        )
    )
    named = source.withColumn("node", F.when(F.col("fine"), F.xxhash64("label", "v")))
    out = named.join(known, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
