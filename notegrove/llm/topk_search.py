"""Exact top-k inner-product search by no-random-access aggregation of sorted lists.

The stated queries meet all rows in cells of one row tile and one query tile.  In a cell
every dimension is a sorted list, read from its top where the query's component is positive
and from its bottom where it is negative.  After each depth an entry that was read counts
with its value; one that was not is bounded by the list's frontier above and by its far end
below.  Rows whose upper bound is under the k-th best lower bound cannot qualify any more;
reading stops when few others are left, whose final scores are then resolved exactly.  The
bounds of many queries are two matrix products.  A cell keeps k rows a query, and a last
window ranks those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ROWS, QUERIES, QUERY_BLOCK = 16384, 2048, 128
DEPTHS = (0.25, 0.5, 0.7, 0.85, 0.95)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``(vec_id, v array<long>)`` of the vectors that take part."""
    v = F.col(vec_col)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return vectors.filter(fine).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _pack(table: pa.Table) -> pa.Table:
    """One row a length of vectors: ids and the matrix as bytes."""
    lengths = np.array([len(x) for x in table.column("v").to_pylist()], np.int64)
    ids = table.column("vec_id").to_numpy()
    values = table.column("v").combine_chunks()
    flat = (values.flatten() if isinstance(values, pa.ListArray) else pa.concat_arrays([c.flatten() for c in values.chunks])).to_numpy()
    starts = np.cumsum(lengths) - lengths
    out = {"tile": [], "dim": [], "ids": [], "data": []}
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        out["tile"].append(table.column("tile")[0].as_py())
        out["dim"].append(int(d))
        out["ids"].append(ids[rows].astype(np.int64).tobytes())
        out["data"].append(flat[starts[rows][:, None] + np.arange(d)].astype(np.int64).tobytes())
    return pa.table({"tile": pa.array(out["tile"], pa.int64()), "dim": pa.array(out["dim"], pa.int32()), "ids": pa.array(out["ids"], pa.binary()), "data": pa.array(out["data"], pa.binary())})


def search_cell(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int):
    """``(query_id, vec_id, score)`` arrays: the k best rows of the cell for each query."""
    n, d = x.shape
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    limit = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(d, 1)
    if limit >= 2**52:  # beyond what doubles hold exactly
        return _plain(ids, x.astype(object), qids, q.astype(object), k)
    xf, lists = x.astype(np.float64), np.sort(x, axis=0).astype(np.float64)
    out = []
    for a in range(0, len(q), QUERY_BLOCK):
        block, names = q[a : a + QUERY_BLOCK].astype(np.float64), qids[a : a + QUERY_BLOCK]
        up, down = np.maximum(block, 0).T, np.minimum(block, 0).T
        alive = np.ones(n, bool)
        contenders = ids[:, None] != names[None, :]
        for depth in DEPTHS if n > 8 * k and d else ():
            t = int(n * depth)
            high, low = lists[n - t], lists[t - 1]
            rows = np.flatnonzero(alive)
            part = xf[rows]
            above, below = part >= high, part <= low
            lower = np.where(above, part, lists[0]) @ up + np.where(below, part, lists[-1]) @ down
            upper = np.where(above, part, high) @ up + np.where(below, part, low) @ down
            lower[~contenders[rows]] = -np.inf
            if len(rows) <= k:
                break
            bar = np.partition(lower, len(rows) - k, axis=0)[len(rows) - k]
            contenders[rows] &= upper >= bar
            alive = contenders.any(axis=1)
            if alive.sum() <= 16 * k:
                break
        rows = np.flatnonzero(alive)
        scores = xf[rows] @ block.T
        scores[~contenders[rows]] = -np.inf
        keep = min(k, len(rows))
        for j in range(len(names)):
            s = scores[:, j]
            if keep and keep < len(rows):
                bar = np.partition(s, len(rows) - keep)[len(rows) - keep]
                found = np.flatnonzero(s >= max(bar, -1e300))
            else:
                found = np.flatnonzero(s > -np.inf)
            found = found[np.lexsort((ids[rows[found]], -s[found]))][:k]
            out.append((np.full(len(found), names[j]), ids[rows[found]], s[found].astype(np.int64)))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _plain(ids, x, qids, q, k):
    out = ([], [], [])
    for name, row in zip(qids.tolist(), q):
        s = [(-int(v), i) for v, i in zip(x @ row if len(row) else [0] * len(x), ids.tolist()) if i != name]
        for v, i in sorted(s)[:k]:
            for c, value in zip(out, (name, i, max(-(2**63), min(2**63 - 1, -v)))):
                c.append(value)
    return [np.array(c, np.int64) for c in out]


def _cell(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found = [[np.zeros(0, np.int64)] * 3]
        for dim, qids, qdata in zip(*(queries.column(c).to_pylist() for c in ("dim", "ids", "data"))):
            for other, ids, data in zip(*(rows.column(c).to_pylist() for c in ("dim", "ids", "data"))):
                if dim == other:
                    a, b = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64)
                    x = np.frombuffer(data, np.int64).reshape(len(a), dim)
                    found.append(search_cell(a, x, b, np.frombuffer(qdata, np.int64).reshape(len(b), dim), k))
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], schema=schema)

    return run


def top_k_search(
    vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each row whose id is divisible by
    ``every``; returns ``query_id, rank, vec_id, score``.

    Components count as ``floor(scale * x)``.  A row is no candidate for a query of its own
    id.  Ties go to the smaller id.  Vectors that are null, have null or non-finite
    components, or have no id take no part; vectors of different lengths do not meet, empty
    ones score 0.  Scores outside the range of a long are clipped.  Fewer candidates than
    ``k`` give fewer rows, an empty table none.
    """
    given = materialize(quantised(vectors, id_col, vec_col, scale), "topk-vectors")
    asked = given.filter(F.col("vec_id") % every == 0)
    row_tiles = given.count() // ROWS + 1
    query_tiles = asked.count() // QUERIES + 1

    def tiles(df: DataFrame, n: int) -> DataFrame:
        tile = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).alias("tile")
        return df.select("vec_id", "v", tile).groupBy("tile").applyInArrow(_pack, "tile long, dim int, ids binary, data binary")

    rows = tiles(given, row_tiles).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1))))
    queries = tiles(asked, query_tiles).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(row_tiles - 1))))
    left = rows.select(F.col("tile").alias("r"), F.col("other").cast("long").alias("q"), "dim", "ids", "data")
    right = queries.select(F.col("other").cast("long").alias("r"), F.col("tile").alias("q"), "dim", "ids", "data")
    found = left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH given AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, g.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, g.v), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM given q JOIN given g ON q.vec_id % 50 = 0 AND q.vec_id <> g.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM scored
)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rn <= 5
"""
