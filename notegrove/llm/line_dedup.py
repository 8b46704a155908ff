"""Deleting later copies of repeated line runs, by suffix ranks over line-ID sequences.

A text is the sequence of the IDs of its lines.  Prefix doubling ranks the suffixes of all
sequences by their first 1, 2, 4, ... lines: the rank of a stretch of 2 * n lines is made of
the ranks of its two halves.  Ranks here are content hashes, so equal stretches have equal
ranks wherever they lie and doubling needs no exchange; one exchange over all suffixes then
finds the LCP intervals, the sets of suffixes that share a stretch.

A run counts if it has at least ``min_words`` words.  Every run that occurs again and counts
is the union of the shortest counting stretches that begin, and those that end, at its lines.
So for each line the suffix's interval at the depth of its shortest counting stretch is asked
for (and the same backwards), its rank being that of two overlapping power-of-two stretches.
All members of an interval but the first in order of ``(doc_id, line)`` are later copies;
the union of their stretches are the maximal repeated runs, and those lines go.  The first
copy of every line stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix64, text_batches

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def line_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """IDs and word counts of all lines of the texts, and each text's line offsets."""
    split = [t.split(b"\n") for t in texts]
    lines = [x for s in split for x in s]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(s) for s in split], out=offsets[1:])
    ids = np.array([hash_line(x) for x in lines], np.uint64)
    words = np.array([len(x.split()) for x in lines], np.int64)
    return ids, words, offsets


def hash_line(line: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(line)


def doubled_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4, ... lines that begin at each line."""
    ranks = [mix64(ids + _A)]
    while 2 << (len(ranks) - 1) <= len(ids):
        half, last = 1 << (len(ranks) - 1), ranks[-1]
        ranks.append(mix64(last[: len(last) - half] * _A + mix64(last[half:] + _B)))
    return ranks


def counting_stretches(words: np.ndarray, least: int) -> np.ndarray:
    """``(start, end)`` of the shortest stretches of ``least`` words from and to each line."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    end = np.searchsorted(total, total[:-1] + least, side="left")  # total[end] - total[start] >= least
    start = np.searchsorted(total, total[1:] - least, side="right") - 1
    forward = np.stack([np.arange(n), end], axis=1)[end <= n]
    backward = np.stack([start, np.arange(1, n + 1)], axis=1)[start >= 0]
    both = np.concatenate([forward, backward])
    return np.unique(both, axis=0) if len(both) else both


def stretch_ranks(ranks: list[np.ndarray], stretches: np.ndarray) -> np.ndarray:
    """Ranks of arbitrary stretches, from two overlapping power-of-two ones."""
    length = stretches[:, 1] - stretches[:, 0]
    level = np.frexp(length.astype(np.float64))[1] - 1
    out = np.zeros(len(stretches), np.uint64)
    for k in np.unique(level):
        rows = np.flatnonzero(level == k)
        a, b = ranks[k][stretches[rows, 0]], ranks[k][stretches[rows, 1] - (1 << int(k))]
        out[rows] = mix64(a * _A + mix64(b + length[rows].astype(np.uint64) * _B))
    return out


def _suffixes(least: int):
    names = ["rank", "doc_id", "version", "start", "end"]

    def run(batches):
        for batch in batches:
            ids, versions = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            for a, b in text_batches(texts):
                lines, words, offsets = line_table(texts[a:b])
                doc, rank, span = [], [], []
                for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist()), a):
                    stretches = counting_stretches(words[lo:hi], least)
                    if len(stretches):
                        rank.append(stretch_ranks(doubled_ranks(lines[lo:hi]), stretches))
                        span.append(stretches)
                        doc.append(np.full(len(stretches), i))
                if not doc:
                    continue
                at, spans = np.concatenate(doc), np.concatenate(span)
                doc_ids = pa.array(np.where(nulls[at], 0, ids[at]).astype(np.int64), mask=nulls[at])
                columns = [
                    pa.array(np.concatenate(rank).astype(np.int64)),
                    doc_ids,
                    pa.array(versions[at]),
                    pa.array(spans[:, 0].astype(np.int32)),
                    pa.array(spans[:, 1].astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _delete(names: list[str]):
    def run(batches):
        for batch in batches:
            *kept, texts, spans = batch.columns
            out, lines_n, gone_n = [], [], []
            for text, cut in zip(texts.to_pylist(), spans.to_pylist()):
                lines = text.split("\n") if text is not None else []
                lines_n.append(len(lines) if text else 0)
                if cut:
                    gone = np.zeros(len(lines) + 1, np.int64)
                    for c in cut:
                        gone[c["start"]] += 1
                        gone[c["end"]] -= 1
                    gone = np.cumsum(gone)[:-1] > 0
                    gone_n.append(int(gone.sum()))
                    out.append("\n".join(x for x, g in zip(lines, gone.tolist()) if not g))
                else:
                    gone_n.append(0)
                    out.append(text)
            columns = [*kept, pa.array(out, pa.string()), pa.array(lines_n, pa.int64()), pa.array(gone_n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "text", "n_lines", "n_removed"])

    return run


def line_dedup(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the later copies of repeated line runs of ``min_words`` words or more
    cut from the text column, and the columns ``n_lines`` and ``n_removed``.

    Lines end at line feeds and are compared as they are; the first copy in order of
    ``(id, line)`` stays, a copy within the same text counts as later.  Null texts stay null
    and have no lines, empty ones stay empty.  Rows alike in id and text are one document and
    treated alike; rows without id come first.  Other columns are kept, save ``n_lines``,
    ``n_removed`` and names that start with ``__``, which are replaced.
    """
    version = F.xxhash64(F.col(text_col))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), version.alias("version"), F.col(text_col).alias("text"))
    suffixes = given.filter("text is not null").mapInArrow(
        lean(_suffixes(min_words)), "rank long, doc_id long, version long, start int, end int"
    )
    place = F.struct("doc_id", "version", "start")
    intervals = suffixes.groupBy("rank").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    later = suffixes.join(intervals.select("rank", "first"), "rank").filter(place != F.col("first"))
    cuts = later.groupBy(F.col("doc_id").alias("__id"), F.col("version").alias("__of")).agg(
        F.collect_set(F.struct("start", "end")).alias("__cuts")
    )
    kept = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed") and not c.startswith("__")]
    rows = docs.select(*kept, F.col(text_col).alias("__text"), version.alias("__version"))
    joined = rows.join(cuts, (F.col("__version") == F.col("__of")) & F.col(id_col).cast("long").eqNullSafe(F.col("__id")), "left")
    schema = docs.select(*kept).schema.add("text", "string").add("n_lines", "long").add("n_removed", "long")
    out = joined.select(*kept, "__text", "__cuts").mapInArrow(lean(_delete(kept)), schema)
    return out.withColumnRenamed("text", text_col) if text_col != "text" else out
