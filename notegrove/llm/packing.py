"""Packing documents into sequences: first-fit decreasing in randomised groups.

A document's ids, with an end id, are cut at multiples of the sequence length.  Full pieces
are sequences already and go no further.  The last, shorter pieces are dealt at random to
groups of about ``GROUP`` and packed there by first-fit decreasing; a tournament tree over the
room left in the bins finds the first bin that fits in logarithmic time.  A group's last
bins have room left: of those with more than ``SLACK`` of it, the pieces are laid end to end
and cut at the sequence length instead, and the final rest is cut at powers of two, which
are sequence lengths without padding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize
from .tokens import encoder

GROUP = 4096
#: Texts encoded at once, and the first number of the sequences that are one full piece.
TEXTS, FULL = 500, 1 << 62
SLACK = 1 / 128
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class BinTree:
    """Room left in each bin, under a tree of maxima."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.size)

    def take(self, need: int) -> int:
        """The first bin with room for ``need``, which it then loses."""
        tree, at = self.tree, 1
        while at < self.size:
            at *= 2
            if tree[at] < need:
                at += 1
        tree[at] -= need
        leaf = at
        at //= 2
        while at:
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
            at //= 2
        return leaf - self.size


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece; pieces are taken from the longest down, ties in given order."""
    bins = np.zeros(len(lengths), np.int64)
    tree = BinTree(max(1, len(lengths)), capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i] = tree.take(int(lengths[i]))
    return bins


def refill(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``(piece, start, length, bin, offset)``: the packing with loose bins laid end to end."""
    order = np.lexsort((np.arange(len(bins)), bins))
    used = np.bincount(bins, lengths, int(bins.max(initial=-1)) + 1).astype(np.int64)
    loose = (capacity - used > SLACK * capacity) & (used & (used - 1) != 0)
    out, filled = [], {}
    rest = []
    for i in order.tolist():
        b, n = int(bins[i]), int(lengths[i])
        if loose[b]:
            rest.append((i, n))
            continue
        out.append((i, 0, n, b, filled.get(b, 0)))
        filled[b] = filled.get(b, 0) + n
    # the loose pieces in one line, cut into full sequences and then powers of two
    total = sum(n for _, n in rest)
    sizes = [capacity] * (total // capacity) + [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> k & 1]
    bin_, room, at = len(used), sizes[0] if sizes else 0, 0
    for i, n in rest:
        start = 0
        while start < n:
            if at == room:
                bin_, at = bin_ + 1, 0
                room = sizes[bin_ - len(used)]
            part = min(n - start, room - at)
            out.append((i, start, part, bin_, at))
            start, at = start + part, at + part
    return out


def _pieces(tokenizer: str, end_id: int, capacity: int, dtype: str, names: list[str]):
    width = np.dtype(dtype).itemsize

    def run(batches):
        encode, full = encoder(tokenizer).encode, FULL + (TaskContext.get().partitionId() << 36)
        for batch in batches:
            for a in range(0, len(batch), TEXTS):
                part = batch.slice(a, TEXTS)
                ids, ends = encode(part.column(1).to_pylist(), end_id)
                tokens = np.diff(ends, prepend=0)
                pieces = -(-tokens // capacity)
                doc = np.repeat(np.arange(len(part)), pieces)
                start = capacity * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                length = np.minimum(tokens[doc] - start, capacity)
                whole = length == capacity
                offsets = width * np.append(0, np.cumsum(length))
                number = full + np.cumsum(whole) - 1
                full += int(whole.sum())
                data = pa.py_buffer(ids.astype(dtype).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(doc)),
                        pa.array(start),
                        pa.array(tokens[doc]),
                        part.column(2).take(pa.array(doc)),
                        pa.array(number, mask=~whole),
                        pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(offsets.astype("<i8").tobytes()), data]).cast(pa.binary()),
                    ],
                    names=names,
                )

    return run


def _pack(capacity: int, dtype: str):
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        rows = table.drop_columns(["ids"]).to_pydict()
        pieces = [np.frombuffer(d, dtype) for d in table.column("ids").to_pylist()]
        lengths = np.array([len(x) for x in pieces], np.int64)
        order = np.lexsort((rows["start"], [i or 0 for i in rows["doc_id"]], rows["draw"]))
        bins = first_fit_decreasing(lengths[order], capacity)
        base = rows["grp"][0] << 32
        out = []
        for k, start, n, b, offset in refill(lengths[order], bins, capacity):
            i = int(order[k])
            ids = pieces[i][start : start + n].tobytes()
            out.append((rows["doc_id"][i], rows["start"][i] + start, n, rows["doc_tokens"][i], base + b, offset, ids))
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return run


def _wide(dtype: str):
    """The ids of a batch's last column as unsigned little-endian 32-bit integers."""

    def run(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1).to_pylist()
            ids = [np.frombuffer(d, dtype).astype("<u4").tobytes() for d in column]
            yield batch.set_column(batch.num_columns - 1, "ids", pa.array(ids, pa.binary()))

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, seed: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of packed sequences; ``SCHEMA`` names the columns, ``ids`` being unsigned
    little-endian 32-bit ids and ``start`` the ids of the document before the piece.

    Null and empty texts are the end id alone.  Each id of each row lies in exactly one
    piece; repeated rows are packed as often as they come, and a null doc_id stays null.
    A sequence is padded to ``capacity`` unless its length is a power of two.  Other columns
    are ignored; an empty table gives no pieces.

    The pieces are written to the shared folder once encoded; only those shorter than a
    sequence are shuffled, and a group of them is bounded by ``GROUP`` sequences on average.
    """
    dtype = "<u2" if max(encoder(tokenizer).vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)), 1)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), draw.alias("draw"))
    schema = "doc_id long, start long, doc_tokens long, draw long, sequence_id long, ids binary"
    pieces = given.mapInArrow(lean(_pieces(tokenizer, end_id, capacity, dtype, [c.split()[0] for c in schema.split(", ")])), schema)
    pieces = materialize(pieces, "pack-pieces")
    short = pieces.filter("sequence_id is null").drop("sequence_id")
    groups = short.count() // GROUP + 1
    packed = short.withColumn("grp", F.pmod("draw", F.lit(groups))).groupBy("grp").applyInArrow(_pack(capacity, dtype), SCHEMA)
    full = pieces.filter("sequence_id is not null").select(
        "doc_id", "start", F.lit(capacity).cast("long").alias("length"), "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), "ids"
    )
    both = full.union(packed)
    return both if dtype == "<u4" else both.mapInArrow(lean(_wide(dtype)), SCHEMA)
