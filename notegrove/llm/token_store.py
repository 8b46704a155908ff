"""Token-id files: an adaptive context-mixing range coder in independent, checksummed blocks.

A block holds the ids of whole documents.  Its ids are cut into up to ``LANES`` runs of equal
length that are coded side by side, one id of each run a step, so numpy codes a step at
once; all lanes share one model, which starts anew with each block and learns from all ids
of a step after it.  Three predictions drive the coder:

* order 2: a table from a hash of the last two ids to the id that followed, with a
  confidence;
* order 1: the same from the last id;
* order 0: counts of the ids of the block so far.

The chance that order 2 is right, or else order 1, or else order 0 has to spell the id, is
learnt for each pair of confidences and mixes the three: the choice is coded with it, then,
if need be, the id with the order-0 counts.  The range coder is carry-less, with 64 bits of
state a lane and 16-bit words.

Layout of a block, little-endian: ``NGT1``, crc32 of the rest, then ids, documents, lanes,
vocabulary, bytes of the document table (u32 each), the table (zlib: ids, null flags, ids a
document), bytes of the lane lengths (u32), the lengths (zlib), and the words of each lane.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, table_path
from .tokens import encoder

MAGIC = b"NGT1"
#: Lanes at most, ids a lane as a rule, ids of a block unless one document has more, and
#: documents handled at once.
LANES, STEPS = 16384, 128
BLOCK = LANES * STEPS
TEXTS = 500
HASH_BITS = 20
CONFIDENT = 7
WEIGHT, REST = 24, 8
#: Order-0 counts are halved above MOST; the spelling's share is LEAST / 2 ** 16 at least, so
#: every id keeps an interval.
MOST, LEAST = 1 << 23, 512
_U = np.uint64
TOP, BOTTOM = _U(1 << 48), _U(1 << 40)


class _Model:
    """Predictions of the next id, shared by the lanes of a block.

    A guess and its confidence share one entry: ``8 * id + confidence``.  The order-0 counts
    follow the ids after ``REST`` steps at most.
    """

    def __init__(self, vocabulary: int):
        self.counts = np.ones(vocabulary, np.int32)
        self.first_order = np.full(vocabulary, -8, np.int32)
        self.second_order = np.full(1 << HASH_BITS, -8, np.int32)
        self.outcomes = np.ones((2 * (CONFIDENT + 1) ** 2, 3), np.int64)
        self.edges = np.zeros((len(self.outcomes), 4), np.int64)
        self.edges[:, 3] = 1 << 32
        self.cumulative = np.zeros(vocabulary + 1, np.int32)
        self.seen: list[np.ndarray] = []
        self.rest = 1
        self._count()

    def _count(self) -> None:
        if self.seen:
            ids = np.concatenate(self.seen)
            self.counts += np.bincount(ids, minlength=len(self.counts)).astype(np.int32) * np.int32(WEIGHT)
            self.seen = []
            if int(self.counts.sum(dtype=np.int64)) > MOST:
                self.counts = (self.counts + 1) >> 1
        np.cumsum(self.counts, out=self.cumulative[1:])
        self.total = int(self.cumulative[-1])

    def predict(self, last: np.ndarray, before: np.ndarray) -> None:
        """Prepare a step for lanes whose last two ids are given."""
        if len(self.seen) >= self.rest:
            self._count()
            self.rest = min(REST, 2 * self.rest)
        self.last = last
        mixed = before.astype(np.uint32) * np.uint32(0x9E3779B1) + last.astype(np.uint32) * np.uint32(0x85EBCA6B)
        self.slot = (mixed >> np.uint32(32 - HASH_BITS)).astype(np.int64)
        self.e1, self.e2 = self.first_order[last], self.second_order[self.slot]
        self.p1, self.p2 = self.e1 >> 3, self.e2 >> 3
        self.context = ((self.e2 & 7) << 4) + ((self.e1 & 7) << 1) + (self.p1 == self.p2)
        share = (self.outcomes << 16) // self.outcomes.sum(axis=1, keepdims=True)
        first = np.clip(share[:, 0], 1, (1 << 16) - LEAST - 1)
        self.edges[:, 1] = first << 16
        self.edges[:, 2] = np.clip(first + share[:, 1], first + 1, (1 << 16) - LEAST) << 16

    def choose(self, ids: np.ndarray) -> np.ndarray:
        """0 if order 2 has the id, else 1 if order 1 has it, else 2."""
        return (ids != self.p2) * (1 + (ids != self.p1))

    def bounds(self, ids: np.ndarray, choice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each id's interval, in parts of 2 ** 32."""
        flat, at = self.edges.reshape(-1), 4 * self.context + choice
        low = flat[at]
        size = flat[at + 1] - low
        spelt = np.flatnonzero(choice == 2)
        x, room = ids[spelt], size[spelt]
        start = room * self.cumulative[x] // self.total
        size[spelt] = room * self.cumulative[x + 1] // self.total - start
        low[spelt] += start
        return low, size

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Choice and id of the intervals that hold the values."""
        first, second = self.edges[:, 1][self.context], self.edges[:, 2][self.context]
        choice = (v >= first).astype(np.int64) + (v >= second)
        ids = np.where(choice == 0, self.p2, self.p1)
        spelt = np.flatnonzero(choice == 2)
        base = second[spelt]
        most = ((v[spelt] - base + 1) * self.total - 1) // ((1 << 32) - base)
        order = np.argsort(most)  # sorted places are found with fewer cache misses
        ids[spelt[order]] = np.searchsorted(self.cumulative, most[order].astype(np.int32), side="right") - 1
        return choice, ids

    def learn(self, ids: np.ndarray, choice: np.ndarray) -> None:
        self.outcomes += 4 * np.bincount(self.context * 3 + choice, minlength=self.outcomes.size).reshape(-1, 3)
        self.seen.append(ids)
        fresh = ids << 3
        for table, at, e, hit in ((self.first_order, self.last, self.e1, self.p1 == ids), (self.second_order, self.slot, self.e2, self.p2 == ids)):
            sure = e & 7
            kept = np.where(sure > 0, e - sure + (sure >> 1), fresh)
            table[at] = np.where(hit, e + (sure < CONFIDENT), kept)  # of lanes at one place, the last counts


def _spans(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids."""
    lanes = max(1, min(LANES, n // STEPS))
    return lanes, -(-n // lanes)


def _lengths(n: int, lanes: int, steps: int) -> np.ndarray:
    return np.clip(n - steps * np.arange(lanes), 0, steps)


def _settle(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Lanes whose top word is settled; intervals too small are cut so that it is."""
    same = (low ^ (low + span)) < TOP
    tight = np.flatnonzero(~same & (span < BOTTOM))
    if len(tight):
        span[tight] = (~low[tight] + _U(1)) & (BOTTOM - _U(1))
        same[tight] = True
    return np.flatnonzero(same)


def _shift(low: np.ndarray, span: np.ndarray, go: np.ndarray) -> np.ndarray:
    """Drop the top word of some lanes; those of them that have another one settled."""
    lo, sp = low[go] << _U(16), span[go] << _U(16)
    again = _settle(lo, sp)
    low[go], span[go] = lo, sp
    return go[again]


def encode_ids(ids: np.ndarray, vocabulary: int) -> tuple[int, bytes, bytes]:
    """``(lanes, lane lengths, words)`` of the coded ids."""
    n = len(ids)
    lanes, steps = _spans(n)
    lengths = _lengths(n, lanes, steps)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    low, span = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    model = _Model(vocabulary)
    out_lane, out_word = [], []

    def put(n: int, start: np.ndarray, size: np.ndarray) -> None:
        r = span[:n] >> _U(32)
        low[:n] += start.astype(_U) * r
        span[:n] = size.astype(_U) * r
        go = _settle(low[:n], span[:n])
        while len(go):
            out_lane.append(go)
            out_word.append((low[go] >> _U(48)).astype(np.uint16))
            go = _shift(low, span, go)

    before, last = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    for t in range(steps):
        active = int(np.searchsorted(-lengths, -t, side="left"))
        now = grid[t, :active]
        model.predict(last[:active], before[:active])
        choice = model.choose(now)
        put(active, *model.bounds(now, choice))
        model.learn(now, choice)
        before[:active], last[:active] = last[:active], now
    for k in (48, 32, 16, 0):
        out_lane.append(np.arange(lanes))
        out_word.append(((low >> _U(k)) & _U(0xFFFF)).astype(np.uint16))
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    words = word[np.argsort(lane, kind="stable")]
    return lanes, np.bincount(lane, minlength=lanes).astype("<u4").tobytes(), words.astype("<u2").tobytes()


def decode_ids(n: int, lanes: int, sizes: bytes, data: bytes, vocabulary: int) -> np.ndarray:
    """The inverse of :func:`encode_ids`."""
    steps = -(-n // lanes)
    lengths = _lengths(n, lanes, steps)
    stream = np.concatenate([np.frombuffer(data, "<u2").astype(_U), np.zeros(8, _U)])
    sizes = np.frombuffer(sizes, "<u4").astype(np.int64)
    at = np.cumsum(sizes) - sizes
    low, span, code = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U), np.zeros(lanes, _U)
    for _ in range(4):
        code = (code << _U(16)) | stream[at]
        at += 1
    model = _Model(vocabulary)

    def drop(n: int, start: np.ndarray, size: np.ndarray) -> None:
        r = span[:n] >> _U(32)
        low[:n] += start.astype(_U) * r
        span[:n] = size.astype(_U) * r
        go = _settle(low[:n], span[:n])
        while len(go):
            code[go] = (code[go] << _U(16)) | stream[at[go]]
            at[go] += 1
            go = _shift(low, span, go)

    grid = np.zeros((steps, lanes), np.int32)
    before, last = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    for t in range(steps):
        active = int(np.searchsorted(-lengths, -t, side="left"))
        model.predict(last[:active], before[:active])
        v = (code[:active] - low[:active]) // (span[:active] >> _U(32))
        choice, now = model.find(np.minimum(v, _U((1 << 32) - 1)).astype(np.int64))
        drop(active, *model.bounds(now, choice))
        grid[t, :active] = now
        model.learn(now, choice)
        before[:active], last[:active] = last[:active], now
    return grid.T.reshape(-1)[:n]


def write_block(doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray, vocabulary: int) -> bytes:
    """One block of whole documents, whose ids follow each other."""
    lanes, sizes, words = encode_ids(ids, vocabulary)
    table = np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes()
    table += np.array([i is None for i in doc_ids], "u1").tobytes()
    table = zlib.compress(table + lengths.astype("<u4").tobytes())
    sizes = zlib.compress(sizes)
    body = struct.pack("<5I", len(ids), len(doc_ids), lanes, vocabulary, len(table))
    body += table + struct.pack("<I", len(sizes)) + sizes + words
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def read_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, the ids of all documents and how many each has; raises ``ValueError``
    on a damaged block."""
    body = block[8:]
    if block[:4] != MAGIC or struct.unpack("<I", block[4:8])[0] != zlib.crc32(body):
        raise ValueError("damaged token block")
    n, docs, lanes, vocabulary, size = struct.unpack_from("<5I", body)
    table = zlib.decompress(body[20 : 20 + size])
    names = np.frombuffer(table, "<i8", docs).tolist()
    nulls = np.frombuffer(table, "u1", docs, 8 * docs)
    lengths = np.frombuffer(table, "<u4", docs, 9 * docs).astype(np.int64)
    at = 20 + size
    (size,) = struct.unpack_from("<I", body, at)
    ids = decode_ids(n, lanes, zlib.decompress(body[at + 4 : at + 4 + size]), body[at + 4 + size :], vocabulary)
    return [None if x else i for i, x in zip(names, nulls)], ids, lengths


def _write(tokenizer: str, end_id: int):
    names = ["part", "seq", "start", "n_tokens", "block"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        enc = encoder(tokenizer)
        vocabulary = max(enc.vocabulary, end_id + 1)
        part = seq = start = size = 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def flush():
            nonlocal seq, start, size
            block = write_block(docs, np.concatenate(held), np.concatenate(lengths), vocabulary)
            row = [part, seq, start, size, block]
            seq, start, size = seq + 1, start + size, 0
            docs.clear(), held.clear(), lengths.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

        for batch in batches:
            if len(batch):
                part = batch.column(2)[0].as_py()
            for a in range(0, len(batch), TEXTS):
                given = batch.slice(a, TEXTS)
                names_, (ids, ends) = given.column(0).to_pylist(), enc.encode(given.column(1).to_pylist(), end_id)
                at = 0
                while at < len(ends):  # as many documents as the block has room for, one at least
                    base = int(ends[at - 1]) if at else 0
                    fit = int(np.searchsorted(ends, base + BLOCK - size, side="right"))
                    if fit <= at and docs:
                        yield flush()
                        continue
                    fit = max(fit, at + 1)
                    docs += names_[at:fit]
                    held.append(ids[base : ends[fit - 1]])
                    lengths.append(np.diff(ends[at:fit], prepend=base))
                    size += int(ends[fit - 1]) - base
                    at = fit
        if docs:
            yield flush()

    return run


def _read(batches):
    names = ["doc_id", "start", "n_tokens", "ids"]
    for batch in batches:
        for block, start in zip(batch.column(0), batch.column(1).to_pylist()):
            docs, ids, lengths = read_block(block.as_py())
            ends = np.cumsum(lengths)
            for a in range(0, len(docs), TEXTS):
                n = lengths[a : a + TEXTS]
                first = int(ends[a] - n[0])
                data = pa.py_buffer(ids[first : first + int(n.sum())].astype("<u4").tobytes())
                offsets = pa.py_buffer(4 * np.append(0, np.cumsum(n)).astype("<i8"))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs[a : a + TEXTS], pa.int64()),
                        pa.array(start + ends[a : a + TEXTS] - n),
                        pa.array(n),
                        pa.Array.from_buffers(pa.large_binary(), len(n), [None, offsets, data]).cast(pa.binary()),
                    ],
                    names=names,
                )


def write_tokens(
    docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write the ids of all texts, each with the end id, to ``path`` in ascending id order.

    The folder is a Parquet table with one block a row (``part, seq, start, n_tokens,
    block``), so it can lie in any store Spark writes to.  Null and empty texts are the end
    id alone; rows without id come first; rows of equal id are in the order of their texts.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = given.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.withColumn("part", F.spark_partition_id())
    schema = "part int, seq long, start long, n_tokens long, block binary"
    ordered.mapInArrow(lean(_write(tokenizer, end_id)), schema).write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the files: ``start`` counts the ids of all
    documents before, ``ids`` are unsigned little-endian 32-bit integers."""
    blocks = spark.read.schema("part int, seq long, start long, n_tokens long, block binary").parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row a file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(bases), "part").select("block", (F.col("start") + F.col("base")).alias("start"))
    return placed.mapInArrow(lean(_read), "doc_id long, start long, n_tokens long, ids binary")


def tokens_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` to the shared folder and read the files back."""
    path = table_path(docs.sparkSession, "token-files")
    write_tokens(docs, tokenizer, path, end_id)
    return read_tokens(docs.sparkSession, path)
