"""Shared plumbing: tables in the cluster's shared folder, and vectorised word hashing."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MASK64 = (1 << 64) - 1
#: White space that separates words: blank and the controls 9 to 13.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes hashed at once; keeps the temporaries of a Python worker near 12 MB, and in its caches.
SEGMENT = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    It is ``spark.checkpoint.dir``.  Only a local session may lack it; then a temporary
    folder is made, because there the driver and the executors are one process.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="notegrove-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`materialize`."""
    spark = df.sparkSession
    root = shared_dir(spark)
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        if folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Return the freed memory of this Python worker to the system; Spark keeps idle workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean(run):
    """Make a function over a task's batches give its memory back when the task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the SplitMix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The value of each byte in a word's hash: 0 for separators, A-Z as a-z.
VALUE = np.where(SEPARATOR, 0, LOWER.astype(np.uint64) + np.uint64(1)).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** k`` modulo 2 ** 64 for k below n at least."""
    if len(_POWERS.get(base, ())) < n:
        p = np.full(max(n, SEGMENT), base, dtype=np.uint64)
        p[0] = 1
        _POWERS[base] = np.multiply.accumulate(p)
    return _POWERS[base]


def _segments(separator: np.ndarray, n: int):
    at = 0
    while at < n:
        end = min(at + SEGMENT, n)
        if end < n:
            cut = np.flatnonzero(separator[at:end])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:  # one word longer than a segment stays whole
                rest = np.flatnonzero(separator[end:])
                end = end + int(rest[0]) + 1 if len(rest) else n
        yield at, end
        at = end


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array in which a blank ends each text, and where each text starts."""
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return buf, offsets


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lowered) of the texts, and each text's word offsets.

    A word's hash is a polynomial in its bytes: bytes are weighed by powers of their place in
    the segment, and a word's sum is brought to its start by the inverse power.
    """
    buf, offsets = join_texts(texts)
    separator = SEPARATOR[buf]
    hashes, starts_all = [], []
    for a, b in _segments(separator, len(buf)):
        word = ~separator[a:b]
        first = word.copy()
        first[1:] &= separator[a : b - 1]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        values = VALUE[buf[a:b]]
        values *= _powers(_BASE, b - a)[: b - a]
        sums = np.add.reduceat(values, starts)
        hashes.append(mix64(sums * _powers(pow(_BASE, -1, 1 << 64), b - a)[starts]))
        starts_all.append(starts + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    starts = np.concatenate(starts_all)
    return np.concatenate(hashes), np.searchsorted(starts, offsets)


def text_batches(texts: list, limit: int = SEGMENT):
    """Index ranges of ``texts`` (bytes or None) holding about ``limit`` bytes each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def binary_texts(column) -> list[bytes]:
    """A string column of an Arrow batch as bytes; nulls become empty."""
    import pyarrow.compute as pc

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.fill_null(column.cast(kind), b"").to_pylist()
