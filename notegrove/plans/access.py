"""Trigram postings as an access path.

Postings narrow the documents before their texts are read; the predicates decide.  Whether
a query uses them is chosen when its plan is built: a semi-join on the ids that hold all
grams of a variant.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fold import solid_grams
from .query import Query, Term

#: Characters whose grams are sorted at once; longer documents are taken in parts.
SPAN = 1 << 20
#: Bits that hold any code point.
WIDE = 21


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _keys(signs: np.ndarray, bits: int) -> np.ndarray:
    """The gram that begins at each place, its signs side by side in a number."""
    x = signs.astype(np.int64)
    return (x[:-2] << (2 * bits)) | (x[1:-1] << bits) | x[2:]


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _of_one(fields: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of one document, of any length."""
    held = np.zeros(0, np.int64)
    for text in fields:
        for at in range(0, max(0, len(text) - 2), SPAN):
            held = _distinct(np.concatenate([held, _keys(_codes(text[at : at + SPAN + 2]), WIDE)]))
    return np.zeros(len(held), np.int64), held


def _of_many(docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of some documents and the number of each one's document."""
    fields = [text for doc in docs for text in doc]
    lengths = np.array([len(text) for text in fields])
    signs = _codes("".join(fields))
    used = np.zeros(0x110000, np.bool_)
    used[signs] = True
    alphabet = np.flatnonzero(used)
    bits = max(1, (len(alphabet) - 1).bit_length())
    if len(docs) == 1 or 3 * bits + len(docs).bit_length() > 63:  # too many signs for one number
        each = [_of_one(doc) for doc in docs]
        return np.repeat(np.arange(len(docs)), [len(k) for _, k in each]), np.concatenate([k for _, k in each])
    place = np.zeros(0x110000, np.int32)
    place[alphabet] = np.arange(len(alphabet))
    keys = _keys(place.take(signs), bits)
    field = np.repeat(np.arange(len(fields)), lengths)
    number = np.repeat(np.arange(len(docs)), [len(doc) for doc in docs])
    inside = field[2:] == field[:-2]
    keys = _distinct((keys | (number.take(field[:-2]) << (3 * bits)))[inside])
    low = (1 << bits) - 1
    wide = alphabet.take((keys >> (2 * bits)) & low) << (2 * WIDE) | alphabet.take((keys >> bits) & low) << WIDE | alphabet.take(keys & low)
    return keys >> (3 * bits), wide


def _spelt(keys: np.ndarray) -> pa.Array:
    """The grams as strings; each distinct one is spelt once."""
    coded = pa.array(keys).dictionary_encode()
    kinds = coded.dictionary.to_numpy()
    signs = np.stack([kinds >> (2 * WIDE), kinds >> WIDE, kinds], axis=1) & ((1 << WIDE) - 1)
    joined = signs.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    names = [joined[i : i + 3] for i in range(0, len(joined), 3)]
    return pa.DictionaryArray.from_arrays(coded.indices, pa.array(names, pa.string())).dictionary_decode()


def _post(batches):
    for batch in batches:
        ids = batch.column(0)
        columns = [c.cast(pa.binary()).to_pylist() for c in batch.columns[1:]]
        docs, size, first = [], 0, 0
        for i, row in enumerate(zip(*columns)):
            docs.append([x.decode("utf-8", "replace") for x in row if x])
            size += sum(map(len, docs[-1]))
            if size >= SPAN or i + 1 == len(ids):
                number, keys = _of_many(docs) if size else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                for a in range(0, len(keys), SPAN):
                    holder = ids.take(pa.array(first + number[a : a + SPAN]))
                    yield pa.RecordBatch.from_arrays([_spelt(keys[a : a + SPAN]), holder], names=["gram", "id"])
                docs, size, first = [], 0, i + 1


def postings(docs: DataFrame) -> DataFrame:
    """``(gram, id)``, distinct, over text, title and path of each document.

    One Arrow pass: grams are numbers that are sorted with their document's, many documents
    at a time, so a character costs a few steps of numpy and each distinct gram a string.
    """
    return docs.select("id", "text", "title_norm", "path_norm").mapInArrow(_post, "gram string, id long")


def write_postings(docs: DataFrame, path: str, prefixes: int = 64) -> None:
    """Postings sorted by gram, in folders by a hash of the gram, so a query reads few files."""
    out = postings(docs).withColumn("bucket", F.pmod(F.hash("gram"), F.lit(prefixes)))
    out.repartition("bucket").sortWithinPartitions("gram", "id").write.partitionBy("bucket").parquet(path)


def gram_frequency(grams: DataFrame) -> DataFrame:
    return grams.groupBy("gram").agg(F.count("*").alias("n_docs"))


def fuzzy_floor(n_grams: int, distance: int) -> int:
    """Grams that a document within so many edits of a term still shares with it."""
    return n_grams - 3 * max(0, distance)


def term_needs(term: Term, fuzzy_distance: int | None = None) -> list[tuple[list[str], int]] | None:
    """Grams of each variant of a term, and how many of them a document that may match holds;
    None if every document may."""
    if term.field in ("property", "tag") or term.short:
        return None
    out = []
    for v in term.variants:
        wanted = solid_grams(v)
        floor = len(wanted) if fuzzy_distance is None or not term.fuzzy else fuzzy_floor(len(wanted), fuzzy_distance)
        if not wanted or floor <= 0:
            return None
        out.append((wanted, floor))
    return out


def narrow(docs: DataFrame, grams: DataFrame, query: Query, distance=None) -> DataFrame:
    """``docs`` that may match, by a semi-join against postings, which are read once.

    ``distance`` gives a term's fuzzy distance, or is None for literal search.
    """
    groups = []
    for group in [(t,) for t in query.must] + list(query.should):
        found = [term_needs(t, distance(t) if distance else None) for t in group]
        if all(f is not None for f in found):
            groups.append([need for f in found for need in f])
    if not groups:
        return docs
    asked = sorted({g for group in groups for wanted, _ in group for g in wanted})
    held = grams.filter(F.col("gram").isin(*asked)).groupBy("id").agg(F.collect_set("gram").alias("held"))

    def holds(wanted: list[str], floor: int):
        return F.size(F.array_intersect("held", F.array(*map(F.lit, wanted)))) >= floor

    tests = [reduce(or_, [holds(*need) for need in group], F.lit(False)) for group in groups]
    return docs.join(held.filter(reduce(and_, tests)).select("id"), "id", "left_semi")
