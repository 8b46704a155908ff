"""Edit distance with transpositions of neighbours (optimal string alignment)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def osa(a: str, b: str) -> int:
    """Optimal string alignment: no stretch is edited twice, so ca to abc takes 3."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def within(word: str, term: str, most: int) -> bool:
    return bool(word) and abs(len(word) - len(term)) <= most and osa(word, term) <= most


def within_native(word: Column, term: str, most: int) -> Column:
    """The same test in plain column expressions, for words inside arrays.

    Besides plain edits, an alignment may transpose neighbours; what lies before the first
    transposition takes plain edits only, what lies behind it any.
    """

    def aligned(w: Column, t: str, k: int) -> Column:
        near = F.levenshtein(w, F.lit(t), k) >= 0
        for i in range(len(t) - 1 if k else 0):
            front, pair, rest = t[:i], t[i + 1] + t[i], t[i + 2 :]
            if pair[0] == pair[1]:
                continue
            for a in range(k):  # edits in front
                for d in range(max(-a, -i), a + 1):  # how much longer the front is in the word
                    at = i + d
                    here = F.substring(w, at + 1, 2) == pair
                    before = F.substring(w, 1, at) if at else F.lit("")
                    behind = F.substring(w, at + 3, 1 << 30)
                    here &= (before == front) if a == 0 else F.levenshtein(before, F.lit(front), a) >= 0
                    near |= here & (aligned(behind, rest, k - 1 - a) if k - 1 - a else behind == rest)
        return near

    return (word != "") & (F.abs(F.length(word) - len(term)) <= most) & aligned(word, term, most)


def within_column(word: Column, term: str, most: int) -> Column:
    """Whether a word is within ``most`` edits of ``term``.

    A transposition is at most two plain edits, so the JVM's bounded distance drops all but
    a few words before the exact test sees them in Arrow batches.
    """

    @F.pandas_udf("boolean")
    def exact(s: pd.Series) -> pd.Series:
        return s.map(lambda w: within(w, term, most)).astype(bool)

    near = (F.abs(F.length(word) - len(term)) <= most) & (F.levenshtein(word, F.lit(term), 2 * most) >= 0)
    plain = F.levenshtein(word, F.lit(term), most) >= 0
    return near & (plain | F.coalesce(exact(F.when(near & ~plain, word).otherwise(F.lit(""))), F.lit(False)))
