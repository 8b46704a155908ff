"""Scores, relevance and order of hits."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FIELDS, Weights
from ..plans.query import Query
from .matches import MATCHES, let

DAY = 86_400_000


def occurrence_factor(n: Column) -> Column:
    """Damped count: 0, 1, and towards 2.2 for many."""
    log = F.log(F.greatest(n, F.lit(1)).cast("double"))
    return F.when(n <= 0, 0.0).otherwise(1 + 1.2 * (log / (log + 4)))


def _weights(w: Weights) -> Column:
    return F.array(*(F.struct(F.lit(f).alias("field"), F.lit(float(w.field[f])).alias("weight")) for f in FIELDS))


def _count(matches: Column, where) -> Column:
    return F.size(F.filter(matches, lambda m: m["field"] == where))


def base(matches: Column, w: Weights) -> Column:
    return F.aggregate(_weights(w), F.lit(0.0), lambda acc, f: acc + f["weight"] * occurrence_factor(_count(matches, f["field"])))


def frequency_factor(matches: Column, w: Weights) -> Column:
    """How much repetition adds to the base; for explanation only."""
    single = F.aggregate(_weights(w), F.lit(0.0), lambda acc, f: acc + F.when(_count(matches, f["field"]) > 0, f["weight"]).otherwise(0.0))
    return F.when(single > 0, base(matches, w) / single).otherwise(1.0)


def whole_word_factor(matches: Column, w: Weights) -> Column:
    """The bonus for whole words, weighted by the fields of the matches; by counts, so that
    matches in another order score the same to the last bit."""
    counts = F.transform(
        _weights(w),
        lambda f: F.struct(
            f["weight"].alias("weight"),
            _count(matches, f["field"]).alias("n"),
            F.size(F.filter(matches, lambda m: (m["field"] == f["field"]) & m["whole_word"])).alias("whole"),
        ),
    )
    start = F.struct(F.lit(0.0).alias("bonus"), F.lit(0.0).alias("plain"))

    def add(acc: Column, f: Column) -> Column:
        bonus = f["weight"] * ((f["n"] - f["whole"]) + w.whole_word * f["whole"])
        return F.struct((acc["bonus"] + bonus).alias("bonus"), (acc["plain"] + f["weight"] * f["n"]).alias("plain"))

    return F.aggregate(counts, start, add, lambda acc: F.when(acc["plain"] > 0, acc["bonus"] / acc["plain"]).otherwise(1.0))


def covering_width(matches: Column, terms: int) -> Column:
    """Width of the narrowest stretch that has a match of each of the distinct terms.

    ``terms`` is the number of terms of the query.  The fold keeps, for each term, the last
    match seen; a stretch begins at the earliest of those, and counts when that moves on.
    """
    return let(F.sort_array(F.transform(matches, _place)), lambda m: _narrowest(m, terms))


def _place(m: Column) -> Column:
    return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["term_index"].alias("term_index"))


def _narrowest(ordered: Column, terms: int) -> Column:
    far = 1 << 30
    absent = F.transform(
        F.sequence(F.lit(0), F.lit(terms - 1)),
        lambda t: F.when(F.exists(ordered, lambda m: m["term_index"] == t), F.lit(-1)).otherwise(F.lit(far)),
    )
    start = F.struct(absent.alias("last"), F.lit(-1).alias("left"), F.lit(None).cast("int").alias("best"), F.lit(0).alias("i"))

    def step(acc: Column, m: Column) -> Column:
        last = F.transform(acc["last"], lambda v, t: F.when(t == m["term_index"], acc["i"]).otherwise(v))
        left = F.array_min(last)
        better = (left >= 0) & (left > acc["left"])
        width = F.greatest(F.lit(0), m["end"] - F.get(ordered, left)["start"])
        return F.struct(
            last.alias("last"),
            F.when(better, left).otherwise(acc["left"]).alias("left"),
            F.when(better, F.least(acc["best"], width)).otherwise(acc["best"]).alias("best"),
            (acc["i"] + 1).alias("i"),
        )

    return F.aggregate(ordered, start, step, lambda acc: acc["best"])


def proximity_factor(matches: Column, query: Query, w: Weights) -> Column:
    """Up to the bonus where the matched terms stand together in text, title or path."""
    terms = len(query.terms)
    if terms < 2 or w.proximity_window <= 0:
        return F.lit(1.0)
    distinct = F.size(F.array_distinct(F.transform(matches, lambda m: m["term_index"])))

    def width(domain: Column) -> Column:
        part = F.filter(matches, lambda m: F.when(m["field"].isin("title", "path"), m["field"]).otherwise("file") == domain)

        def measure(held: Column) -> Column:
            n = F.size(F.array_distinct(F.transform(held, lambda m: m["term_index"])))
            return F.when(n == distinct, covering_width(held, terms))

        return let(part, measure)

    best = F.array_min(F.transform(F.array(*map(F.lit, ("file", "title", "path"))), width))
    close = F.greatest(F.lit(0.0), 1 - best / F.lit(float(w.proximity_window)))
    return F.when((distinct < 2) | best.isNull(), 1.0).otherwise(1 + (w.proximity - 1) * close)


def recency_factor(modified: Column, now: int, w: Weights) -> Column:
    if w.recency_days <= 0:
        return F.lit(1.0)
    age = F.greatest(F.lit(0.0), (F.lit(now) - modified) / F.lit(float(DAY)))
    return 1 + F.lit(w.recency - 1) * F.greatest(F.lit(0.0), 1 - age / F.lit(float(w.recency_days)))


def quality_factor(quality: Column, w: Weights) -> Column:
    return F.when(quality == 2, w.fuzzy).when(quality == 1, w.alias).otherwise(1.0)


def _factors(query: Query, now: int, w: Weights) -> dict[str, Column]:
    m = F.col("matches").cast(MATCHES)
    return {
        "base": base(m, w),
        "whole_word": whole_word_factor(m, w),
        "proximity": proximity_factor(m, query, w),
        "recency": recency_factor(F.col("modified_at"), now, w),
        "quality": quality_factor(F.col("quality"), w),
    }


def score(query: Query, now: int, w: Weights = Weights()) -> Column:
    """The product of a hit's factors, over ``matches``, ``quality`` and ``modified_at``."""
    return reduce(mul, _factors(query, now, w).values())


def breakdown(query: Query, now: int, w: Weights = Weights()) -> Column:
    """A hit's factors one by one, with each field's part of the base and the total."""
    m = F.col("matches").cast(MATCHES)
    parts = _factors(query, now, w) | {"frequency": frequency_factor(m, w), "total": score(query, now, w)}
    fields = F.struct(*((F.lit(w.field[f]) * occurrence_factor(_count(m, f))).alias(f) for f in FIELDS))
    return F.struct(*(v.alias(k) for k, v in parts.items()), fields.alias("fields"))


def with_scores(hits: DataFrame, query: Query, now: int, w: Weights = Weights()) -> DataFrame:
    """``hits`` with ``score``; 0 where the query has no positive term."""
    return hits.withColumn("score", score(query, now, w) if query.terms else F.lit(0.0))


def with_relevance(hits: DataFrame) -> DataFrame:
    """Percent of the best score of all hits, before any limit."""
    best = hits.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("best")).scalar()
    share = F.least(F.lit(100), F.greatest(F.lit(0), F.round(F.col("score") / F.col("__best") * 100).cast("int")))
    return hits.withColumn("__best", best).withColumn("relevance", F.when(F.col("__best") > 0, share).otherwise(0)).drop("__best")


def natural(c: Column) -> Column:
    """A key that sorts names without case and accents and digits by their value."""
    padded = F.regexp_replace(F.regexp_replace(c, r"(\d+)", "0" * 20 + "$1"), r"\d*(\d{20})", "$1")
    return F.collate(padded, "UNICODE_CI_AI")


def effective_sort(sort: str, query: Query) -> str:
    return "created-desc" if sort == "relevance" and not query.terms else sort


def sort_keys(sort: str, by_name: bool = True) -> list[Column]:
    """A total order: the asked key, then the path by name, by code point, and the id; without
    ``by_name`` ties go by code point at once."""
    finite = F.when(F.isnan("score") | (F.abs("score") == float("inf")), 0.0).otherwise(F.col("score")) if sort == "relevance" else None
    first = {
        "relevance": lambda: [F.asc("quality"), finite.desc()],
        "created-desc": lambda: [F.desc("created_at")],
        "created-asc": lambda: [F.asc("created_at")],
        "modified-desc": lambda: [F.desc("modified_at")],
        "modified-asc": lambda: [F.asc("modified_at")],
        "title-asc": lambda: [natural(F.col("title")).asc()],
        "path-asc": lambda: [],
    }[sort]()
    return [*first, *([natural(F.col("path")).asc()] if by_name else []), F.asc("path"), F.asc("id")]
