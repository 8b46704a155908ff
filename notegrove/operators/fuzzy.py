"""Typo tolerance: words within one or two edits of a term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Tuning
from ..functions.distance import within_column, within_native
from ..functions.fold import words_column
from ..plans.query import Query, Term
from .matches import _run_is_tag, field_at, original, word_matches

#: Words of the vocabulary that go into a plan as literals, at most.
LITERALS = 5000


def distance(term: Term, tuning: Tuning = Tuning()) -> int:
    return tuning.fuzzy_short if len(term.normalized) <= tuning.fuzzy_short_term else tuning.fuzzy_long


def vocabulary(docs: DataFrame) -> DataFrame:
    """Distinct words of texts, titles and paths, and the tags."""
    held = F.concat("words", words_column(F.col("title_norm")), words_column(F.col("path_norm")), "tags")
    return docs.select(F.explode(held).alias("word")).distinct()


def near_words(vocab: DataFrame, term: str, most: int) -> DataFrame:
    """Words of the vocabulary within so many edits; each word is tested once, not once a
    document."""
    return vocab.filter(within_column(F.col("word"), term, most)).select("word")


class FuzzyPlan:
    """The near words of a query's terms, found over the vocabulary before the search.

    The words within two edits of one term are few; a term with more than ``LITERALS`` of
    them is tested document by document instead.
    """

    def __init__(self, vocab: DataFrame, query: Query, tuning: Tuning = Tuning()):
        self.tuning = tuning
        self.words: dict[str, list[str] | None] = {}
        for t in query.terms:
            if t.fuzzy and t.normalized not in self.words:
                found = near_words(vocab, t.normalized, distance(t, tuning)).limit(LITERALS + 1).collect()
                self.words[t.normalized] = sorted(r[0] for r in found) if len(found) <= LITERALS else None

    def near(self, words: Column, term: Term) -> Column:
        """Those of an array of words that are near the term, in their order."""
        known = self.words[term.normalized]
        if known is None:
            most = distance(term, self.tuning)
            return F.filter(words, lambda w: within_native(w, term.normalized, most))
        if not known:
            return F.array().cast("array<string>")
        return F.filter(words, lambda w: w.isin(*known))

    def predicate(self, term: Term) -> Column:
        """Whether a document has a near word where the term looks."""
        if not term.fuzzy:
            return F.lit(False)
        if term.field == "tag":
            return F.size(self.near(F.col("tags"), term)) > 0
        if term.field in ("title", "path"):
            return F.size(self.near(words_column(F.col(f"{term.field}_norm")), term)) > 0
        return (F.size(self.near(F.col("words"), term)) > 0) | (F.size(self.near(words_column(F.col("title_norm")), term)) > 0)

    def matches(self, term: Term, index: int) -> Column:
        """Fuzzy matches; in any field those of the text, else those of the title."""
        most = self.tuning.max_matches

        def name(where: str) -> Column:
            text = F.col(f"{where}_norm")
            return word_matches(text, self.near(words_column(text), term), index, most, lambda a, b: (a, b, F.lit(where)))

        if term.field in ("title", "path"):
            return name(term.field)
        text = F.col("text")
        if term.field == "tag":
            # the span is checked against the tags by its own run of tag characters
            found = word_matches(text, self.near(F.col("tags"), term), index, most, lambda a, b: (a, b, F.when(_run_is_tag(text, a, b), "tag").otherwise("")))
            kept = F.filter(found, lambda m: m["field"] == "tag")

            def moved(m: Column) -> Column:
                a, b = original(m["start"], m["end"])
                return m.withField("start", a.cast("int")).withField("end", b.cast("int"))

            return F.transform(kept, moved)
        body = word_matches(text, self.near(F.col("words"), term), index, most, lambda a, b: (*original(a, b), field_at(a)))
        return F.when(F.size(body) > 0, body).otherwise(name("title"))


__all__ = ["FuzzyPlan", "distance", "near_words", "vocabulary"]
