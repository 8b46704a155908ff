"""Search over a ``docs`` table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import QUALITIES, Settings, Tuning
from .operators import matches as M
from .operators import ranking as R
from .operators.fuzzy import FuzzyPlan, distance, vocabulary
from .operators.snippets import with_snippets
from .plans import access
from .plans.predicates import Filters, exclusions, filter_predicate, query_predicate
from .plans.query import Query, parse
from .sources.ingest import DOCS

HIT = ["id", "path", "title", "folder", "created_at", "modified_at"]


class SearchEngine:
    """Queries over ``docs``.

    ``postings`` and ``vocabulary`` are optional tables made at ingest: with postings texts
    are read for candidates only, with a vocabulary fuzzy search need not derive one.
    """

    def __init__(self, docs: DataFrame, postings: DataFrame | None = None, vocabulary: DataFrame | None = None,
                 settings: Settings = Settings(), tuning: Tuning = Tuning()):
        self.docs, self.postings, self.words = docs, postings, vocabulary
        self.settings, self.tuning = settings, tuning
        self._kept: DataFrame | None = None

    def parse(self, text: str) -> Query:
        return parse(text, self.tuning)

    def _fuzzy(self, query: Query, fuzzy: bool) -> FuzzyPlan | None:
        if not fuzzy or not any(t.fuzzy for t in query.terms):
            return None
        return FuzzyPlan(self.words if self.words is not None else vocabulary(self.docs), query, self.tuning)

    def candidates(self, query: Query, filters: Filters = Filters(), fuzzy: bool = False) -> DataFrame:
        """Documents that pass the filters and, as far as postings tell, may match."""
        docs = self.docs.filter(filter_predicate(filters))
        if self.postings is None:
            return docs
        return access.narrow(docs, self.postings, query, (lambda t: distance(t, self.tuning)) if fuzzy else None)

    def matching(self, query: str | Query, filters: Filters = Filters(), fuzzy: bool = False) -> DataFrame:
        """Rows of ``docs`` that match; with filters alone, those that pass and are not
        excluded; none if nothing is asked."""
        query = self.parse(query) if isinstance(query, str) else query
        if query.is_empty:
            rows = self.docs.filter(filter_predicate(filters))
            return rows.filter(exclusions(query)) if filters.active else rows.filter(F.lit(False))
        plan = self._fuzzy(query, fuzzy)
        # without fuzzy words a literal test decides; with them either does
        return self.candidates(query, filters, fuzzy).filter(query_predicate(query, plan.predicate if plan else None))

    def hits(self, query: str | Query, filters: Filters = Filters(), fuzzy: bool = False) -> DataFrame:
        """Matching documents with their ``matches`` and the worst ``quality`` among them."""
        query = self.parse(query) if isinstance(query, str) else query
        plan = self._fuzzy(query, fuzzy)
        rows = self.matching(query, filters, fuzzy)
        apart = plan is None and all(len(t.variants) <= 1 for t in query.terms)
        found = M.finalize(M.query_matches(query, plan.matches if plan else None, self.tuning), apart)
        rows = rows.select(*HIT, found.alias("matches"))
        return rows.withColumn("quality", M.worst_quality(F.col("matches")))

    def ranked(self, query: str | Query, filters: Filters = Filters(), fuzzy: bool = False, now: int = 0) -> DataFrame:
        """Hits with ``score`` and ``relevance``, in no order yet.

        The scored hits are kept until the next search, on disk if need be, so that the best
        score, the order and the excerpts do not read the texts again.
        """
        query = self.parse(query) if isinstance(query, str) else query
        hits = R.with_scores(self.hits(query, filters, fuzzy), query, now, self.tuning.weights)
        if not query.terms:
            return hits.withColumn("relevance", F.lit(0))
        if self._kept is not None:
            self._kept.unpersist()
        self._kept = hits.persist()
        return R.with_relevance(hits)

    def search(self, query: str | Query, filters: Filters = Filters(), sort: str | None = None, fuzzy: bool | None = None,
               limit: int | None = None, now: int = 0, snippets: int | None = None, by_name: bool = True) -> DataFrame:
        """The first hits in order, with ``position`` from 0, and excerpts if asked for.

        Relevance is measured against all hits; the limit comes after the order.  Ties go by
        the names in the path, numbers by value, or by its code points without ``by_name``.
        """
        query = self.parse(query) if isinstance(query, str) else query
        fuzzy = self.settings.fuzzy if fuzzy is None else fuzzy
        key = R.effective_sort(sort or self.settings.default_sort, query)
        keys = R.sort_keys(key, by_name)
        top = self.ranked(query, filters, fuzzy, now).orderBy(*keys).limit(max(1, limit or self.settings.max_results))
        order = F.row_number().over(Window.orderBy(*keys)) - 1  # over the few rows of the limit
        out = top.withColumn("position", order)
        if snippets:
            out = with_snippets(out, self.docs, snippets, self.tuning)
        names = F.array(*map(F.lit, QUALITIES))
        return out.withColumn("quality", F.get(names, F.col("quality"))).orderBy("position")

    def count(self, query: str | Query, filters: Filters = Filters(), fuzzy: bool = False) -> int:
        return self.matching(query, filters, fuzzy).count()

    def batch(self, queries: dict[str, str], filters: Filters = Filters()) -> DataFrame:
        """``query, id, path`` for many queries in one pass over the texts.

        Each document is read once and tested by all predicates.
        """
        asked = {k: self.parse(q) for k, q in queries.items()}
        tests = [F.when(query_predicate(q), F.lit(k)) for k, q in asked.items() if not q.is_empty]
        if not tests:
            return self.docs.select(F.lit("").alias("query"), "id", "path").limit(0)
        found = F.array_compact(F.array(*tests))
        return self.docs.filter(filter_predicate(filters)).select(F.explode(found).alias("query"), "id", "path")


def empty_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)


def union_docs(parts: list[DataFrame]) -> DataFrame:
    """Several ``docs`` tables as one."""
    return reduce(DataFrame.unionByName, parts)
