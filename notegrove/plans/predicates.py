"""Terms, groups and filters as column expressions over ``docs``."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.ingest import excluded, inside
from .query import Query, Term, split_property

WORD = "[a-z0-9]"


@dataclass(frozen=True)
class Filters:
    """Metadata conditions; None is no condition.  Bounds are inclusive epoch millis."""

    folder: str | None = None
    subfolders: bool = True
    created_from: int | None = None
    created_to: int | None = None
    modified_from: int | None = None
    modified_to: int | None = None
    prop: tuple[str, str | None] | None = None
    open_tasks: bool = False
    formats: tuple[str, ...] | None = None
    note: str | None = None
    excluded_folders: tuple[str, ...] = ()

    @property
    def active(self) -> bool:
        """Whether the filters alone ask for something; formats and exclusions never do."""
        bounds = (self.created_from, self.created_to, self.modified_from, self.modified_to, self.prop, self.note)
        if self.open_tasks or any(b is not None for b in bounds):
            return True
        return self.folder is not None and (bool(self.folder.strip().strip("/")) or not self.subfolders)


def literal(text: str) -> str:
    """A pattern, for Java's and Python's engines, that matches the text itself."""
    return re.sub(r"([^a-z0-9 \x80-\U0010ffff])", r"\\\1", text)


def segments(variant: str) -> list[str]:
    return variant.split()


def pattern(variant: str, boundary: str = "anywhere") -> str | None:
    """A variant's pattern: segments a run of blanks apart, edges where the boundary asks.

    An edge that is no word character always is a boundary.  None matches nothing.
    """
    parts = segments(variant)
    if not parts:
        return None
    out = " +".join(map(literal, parts))
    if boundary in ("whole", "prefix") and re.match(WORD, parts[0]):
        out = f"(?<!{WORD}){out}"
    if boundary in ("whole", "suffix") and re.search(WORD + r"\Z", parts[-1]):
        out = f"{out}(?!{WORD})"
    return out


def holds(text: Column, variants: Iterable[str], boundary: str = "anywhere") -> Column:
    """Whether the text has one of the variants; plain ``contains`` where that is enough."""
    tests = []
    for v in variants:
        p = pattern(v, boundary)
        if p is None:
            continue
        plain = boundary == "anywhere" and len(segments(v)) == 1
        tests.append(text.contains(segments(v)[0]) if plain else text.rlike(p))
    return reduce(or_, tests) if tests else F.lit(False)


def term_predicate(term: Term) -> Column:
    """Literal match of a term, in its field or in text, title and path."""
    v, b = term.variants, term.boundary
    if term.field == "title":
        return holds(F.col("title_norm"), v, b)
    if term.field == "path":
        return holds(F.col("path_norm"), v, b)
    if term.field == "tag":
        return F.exists("tags", lambda t: holds(t, v, b))
    if term.field == "property":
        key, value = split_property(term.normalized)
        if not key:
            return F.lit(False)
        return has_property(key, value)
    return holds(F.col("text_b"), v, b) | holds(F.col("title_norm"), v, b) | holds(F.col("path_norm"), v, b)


def has_property(key: str, value: str | None) -> Column:
    stored = F.try_element_at(F.col("properties"), F.lit(key))
    return F.coalesce(stored.isNotNull() if value is None else stored.contains(value), F.lit(False))


def exclusions(query: Query) -> Column:
    return reduce(and_, [~term_predicate(t) for t in query.must_not], F.lit(True))


def query_predicate(query: Query, extra=None) -> Column:
    """All musts, one of each group, no exclusion.  ``extra`` widens positive terms."""

    def positive(t: Term) -> Column:
        return term_predicate(t) if extra is None else term_predicate(t) | extra(t)

    parts = [positive(t) for t in query.must]
    parts += [reduce(or_, map(positive, group)) for group in query.should]
    return reduce(and_, [*parts, exclusions(query)])


def filter_predicate(f: Filters) -> Column:
    """Cheap comparisons first; ranges and equalities reach the scan."""
    out: list[Column] = []
    for name, low, high in (("created_at", f.created_from, f.created_to), ("modified_at", f.modified_from, f.modified_to)):
        out += [F.col(name) >= low] if low is not None else []
        out += [F.col(name) <= high] if high is not None else []
    if f.note is not None:
        out.append(F.col("path") == f.note)
    if f.formats is not None:
        out.append(F.col("format").isin(*f.formats) if f.formats else F.lit(False))
    if f.folder is not None:
        name = f.folder.strip().strip("/")
        if name:
            out.append(inside(F.col("folder"), name) if f.subfolders else F.col("folder") == name)
        elif not f.subfolders:
            out.append(F.col("folder") == "")
    if f.open_tasks:
        out.append(F.col("has_open_task"))
    if any(x.strip().strip("/") for x in f.excluded_folders if isinstance(x, str)):
        out.append(~excluded(F.col("path"), f.excluded_folders))
    if f.prop is not None:
        out.append(has_property(*f.prop))
    return reduce(and_, out, F.lit(True))
