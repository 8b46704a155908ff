"""The query language: text to a tree of groups of terms, and back.

``a b`` asks for both, ``a OR b`` for one, ``"a b"`` for a phrase, ``-a`` excludes a word
(``-a*``, ``-*a``, ``-*a*`` its beginnings, ends and any place), and ``path:``, ``tag:``,
``title:`` and ``prop:`` look in one field.  Parsing never fails; what it could not use is
listed in ``errors``.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from ..config import Tuning
from ..functions.fold import fold, grams, utf16_length, variants

SPACE = " \t\n\r\x0b\x0c\xa0"
_WS = re.compile(f"[{SPACE}]+")
_TOKEN = re.compile(
    rf"""(?P<minus>-)?(?:(?P<name>[A-Za-z]+):)?(?:"(?P<phrase>[^"]*)(?P<close>"?)|(?P<word>[^{SPACE}]*))""", re.S
)
FIELD_NAMES = {"path": "path", "prop": "property", "tag": "tag", "title": "title"}


@dataclass(frozen=True)
class Term:
    """One word or phrase; ``variants`` are the folded spellings that match it."""

    kind: str
    field: str
    raw: str
    boundary: str = "anywhere"
    span: tuple[int, int] = field(default=(0, 0), compare=False)
    normalized: str = field(default="", compare=False)
    variants: tuple[str, ...] = field(default=(), compare=False)
    grams: tuple[str, ...] = field(default=(), compare=False)
    fuzzy: bool = field(default=False, compare=False)

    @property
    def short(self) -> bool:
        return not self.grams


@dataclass(frozen=True)
class Error:
    code: str
    start: int
    end: int


@dataclass(frozen=True)
class Query:
    """All of ``must``, one of each group of ``should``, none of ``must_not``."""

    must: tuple[Term, ...] = ()
    should: tuple[tuple[Term, ...], ...] = ()
    must_not: tuple[Term, ...] = ()
    errors: tuple[Error, ...] = field(default=(), compare=False)
    raw: str = field(default="", compare=False)

    @property
    def terms(self) -> tuple[Term, ...]:
        """The positive terms in the order that match lists number them."""
        return self.must + tuple(t for group in self.should for t in group)

    @property
    def is_empty(self) -> bool:
        return not self.terms


def field_of(prefix: str) -> str | None:
    return FIELD_NAMES.get(prefix.split(":", 1)[0].strip().lower())


def split_property(text: str) -> tuple[str, str | None]:
    """Key and value of ``key=value``; no value asks whether the key is there."""
    key, _, value = text.partition("=")
    return key.strip(), value.strip() or None


def make_term(raw: str, kind: str = "word", where: str = "any", boundary: str = "anywhere", negated: bool = False,
              span: tuple[int, int] = (0, 0), tuning: Tuning = Tuning()) -> Term:
    normalized = fold(unicodedata.normalize("NFC", raw))
    short = utf16_length(normalized) < tuning.min_gram_term
    spelt = variants(raw, tuning.max_variants)
    return Term(
        kind, where, raw, boundary, span, normalized, tuple(spelt),
        () if short else tuple(dict.fromkeys(g for v in spelt for g in grams(v, tuning.gram))),
        kind == "word" and not negated and not short and where != "property",
    )


def _edges(negated: bool, start: bool, end: bool) -> str:
    if not negated or (start and end):
        return "anywhere"
    return "prefix" if end else "suffix" if start else "whole"


def _cut(text: str, units: int) -> str:
    """At most so many UTF-16 units, whole characters only."""
    return text.encode("utf-16-le")[: 2 * units].decode("utf-16-le", "ignore")


def parse(raw: str, tuning: Tuning = Tuning()) -> Query:
    errors: list[Error] = []
    text = _cut(raw, tuning.max_query)
    if len(text) < len(raw):
        errors.append(Error("query-too-long", len(text), len(raw)))
    groups: list[list[Term]] = []
    excluded: list[Term] = []
    chain = False  # whether the last token was a positive term, which OR can extend
    waiting: Error | None = None  # an OR without its right side
    at = 0
    while at < len(text):
        if blank := _WS.match(text, at):
            at = blank.end()
            continue
        if re.compile(rf"OR(?=[{SPACE}]|\Z)").match(text, at):
            operator = Error("dangling-operator", at, at + 2)
            if chain and waiting is None:
                waiting = operator
            else:
                errors.append(operator)
            at += 2
            continue
        token = _TOKEN.match(text, at)
        if token["name"] and field_of(token["name"]) is None:
            start = token.start("name")
            errors.append(Error("unknown-field", start, token.end("name") + 1))
            # an unknown field stays part of the word
            token = re.compile(rf"(?P<minus>-)?(?P<name>)(?P<phrase>(?!))?(?P<close>)(?P<word>[^{SPACE}]+)").match(text, at)
        where = field_of(token["name"]) if token["name"] else "any"
        negated = token["minus"] is not None
        phrase = token["phrase"] is not None
        body, begin = (token["phrase"], token.start("phrase")) if phrase else (token["word"], token.start("word"))
        if phrase and not token["close"]:
            errors.append(Error("unclosed-quote", begin - 1, len(text)))
        bare = body.lstrip("*")
        opened = len(bare) < len(body)
        begin += len(body) - len(bare)
        core = bare.rstrip("*")
        if not core:
            if not phrase:
                errors.append(Error("dangling-operator", at, token.end()))
            at = token.end()
            continue
        at = token.end()
        edges = _edges(negated, opened, len(core) < len(bare))
        term = make_term(core, "phrase" if phrase else "word", where, edges, negated, (begin, begin + len(core)), tuning)
        if negated:
            if waiting:
                errors.append(waiting)
            excluded.append(term)
            chain = False
        elif waiting:
            groups[-1].append(term)
        else:
            groups.append([term])
            chain = True
        waiting = None
    if waiting:
        errors.append(waiting)
    return Query(
        tuple(g[0] for g in groups if len(g) == 1),
        tuple(tuple(g) for g in groups if len(g) > 1),
        tuple(excluded),
        tuple(errors),
        raw,
    )


_STARS = {"prefix": "{}*", "suffix": "*{}", "anywhere": "*{}*", "whole": "{}"}


def render(term: Term, negated: bool = False) -> str:
    prefix = ("-" if negated else "") + ({"any": "", "property": "prop:"}.get(term.field, f"{term.field}:"))
    body = _STARS[term.boundary].format(term.raw) if negated else term.raw
    quoted = term.kind == "phrase" or not term.raw or _WS.search(term.raw) or (not prefix and term.raw == "OR")
    return f'{prefix}"{body}"' if quoted else prefix + body


def _pieces(query: Query) -> tuple[list[str], list[str]]:
    positive = [render(t) for t in query.must] + [" OR ".join(map(render, g)) for g in query.should]
    return positive, [render(t, True) for t in query.must_not]


def stringify(query: Query) -> str:
    """A text that parses to the same tree: positive terms, then exclusions."""
    positive, negative = _pieces(query)
    return " ".join(p for p in positive + negative if p)


def add_alternative(query: Query, term: str, tuning: Tuning = Tuning()) -> str:
    """The query's text with ``term`` as another choice for its last positive group."""
    parsed = parse(term, tuning)
    flat = term.strip().replace('"', "")
    added = render(parsed.terms[0]) if len(parsed.terms) == 1 else f'"{flat}"' if flat else ""
    positive, negative = _pieces(query)
    if added and positive:
        positive[-1] += f" OR {added}"
    elif added:
        positive = [added]
    return " ".join(positive + negative)
