"""Occurrences of terms as arrays of structs, in built-in functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Tuning
from ..plans.predicates import WORD, has_property, holds, literal, pattern
from ..plans.query import Query, Term, split_property

MATCH = "struct<start:int,end:int,field:string,term_index:int,whole_word:boolean,quality:int,matched_text:string>"
MATCHES = f"array<{MATCH}>"


def no_matches() -> Column:
    return F.array().cast(MATCHES)


EXACT, ALIAS, FUZZY = 0, 1, 2


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


SPANS = "array<struct<start:int,end:int,whole:boolean>>"
#: Characters of tags, and what a variant is that lies in one run of them.
TAG = "[a-z0-9_/-]"


def occurrences(text: Column, regex: str, most: int) -> Column:
    """``array<struct<start,end,whole>>`` of the first hits, left to right and not overlapping;
    ``whole`` ones neither begin nor end inside a word.

    Hits are fenced by U+0001 and U+0002, and edges inside words marked by U+0005 and U+0006,
    which folded text cannot hold; the text is cut at the first and lengths are added up.  So
    no offset is looked up in the text, which would take time by its length for each.
    """
    fenced = F.regexp_replace(text, f"({regex})", "\x01$1\x02")
    fenced = F.regexp_replace(fenced, f"(?<={WORD}|{WORD}\x02)\x01(?={WORD})", "\x01\x05")
    fenced = F.regexp_replace(fenced, f"(?<={WORD})\x02(?=(?:\x01\x05?)?{WORD})", "\x02\x06")

    def step(acc: Column, piece: Column) -> Column:
        into, close = piece.startswith("\x05"), F.instr(piece, "\x02")
        out = F.substring(piece, close + 1, F.lit(1)) == "\x06"
        begin = F.when(into, 1).otherwise(0)
        end = acc["at"] + close - 1 - begin
        hit = F.struct(acc["at"].alias("start"), end.alias("end"), (~into & ~out).alias("whole"))
        at = acc["at"] + F.length(piece) - 1 - begin - F.when(out, 1).otherwise(0)
        return F.struct(at.alias("at"), F.concat(acc["hits"], F.array(hit)).alias("hits"))

    def add_up(pieces: Column) -> Column:
        begin = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), F.array().cast(SPANS).alias("hits"))
        return F.aggregate(F.slice(pieces, F.lit(2), F.lit(most)), begin, step, lambda acc: acc["hits"])

    return let(F.split(fenced, "\x01", -1), add_up)


def field_at(offset: Column) -> Column:
    front = F.col("frontmatter")
    heading = F.exists("headings", lambda h: (offset >= h["start"]) & (offset < h["end"]))
    return (
        F.when(front.isNotNull() & (offset >= front["start"]) & (offset < front["end"]), "frontmatter")
        .when(heading, "heading")
        .otherwise("body")
    )


def original(start: Column, end: Column) -> tuple[Column, Column]:
    """A span of the text as a span of the raw text.

    A span of a compact format ends after its last character, not where the next segment
    begins.
    """
    to = F.col("offset_map")
    begin = F.when(to.isNull(), start).otherwise(F.get(to, start))
    after = F.when(F.col("format") == "markdown", F.get(to, end)).otherwise(F.get(to, end - 1) + 1)
    return begin, F.when(to.isNull(), end).otherwise(after)


def _match(start, end, where, index: int, whole, quality, text=None) -> Column:
    text = F.lit(None).cast("string") if text is None else text
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), where.alias("field"), F.lit(index).alias("term_index"),
        whole.alias("whole_word"), F.lit(quality).alias("quality"), text.alias("matched_text"),
    ).cast(MATCH)


def _found(text: Column, variant: str, boundary: str, most: int) -> Column:
    p = pattern(variant, boundary)
    return occurrences(text, p, most) if p else F.array().cast(SPANS)


def _quality(term: Term, variant: str) -> int:
    return EXACT if variant == term.normalized else ALIAS


def in_text(term: Term, index: int, most: int) -> Column:
    text = F.col("text_b")

    def one(variant: str) -> Column:
        def build(o: Column) -> Column:
            a, b = o["start"], o["end"]
            return _match(*original(a, b), field_at(a), index, o["whole"], _quality(term, variant))

        return F.transform(_found(text, variant, term.boundary, most), build)

    return F.concat(*map(one, term.variants)) if term.variants else no_matches()


def in_name(column: str, where: str, term: Term, index: int, most: int) -> Column:
    text = F.col(column)

    def one(variant: str) -> Column:
        def build(o: Column) -> Column:
            a, b = o["start"], o["end"]
            return _match(a, b, F.lit(where), index, o["whole"], _quality(term, variant))

        return F.transform(_found(text, variant, term.boundary, most), build)

    return F.concat(*map(one, term.variants)) if term.variants else no_matches()


def _run_is_tag(text: Column, a: Column, b: Column) -> Column:
    """Whether the run of tag characters around a span is one of the tags."""
    before = F.regexp_extract(F.substring(text, F.lit(1), a), r"([a-z0-9_/-]*)$", 1)
    after = F.regexp_extract(F.substring(text, b + 1, F.lit(1 << 30)), r"^([a-z0-9_/-]*)", 1)
    return F.array_contains("tags", F.concat(before, F.substring(text, a + 1, b - a), after))


def _tagged(text: Column, variant: str, boundary: str, most: int) -> Column:
    """Occurrences of a variant in the text, each with whether its run of tag characters is a tag.

    A variant of tag characters lies in one run: runs that hold it are found first, and the
    hits within each, so that no run is looked for around an offset.
    """
    kind = "array<struct<start:int,end:int,whole:boolean,tag:boolean>>"
    p = pattern(variant, boundary)
    if p is None:
        return F.array().cast(kind)
    flag = lambda o, tag, base: F.struct(*((base + o[c]).alias(c) for c in ("start", "end")), o["whole"].alias("whole"), tag.alias("tag"))
    if not re.fullmatch(f"{TAG}+", variant):
        return F.transform(occurrences(text, p, most), lambda o: flag(o, _run_is_tag(text, o["start"], o["end"]), F.lit(0))).cast(kind)
    parts = F.split(F.regexp_replace(text, f"({TAG}*{p}{TAG}*)", "\x01$1\x02"), "\x01", -1)

    def inside(acc: Column, piece: Column) -> Column:
        run = F.substring_index(piece, "\x02", 1)
        row = F.struct(acc["at"].alias("at"), run.alias("run"))
        return F.struct((acc["at"] + F.length(piece) - 1).alias("at"), F.concat(acc["runs"], F.array(row)).alias("runs"))

    def add_up(pieces: Column) -> Column:
        begin = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), F.array().cast("array<struct<at:int,run:string>>").alias("runs"))
        return F.aggregate(F.slice(pieces, F.lit(2), F.lit(most)), begin, inside, lambda acc: acc["runs"])

    def hits(r: Column) -> Column:
        tag = F.array_contains("tags", r["run"])
        return F.transform(occurrences(r["run"], p, most), lambda o: flag(o, tag, r["at"])).cast(kind)

    return F.slice(F.flatten(F.transform(let(parts, add_up), hits)), F.lit(1), F.lit(most))


def in_tags(term: Term, index: int, most: int) -> Column:
    """Occurrences in the text of variants that a tag holds, those within a tag if any are."""
    text, kind = F.col("text_b"), "array<struct<start:int,end:int,whole:boolean,tag:boolean,q:int>>"

    def one(variant: str) -> Column:
        spans = F.transform(_tagged(text, variant, term.boundary, most), lambda o: o.withField("q", F.lit(_quality(term, variant))))
        held = F.exists("tags", lambda t: holds(t, [variant], term.boundary))
        return F.when(held, spans).otherwise(F.array().cast(kind))

    if not term.variants:
        return no_matches()

    def build(s: Column) -> Column:
        return F.struct(
            *(x.cast("int").alias(n) for x, n in zip(original(s["start"], s["end"]), ("start", "end"))), F.lit("tag").alias("field"),
            F.lit(index).alias("term_index"), s["whole"].alias("whole_word"), s["q"].alias("quality"), F.lit(None).cast("string").alias("matched_text"),
        )

    def chosen(spans: Column) -> Column:
        return F.when(F.exists(spans, lambda s: s["tag"]), F.filter(spans, lambda s: s["tag"])).otherwise(spans)

    return F.transform(let(F.concat(*map(one, term.variants)), chosen), build)


def in_property(term: Term, index: int) -> Column:
    """One match where the property is named in the frontmatter, or at the very start."""
    key, value = split_property(term.normalized)
    if not key:
        return no_matches()
    front, text = F.col("frontmatter"), F.col("text")
    at = F.locate(key, text, 1) - 1 if isinstance(key, str) else F.lit(-1)
    named = front.isNotNull() & (at >= F.coalesce(front["start"], F.lit(0))) & (at + len(key) <= front["end"])
    start = F.when(named, at).otherwise(0)
    end = F.when(named, at + len(key)).otherwise(F.least(F.lit(1), F.length(text)))
    one = F.array(_match(*original(start, end), F.lit("frontmatter"), index, F.lit(True), EXACT))
    return F.when(has_property(key, value) & (end > start), one).otherwise(no_matches())


def literal_matches(term: Term, index: int, tuning: Tuning = Tuning()) -> Column:
    most = tuning.max_matches
    if term.field == "title":
        return in_name("title_norm", "title", term, index, most)
    if term.field == "path":
        return in_name("path_norm", "path", term, index, most)
    if term.field == "tag":
        return in_tags(term, index, most)
    if term.field == "property":
        return in_property(term, index)
    return F.concat(
        in_text(term, index, most), in_name("title_norm", "title", term, index, most), in_name("path_norm", "path", term, index, most)
    )


def word_matches(text: Column, words: Column, index: int, most: int, place=None) -> Column:
    """Whole-word occurrences of each of an array of words, as fuzzy matches."""

    def one(word: Column) -> Column:
        spans = _word_spans(text, word, most)

        def build(o: Column) -> Column:
            a, b = o["start"], o["end"]
            begin, end, where = place(a, b)
            return F.struct(
                begin.cast("int").alias("start"), end.cast("int").alias("end"), where.alias("field"), F.lit(index).alias("term_index"),
                F.lit(True).alias("whole_word"), F.lit(FUZZY).alias("quality"), word.alias("matched_text"),
            )

        return F.transform(spans, build)

    return F.flatten(F.transform(words, one)).cast(MATCHES)


def _word_spans(text: Column, word: Column, most: int) -> Column:
    regex = F.concat(F.lit(f"(?<!{WORD})("), word, F.lit(f")(?!{WORD})"))
    cut = F.split(F.regexp_replace(text, regex, F.lit("\x01$1")), "\x01", -1)
    spans = "array<struct<start:int,end:int>>"

    def step(acc: Column, piece: Column) -> Column:
        hit = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(word)).alias("end"))
        return F.struct((acc["at"] + F.length(piece)).alias("at"), F.concat(acc["hits"], F.array(hit)).alias("hits"))

    def add_up(pieces: Column) -> Column:
        begin = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), F.array().cast(spans).alias("hits"))
        return F.aggregate(F.slice(pieces, F.lit(2), F.lit(most)), begin, step, lambda acc: acc["hits"])

    return let(cut, add_up)


def finalize(matches: Column, apart: bool = False) -> Column:
    """Matches without overlaps within a term and field, in order of place.

    Of overlapping ones the first stays, at one start the longer, then the better.  ``apart``
    says that there are none, as with one spelling a term.
    """

    def by(*keys) -> Column:
        """Matches in the order of key structs, which travel in front of them."""
        keyed = lambda m: F.struct(F.struct(*(k(m).alias(f"k{i}") for i, k in enumerate(keys))).alias("key"), m.alias("m"))
        return lambda ms: F.transform(F.sort_array(F.transform(ms, keyed)), lambda x: x["m"])

    group = by(lambda m: m["term_index"], lambda m: m["field"], lambda m: m["start"], lambda m: -m["end"], lambda m: m["quality"])
    place = by(lambda m: m["start"], lambda m: m["end"], lambda m: m["term_index"])
    if apart:
        return place(matches)

    def step(acc: Column, m: Column) -> Column:
        clash = (acc["term"] == m["term_index"]) & (acc["field"] == m["field"]) & (m["start"] < acc["end"])
        at = acc["at"] + 1
        skip = F.struct(acc["term"].alias("term"), acc["field"].alias("field"), acc["end"].alias("end"), at.alias("at"), acc["kept"].alias("kept"))
        keep = F.struct(
            m["term_index"].alias("term"), m["field"].alias("field"), m["end"].alias("end"), at.alias("at"), F.concat(acc["kept"], F.array(at)).alias("kept")
        )
        return F.when(clash, skip).otherwise(keep)

    def apart_of(ms: Column) -> Column:
        """The kept ones by their numbers, which grow cheaper than the matches would."""
        begin = F.struct(
            F.lit(-1).alias("term"), F.lit("").alias("field"), F.lit(-1).alias("end"), F.lit(-1).alias("at"), F.array().cast("array<int>").alias("kept")
        )
        return F.transform(F.aggregate(ms, begin, step, lambda acc: acc["kept"]), lambda i: F.get(ms, i))

    return place(let(group(matches), apart_of))


def worst_quality(matches: Column) -> Column:
    """The worst quality among the matches, exact for none."""
    return F.coalesce(F.array_max(F.transform(matches, lambda m: m["quality"])), F.lit(EXACT))


def query_matches(query: Query, fuzzy=None, tuning: Tuning = Tuning()) -> Column:
    """All matches of the positive terms.  ``fuzzy`` gives a term's fuzzy matches, which
    count where the literal ones are none."""
    parts = []
    for i, t in enumerate(query.terms):
        found = literal_matches(t, i, tuning)
        if fuzzy is not None and t.fuzzy:
            found = F.when(F.size(found) > 0, found).otherwise(fuzzy(t, i))
        parts.append(found)
    return reduce(lambda a, b: F.concat(a, b), parts, no_matches())


__all__ = ["MATCHES", "no_matches", "finalize", "literal", "literal_matches", "occurrences", "query_matches", "worst_quality"]
