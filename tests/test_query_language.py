import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notegrove.config import Tuning, canonical_formats, format_of, migrate
from notegrove.plans.query import add_alternative, field_of, parse, split_property, stringify

CASES = [
    # query, must, should, must_not (with boundary)
    ("a b", ["a", "b"], [], []),
    ('"a b"', ["a b"], [], []),
    ("-a", [], [], [("a", "whole")]),
    ("a b OR c d", ["a", "d"], [["b", "c"]], []),
    ("a OR b OR c", [], [["a", "b", "c"]], []),
    ("a -b OR c", ["a", "c"], [], [("b", "whole")]),
    ("-a* -*b -*c*", [], [], [("a", "prefix"), ("b", "suffix"), ("c", "anywhere")]),
    ("e-mail foo:bar", ["e-mail", "foo:bar"], [], []),
    ('a "OR" b', ["a", "OR", "b"], [], []),
    ("a or b", ["a", "or", "b"], [], []),
    ("a ORb", ["a", "ORb"], [], []),
    ("  a \t b\xa0c ", ["a", "b", "c"], [], []),
    ("*a*", ["a"], [], []),
    ('""', [], [], []),
]


@pytest.mark.parametrize("text,must,should,must_not", CASES)
def test_grammar(text, must, should, must_not):
    q = parse(text)
    assert [t.raw for t in q.must] == must
    assert [[t.raw for t in g] for g in q.should] == should
    assert [(t.raw, t.boundary) for t in q.must_not] == must_not
    assert q.is_empty == (not must and not should)


@pytest.mark.parametrize("text,field", [("path:x", "path"), ("PATH:x", "path"), ("tag:x", "tag"), ("title:x", "title"), ("prop:x=y", "property")])
def test_fields(text, field):
    assert parse(text).must[0].field == field


@pytest.mark.parametrize(
    "text,errors",
    [
        ("a OR", [("dangling-operator", 2, 4)]),
        ("OR a", [("dangling-operator", 0, 2)]),
        ("a OR OR b", [("dangling-operator", 5, 7)]),
        ('"open', [("unclosed-quote", 0, 5)]),
        ("foo:x", [("unknown-field", 0, 4)]),
        ("tag:", [("dangling-operator", 0, 4)]),
        ("***", [("dangling-operator", 0, 3)]),
        ("x" * 600, [("query-too-long", 512, 600)]),
    ],
)
def test_errors(text, errors):
    assert [(e.code, e.start, e.end) for e in parse(text).errors] == errors


@given(st.text(alphabet='ab*-"OR :propatg=é\n', max_size=40))
@settings(max_examples=300, deadline=None)
def test_parse_never_fails_and_round_trips(text):
    q = parse(text)
    again = parse(stringify(q))
    assert again.must_not == q.must_not or '"' in "".join(t.raw for t in q.must_not + q.terms) or "*" in text
    assert len(again.terms) == len(q.terms) or '"' in "".join(t.raw for t in q.terms) or "*" in text


def test_round_trip_of_plain_queries():
    for text, *_ in CASES:
        q = parse(text)
        assert parse(stringify(q)) == q


def test_terms_and_helpers():
    t = parse("Küche").must[0]
    assert t.variants == ("kuche", "kueche") and t.fuzzy and not t.short
    assert parse("ab").must[0].short and not parse("ab").must[0].fuzzy
    assert not parse("-abc").must_not[0].fuzzy and not parse("prop:abc").must[0].fuzzy
    assert split_property("a = b=c ") == ("a", "b=c") and split_property("a=") == ("a", None)
    assert field_of("Title:x") == "title" and field_of("x") is None
    assert add_alternative(parse("a b -c"), "d e") == 'a b OR "d e" -c'
    assert add_alternative(parse(""), "d") == "d" and add_alternative(parse("a"), " ") == "a"
    assert parse("abc def", Tuning(max_query=3)).must[0].raw == "abc"


def test_settings_are_clamped():
    s = migrate({"snippet_count": 9, "max_results": "x", "default_sort": "bad", "formats": ["canvas", "zip"], "junk": 1, "fuzzy": True})
    assert (s.snippet_count, s.max_results, s.default_sort, s.formats, s.fuzzy) == (3, 200, "relevance", ("markdown", "canvas"), True)
    assert migrate(None) == migrate([]) == migrate({})
    assert canonical_formats(None) == ("markdown",) and format_of("MD") == "markdown" and format_of("txt") is None
