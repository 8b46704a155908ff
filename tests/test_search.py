import pytest
from pyspark.sql import functions as F

from notegrove.engine import SearchEngine
from notegrove.operators import catalogue, ranking
from notegrove.operators.matches import MATCHES
from notegrove.plans import access
from notegrove.plans.predicates import Filters
from notegrove.plans.query import parse
from notegrove.sources.ingest import build_docs

NOW = 1_767_225_600_000
DAY = 86_400_000
FILES = [
    ("Küche/Rezepte.md", "---\ntags: [kochen]\nstatus: offen\ncreated: 2024-05-01\n---\n# Suppe\nDie Küche ist blau.\n\nzweiter Block snake\n- [ ] kaufen", 1),
    ("Küche/Liste.md", "Kueche und Straße. form the from", 2),
    ("Projekte/a.canvas", '{"nodes":[{"text":"Küche Plan"}]}', 3),
    ("Projekte2/b.md", "unterkuchen und Küchen, #idee\nSchokolade", 4),
    ("view.base", "filters:\n  status", 5),
]


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(p, t, NOW - a * DAY, NOW - a * DAY) for p, t, a in FILES]
    docs = build_docs(spark.createDataFrame(rows, "path string, raw string, ctime long, mtime long")).cache()
    return SearchEngine(docs)


def paths(engine, query, filters=Filters(), fuzzy=False):
    return sorted(r.path.rsplit("/", 1)[-1] for r in engine.matching(query, filters, fuzzy).collect())


@pytest.mark.parametrize(
    "query,expected",
    [
        ("küche", ["Liste.md", "Rezepte.md", "a.canvas", "b.md"]),
        ("kueche", ["Liste.md", "Rezepte.md", "a.canvas", "b.md"]),
        ("strasse", ["Liste.md"]),
        ("schoko", ["b.md"]),
        ("kuche -kuchen", ["Liste.md", "Rezepte.md", "a.canvas"]),
        ("kuche -*kuchen*", ["Liste.md", "Rezepte.md", "a.canvas"]),
        ("und -unter*", ["Liste.md"]),
        ("title:rezepte", ["Rezepte.md"]),
        ("path:projekte/", ["a.canvas"]),
        ("tag:koch", ["Rezepte.md"]),
        ("tag:idee", ["b.md"]),
        ("prop:status", ["Rezepte.md"]),
        ("prop:status=off", ["Rezepte.md"]),
        ('"ist blau"', ["Rezepte.md"]),
        ('"blau. zweiter"', []),
        ('"suppe die"', []),
        ("blau OR schokolade", ["Rezepte.md", "b.md"]),
        ("status", ["Rezepte.md", "view.base"]),
        ("-blau", []),
        ("", []),
    ],
)
def test_literal(engine, query, expected):
    assert paths(engine, query) == expected


@pytest.mark.parametrize(
    "filters,expected",
    [
        (Filters(folder="Projekte"), ["a.canvas"]),
        (Filters(folder="", subfolders=False), ["view.base"]),
        (Filters(open_tasks=True), ["Rezepte.md"]),
        (Filters(prop=("status", "off")), ["Rezepte.md"]),
        (Filters(note="view.base"), ["view.base"]),
        (Filters(modified_from=NOW - 2 * DAY), ["Liste.md", "Rezepte.md"]),
        (Filters(created_to=NOW - 600 * DAY), ["Rezepte.md"]),
        (Filters(modified_to=NOW, formats=("canvas",)), ["a.canvas"]),
        (Filters(modified_to=NOW, formats=()), []),
        (Filters(modified_to=NOW, excluded_folders=("Küche", "", "Projekte2/")), ["a.canvas", "view.base"]),
        (Filters(formats=("canvas",)), []),
    ],
)
def test_filters_alone(engine, filters, expected):
    assert paths(engine, "", filters) == expected


def test_fuzzy(engine):
    assert paths(engine, "shcokolade", fuzzy=True) == ["b.md"]
    assert paths(engine, "title:rezpete", fuzzy=True) == ["Rezepte.md"]
    assert paths(engine, "tag:kohcen", fuzzy=True) == ["Rezepte.md"]
    assert set(paths(engine, "kuche")) <= set(paths(engine, "kuche", fuzzy=True))
    hit = engine.hits("shcokolade", fuzzy=True).first()
    assert hit.quality == 2 and hit.matches[0].matched_text == "schokolade"


def test_postings_change_nothing(engine):
    indexed = SearchEngine(engine.docs, postings=access.postings(engine.docs))
    for q in ("küche", "blau OR schokolade", '"ist blau"', "ab", "prop:status und", "schokolade küche"):
        assert paths(indexed, q) == paths(engine, q)


def test_matches_lead_to_the_text(engine):
    raw = dict((p, t) for p, t, _ in FILES)
    from notegrove.functions.fold import fold

    for r in engine.hits("küche und").collect():
        for m in r.matches:
            if m.field in ("body", "heading"):
                assert fold(raw[r.path][m.start : m.end]) in ("kuche", "kueche", "und")
    by_path = {r.path: r for r in engine.hits("küche").collect()}
    assert by_path["Küche/Liste.md"].quality == 1  # its text spells the alias
    assert [m.whole_word for m in by_path["Projekte2/b.md"].matches] == [False, False]
    fields = {m.field for m in engine.hits("suppe").first().matches}
    assert fields == {"heading"}


def test_order_snippets_and_relevance(engine):
    out = engine.search("küche", now=NOW, snippets=2).collect()
    assert [r.position for r in out] == list(range(len(out))) and max(r.relevance for r in out) == 100
    assert [r.quality for r in out] == sorted((r.quality for r in out), key=["exact", "alias", "fuzzy"].index)
    shown = {r.path: r for r in out}["Projekte/a.canvas"].snippets[0]
    assert [shown.text[m.start : m.end] for m in shown.marks] == ["Küche"]
    assert [r.path for r in engine.search("", Filters(modified_to=NOW)).collect()][0] == "Küche/Liste.md"
    assert [r.title for r in engine.search("und", sort="title-asc").collect()] == ["b", "Liste"]
    assert len(engine.search("küche", limit=1).collect()) == 1


def test_batch_equals_single(engine):
    got = {(r.query, r.path) for r in engine.batch({"a": "küche", "b": "-x", "c": "status"}).collect()}
    assert got == {(k, r.path) for k, q in (("a", "küche"), ("c", "status")) for r in engine.matching(q).collect()}


def test_catalogues(engine):
    docs = engine.docs
    assert {(r.key, r.value) for r in catalogue.properties(docs).collect()} >= {("status", "offen")}
    assert [r.value for r in catalogue.property_suggestions(docs, "status", "Off").collect()] == ["offen"]
    assert [r.folder for r in catalogue.folder_suggestions(docs, "PROJ").collect()] == ["Projekte", "Projekte2"]
    s = catalogue.stats(docs, access.postings(docs)).first()
    assert s.n_docs == 5 and s.n_postings > s.n_grams > 0
    run = engine.matching("küche")
    assert catalogue.curate(run, run.limit(1), None).count() == 1
    assert catalogue.curate(run, None, run.limit(1)).count() == 3


# Expected values of a fixed ranking: fields, counts, ages and the score to four places.
GOLDEN = [
    ("Übersicht.md", [("title", 0, True), ("tag", 4, False)], 0, 0, 6.7850),
    ("küche/Vorrat.md", [("title", 0, True, 0), ("body", 60, False, 1)], 0, 60, 5.5142),
    ("inbox/Kaffee.md", [("title", 0, True)], 0, 1, 4.4834),
    ("notizen/Tasse.md", [("tag", 0, True)], 0, 3, 2.9868),
    ("küche/Rezepte.md", [("body", 100, True, 0), ("body", 112, True, 1)], 0, 20, 2.4131),
    ("projekte/Barista.md", [("body", 20 * i, False) for i in range(12)], 0, 200, 1.5588),
    ("küche/Einkauf.md", [("body", 100, False, 0), ("body", 2400, False, 1)], 0, 20, 1.3441),
    ("referenz/Anhang.md", [], 0, 400, 0.0),
    ("archiv/2024/Muehle.md", [("path", 0, False)], 1, 900, 0.95),
    ("daily/2026-03-02.md", [("body", 20 * i, False) for i in range(4)], 2, 12, 1.0491),
]


def test_golden_scores(spark):
    rows = []
    for i, (path, ms, quality, age, _) in enumerate(GOLDEN):
        found = [(m[1], m[1] + 7, m[0], m[3] if len(m) > 3 else 0, m[2], quality, None) for m in ms]
        rows.append((i, path, path, NOW - (age + 30) * DAY, NOW - age * DAY, found, quality))
    hits = spark.createDataFrame(rows, f"id long, path string, title string, created_at long, modified_at long, matches {MATCHES}, quality int")
    out = ranking.with_relevance(ranking.with_scores(hits, parse("a b"), NOW)).orderBy(*ranking.sort_keys("relevance")).collect()
    assert [r.path for r in out] == [g[0] for g in GOLDEN]
    assert [round(r.score, 4) for r in out] == [pytest.approx(g[4], abs=6e-5) for g in GOLDEN]
    assert out[0].relevance == 100 and out[7].relevance == 0


def test_natural_order(spark):
    rows = spark.createDataFrame([("note10",), ("Note9",), ("Äpfel",), ("apfel2",), ("zebra",)], "t string")
    assert [r.t for r in rows.orderBy(ranking.natural(F.col("t"))).collect()] == ["Äpfel", "apfel2", "Note9", "note10", "zebra"]
