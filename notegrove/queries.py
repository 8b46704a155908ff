"""Named queries over the tables of a scale-factor folder, with DuckDB counterparts.

The SQL is written from the semantics, not from the Spark plans: folding by
``strip_accents``, boundaries by consuming patterns, occurrences by replacing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpus
from .config import Tuning, Weights
from .engine import SearchEngine, union_docs
from .functions import dates
from .operators import catalogue, fuzzy, matches, ranking, snippets
from .plans import access
from .plans.predicates import Filters
from .plans.query import parse
from .sources import formats, ingest, store
from .streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DOCS_SQL = f"""WITH d AS (
  SELECT doc_id, source || '/' || lang || '/doc-' || doc_id || '.md' AS path, 'doc-' || doc_id AS title,
         source || '/' || lang AS folder, lang, text AS raw,
         translate(lower(strip_accents(text)), 'ßæœø' || chr(10) || chr(13) || chr(9), 'saoo   ') AS t,
         CAST({corpus.EPOCH} + doc_id * {corpus.HOUR} AS BIGINT) AS created_at,
         CAST({corpus.EPOCH} + doc_id * {corpus.HOUR} + doc_id % 400 * {corpus.DAY} AS BIGINT) AS modified_at,
         quality, toxic
  FROM documents LEFT JOIN labels USING (doc_id))
"""


def engine(spark: SparkSession, sf_dir: str) -> SearchEngine:
    return SearchEngine(corpus.documents(spark, sf_dir))


def anywhere(*words: str) -> str:
    """SQL: one of the words in text, title or path."""
    return "(" + " OR ".join(f"contains(t, '{w}') OR contains(title, '{w}') OR contains(lower(path), '{w}')" for w in words) + ")"


def patterned(regex: str) -> str:
    return f"(regexp_matches(t, '{regex}') OR regexp_matches(title, '{regex}') OR regexp_matches(lower(path), '{regex}'))"


def found(name: str, query: str, where: str, filters: Filters = Filters()) -> None:
    """A query whose answer is the set of matching paths."""
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).matching(query, filters).select("path")
    SQL[name] = f"{DOCS_SQL} SELECT path FROM d WHERE {where}"


B, E = "(^|[^a-z0-9])", "([^a-z0-9]|$)"
found("infix_term", "keit", anywhere("keit"))
found("two_terms_and", "heit keit", f"{anywhere('heit')} AND {anywhere('keit')}")
found("or_group", "heit OR ación OR rement", anywhere("heit", "acion", "rement"))
found("or_binds_tighter", "the ation OR stre", f"{anywhere('the')} AND {anywhere('ation', 'stre')}")
found("umlaut_alias", "über", anywhere("uber", "ueber"))
found("sharp_s_alias", "eiß", anywhere("eis", "eiss"))
found("contraction_variants", "ueber", anywhere("ueber", "uber"))
found("short_term", "ño", anywhere("no"))
found("exclude_whole", "tion -that", f"{anywhere('tion')} AND NOT {patterned(B + 'that' + E)}")
found("exclude_prefix", "tion -sting*", f"{anywhere('tion')} AND NOT {patterned(B + 'sting')}")
found("exclude_suffix", "tion -*sting", f"{anywhere('tion')} AND NOT {patterned('sting' + E)}")
found("exclude_anywhere", "tion -*sting*", f"{anywhere('tion')} AND NOT {anywhere('sting')}")
found("title_field", "title:doc-1", "contains(title, 'doc-1')")
found("path_field", "path:src1/en", "contains(lower(path), 'src1/en')")
found("tag_field", "tag:de", "contains(lang, 'de')")
found("tag_exclude", "tion -tag:en", f"{anywhere('tion')} AND NOT lang = 'en'")
found("prop_presence", "prop:toxic", "toxic IS NOT NULL")
found("prop_value", "prop:toxic=1", "toxic = 1")
found("prop_exclude", "the -prop:quality=0", f"{anywhere('the')} AND (quality IS NULL OR quality <> 0)")
found("phrase_ws_run", '"of the"', patterned("of +the"))
found("phrase_exclude", 'tion -"of the"', f"{anywhere('tion')} AND NOT {patterned(B + 'of +the' + E)}")
found("phrase_three", '"in the the" OR "de la la"', f"{patterned('in +the +the')} OR {patterned('de +la +la')}")
found("filter_folder", "", "(folder = 'src1' OR folder LIKE 'src1/%')", Filters(folder="/src1/"))
found("filter_folder_flat", "tion", f"{anywhere('tion')} AND folder = 'src1/en'", Filters(folder="src1/en", subfolders=False))
found("filter_excluded", "the", f"{anywhere('the')} AND NOT path LIKE 'src1/%'", Filters(excluded_folders=("src1",)))
LOW, HIGH = corpus.EPOCH + 100 * corpus.HOUR, corpus.EPOCH + 400 * corpus.HOUR
found("filter_created", "", f"created_at BETWEEN {LOW} AND {HIGH}", Filters(created_from=LOW, created_to=HIGH))
MID = corpus.EPOCH + 90 * corpus.DAY
found("filter_modified", "tion", f"{anywhere('tion')} AND modified_at >= {MID}", Filters(modified_from=MID))
found("filter_property", "", "contains(CAST(quality AS VARCHAR), '1')", Filters(prop=("quality", "1")))
found("filter_note", "", "path = 'src1/en/doc-1.md'", Filters(note="src1/en/doc-1.md"))
found("filter_only_negation", "-the", f"NOT {patterned(B + 'the' + E)} AND modified_at >= {MID}", Filters(modified_from=MID))
found("negation_alone", "-the", "false")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query(
    "filter_format",
    """SELECT 'chat/' || conv_id || '/' || turn || '.canvas' AS path, 'canvas' AS format FROM conversations
       WHERE contains(translate(lower(strip_accents(text)), 'ßæœø' || chr(10), 'saoo '), 'th')
       UNION ALL SELECT regexp_replace(url, '^[a-z]+://', ''), 'base' FROM pages
       WHERE contains(lower(html), 'th') OR contains(lower(url), 'th')""",
)
def filter_format(spark, sf_dir):
    docs = union_docs([corpus.pages(spark, sf_dir), corpus.conversations(spark, sf_dir), corpus.documents(spark, sf_dir)])
    e = SearchEngine(docs)
    return e.matching("th", Filters(formats=("canvas", "base"))).select("path", "format")


def ordered(name: str, sort: str, order: str, text: str = "keit", limit: int = 50) -> None:
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).search(text, sort=sort, limit=limit, now=corpus.NOW).select(
        "position", "path"
    )
    SQL[name] = f"""{DOCS_SQL} SELECT CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS position, path
        FROM d WHERE {anywhere(text)} ORDER BY {order} LIMIT {limit}"""


NUMERIC = "CAST(regexp_extract(source, '[0-9]+') AS INTEGER)"
SQL_PATH = "CAST(regexp_extract(path, 'src([0-9]+)', 1) AS INTEGER), lang, doc_id"
ordered("sort_created", "created-desc", "created_at DESC")
ordered("sort_created_asc", "created-asc", "created_at")
ordered("sort_modified", "modified-desc", f"modified_at DESC, {SQL_PATH}")
ordered("sort_modified_asc", "modified-asc", f"modified_at, {SQL_PATH}")
ordered("sort_title", "title-asc", "doc_id")
ordered("sort_path", "path-asc", SQL_PATH)


def _hits(spark, sf_dir, text: str, fuzzy_: bool = False) -> DataFrame:
    return engine(spark, sf_dir).hits(text, fuzzy=fuzzy_)


@query("match_counts", f"""{DOCS_SQL} SELECT path, CAST(least(500, (length(t) - length(replace(t, 'keit', ''))) // 4) AS INTEGER) AS n
       FROM d WHERE contains(t, 'keit')""")
def match_counts(spark, sf_dir):
    return _hits(spark, sf_dir, "keit").select("path", F.size("matches").alias("n"))


@query("match_offsets", f"""{DOCS_SQL}, p AS (SELECT path, t, unnest(range(1, length(t) - 8)) AS i FROM d WHERE contains(t, 'lichkeit'))
       SELECT path, CAST(i - 1 AS INTEGER) AS start, CAST(i + 7 AS INTEGER) AS "end" FROM p WHERE substr(t, i, 8) = 'lichkeit'""")
def match_offsets(spark, sf_dir):
    return _hits(spark, sf_dir, "lichkeit").select("path", F.explode("matches").alias("m")).select("path", "m.start", "m.end")


@query("field_attribution", f"""{DOCS_SQL}, n AS (
       SELECT 'body' AS field, sum(least(500, (length(t) - length(replace(t, 'src1', ''))) // 4)) AS n FROM d WHERE {anywhere('src1')}
       UNION ALL SELECT 'path', sum((length(path) - length(replace(path, 'src1', ''))) // 4) FROM d WHERE {anywhere('src1')})
       SELECT field, CAST(n AS BIGINT) AS n FROM n WHERE n > 0""")
def field_attribution(spark, sf_dir):
    each = _hits(spark, sf_dir, "src1").select(F.explode("matches").alias("m"))
    return each.groupBy("m.field").agg(F.count("*").alias("n"))


@query("whole_word_flags", f"""{DOCS_SQL}, w AS (SELECT path, string_split(t, 'that') AS p FROM d WHERE contains(t, 'that')),
       n AS (SELECT path, p, least(500, len(p) - 1) AS n FROM w)
       SELECT path, CAST(n AS INTEGER) AS n, CAST(len(list_filter(range(1, n + 1), lambda i:
         NOT (regexp_matches(p[i], '[a-z0-9]$') OR (i > 1 AND p[i] = ''))
         AND NOT (regexp_matches(p[i + 1], '^[a-z0-9]') OR (p[i + 1] = '' AND i + 1 < len(p))))) AS INTEGER) AS whole FROM n""")
def whole_word_flags(spark, sf_dir):
    m = F.filter("matches", lambda x: x["field"] == "body")
    out = _hits(spark, sf_dir, "that").select("path", F.size(m).alias("n"), F.size(F.filter(m, lambda x: x["whole_word"])).alias("whole"))
    return out.filter("n >= 1")  # counts stop at 500


@query("worst_quality", f"""{DOCS_SQL} SELECT path, CASE WHEN contains(t, 'ueber') THEN 1 ELSE 0 END AS quality
       FROM d WHERE {anywhere('uber', 'ueber')}""")
def worst_quality(spark, sf_dir):
    return _hits(spark, sf_dir, "über").select("path", "quality")


def occurrence_sql(n: str) -> str:
    return f"(CASE WHEN {n} <= 0 THEN 0.0 WHEN {n} <= 1 THEN 1.0 ELSE 1 + 1.2 * (ln({n}) / (ln({n}) + 4)) END)"


RECENCY_SQL = f"(1 + 0.15 * greatest(0.0, 1 - greatest(0.0, ({corpus.NOW} - modified_at) / {float(corpus.DAY)}) / 365.0))"


@query("occurrence_factor", f"SELECT CAST(range AS BIGINT) AS n, round({occurrence_sql('range')}, 9) AS factor FROM range(0, 60)")
def occurrence_factor(spark, sf_dir):
    return spark.range(60).select(F.col("id").alias("n"), F.round(ranking.occurrence_factor(F.col("id")), 9).alias("factor"))


@query("recency_factor", f"{DOCS_SQL} SELECT path, round({RECENCY_SQL}, 9) AS factor FROM d")
def recency_factor(spark, sf_dir):
    return corpus.documents(spark, sf_dir).select("path", F.round(ranking.recency_factor(F.col("modified_at"), corpus.NOW, Weights()), 9).alias("factor"))


KEIT = "least(500, (length(t) - length(replace(t, 'keit', ''))) // 4)"
# words that end in the term are no whole words unless they are the term
SCORE_SQL = f"""{DOCS_SQL}, w AS (SELECT path, {KEIT} AS n, {RECENCY_SQL} AS recency,
  len(regexp_extract_all(regexp_replace(t, '[^a-z0-9]+', '  ', 'g'), '(^| )keit( |$)')) AS whole FROM d WHERE contains(t, 'keit')),
  s AS (SELECT path, {occurrence_sql('n')} * ((n - whole) + 1.3 * whole) / n * recency AS score FROM w)"""


@query("score_breakdown", f"{SCORE_SQL} SELECT path, round(score, 6) AS score FROM s")
def score_breakdown(spark, sf_dir):
    return engine(spark, sf_dir).ranked("keit", now=corpus.NOW).select("path", F.round("score", 6).alias("score"))


@query("relevance_pct", f"{SCORE_SQL} SELECT path, CAST(round(score / (SELECT max(score) FROM s) * 100) AS INTEGER) AS relevance FROM s")
def relevance_pct(spark, sf_dir):
    return engine(spark, sf_dir).ranked("keit", now=corpus.NOW).select("path", "relevance")


@query("top_k", f"""{SCORE_SQL} SELECT CAST(row_number() OVER (ORDER BY score DESC, path) - 1 AS INTEGER) AS position, path, round(score, 6) AS score
       FROM s ORDER BY score DESC, path LIMIT 20""")
def top_k(spark, sf_dir):
    out = engine(spark, sf_dir).search("keit", limit=20, now=corpus.NOW, by_name=False)
    return out.select("position", "path", F.round("score", 6).alias("score"))


@query("proximity_two_terms", f"""{DOCS_SQL}, s AS (
       SELECT path, w, string_split(t, w) AS p FROM d, (VALUES ('lichkeit'), ('heitung')) v(w) WHERE contains(t, 'lichkeit') AND contains(t, 'heitung')),
       o AS (SELECT path, w, unnest(list_transform(range(1, least(500, len(p) - 1) + 1),
         lambda i: CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) AS BIGINT) + (i - 1) * length(w))) AS i FROM s),
       p AS (SELECT a.path, min(greatest(a.i + length(a.w), b.i + length(b.w)) - least(a.i, b.i)) AS width
             FROM o a JOIN o b ON a.path = b.path AND a.w = 'lichkeit' AND b.w = 'heitung' GROUP BY a.path)
       SELECT path, round(1 + 0.4 * greatest(0.0, 1 - width / 400.0), 6) AS factor FROM p""")
def proximity_two_terms(spark, sf_dir):
    q = parse("lichkeit heitung")
    hits = engine(spark, sf_dir).hits(q)
    return hits.select("path", F.round(ranking.proximity_factor(F.col("matches"), q, Weights()), 6).alias("factor"))


WORDS_SQL = f"{DOCS_SQL}, w AS (SELECT doc_id, path, unnest(list_distinct(regexp_extract_all(t, '[a-z0-9]+'))) AS word FROM d)"
TYPO = "thatnd"


@query("fuzzy_words", f"{WORDS_SQL} SELECT DISTINCT word FROM w WHERE abs(length(word) - 6) <= 2 AND damerau_levenshtein(word, '{TYPO}') <= 2")
def fuzzy_words(spark, sf_dir):
    vocab = corpus.documents(spark, sf_dir).select(F.explode("words").alias("word")).distinct()
    return fuzzy.near_words(vocab, TYPO, 2)


@query("fuzzy_docs", f"""{WORDS_SQL} SELECT DISTINCT path FROM w WHERE abs(length(word) - 8) <= 2 AND damerau_levenshtein(word, 'schkietz') <= 2
       UNION SELECT path FROM d WHERE contains(t, 'schkietz')""")
def fuzzy_docs(spark, sf_dir):
    return engine(spark, sf_dir).matching("schkietz", fuzzy=True).select("path")


GRAMS_SQL = f"""{DOCS_SQL}, g AS (SELECT DISTINCT path, unnest(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) AS gram
  FROM (SELECT path, t AS x FROM d UNION ALL SELECT path, title FROM d UNION ALL SELECT path, lower(path) FROM d))"""


@query("fuzzy_floor", f"""{GRAMS_SQL} SELECT path, count(*) AS n FROM g
       WHERE gram IN ('lic', 'ich', 'chk', 'hke', 'kei', 'eit', 'ite', 'tes') GROUP BY path HAVING count(*) >= 2""")
def fuzzy_floor(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir)
    wanted = access.solid_grams("lichkeites")
    held = access.postings(docs).filter(F.col("gram").isin(*wanted)).groupBy("id").agg(F.count("*").alias("n"))
    return held.filter(F.col("n") >= access.fuzzy_floor(len(wanted), 2)).join(docs.select("id", "path"), "id").select("path", "n")


@query("trigram_postings", f"{GRAMS_SQL} SELECT gram, count(*) AS n_docs FROM g GROUP BY gram")
def trigram_postings(spark, sf_dir):
    return access.gram_frequency(access.postings(corpus.documents(spark, sf_dir, labelled=False)))


@query("trigram_candidates", f"{GRAMS_SQL} SELECT path FROM g WHERE gram IN ('kei', 'eit') GROUP BY path HAVING count(*) = 2")
def trigram_candidates(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir, labelled=False)
    return access.narrow(docs, access.postings(docs), parse("keit")).select("path")


@query("indexed_search", f"{DOCS_SQL} SELECT path FROM d WHERE {anywhere('lichkeit')} AND {anywhere('heit')}")
def indexed_search(spark, sf_dir):
    docs, grams = corpus.documents(spark, sf_dir), access.postings(corpus.documents(spark, sf_dir, labelled=False))
    return SearchEngine(docs, postings=grams).matching("lichkeit heit").select("path")


@query("gram_stats", f"{GRAMS_SQL} SELECT count(DISTINCT gram) AS n_grams, count(*) AS n_postings FROM g")
def gram_stats(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir)
    return catalogue.stats(docs, access.postings(docs)).select("n_grams", "n_postings")


@query("index_stats", f"{DOCS_SQL} SELECT count(*) AS n_docs, CAST(sum(length(t)) AS BIGINT) AS text_chars, CAST(sum(strlen(raw)) AS BIGINT) AS bytes FROM d")
def index_stats(spark, sf_dir):
    return catalogue.stats(corpus.documents(spark, sf_dir)).select("n_docs", "text_chars", "bytes")


@query("vocabulary", f"{WORDS_SQL} SELECT word, count(*) AS n_docs FROM w GROUP BY word")
def vocabulary(spark, sf_dir):
    each = corpus.documents(spark, sf_dir).select(F.explode("words").alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n_docs"))


@query("property_catalogue", """SELECT 'quality' AS key, CAST(quality AS VARCHAR) AS value, count(*) AS n_docs FROM documents JOIN labels USING (doc_id) GROUP BY 2
       UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM documents JOIN labels USING (doc_id) GROUP BY 2""")
def property_catalogue(spark, sf_dir):
    return catalogue.properties(corpus.documents(spark, sf_dir))


@query("property_suggest", "SELECT DISTINCT CAST(quality AS VARCHAR) AS value FROM documents JOIN labels USING (doc_id) WHERE contains(CAST(quality AS VARCHAR), '1')")
def property_suggest(spark, sf_dir):
    return catalogue.property_suggestions(corpus.documents(spark, sf_dir), "quality", "1")


@query("folder_suggest", "SELECT DISTINCT source || '/' || lang AS folder FROM documents WHERE contains(source || '/' || lang, 'c1/') ORDER BY 1 LIMIT 50")
def folder_suggest(spark, sf_dir):
    return catalogue.folder_suggestions(corpus.documents(spark, sf_dir), "C1/")


def _live(spark, sf_dir) -> DataFrame:
    """Files as they are now: some gone, some changed, of the indexed documents."""
    d = corpus.documents(spark, sf_dir).select("path", "raw", F.col("created_at").alias("ctime"), F.col("modified_at").alias("mtime"))
    number = F.regexp_extract("path", r"doc-(\d+)", 1).cast("long")
    return d.filter(number % 5 != 0).withColumn("mtime", F.col("mtime") + F.when(number % 7 == 1, 1).otherwise(0))


@query("stale_files", f"{DOCS_SQL} SELECT path FROM d WHERE doc_id % 5 <> 0 AND doc_id % 7 = 1")
def stale_files(spark, sf_dir):
    return store.stale_files(_live(spark, sf_dir), corpus.documents(spark, sf_dir)).select("path")


@query("vanished_files", f"{DOCS_SQL} SELECT path FROM d WHERE doc_id % 5 = 0")
def vanished_files(spark, sf_dir):
    return store.vanished(corpus.documents(spark, sf_dir), _live(spark, sf_dir)).select("path")


LATEST_SQL = """WITH c AS (SELECT event_id AS seq, 'u/' || user_id || '.md' AS path, props,
  CASE WHEN event_id % 7 = 0 THEN 'delete' ELSE 'index' END AS kind FROM events),
  l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1)"""


@query("latest_change", f"{LATEST_SQL} SELECT path, kind FROM l")
def latest_change(spark, sf_dir):
    return changes.outcomes(corpus.changes(spark, sf_dir)).select("path", "kind")


@query("apply_changes", f"{LATEST_SQL} SELECT path, props AS raw FROM l WHERE kind = 'index'")
def apply_changes(spark, sf_dir):
    feed = corpus.changes(spark, sf_dir)
    # the newest of some changes: any one of them might be another each time that it is read
    tenth = feed.filter("seq % 10 = 0").groupBy("path").agg(F.max(F.struct("seq", "raw", "ctime", "mtime")).alias("c"))
    before = ingest.build_docs(tenth.select("path", "c.raw", "c.ctime", "c.mtime"))
    return changes.apply_changes(before, feed).select("path", "raw")


DATE_SAMPLES = ["2024-05-01", "1.2.2024", "31.2.2024", "1714521600", "1714521600123", "2024-05-01T10:20", "2024-05-01T10:20:30.5+02:00", '"2024-02-29"', "[2023-02-29]", "soon", "2024-13-01"]
DATE_VALUES = [1714521600000, 1706745600000, None, 1714521600000, 1714521600123, 1714558800000, 1714551630500, 1709164800000, None, None, None]


@query("parse_created", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', CAST({'NULL' if v is None else v} AS BIGINT))" for t, v in zip(DATE_SAMPLES, DATE_VALUES)) + ") v(value, millis)")
def parse_created(spark, sf_dir):
    rows = spark.createDataFrame([(t,) for t in DATE_SAMPLES], "value string")
    return rows.select("value", dates.parse_date_column(F.col("value")).alias("millis"))


@query("quick_pick_range", f"""SELECT kind, CAST(epoch_ms(date_trunc('day', make_timestamp({corpus.NOW + 5000} * 1000)) - to_days(n)) AS BIGINT) AS low,
       CAST(epoch_ms(date_trunc('day', make_timestamp({corpus.NOW + 5000} * 1000)) + to_days(1)) - 1 AS BIGINT) AS high
       FROM (VALUES ('today', 0), ('week', 7), ('month', 30), ('year', 365)) v(kind, n)""")
def quick_pick_range(spark, sf_dir):
    rows = [(k, *dates.quick_range(k, corpus.NOW + 5000)) for k in dates.QUICK]
    return spark.createDataFrame(rows, "kind string, low long, high long")


@query("curate_remaining", f"{DOCS_SQL} SELECT path FROM d WHERE {anywhere('keit')} AND folder <> 'src1/de'")
def curate_remaining(spark, sf_dir):
    results = engine(spark, sf_dir).matching("keit").select("path", "folder")
    return catalogue.curate(results, None, results.filter("folder = 'src1/de'")).select("path")


@query("batch_queries", f"""{DOCS_SQL} SELECT 'a' AS query, path FROM d WHERE {anywhere('keit')} UNION ALL SELECT 'b', path FROM d WHERE {anywhere('tion')} AND {anywhere('stre')}
       UNION ALL SELECT 'c', path FROM d WHERE {anywhere('acion', 'rement')}""")
def batch_queries(spark, sf_dir):
    return engine(spark, sf_dir).batch({"a": "keit", "b": "tion stre", "c": "ación OR rement"}).select("query", "path")


NOTES = [
    ("inbox/a.md", "---\ntags: [x, y]\ncreated: 2024-05-01\n---\n# Title\nSome **bold** text\n\n- [ ] call back\n"),
    ("inbox/b.md", "- [x] done\n```\n- [ ] in code\n```\n"),
    ("inbox/c.md", "1. [/] begun\n[link](http://e.x) and `code_x`\n"),
    ("plan.canvas", '{"nodes":[{"type":"text","text":"Plan one"},{"label":"Group"}]}'),
    ("view.base", "filters:\n  - status\n"),
]


def _notes(spark) -> DataFrame:
    rows = [(p, r, corpus.EPOCH, corpus.EPOCH) for p, r in NOTES]
    return ingest.build_docs(spark.createDataFrame(rows, "path string, raw string, ctime long, mtime long"))


def _values(names: str, rows: list[tuple]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows) + f") v({names})"


@query("open_tasks", _values("path", [("inbox/a.md",), ("inbox/c.md",)]))
def open_tasks(spark, sf_dir):
    return SearchEngine(_notes(spark)).matching("", Filters(open_tasks=True)).select("path")


@query("canvas_text", _values("path, text", [("plan.canvas", "plan one group")]))
def canvas_text(spark, sf_dir):
    return _notes(spark).filter("format = 'canvas'").select("path", "text")


@query("base_lines", _values("path, text", [("view.base", "filters: - status")]))
def base_lines(spark, sf_dir):
    return _notes(spark).filter("format = 'base'").select("path", "text")


@query("markdown_blanking", _values("path, text", [
    ("inbox/a.md", "tags: [x, y] created: 2024-05-01 title some bold text call back"), ("inbox/b.md", "x done - [ ] in code"), ("inbox/c.md", "/ begun link and code_x")]))
def markdown_blanking(spark, sf_dir):
    text = F.trim(F.regexp_replace("text", " +", " "))
    return _notes(spark).filter("format = 'markdown'").select("path", text.alias("text"))


BAD = ["a OR", "foo:bar", '"open', "-", "OR a"]
BAD_ERRORS = [("a OR", "dangling-operator", 2, 4), ("foo:bar", "unknown-field", 0, 4), ('"open', "unclosed-quote", 0, 5), ("-", "dangling-operator", 0, 1), ("OR a", "dangling-operator", 0, 2)]


@query("parser_errors", _values('query, code, "start", "end"', BAD_ERRORS))
def parser_errors(spark, sf_dir):
    rows = [(q, e.code, e.start, e.end) for q in BAD for e in parse(q).errors]
    return spark.createDataFrame(rows, "query string, code string, start int, end int")


@query("snippets")
def snippet_query(spark, sf_dir):
    out = engine(spark, sf_dir).search("lichkeit", limit=20, now=corpus.NOW, snippets=2)
    return out.select("path", F.explode("snippets").alias("s")).select("path", "s.text", "s.offset", "s.jump_offset")


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return corpus.read(spark, sf_dir, "events").select("event_id", k.alias("k")).filter("k % 2 = 0")


@query("offset_positions", f"""{DOCS_SQL} SELECT path, CAST(length(x) - length(replace(x, chr(10), '')) AS INTEGER) AS line FROM (
       SELECT path, substr(raw, 1, strpos(t, 'lichkeit') - 1) AS x FROM d WHERE contains(t, 'lichkeit'))""")
def offset_positions(spark, sf_dir):
    first = F.get(F.filter("matches", lambda m: m["field"] == "body"), F.lit(0))["start"]
    hits = _hits(spark, sf_dir, "lichkeit").select("id", first.alias("at"))
    docs = corpus.documents(spark, sf_dir).select("id", "path", "raw").join(hits, "id")
    return docs.select("path", snippets.position(F.col("raw"), F.col("at"))["line"].alias("line"))


@query("fold_table", "SELECT DISTINCT CAST(length(t) = length(raw) AS BOOLEAN) AS same FROM (SELECT text AS raw, translate(lower(strip_accents(text)), 'ß', 's') AS t FROM documents)")
def fold_lengths(spark, sf_dir):
    return corpus.documents(spark, sf_dir).select((F.length("text") == F.length("raw")).alias("same")).distinct()


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: ranked hits of two terms, with excerpts."""
    out = engine(spark, sf_dir).search("heit keit OR tion", limit=50, now=corpus.NOW, snippets=2)
    return out.select("position", "path", "quality", "score", "relevance", F.size("matches").alias("n_matches"), F.get("snippets", F.lit(0))["text"].alias("excerpt"))


__all__ = ["QUERIES", "SQL", "Tuning", "entry", "formats", "matches"]
