import itertools
import random

import pytest

from notegrove import queries
from notegrove.config import Settings
from notegrove.sources import store
from notegrove.sources.ingest import build_docs, live_files, read_files
from notegrove.streaming import changes
from notegrove.streaming.changes import Pending, fold_changes


def files(spark, rows):
    return spark.createDataFrame([(p, r, 1, m) for p, r, m in rows], "path string, raw string, ctime long, mtime long")


def test_versions(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    settings = Settings()
    assert s.load(settings).reason == "missing"
    docs = build_docs(files(spark, [("a.md", "one", 1), ("b/c.md", "two", 2)]))
    s.write(docs, settings, 5)
    assert s.load(settings).docs.count() == 2
    assert s.load(settings, force=True).reason == "forced"
    assert s.load(Settings(created_field="x")).reason == "settings"
    assert store.Store(spark, s.root, "other").load(settings).reason == "vault"
    s.put(build_docs(files(spark, [("a.md", "new", 9)])), settings, 6)
    assert {r.path: r.raw for r in s.load(settings).docs.collect()} == {"a.md": "new", "b/c.md": "two"}
    assert {r.indexed_mtime for r in s.stats(settings).collect()} == {9, 2}
    assert {r.path for r in s.seed(Settings()).collect()} == {"a.md", "b/c.md"}
    s.delete(docs.filter("path = 'a.md'"), "path", settings, 7)
    assert s.load(settings).docs.count() == 1 and s.meta()["version"] == 3
    broken = s.load(settings).docs.selectExpr(*["null as text" if f == "text" else f for f in docs.columns])
    s.write(broken.select(*[broken[c].cast(docs.schema[c].dataType) for c in docs.columns]), settings, 8)
    assert s.load(settings).reason == "corrupt"
    s.clear()
    assert s.load(settings).reason == "missing"


def test_fingerprint_ignores_order():
    a, b = Settings(excluded_folders=("x", "y/")), Settings(excluded_folders=("y", "x"))
    assert store.fingerprint(a) == store.fingerprint(b) != store.fingerprint(Settings())


def test_staleness(spark):
    docs = build_docs(files(spark, [("a.md", "1", 1), ("b.md", "2", 1), ("c.md", "3", 1)]))
    live = files(spark, [("a.md", "1", 1), ("b.md", "2", 5), ("d.md", "4", 1)])
    assert {r.path for r in store.stale_files(live, docs).collect()} == {"b.md", "d.md"}
    assert {r.path for r in store.drop_vanished(docs, live).collect()} == {"a.md", "b.md"}


def test_read_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "sub" / "b.CANVAS").write_text("{}")
    (tmp_path / "c.txt").write_text("no")
    found = read_files(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == {"a.md", "sub/b.CANVAS"}
    assert {r.path for r in live_files(found, Settings(excluded_folders=("sub",))).collect()} == {"a.md"}


def test_fold_rules():
    assert fold_changes([("renamed", "b", "a")]) == {"b": Pending("move", "a")}
    assert fold_changes([("modified", "a", None), ("renamed", "b", "a")]) == {"b": Pending("index", "a")}
    assert fold_changes([("deleted", "a", None), ("renamed", "b", "a")]) == {"b": Pending("delete", "a")}
    assert fold_changes([("renamed", "x", "a"), ("renamed", "x", "b")]) == {"a": Pending("delete"), "x": Pending("move", "b")}


def test_apply_keeps_ids_and_counts(spark):
    docs = build_docs(files(spark, [("a.md", "one", 1), ("b.md", "two", 1), ("c.md", "three", 1)])).cache()
    ids = {r.path: r.id for r in docs.collect()}
    events = [
        (1, "renamed", "d/x.md", "a.md", None),
        (2, "modified", "b.md", None, "TWO"),
        (3, "modified", "b.md", None, "zwei"),
        (4, "deleted", "c.md", None, None),
        (5, "created", "n.md", None, "new"),
        (6, "created", "n.txt", None, "no"),
    ]
    batch = spark.createDataFrame([(s, k, p, o, r, 5, 5) for s, k, p, o, r in events], changes.CHANGES)
    after = {r.path: r for r in changes.apply_changes(docs, batch).collect()}
    assert set(after) == {"d/x.md", "b.md", "n.md"}
    assert after["d/x.md"].id == ids["a.md"] and after["d/x.md"].raw == "one" and after["d/x.md"].folder == "d"
    assert after["b.md"].id == ids["b.md"] and after["b.md"].text == "zwei"


def test_random_feeds_end_where_a_replay_ends(spark):
    """Contents by path after folding equal those of applying every event in turn."""
    rng = random.Random(4)
    names = [f"{c}.md" for c in "abcde"]
    for _ in range(4):
        state = {n: f"old {n}" for n in names[:3]}
        docs = build_docs(files(spark, [(p, t, 1) for p, t in state.items()]))
        events = []
        for seq in itertools.count():
            if seq == 8:
                break
            kind = rng.choice(["created", "modified", "deleted", "renamed"])
            if kind == "renamed":
                free = [n for n in names if n not in state]
                if not state or not free:
                    continue
                old, new = rng.choice(sorted(state)), rng.choice(free)
                state[new] = state.pop(old)
                events.append((seq, kind, new, old, state[new], 5, 5 + seq))
            elif kind == "deleted":
                if state:
                    gone = rng.choice(sorted(state))
                    del state[gone]
                    events.append((seq, kind, gone, None, None, 5, 5))
            else:
                path = rng.choice(names)
                state[path] = f"new {seq}"
                events.append((seq, kind, path, None, state[path], 5, 5 + seq))
        batch = spark.createDataFrame(events, changes.CHANGES)
        rows = changes.apply_changes(docs, batch).collect()
        assert {r.path: r.raw for r in rows} == state, events
        assert len({r.id for r in rows}) == len(rows)


def test_follow_a_stream(spark, tmp_path):
    feed = f"{tmp_path}/feed"
    spark.createDataFrame([(1, "created", "a.md", None, "alpha", 1, 1)], changes.CHANGES).write.parquet(f"{feed}/1")
    s = store.Store(spark, f"{tmp_path}/store")
    changes.follow(spark, f"{feed}/*", s, checkpoint=f"{tmp_path}/cp").awaitTermination(120)
    assert [r.text for r in s.load(Settings()).docs.collect()] == ["alpha"]


@pytest.mark.parametrize("newest_first", [False, True])
def test_apply_changes_begins_with_the_same_records_however_rows_come(spark, tmp_path, monkeypatch, newest_first):
    """The records are read more than once, so an arbitrary one of a path's would not do."""
    events = spark.range(197).selectExpr("id AS event_id", "timestamp_millis(1704067200000 + id * 1000) AS ts", "id % 3 AS user_id", "'k' || (100 + id) AS props")
    events.coalesce(1).sortWithinPartitions("event_id", ascending=not newest_first).write.parquet(f"{tmp_path}/events.parquet")
    seen, apply = [], changes.apply_changes
    monkeypatch.setattr(changes, "apply_changes", lambda docs, batch: seen.append(docs) or apply(docs, batch))
    out = queries.QUERIES["apply_changes"](spark, str(tmp_path))
    newest = lambda ids: {f"u/{u}.md": f"k{100 + max(i for i in ids if i % 3 == u)}" for u in range(3)}
    assert {r.path: r.raw for r in seen[0].collect()} == newest(range(0, 197, 10))
    live = {p: raw for p, raw in newest(range(197)).items() if (int(raw[1:]) - 100) % 7}
    assert {r.path: r.raw for r in out.collect()} == live and len(live) == 2
