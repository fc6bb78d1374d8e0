"""Search by index, texts of all keys, and the live usage log."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexigraph import schema as S
from lexigraph.operators import render, search, serve, snapshot
from lexigraph.streaming import live

R = random.Random(8)


def concepts(spark, n=150):
    word = lambda: "".join(R.choice("abcé ÅK-_%") for _ in range(R.randint(1, 9)))
    rows = [(f"c{i}", word() or "x", word() if i % 3 else None, None, [word() for _ in range(i % 4)] if i % 5 else None, "candidate") for i in range(n)]
    return spark.createDataFrame(rows, S.CONCEPT)


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    df = concepts(spark)
    path = f"{tmp_path}/index"
    search.write_index(df, path, buckets=16)
    texts = [t for r in df.collect() for t in (r["name"], r["definition"], *(r["aliases"] or [])) if t]
    asked = ["", "a", "ab", "none at all", "ABC", "é Å"] + [t[i : i + R.randint(3, 6)] for t in R.sample(texts, 12) for i in [R.randrange(len(t))]]
    for q in asked:
        want = [tuple(r) for r in serve.search_concepts(df, q, 1000).select("id", "name").collect()]
        assert [tuple(r) for r in search.search(spark, path, df, q, 1000, buckets=16).select("id", "name").collect()] == want, q
    plan = search.candidates(spark, path, "abcé", buckets=16)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan and "PushedFilters: [In(run" in plan


def test_an_index_serves_all_versions_of_its_table(spark, tmp_path):
    root = str(tmp_path)
    snapshot.write(snapshot.empty(spark).with_tables(concepts=concepts(spark, 20)), root)
    first = search.index_of(spark, root)
    snapshot.write(snapshot.read(spark, root).with_tables(files=spark.createDataFrame([("a", 1)], S.SOURCE_FILE)), root)
    assert search.index_of(spark, root) == first
    graph = snapshot.read(spark, root)
    snapshot.write(graph.with_tables(concepts=graph.concepts.union(spark.createDataFrame([("new", "Brand new", None, None, [], "candidate")], S.CONCEPT))), root)
    assert search.index_of(spark, root) != first and [r["id"] for r in search.find(spark, root, "nd NE").collect()] == ["new"]


def test_texts_of_all_concepts_say_what_each_alone_does(spark):
    ids = [f"c{i}" for i in range(8)]
    table = spark.createDataFrame([(i, f"Name {i}", "d" if i != "c3" else None, None, [], "candidate") for i in ids], S.CONCEPT)
    edge = lambda s, d, t, c: (f"{s}{d}", s, d, t, "inferred", c, [], "proposed")
    rows = [edge(f"s{i}", ids[i % 5], "implements", 0.6) for i in range(30)] + [edge(f"r{i}", ids[i % 3], "constrains", 0.6) for i in range(30)]
    rows += [edge(f"d{i}", ids[i % 3], "describes", 0.9 + i / 1000) for i in range(24)] + [edge(a, b, "relates", 0.7 + len(a + b) / 100) for a in ids for b in ids if a < b]
    edges = spark.createDataFrame(rows, S.EDGE)
    art = lambda i, kind, ref: (i, kind, "code", "code", ref, ref.split("/")[-1], None, None)
    artifacts = spark.createDataFrame([art(f"s{i}", "code_symbol", f"src/m{i % 4}/f{i % 2}.go#S{i}") for i in range(30)] + [art(f"r{i}", "rule", f"rule:{i:02d}") for i in range(30)] + [art(f"d{i}", "doc", f"docs/{i:02d}") for i in range(24)], S.ARTIFACT)
    made = render.concept_texts(table, edges, artifacts)
    got = {r["id"]: r["text"] for r in made.collect()}
    assert got == {i: render.concept_context(table, edges, artifacts, f"Name {i}") for i in ids}
    assert render.concept_texts(table, edges, artifacts, files=1).where("id = 'c0'").first()["text"].splitlines()[-1].endswith("more files")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4 and "Partial" in plan
    paths = {r["path"]: r["text"] for r in render.path_texts(table, edges, artifacts).collect()}
    assert set(paths) == {"src/", *(f"src/m{i}/" for i in range(4))}
    for path, text in paths.items():
        assert text == render.why_code(table, edges, artifacts, path)


def lines(events):
    return "\n".join(json.dumps(dict(zip(("ts", "tool", "q", "hit", "chars", "ms"), e))) for e in events) + "\n"


def test_live_usage_counts_each_event_once(spark, tmp_path, monkeypatch):
    """Late and repeated events, a batch that breaks off, and a restart: as one pass over the distinct events."""
    day = 86_400_000
    events = [(1_700_000_000_000 + R.randrange(4) * day + i * 1000, R.choice("ab"), R.choice(["x", None]), i % 3 == 0, i, i * 2) for i in range(120)]
    log, store, at = tmp_path / "log", f"{tmp_path}/store", f"{tmp_path}/at"
    log.mkdir()
    follow = lambda: live.start(spark, str(log), store, at, files_per_batch=1).awaitTermination()
    (log / "a.json").write_text(lines(events[40:90]))
    follow()
    (log / "b.json").write_text(lines(events[:60] + events[:5]))
    real = live.stored_events
    monkeypatch.setattr(live, "stored_events", lambda *a: 1 / 0)
    with pytest.raises(Exception):
        follow()
    monkeypatch.setattr(live, "stored_events", real)
    follow()
    live.merge_into(store)(spark.read.schema(S.USAGE_EVENT).json(str(log / "b.json")), 1)  # the batch again
    (log / "c.json").write_text("broken\n" + lines(events[80:]))
    follow()
    assert sorted(map(str, (tuple(r[:6]) for r in live.stored_events(spark, store).select(*S.USAGE_EVENT.fieldNames()).collect()))) == sorted(map(str, events))
    want = spark.createDataFrame(events, S.USAGE_EVENT).groupBy(F.to_date(F.timestamp_millis("ts")).alias("day"), "tool").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.sum(F.col("chars").cast("long")).alias("chars"), F.sum("ms").alias("ms"))
    assert sorted(map(tuple, live.daily(spark, store).collect())) == sorted(map(tuple, want.collect()))
    assert live.daily(spark, f"{tmp_path}/nowhere").count() == 0
