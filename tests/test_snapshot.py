"""Versions of a graph: what a write adds, what readers see, and what happens to two writers; trees read by path."""

import os
import pathlib

import pytest
from pyspark.sql import functions as F

from lexigraph import schema as S
from lexigraph.operators import dml, manifest, snapshot
from lexigraph.plans import ingest
from lexigraph.sources import files as sources

EAGER = {"least": 0, "share": 0.5}


def mentions(spark, ids, term="t"):
    return spark.createDataFrame([(f"m{i}", f"a{i % 7}", term, term, i) for i in ids], S.MENTION)


def written(root, *names):
    return sum(p.stat().st_size for n in names for p in pathlib.Path(root, n).rglob("*.parquet"))


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """A root with one version: 20,000 mentions, some edges and artifacts with attributes."""
    root = str(tmp_path_factory.mktemp("graph"))
    many = spark.range(20_000).selectExpr("concat('m', id) as id", "concat('a', id % 7) as artifact_id", "sha2(string(id), 256) as term", "sha2(string(id + 1), 256) as normalized", "int(id) as span")
    edges = spark.createDataFrame([(f"e{i}", f"s{i}", "d", "implements" if i % 2 else "relates", "inferred", 0.5, [], "proposed") for i in range(40)], S.EDGE)
    art = spark.createDataFrame([("a1", "file", "code", "code", "r", "t", None, {"k": "v", "b": "c"})], S.ARTIFACT)
    assert snapshot.write(snapshot.empty(spark).with_tables(mentions=many, edges=edges, artifacts=art), root) == 1
    return root


def test_a_small_change_writes_little_and_old_versions_stay(spark, base):
    graph = snapshot.read(spark, base)
    before = rows(graph.edges)
    few = mentions(spark, range(100, 200), "new")
    changed = graph.mentions.join(few.select("id"), "id", "left_anti").where("id <> 'm5'").unionByName(few)
    keys = few.select("id").union(spark.createDataFrame([("m5",)], "id string"))
    assert snapshot.write(graph.with_changes("mentions", changed, keys), base, **EAGER) == 2
    entry = manifest.load(spark, f"{base}/versions/{2:010d}.json")["tables"]
    first = manifest.load(spark, f"{base}/versions/{1:010d}.json")["tables"]
    assert all(entry[n] == first[n] for n in entry if n != "mentions") and entry["mentions"]["buckets"] == first["mentions"]["buckets"]
    whole = written(base, f"data/mentions/{next(iter(first['mentions']['buckets'].values()))}")
    assert written(base, f"data/mentions/{entry['mentions']['deltas'][0]}") < 0.02 * whole
    after = snapshot.read(spark, base)
    assert after.mentions.count() == 19_999 and after.mentions.where("term = 'new'").count() == 100 and after.mentions.where("id = 'm5'").isEmpty()
    assert snapshot.read(spark, base, 1).mentions.count() == 20_000 and rows(after.edges) == before
    # the large side of a read is neither shuffled nor sorted
    plan = after.mentions._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_unknown_changes_are_found_by_digests(spark, base):
    graph = snapshot.read(spark, base)
    edges = graph.edges.withColumn("status", F.when(F.col("src_id") == "s3", "confirmed").otherwise(F.col("status"))).where("src_id <> 's4'")
    at = snapshot.write(graph.with_tables(edges=edges, artifacts=graph.artifacts), base, **EAGER)
    tables = manifest.load(spark, f"{base}/versions/{at:010d}.json")["tables"]
    delta = spark.read.parquet(f"{base}/data/edges/{tables['edges']['deltas'][-1]}")
    assert {(r["src_id"], r["_gone"]) for r in delta.collect()} == {("s3", False), ("s4", True)}
    assert spark.read.parquet(f"{base}/data/artifacts/{tables['artifacts']['deltas'][-1]}").count() == 0
    now = snapshot.read(spark, base)
    assert now.edges.count() == 39 and now.edges.where("status = 'confirmed'").count() == 1 and now.artifacts.first()["attrs"] == {"k": "v", "b": "c"}


def test_deltas_are_folded_into_the_buckets_they_touch(spark, tmp_path):
    root = str(tmp_path)
    graph = snapshot.empty(spark).with_tables(mentions=mentions(spark, range(300)))
    snapshot.write(graph, root, buckets=8)
    expect = {f"m{i}": "t" for i in range(300)}
    for step in range(4):
        graph = snapshot.read(spark, root)
        one = mentions(spark, [step], f"v{step}")
        table, made = dml.merge(graph.mentions, one, ["id"], lambda d, mine: d)
        assert made.count() == 1
        at = snapshot.write(graph.with_changes("mentions", table, made), root, least=0, share=99, most_deltas=2)
        expect[f"m{step}"] = f"v{step}"
    entry = manifest.load(spark, f"{root}/versions/{at:010d}.json")["tables"]["mentions"]
    assert len(entry["deltas"]) == 1 and 2 <= len(set(entry["buckets"].values())) <= 4
    assert {r["id"]: r["term"] for r in snapshot.read(spark, root).mentions.collect()} == expect
    snapshot.expire(spark, root, keep=1)
    assert os.listdir(f"{root}/versions").count(f"{at:010d}.json") == 1 and len(snapshot._versions(spark, root)) == 1
    assert {r["id"]: r["term"] for r in snapshot.read(spark, root).mentions.collect()} == expect


def test_writers_do_not_lose_one_anothers_work(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        snapshot.read(spark, root)

    def put(name):
        def change(graph):
            row = spark.createDataFrame([(name, 1)], S.SOURCE_FILE)
            return graph.with_changes("files", graph.files.unionByName(row), row)

        return change

    one = snapshot.update(spark, root, put("one"))
    stale = put("two")(one)
    snapshot.update(spark, root, put("three"))
    with pytest.raises(snapshot.Moved):
        snapshot.write(stale, root)
    assert {r["path"] for r in snapshot.read(spark, root).files.collect()} == {"one", "three"}
    met = []

    def slow(graph):  # another writer is first, once
        if not met:
            met.append(snapshot.update(spark, root, put("four")))
        return put("five")(graph)

    assert {r["path"] for r in snapshot.update(spark, root, slow).files.collect()} == {"one", "three", "four", "five"}
    with pytest.raises(snapshot.Moved):  # a graph that was not read from here
        snapshot.write(snapshot.empty(spark), root)


def test_a_write_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    snapshot.write(snapshot.empty(spark).with_tables(files=spark.createDataFrame([("a", 1)], S.SOURCE_FILE)), root)
    graph = snapshot.read(spark, root).with_tables(files=spark.createDataFrame([("b", 1)], S.SOURCE_FILE))
    monkeypatch.setattr(manifest, "publish", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        snapshot.write(graph, root)
    assert [r["path"] for r in snapshot.read(spark, root).files.collect()] == ["a"]


def test_a_manifest_is_published_once(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/v/1.json"
    assert manifest.publish(spark, path, {"a": 1}) and not manifest.publish(spark, path, {"a": 2})
    assert manifest.load(spark, path) == {"a": 1} and manifest.names_in(spark, f"{tmp_path}/v") == ["1.json"]
    # the way of other file systems, on this one
    jvm = spark._jvm.org.apache.hadoop.fs

    class Elsewhere:
        def __init__(self, fs):
            self.fs = fs

        def getUri(self):
            return type("U", (), {"getScheme": lambda _: "hdfs"})()

    fs, draft = manifest._path(spark, f"{tmp_path}/v/.draft")
    fs.create(draft, False).close()
    monkeypatch.setattr(manifest, "_context", lambda *_: jvm.FileContext.getLocalFSFileContext())
    assert manifest._move(spark, Elsewhere(fs), draft, path) is False
    assert manifest._move(spark, Elsewhere(fs), draft, f"{tmp_path}/v/2.json") is True


def read_files(df):
    """How many files the scans of a query have read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = 0, [plan]
    while todo:
        p = todo.pop()
        todo += [p.children().apply(i) for i in range(p.children().size())]
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        if hasattr(p, "plan") and p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            found += p.metrics().apply("numFiles").value()
    return found


def test_only_files_that_changed_are_opened(spark, tmp_path):
    root = tmp_path / "tree"
    for i in range(30):
        (root / f"m{i % 3}").mkdir(parents=True, exist_ok=True)
        (root / f"m{i % 3}/f{i}.go").write_text(f"func F{i}() {{}}\n")
    (root / "m0/notes.txt").write_text("x")
    (root / "m0/a b.go").write_text("func Spaced() {}\n")
    tree = sources.source_tree(spark, str(root))
    listing = tree.listing()
    assert listing.count() == 31 and "content" not in listing.columns
    some = listing.where("path in ('m0/f3.go', 'm0/a b.go')")
    named = tree.contents(some)
    assert {r["path"]: r["content"] for r in named.collect()} == {"m0/f3.go": "func F3() {}\n", "m0/a b.go": "func Spaced() {}\n"}
    raw = tree._raw().where(F.col("_metadata.file_path").isin([r["file_path"] for r in some.collect()])).select("content")
    assert read_files(raw) == 2
    old = 1_000_000_000
    for p in root.rglob("*.go"):
        if p.name not in ("f3.go", "a b.go"):
            os.utime(p, (old, old))
    young = tree.listing().where("path in ('m0/f3.go', 'm0/a b.go')")
    assert {r["path"] for r in tree.contents(young, named=1).collect()} == {"m0/f3.go", "m0/a b.go"}
    assert read_files(tree._raw().where(F.col("_metadata.file_modification_time") >= F.timestamp_millis(F.lit(old * 1000 + 1))).select("content")) == 2


def test_reviews_outlive_a_changed_file_and_mentions_of_gone_files_go(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "dock").mkdir(parents=True)
    (root / "dock/crane.go").write_text("func Lift() {}\nfunc Lower() {}\n")
    (root / "dock/rope.go").write_text("func Splice() {}\n")
    tree = sources.source_tree(spark, str(root))
    graph, _ = ingest.ingest_symbols(snapshot.empty(spark), tree)
    graph, _ = ingest.ingest_mentions(graph, tree)
    snapshot.write(graph, f"{tmp_path}/g")
    graph = snapshot.read(spark, f"{tmp_path}/g")
    symbol = {r["id"]: r["title"] for r in graph.artifacts.where("kind = 'code_symbol'").collect()}
    decide = graph.edges.select("id", F.lit("confirmed").alias("status"))
    graph = graph.with_tables(edges=dml.set_status(graph.edges, decide))
    (root / "dock/crane.go").write_text("func Lift() {}\nfunc Turn() {}\n")
    os.utime(root / "dock/crane.go", (5_000_000_000, 5_000_000_000))
    (root / "dock/rope.go").unlink()
    after, counted = ingest.ingest_symbols(graph, tree)
    told, said = ingest.ingest_mentions(after, tree)
    assert {r["counter"]: r["n"] for r in counted.collect()}["changed"] == 1
    assert {r["counter"]: r["n"] for r in said.collect()}["changed"] == 1
    snapshot.write(told, f"{tmp_path}/g")
    now = snapshot.read(spark, f"{tmp_path}/g")
    titles = {r["id"]: r["title"] for r in now.artifacts.where("kind = 'code_symbol'").collect()}
    assert {titles[r["src_id"]]: r["status"] for r in now.edges.collect()} == {"Lift": "confirmed", "Turn": "proposed"} and set(symbol.values()) == {"Lift", "Lower", "Splice"}
    assert {r["normalized"] for r in now.mentions.collect()} == {"lift", "turn"} and now.artifacts.where("ref like '%rope%'").isEmpty()
    again, said = ingest.ingest_mentions(now, tree)
    assert {r["counter"]: r["n"] for r in said.collect()} == {"files": 1, "changed": 0, "gone": 0, "mentions": 0} and again.mentions.count() == now.mentions.count()
