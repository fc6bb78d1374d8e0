"""The whole flow on a small product, twice, and its readable form."""

import json

from lexigraph.operators import curate, render, serve, snapshot
from lexigraph.plans import connect, ingest
from lexigraph.plans import sync as P
from lexigraph.sources import files as sources
from lexigraph.sources.registry import Config

EXPORT = {
    "repo": "shop",
    "communities": [{"label": "Ferry", "members": [{"kind": "func", "name": "Board", "file": "ferry/board.go"}]}, {"label": "Ferries", "members": [{"kind": "func", "name": "Leave", "file": "ferry/leave.go"}]}, {"label": "Noise", "members": [{"kind": "func", "name": "X", "file": "x.go"}]}],
    "calls": [{"from": "ferry/board.go#Board", "to": "x.go#X"}],
}
VERDICTS = [{"cluster": "Ferry", "name": "Ferry", "definition": "Crosses water", "confidence": 0.9}, {"cluster": "Noise", "keep": False}]


def test_sync_and_render(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps(EXPORT))
    exports = sources.code_graph_export(spark, str(tmp_path / "g.json"))
    documents = spark.createDataFrame([("r.md", "r.md", "# Ferry\nIt must sail within 30 minutes.\n")], "ref string, name string, content string")
    verdicts = curate.concept_verdicts(spark.createDataFrame([(json.dumps(VERDICTS),)], "reply string"), "reply")
    graph = P.sync(snapshot.empty(spark), f"{tmp_path}/one", [exports], [documents], verdicts)
    assert [r["name"] for r in graph.concepts.collect()] == ["Ferry"]
    assert {r["ref"] for r in serve.implementers_of(graph.edges, graph.artifacts).collect()} == {"ferry/board.go#Board", "ferry/leave.go#Leave"}
    text = render.concept_context(graph.concepts, graph.edges, graph.artifacts, "ferries")
    assert "Crosses water" in text and "rule: It must sail within 30 minutes." in text and "[go] ferry/board.go: Board" in text
    around = render.path_context(graph.concepts, graph.edges, graph.artifacts, "ferry/")
    assert "Ferry: Board, Leave" in around and "calls x.go#X" in around
    assert render.concept_context(graph.concepts, graph.edges, graph.artifacts, "nothing").startswith("No concept")
    again, _ = ingest.ingest_documents(graph, documents)
    assert again.edges.count() == graph.edges.count() and again.artifacts.count() == graph.artifacts.count()


def _tree(root, **files):
    for name, content in files.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)


def test_trees_are_read_by_what_changed(spark, tmp_path):
    """New, changed, unchanged and gone files: symbols, edges and mentions follow, counters say what was done."""
    schema = "path string, mtime long, lang string, content string"
    first = [("dock/crane.go", 1, "go", "func Lift() {}\nfunc Lower() {}\n"), ("dock/rope.py", 1, "python", "def splice():\n    pass\n"), ("dock/view.tsx", 1, "tsx", "const x = 1")]
    graph, counted = ingest.ingest_symbols(snapshot.empty(spark), spark.createDataFrame(first, schema))
    assert {r["counter"]: r["n"] for r in counted.collect()} == {"files": 2, "changed": 2, "gone": 0, "symbols": 3, "concepts": 1, "links": 3, "skipped_files": 1}
    snapshot.write(graph, f"{tmp_path}/g")
    graph = snapshot.read(spark, f"{tmp_path}/g")
    _, counted = ingest.ingest_symbols(graph, spark.createDataFrame(first, schema))
    assert {r["counter"]: r["n"] for r in counted.collect()}["changed"] == 0
    second = [("dock/crane.go", 2, "go", "func Lift() {}\nfunc Turn() {}\n"), ("quay/bell.go", 1, "go", "func Ring() {}")]
    listing = spark.createDataFrame(second, schema)
    assert tuple(ingest.file_counts(graph.files, listing).first()) == (2, 2)
    after, counted = ingest.ingest_symbols(graph, listing)
    assert {r["counter"]: r["n"] for r in counted.collect()} == {"files": 2, "changed": 2, "gone": 1, "symbols": 3, "concepts": 2, "links": 3, "skipped_files": 0}
    assert {r["ref"] for r in after.artifacts.where("kind = 'code_symbol'").collect()} == {"dock/crane.go#Lift", "dock/crane.go#Turn", "quay/bell.go#Ring"}
    assert after.edges.count() == 3 and {r["name"] for r in after.concepts.collect()} == {"Dock", "Quay"}
    assert tuple(ingest.file_counts(after.files, listing).first()) == (2, 0)
    told, counted = ingest.ingest_mentions(after, listing)
    again, _ = ingest.ingest_mentions(told, listing)
    assert told.mentions.where("normalized = 'ring'").count() == 1 and again.mentions.count() == told.mentions.count()
    assert told.mentions.join(told.artifacts, told.mentions["artifact_id"] == told.artifacts["id"], "left_anti").count() == 0


def test_sources_run_by_phase_and_faults_are_reported(spark, tmp_path):
    _tree(tmp_path / "src", dock__crane_go="", **{"dock__crane.go": "func Lift() {}\n", "quay__bell.go": "func Ring() {}\n"})
    _tree(tmp_path / "docs", **{"a.md": "# Dock\nThe crane must rest at night.\n"})
    spark.createDataFrame([("http://h/quay", "<h1>Quay</h1><p>It shall be dry.</p>"), ("http://h/other", "<h1>Dock</h1>")], "url string, html string").write.parquet(f"{tmp_path}/pages")
    (tmp_path / "urls").write_text("# those we want\nhttp://h/quay\n\nhttp://h/quay\n")
    for name, rows, kind in (("files", [(1, "pier\\x.go")], "id long, path string"), ("symbols", [("Moor", "func", 1), ("fmt", "import", 1)], "name string, kind string, file_id long")):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/index/{name}")
    (tmp_path / "lexigraph.yml").write_text(f"""
sources:
  - {{type: docs, path: {tmp_path}/docs}}
  - {{type: web, path: {tmp_path}/pages, urls: {tmp_path}/urls}}
  - {{type: symbols, path: {tmp_path}/src}}
  - {{type: codegraph, path: {tmp_path}/nowhere.json}}
  - {{type: codegraph}}
  - {{type: astindex, path: {tmp_path}/index}}
  - {{type: letters, path: x}}
review: {{acceptAbove: 0.7}}
""")
    config = connect.find_config(str(tmp_path))
    assert connect.find_config(str(tmp_path / "src")) == Config() and config.accept_above == 0.7
    graph, reports = connect.sync_sources(spark, snapshot.empty(spark), f"{tmp_path}/graph", config)
    assert [(r.source, r.failed) for r in reports] == [("symbols", False), ("codegraph", True), ("codegraph", False), ("astindex", False), ("letters", True), ("docs", False), ("web", False)]
    said = [r.said for r in reports]
    assert said[0].startswith("2 files, 2 changed") and said[2] == "no path configured" and "1 symbols, 1 concepts" in said[3] and "1 rules" in said[5] and said[6].startswith("1 docs")
    assert {r["name"] for r in graph.concepts.collect()} == {"Dock", "Quay", "Pier"}
    assert graph.edges.where("type = 'describes' and status = 'confirmed'").count() == 2
    again, reports = connect.sync_sources(spark, graph, f"{tmp_path}/graph", config)
    assert "0 changed" in reports[0].said and again.edges.count() == graph.edges.count() and again.concepts.count() == 3
