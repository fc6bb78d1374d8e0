"""Graph operators: gates, calls, merging, verdicts, deletes, upserts, documents, code, files, streams."""

import json
import re

import pytest
from pyspark.sql import functions as F

from lexigraph import schema as S
from lexigraph.operators import beyond, code, curate, dml, docs, evals, export, ranks, render, serve, snapshot
from lexigraph.sources import files as sources
from lexigraph.sources import registry
from lexigraph.streaming import usage as windows

C = "id string, name string, definition string, bounded_context string, aliases array<string>, status string"
E = "id string, src_id string, dst_id string, type string, source string, confidence double, status string"
A = "id string, kind string, layer string, source string, ref string, title string, body string"


def concept(i, name, definition=None, aliases=()):
    return (i, name, definition, None, list(aliases), "candidate")


def edge(src, dst, type_, confidence, status="proposed"):
    return (f"{src}>{dst}", src, dst, type_, "inferred", confidence, status)


def art(i, kind, ref):
    return (i, kind, "code", "code", ref, ref.split("#")[-1], None)


def test_gates(spark):
    """Each gate at its bar, under it, confirmed under it, and rejected over it."""
    names = {"tide": "d", "quay": "d", "rope": "d", "crew": "d", "fog": None, "buoy": " "}
    concepts = spark.createDataFrame([concept(i, i.title(), d) for i, d in names.items()], C)
    rows = [edge("tide", "quay", "relates", 0.7), edge("tide", "rope", "relates", 0.69), edge("tide", "fog", "relates", 0.95), edge("tide", "buoy", "relates", 0.95), edge("crew", "tide", "relates", 0.1, "confirmed"), edge("rope", "crew", "relates", 1.0, "rejected")]
    rows += [edge("n1", "tide", "describes", 0.9), edge("n2", "tide", "describes", 0.89), edge("n3", "tide", "describes", 0.2, "confirmed"), edge("n4", "tide", "describes", 0.99, "rejected")]
    edges = spark.createDataFrame(rows, E)
    artifacts = spark.createDataFrame([art(f"n{i}", "doc", f"notes/{i}.md#top") for i in range(1, 5)], A)
    near = serve.related_concepts(concepts, edges)
    assert {r["other_name"] for r in near.where("concept_id = 'tide'").collect()} == {"Quay", "Crew"} and near.where("concept_id = 'rope'").count() == 0
    assert {r["ref"] for r in serve.describing_docs(edges, artifacts).collect()} == {"notes/1.md#top", "notes/3.md#top"}


def test_calls_split_by_path(spark):
    refs = {"a": "lock/gate.go#Open", "b": "lock/gate.go#Shut", "c": "tide/clock.go#Now", "d": "cmd/run.go#Start", "e": "locker/box.go#Put"}
    artifacts = spark.createDataFrame([art(i, "code_symbol", r) for i, r in refs.items()], A)
    calls = [edge("a", "c", "calls", 1.0, "confirmed"), edge("d", "a", "calls", 1.0, "proposed"), edge("a", "b", "calls", 1.0, "confirmed"), edge("e", "b", "calls", 1.0, "rejected"), edge("d", "c", "calls", 1.0, "confirmed")]
    edges = spark.createDataFrame(calls, E)
    assert [r["dst_ref"] for r in serve.calls_from_path(edges, artifacts, "lock/").collect()] == [refs["b"], refs["c"]]
    assert [r["src_ref"] for r in serve.calls_into_path(edges, artifacts, "lock/").collect()] == [refs["d"]]
    assert serve.calls_into_path(edges, artifacts, "tide", limit=1).collect()[0]["src_ref"] == refs["d"]


def test_merging_names(spark):
    concepts = spark.createDataFrame([concept("1", "Ferry", "d", ["boat"]), concept("2", "Ferries", "d"), concept("3", "ferry"), concept("4", "Pier")], C)
    edges = spark.createDataFrame([edge("e", "1", "implements", 1.0, "confirmed"), edge("f", "1", "implements", 0.6), edge("d", "2", "implements", 1.0, "confirmed"), edge("e", "3", "implements", 0.9), edge("2", "1", "relates", 0.9), edge("x", "x", "calls", 1.0, "confirmed")], E)
    kept, moved, mapping = curate.dedupe_by_name(concepts, edges)
    assert {r["name"] for r in kept.collect()} == {"Ferry", "Pier"} and {(r["id"], r["survivor"]) for r in mapping.collect()} == {("2", "1"), ("3", "1")}
    assert {(r["src_id"], r["dst_id"], r["confidence"]) for r in moved.collect()} == {("e", "1", 1.0), ("f", "1", 0.6), ("d", "1", 1.0), ("x", "x", 1.0)}
    terms = spark.createDataFrame([("ferries",), ("BOAT",), ("Raft",)], "term string")
    assert {r["term"]: r["concept_id"] for r in serve.resolve_terms(kept, terms).collect()} == {"ferries": "1", "BOAT": "1", "Raft": None}
    again, _, more = curate.dedupe_by_name(kept, moved)
    assert more.count() == 0 and again.count() == 2
    assert curate.repoint_edges(edges, mapping, all_self_loops=True).where("type = 'calls'").count() == 0


def test_rule_verdicts(spark):
    """The last verdict of an id holds; blank and equal wordings change nothing; no verdict leaves a rule as it is."""
    edges = spark.createDataFrame([edge(f"r{i}", "c", "constrains", 0.6) for i in range(1, 6)], E)
    rules = spark.createDataFrame([(f"r{i}", "rule", "product", "docs", f"rule:{i}", f"ropes number {i} must hold", f"ropes number {i} must hold") for i in range(1, 6)], A)
    concepts = spark.createDataFrame([concept("c", "Rope", "d")], C)
    verdicts = [{"id": 1, "keep": False, "refined": "gone"}, {"id": 1, "keep": True, "refined": "  Rope one holds.  "}, {"id": 2, "keep": False}, {"id": 3, "keep": True, "refined": "   "}, {"id": 4, "keep": True, "refined": " ropes number 4 must hold "}]
    reply = spark.createDataFrame([("here you are " + json.dumps(verdicts) + " bye", 0), ("no array at all", 0)], "reply string, batch int")
    candidates = serve.candidate_rules(edges, rules, concepts)
    after, renamed = curate.refine_rules(edges, rules, candidates, curate.rule_verdicts(reply, "reply"))
    assert {r["src_id"]: r["status"] for r in after.collect()} == {"r1": "confirmed", "r2": "rejected", "r3": "confirmed", "r4": "confirmed", "r5": "proposed"}
    titles = {r["id"]: r["title"] for r in renamed.collect()}
    assert titles["r1"] == "Rope one holds." and all(titles[f"r{i}"] == f"ropes number {i} must hold" for i in range(2, 6))
    # without a batch, one reply serves every batch
    twos, _ = curate.refine_rules(edges, rules, candidates, curate.rule_verdicts(reply, "reply").drop("batch"), batch=2)
    assert {r["src_id"]: r["status"] for r in twos.collect()} == {"r1": "confirmed", "r2": "rejected", "r3": "confirmed", "r4": "rejected", "r5": "confirmed"}
    with pytest.raises(ValueError):
        curate.refine_rules(edges, rules, candidates, curate.rule_verdicts(reply.where("reply like 'no%'"), "reply"))


def test_batches_number_all_rows_in_ranges(spark):
    rows = [(f"n{(7919 * i) % 30011:05d}" if i % 100 else None, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "name string, i long").repartition(3)
    made = ranks.batches(df, [], [F.col("name"), F.col("i")], 12)
    assert made.columns == ["name", "i", "batch", "id"]
    got = sorted((r["batch"] * 12 + r["id"] - 1, r["name"] or "", r["i"]) for r in made.collect())
    assert got == [(n, *r) for n, r in enumerate(sorted((name or "", i) for name, i in rows))]
    assert "SinglePartition" not in made._jdf.queryExecution().executedPlan().toString()
    assert ranks.batches(df.limit(0), [], [F.col("name")], 12).count() == 0


def test_every_rule_gets_its_verdict(spark, monkeypatch):
    from lexigraph.plans import catalogue
    from lexigraph.plans import fixtures as X

    own = [(f"r{i:05d}", X.VOCABULARY[0][0]) for i in range(5000)]
    edges = spark.createDataFrame([edge(r, c, "constrains", 0.6) for r, c in own], E)
    rules = spark.createDataFrame([art(r, "rule", r) for r, _ in own], A)
    monkeypatch.setattr(catalogue, "_rule_graph", lambda *_: (edges, rules))
    status = [r["status"] for r in catalogue.refine_apply(spark, "").orderBy("rule").collect()]
    assert status == ["rejected" if n % 3 == 0 else "proposed" if n % 5 == 0 else "confirmed" for n in (i % 12 + 1 for i in range(5000))]
    assert catalogue.candidate_rules(spark, "").count() == 5000
    assert serve.candidate_rules(edges, rules, X.vocabulary(spark)).count() == 1000


def test_concept_verdicts(spark):
    concepts = spark.createDataFrame([concept(i, n) for i, n in (("1", "Lock"), ("2", "Noise"), ("3", "Later"), ("4", "Doubt"), ("5", "Blank"))], C)
    edges = spark.createDataFrame([edge("s", i, "implements", 0.6) for i in "12345"], E)
    verdicts = [{"cluster": "Lock", "keep": False}, {"cluster": "Lock", "name": "Ship lock", "definition": " d ", "confidence": 0.9}, {"cluster": "Noise", "keep": False}, {"cluster": "Doubt", "confidence": 0.49}, {"cluster": "Blank", "name": "  ", "definition": " "}]
    reply = spark.createDataFrame([(json.dumps(verdicts[:1]), 1), (json.dumps(verdicts[1:]), 2)], "reply string, reply_no int")
    kept, left = curate.canonicalize(concepts, edges, concepts.select("id", "name"), curate.concept_verdicts(reply, "reply"))
    assert {r["name"]: r["definition"] for r in kept.collect()} == {"Ship lock": "d", "Later": None, "Blank": None}
    assert {r["dst_id"] for r in left.collect()} == {"1", "3", "5"}


def test_upserts(spark):
    delta = spark.createDataFrame([("a", "b", "relates", "one", 0.4, "proposed", 1), ("a", "b", "relates", "two", 0.8, "proposed", 2)], "src_id string, dst_id string, type string, source string, confidence double, status string, _seq long")
    once = dml.upsert_edges(delta)
    row = once.first()
    assert once.count() == 1 and (row["source"], row["confidence"]) == ("one", 0.8)
    stored = once.withColumn("status", F.lit("rejected"))
    assert dml.upsert_edges(delta, stored).first()["status"] == "rejected"
    assert dml.upsert_edges(delta, stored, keep_review=False).first()["status"] == "proposed"
    assert sorted(map(tuple, dml.upsert_edges(delta, once).collect())) == sorted(map(tuple, once.collect()))
    arts = spark.createDataFrame([("code", "r", "file", {"k": "1"}, 1), ("code", "r", "code_symbol", {"k": "2"}, 2)], "source string, ref string, kind string, attrs map<string,string>, _seq long")
    got = dml.upsert_artifacts(arts).first()
    assert got["kind"] == "file" and got["attrs"] == {"k": "2"}


def test_deletes_leave_nothing_dangling(spark):
    artifacts = spark.createDataFrame([art("1", "code_symbol", "a.go#X"), art("2", "file", "a.go"), art("3", "code_symbol", "a.gox#Y")], A)
    edges = spark.createDataFrame([edge("1", "3", "calls", 1.0), edge("3", "3", "calls", 1.0)], E)
    mentions = spark.createDataFrame([("1",), ("3",)], "artifact_id string")
    left, e, m = dml.delete_file_artifacts(artifacts, edges, mentions, spark.createDataFrame([("a.go",)], "path string"))
    assert [r["id"] for r in left.collect()] == ["3"] and e.count() == 1 and m.count() == 1


def test_aliases_fold_case(spark):
    concepts = spark.createDataFrame([concept("1", "Lock", None, ["Gate"])], C)
    extra = spark.createDataFrame([("1", "GATE", 1), ("1", "lock", 2), ("1", "Sluice", 3), ("1", "sluICE", 4)], "id string, alias string, pos int")
    assert dml.add_aliases(concepts, extra).first()["aliases"] == ["Gate", "Sluice"]


def test_linking_documents(spark):
    concepts = spark.createDataFrame([concept("1", "TideTable", "d", ["ebb"]), concept("2", "Ferry", "d")], C)
    text = "before\n# Tide Table\nIt must hang on the wall. See the ferry.\n## Other\nebb and Ferry\n"
    made = docs.link_docs(spark.createDataFrame([("a.md", "a.md", text)], "ref string, name string, content string"), concepts)
    assert {(r["kind"], r["title"]) for r in made.artifacts.collect()} == {("doc", "Tide Table"), ("doc", "Other"), ("rule", "It must hang on the wall.")}
    edges = sorted((r["type"], round(r["confidence"], 2)) for r in made.edges.collect())
    assert edges == [("constrains", 0.6), ("describes", 0.6), ("describes", 0.6), ("describes", 0.6), ("describes", 0.9), ("relates", 0.5)]
    assert [r["alias"] for r in made.aliases.collect()] == ["Tide Table"]
    assert docs.link_docs(spark.createDataFrame([("a", "a", text)], "ref string, name string, content string"), concepts.limit(0)).edges.count() == 0


def test_forms_of_all_kinds_are_found_with_their_borders(spark):
    forms = ["+++", "C++", "a\\E.b", "tide table", "Übung", "--", "x y z w", "$"]
    concepts = spark.createDataFrame([(str(i), f) for i, f in enumerate(forms)], "concept_id string, form string")
    texts = ["one +++ two", "a+++b", "++++", "C++ code", "aC++", "see a\\E.b here", "Tide  Table", "TIDE TABLE!", "die übung", "übungen", "a -- b", "x y z w v", "cost $ 5", "cost5$", ""]
    sections = spark.createDataFrame([("r", i, "$" if t == "C++ code" else "(intro)", t) for i, t in enumerate(texts)], "ref string, idx int, heading string, body string")
    got = {(r["idx"], r["concept_id"], r["heading_hit"]) for r in docs.dictionary_match(sections, concepts).collect()}
    want = set()
    for i, t in enumerate(texts):
        whole = "$\n" + t if t == "C++ code" else t
        for k, f in enumerate(forms):
            if re.search(r"(^|[^\w])" + re.escape(f) + r"([^\w]|$)", whole, re.I):
                want.add((i, str(k), t == "C++ code" and f == "$"))
    assert got == want and len(want) == 10


def test_source_files_symbols_and_staleness(spark, tmp_path):
    (tmp_path / "lock").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "lock/gate.go").write_text("package lock\nfunc Open() {}\nfunc Shut() {}\n")
    (tmp_path / "lock/pump.py").write_text('def drain_basin():\n    "the basin"\n')
    (tmp_path / "node_modules/x.go").write_text("func Hidden() {}\n")
    (tmp_path / "README.md").write_text("# Hi\n")
    found = sources.source_files(spark, str(tmp_path))
    assert {r["path"] for r in found.collect()} == {"lock/gate.go", "lock/pump.py"}
    symbols = code.find_symbols(found)
    assert {r["name"] for r in symbols.collect()} == {"Open", "Shut", "drain_basin"}
    artifacts, names, edges = code.symbol_graph(symbols)
    assert artifacts.count() == 3 and [r["name"] for r in names.collect()] == ["Lock"] and edges.count() == 3
    assert code.find_mentions(found).where("normalized like '%basin%'").count() >= 1
    assert [r["name"] for r in sources.document_files(spark, str(tmp_path)).collect()] == ["README.md"]
    stored, listed = spark.createDataFrame([("a", 1)], S.SOURCE_FILE), spark.createDataFrame([("a", 2)], S.SOURCE_FILE)
    assert dml.stale_files(stored, listed).count() == 1 and dml.stale_files(listed, listed).count() == 0


def test_code_graphs_and_prefixes(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"repo": "r", "extra": 1, "communities": [{"label": "Lock", "members": [{"kind": "func", "name": "Open", "file": "a\\b.go"}]}], "calls": [{"from": "a/b.go#Open", "to": "c.go#Turn"}]}))
    artifacts, names, edges = code.code_graph(sources.code_graph_export(spark, str(tmp_path / "g.json")))
    assert {(r["kind"], r["ref"]) for r in artifacts.collect()} == {("file", "a/b.go"), ("code_symbol", "a/b.go#Open"), ("code_symbol", "c.go#Turn")}
    assert artifacts.where("ref = 'a/b.go#Open'").first()["attrs"] == {"symbolKind": "func"} and edges.count() == 2 and names.count() == 1
    modules = spark.createDataFrame([("core", "src"), ("lock", "src/lock"), ("x", "  ")], "name string, path string")
    files = spark.createDataFrame([("src/lock/a.go",), ("src/b.go",), ("lib/c.go",)], "file string")
    assert {r["file"]: r["module"] for r in code.longest_prefix_module(files, modules).collect()} == {"src/lock/a.go": "Lock", "src/b.go": "Core", "lib/c.go": "Lib"}


def test_snapshot_round_trip(spark, tmp_path):
    odd = [("1", "unheard of", "nowhere", "code", "r", "t", None), ("2", "rule", "product", "docs", "q", "t", None)]
    g = snapshot.empty(spark).with_tables(concepts=spark.createDataFrame([concept("1", "A"), ("2", "B", None, None, [], "odd")], C), artifacts=spark.createDataFrame(odd, A))
    snapshot.write(g, str(tmp_path))
    back = snapshot.read(spark, str(tmp_path))
    assert {(r["name"], r["status"]) for r in back.concepts.collect()} == {("A", "candidate"), ("B", "candidate")}
    assert {(r["id"], r["kind"], r["layer"]) for r in back.artifacts.collect()} == {("1", "file", "code"), ("2", "rule", "product")}


def test_pages_of_a_graph(spark, tmp_path):
    nodes, links = spark.createDataFrame([("1", "A</script>")], "id string, name string"), spark.createDataFrame([("1", "2")], "src string, dst string")
    export.write_html(nodes, links, "<script>var g = __GRAPH_DATA__;</script>", f"{tmp_path}/g.html")
    page = (tmp_path / "g.html").read_text()
    assert json.loads(page[len("<script>var g = ") : -len(";</script>")].replace("<\\/", "</")) == {"nodes": [{"id": "1", "name": "A</script>"}], "links": [{"src": "1", "dst": "2"}]}
    for template, most in (("no place", 9), ("__GRAPH_DATA__", 0)):
        with pytest.raises(ValueError):
            export.write_html(nodes, links, template, f"{tmp_path}/g.html", most=most)


def test_prompts_and_usage_files(spark, tmp_path):
    candidates = spark.createDataFrame([(str(i), f"N{i}", ["s1", "s2"], ["d"]) for i in range(10)], "id string, name string, symbols array<string>, directories array<string>")
    prompts = {r["batch"]: r["prompt"] for r in render.verdict_prompts(candidates, 8).collect()}
    assert prompts[0].splitlines()[0] == "- N0: s1, s2 in d" and len(prompts[0].splitlines()) == 8 and len(prompts[1].splitlines()) == 2
    event = spark.createDataFrame([(1, "t", "q", True, 3, 4)], S.USAGE_EVENT)
    for _ in range(2):
        sources.append_usage(event, f"{tmp_path}/log")
    assert sources.usage_log(spark, f"{tmp_path}/log").count() == 2
    concepts = spark.createDataFrame([concept("c", "Tide", "d")], C)
    edges = spark.createDataFrame([edge("a", "c", "implements", 0.6)], E)
    artifacts = spark.createDataFrame([art("a", "code_symbol", "tide/clock.go#Now")], A)
    assert render.why_code(concepts, edges, artifacts, "tide/") == "Tide: Now" and "no concept" in render.why_code(concepts, edges, artifacts, "x")
    stale = spark.createDataFrame([("tide/clock.go",), ("other.go",)], "path string")
    assert "1 files here have changed" in render.path_context(concepts, edges, artifacts, "tide/", stale=stale)


def test_an_upsert_of_one_path_reads_its_keys_alone(spark):
    """The path's keys stand in the scan's filters, below the upsert's aggregation."""
    from lexigraph.plans import fixtures as X

    d = "/root/testdata/sf0.001"
    own = serve.concepts_for_path(X.concepts(spark, d), X.implements(spark, d), X.artifacts(spark, d), "A")
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate [src_id") :]  # of the upsert
    assert " IN (" in below or " INSET " in below
    assert "SinglePartition" not in own._jdf.queryExecution().executedPlan().toString()


def test_exact_p_values(spark):
    df = spark.createDataFrame([(4, 0), (6, 0), (7, 1), (0, 0)], "b long, c long")
    got = [round(r["p"], 4) for r in df.select("b", evals.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).orderBy(F.desc("b")).collect()]
    assert got == [0.0703, 0.0312, 0.125, 1.0]


def test_export_drops_loops_and_dangling(spark):
    concepts = spark.createDataFrame([concept("1", "A", "d"), concept("2", "B")], C)
    edges = spark.createDataFrame([edge("1", "2", "relates", 0.5), edge("1", "1", "relates", 0.5), edge("1", "9", "relates", 0.5)], E)
    assert export.export_links(concepts, edges).count() == 1 and export.export_links(concepts, edges, True).count() == 0


def test_hops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src_id string, dst_id string")
    got = beyond.k_hops(edges, spark.createDataFrame([("a",)], "node string"), 2)
    assert {(r["node"], r["hops"]) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_usage_stream_equals_batch(spark, tmp_path):
    events = [{"ts": 1_700_000_000_000 + 3_600_000 * i, "tool": "t", "q": "x", "hit": i % 2 == 0, "chars": 1, "ms": 2} for i in range(30)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, events)) + "\nnot json\n")
    assert sources.usage_log(spark, str(tmp_path / "in")).count() == 30
    q = windows.tumbling(windows.read_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("usage_days").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    batch = windows.tumbling(sources.usage_log(spark, str(tmp_path / "in")).withColumn("at", F.timestamp_millis("ts")))
    streamed = spark.table("usage_days").where("tool is not null")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_configuration():
    config = registry.parse_config("sources:\n  - type: docs\n    path: d\n  - type: other\nreview: {acceptAbove: 0.7}\nunknown: 1\n")
    assert config.accept_above == 0.7 and registry.parse_config("").accept_above == 0.8
    known = registry.Registry()
    known.add(registry.Connector("docs", "Markdown", registry.DOC, lambda: None))
    first, second = known.split_by_phase(config.sources)
    assert [s["type"] for s in first] == ["other"] and [s["type"] for s in second] == ["docs"]


def test_exact_p_values_of_many_pairs(spark):
    """Against sums of exact integers, up to 100,000 pairs."""
    from fractions import Fraction
    from math import comb

    pairs = [(600, 600), (2000, 2000), (560, 640), (1100, 1300), (9, 0), (10, 10), (11, 3), (0, 1200), (5, 1195)]
    df = spark.createDataFrame([*pairs, (50_000, 50_000), (49_500, 50_500), (49_000, 51_000)], "b long, c long")
    got = {(r["b"], r["c"]): r["p"] for r in df.select("b", "c", evals.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()}
    for b, c in pairs:
        want = min(1.0, float(Fraction(2 * sum(comb(b + c, k) for k in range(min(b, c) + 1)), 2 ** (b + c))))
        assert got[b, c] == pytest.approx(want, rel=1e-9), (b, c)
    assert got[50_000, 50_000] == 1.0 and got[49_500, 50_500] == pytest.approx(0.0015812, rel=1e-3) and 0 < got[49_000, 51_000] < 1e-9


def test_vectors_without_a_direction_have_no_neighbours(spark):
    rows = [(i, [1.0, i / 100]) for i in range(100)] + [(200 + i, [0.0, 0.0]) for i in range(3)] + [(300, None), (301, [float("nan"), 1.0]), (302, [float("inf"), 1.0]), (303, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = beyond.nearest_vectors(df.where("vec_id in (0, 50, 200, 301)"), df, 5)
    assert sorted((r["query_id"], r["vec_id"]) for r in got.collect()) == [(0, i) for i in range(1, 6)] + [(50, i) for i in (48, 49, 51, 52, 53)]


@pytest.mark.parametrize("most", [5000, 0])
def test_dictionary_of_anchors_equals_the_search_for_every_form(spark, most):
    import random

    r = random.Random(4)
    words = ["tide", "Table", "quay", "the", "of", "C++", "--", "rope_1", "über", "a.b", "Ebb", "flow"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", " ", "  ", "\n", ".", "-"]) for _ in range(n))
    forms = [(str(i % 9), f) for i, f in enumerate(dict.fromkeys([*words, *(" ".join(r.sample(words, 2)) for _ in range(25)), "the tide of", "of-the", "+++"]))]
    rows = [("r", i, text(2) if i % 3 else docs.INTRO, text(r.randint(0, 40)) if i % 7 else None) for i in range(60)]
    sections = spark.createDataFrame(rows, "ref string, idx int, heading string, body string")
    want = {}
    for ref, idx, heading, body in rows:
        whole = "\n".join(x for x in (None if heading == docs.INTRO else heading, body) if x is not None)
        for concept, form in forms:
            find = lambda t: re.search(r"(^|[^\w])" + re.escape(form) + r"([^\w]|$)", t, re.I)
            if find(whole):
                want[idx, concept] = want.get((idx, concept), False) or bool(heading != docs.INTRO and find(heading))
    got = docs.dictionary_match(sections, spark.createDataFrame(forms, "concept_id string, form string"), most)
    assert {(x["idx"], x["concept_id"]): x["heading_hit"] for x in got.collect()} == want and len(want) > 100


def test_pairs_of_a_hub_section_are_dealt_in_blocks(spark):
    """A section with 300 concepts, most of them nowhere else: only pairs with support are made."""
    rows = [("hub", 0, f"c{i:03d}") for i in range(300)] + [("b", i, f"c{j:03d}") for i in range(3) for j in range(40)] + [("lone", i, f"c{250 + i}") for i in range(5)]
    df = spark.createDataFrame(rows + rows[:10], "ref string, idx int, concept_id string")
    want = {}
    for ref, idx in {(a, b) for a, b, _ in rows}:
        own = sorted(c for a, b, c in rows if (a, b) == (ref, idx))
        for i, x in enumerate(own):
            for y in own[i + 1 :]:
                want[x, y] = want.get((x, y), 0) + 1
    want = {k: n for k, n in want.items() if n >= 2}
    for block in (64, 7):
        assert {(r["low"], r["high"]): r["n"] for r in docs.cooccurrences(df, block=block).collect()} == want
