"""Ingest of sources into a graph: source trees by what changed, symbol indexes, code graphs, documents.

Each function takes a graph and a source's tables and returns the new graph and its counters, a
table (counter, n) of single aggregations. A source tree is listed first; only what changed since is read.
The graph keeps, for each table, the keys that an ingest may have changed, so that a snapshot writes those alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as T
from ..operators import code, docs, dml
from ..operators.scratch import stored
from ..operators.snapshot import Graph


def counters(**counts: DataFrame) -> DataFrame:
    """counter and n, the number of rows of each table."""
    out = None
    for name, df in counts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
        out = one if out is None else out.union(one)
    return out


def edges_of(rows: DataFrame) -> DataFrame:
    more = {} if "evidence" in rows.columns else {"evidence": F.array().cast("array<string>")}
    return S.conform(rows.withColumn("id", S.key("src_id", "dst_id", "type")).withColumns(more), S.EDGE)


def put(graph: Graph, artifacts: DataFrame, edges: DataFrame) -> Graph:
    one = F.lit(1).cast("long")
    for name, table, keys, upsert, schema in (("artifacts", artifacts, dml.ARTIFACT_KEY, dml.upsert_artifacts, S.ARTIFACT), ("edges", edges, dml.EDGE_KEY, dml.upsert_edges, S.EDGE)):
        delta = S.conform(table, schema).withColumn("_seq", one)
        whole, made = dml.merge(getattr(graph, name), delta, keys, lambda d, mine, f=upsert, s=schema: S.conform(f(d, mine), s))
        graph = graph.with_changes(name, whole, made)
    return graph


def _linked(graph: Graph, names: DataFrame, edges: DataFrame, to: str) -> tuple[Graph, DataFrame]:
    """The graph with a concept for each new name, and edges whose implements end (column `to`, a name) is its id."""
    concepts = S.conform(dml.find_or_create_concepts(graph.concepts, names), S.CONCEPT)
    first = concepts.join(names.select("name").distinct(), "name", "left_semi").groupBy(F.col("name").alias(to)).agg(F.min("id").alias("concept_id"))
    dst = F.when(F.col("type") == "implements", F.col("concept_id")).otherwise(F.col(to))
    new = names.where("name is not null").select(S.key(F.lit("concept"), "name").alias("id"))
    return graph.with_changes("concepts", concepts, new), edges.join(first, to, "left").withColumn("dst_id", dst)


def ingest_code_graph(graph: Graph, exports: DataFrame) -> tuple[Graph, DataFrame]:
    """Code-graph exports: artifacts, a concept for each new community label, implements and calls edges."""
    artifacts, names, edges = code.code_graph(exports)
    linked_graph, linked = _linked(graph, names, edges, "dst")
    counted = counters(files=artifacts.where("kind = 'file'"), symbols=artifacts.where("kind = 'code_symbol'"), concepts=names, links=edges.where("type = 'implements'"), calls=edges.where("type = 'calls'"))
    return put(linked_graph, artifacts, edges_of(linked.select("src_id", "dst_id", "type", "source", "confidence", "status"))), counted


def ingest_symbol_index(graph: Graph, files: DataFrame, symbols: DataFrame, modules: DataFrame, source: str = "astindex") -> tuple[Graph, DataFrame]:
    """An external symbol index as a code graph: each module is a community of its symbols."""
    named = code.ast_index(files, symbols, modules)
    member = F.struct(F.col("kind"), F.col("name"), F.col("file"))
    community = named.select(F.lit("").alias("repo"), F.lit(source).alias("source"), F.array(F.struct(F.col("module").alias("label"), F.array(member).alias("members"))).alias("communities"), F.lit(None).cast("array<struct<from:string,to:string>>").alias("calls"))
    return ingest_code_graph(graph, community)


def _read(files, own: DataFrame) -> DataFrame:
    """own (listed files) with their content: of a tree that reads by path, or of a table that has it."""
    return files.contents(own) if hasattr(files, "contents") else own


def _listed(files) -> DataFrame:
    return files.listing() if hasattr(files, "listing") else files


def ingest_symbols(graph: Graph, files, confidence: float = 0.6) -> tuple[Graph, DataFrame]:
    """Declarations of a source tree: symbols, their files, concepts by folder, implements edges.

    files: a table (path, mtime, lang, content) or a tree (`sources.files.Tree`), of which only new and changed files
    are read. What changed and gone ones gave is deleted first, but for human reviews: an implements edge that was
    confirmed or rejected is so again if its symbol still stands. The listing becomes the stored files. Languages
    that are known but not read are counted, with their files.
    """
    listed = _listed(files)
    read = listed.where(F.col("lang").isNotNull() & ~F.col("lang").isin(*code.SKIPPED))
    diff = stored(dml.diff_files(graph.files, read), "file-diff")
    old = diff.where(F.col("state").isin("changed", "gone"))
    own = read.join(diff.where(F.col("state").isin("new", "changed")).select("path"), "path", "left_semi")
    symbols = stored(code.find_symbols(_read(files, own)), "symbols")

    gone = stored(dml.file_artifacts(graph.artifacts, old), "gone-artifacts")
    lost = stored(dml.edges_touching(graph.edges, gone), "gone-edges")
    told = graph.mentions.join(gone.select(F.col("id").alias("artifact_id")), "artifact_id", "left_semi").select("id")
    rest = graph.with_changes("artifacts", graph.artifacts.join(gone, "id", "left_anti"), gone)
    rest = rest.with_changes("edges", graph.edges.join(lost.select(*dml.EDGE_KEY), dml.EDGE_KEY, "left_anti"), lost)
    rest = rest.with_changes("mentions", graph.mentions.join(gone.select(F.col("id").alias("artifact_id")), "artifact_id", "left_anti"), told)
    moved = diff.where("state <> 'unchanged'")
    now = graph.files.join(moved.select("path"), "path", "left_anti").unionByName(S.conform(moved.where("now is not null").select("path", F.col("now").alias("mtime")), S.SOURCE_FILE))
    rest = rest.with_changes("files", now, moved)

    artifacts, names, edges = code.symbol_graph(symbols, confidence)
    owners = symbols.select("path").distinct()
    holders = owners.select(S.key(F.lit("code"), "path").alias("id"), F.lit("file").alias("kind"), F.lit("code").alias("layer"), F.lit("code").alias("source"), F.col("path").alias("ref"), F.col("path").alias("title"))
    linked_graph, linked = _linked(rest, names, edges.withColumnRenamed("concept", "dst"), "dst")
    evidence = F.array(F.concat(F.lit("folder:"), "dst"))
    reviewed = lost.where((F.col("type") == "implements") & F.col("status").isin("confirmed", "rejected")).select(*dml.EDGE_KEY, F.col("status").alias("_reviewed"))
    new = linked.join(reviewed, dml.EDGE_KEY, "left").withColumn("status", F.coalesce("_reviewed", "status"))
    new = new.select("src_id", "dst_id", "type", "source", "confidence", "status", evidence.alias("evidence"))
    counted = counters(files=read, changed=diff.where(F.col("state").isin("new", "changed")), gone=diff.where("state = 'gone'"), symbols=artifacts, concepts=names, links=edges, skipped_files=listed.where(F.col("lang").isin(*code.SKIPPED)))
    return put(linked_graph, artifacts.unionByName(holders, allowMissingColumns=True), edges_of(new)), counted


def ingest_mentions(graph: Graph, files) -> tuple[Graph, DataFrame]:
    """Identifiers, comments and strings of source files as mentions of each file's artifact, in place of its old ones.

    files as in `ingest_symbols`; new and changed ones are read, by what this reader has read before. Mentions of files that
    are gone go, with the artifact of the file if no other reader has listed it.
    """
    listed = _listed(files)
    read = listed.where(F.col("lang").isNotNull() & ~F.col("lang").isin(*code.SKIPPED))
    before = graph.reads.where("reader = 'mentions'")
    diff = stored(dml.diff_files(before, read), "read-diff")
    own = read.join(diff.where(F.col("state").isin("new", "changed")).select("path"), "path", "left_semi")
    found = stored(code.find_mentions(_read(files, own)), "mentions")
    owner = S.key(F.lit("code"), "path")
    moved = diff.where("state <> 'unchanged'").withColumn("artifact_id", owner)
    holders = own.select(owner.alias("id"), F.lit("file").alias("kind"), F.lit("code").alias("layer"), F.lit("code").alias("source"), F.col("path").alias("ref"), F.col("path").alias("title"))
    rows = S.conform(found.select(S.key(owner, "node", "normalized").alias("id"), owner.alias("artifact_id"), "term", "normalized", "span"), S.MENTION)
    lost = graph.mentions.join(moved.select("artifact_id"), "artifact_id", "left_semi").select("id")
    cleared = dml.clear_mentions(graph.mentions, moved)
    gone = moved.where("state = 'gone'").join(graph.files.select("path"), "path", "left_anti").select(F.col("artifact_id").alias("id"))
    rest = graph.with_changes("artifacts", graph.artifacts.join(gone, "id", "left_anti"), gone)
    now = S.conform(moved.where("now is not null").select(F.lit("mentions").alias("reader"), "path", F.col("now").alias("mtime")), S.READ_FILE)
    names = moved.select(F.lit("mentions").alias("reader"), "path")
    reads = graph.reads.join(names, ["reader", "path"], "left_anti").unionByName(now)
    new = put(rest, holders, graph.edges.limit(0)).with_changes("mentions", S.conform(cleared.unionByName(rows), S.MENTION), lost.union(rows.select("id")))
    return new.with_changes("reads", reads, names), counters(files=read, changed=own, gone=diff.where("state = 'gone'"), mentions=found)


def ingest_documents(graph: Graph, documents: DataFrame, source: str = "docs") -> tuple[Graph, DataFrame]:
    """Documents (ref, name, content): sections, rules, describes, constrains and relates edges, new aliases."""
    linked = docs.link_docs(documents, graph.concepts, source)
    kind = lambda k: linked.edges.where(F.col("type") == k)
    counted = counters(docs=documents, sections=linked.artifacts.where("kind = 'doc'"), links=kind("describes"), relations=kind("relates"), rules=linked.artifacts.where("kind = 'rule'"))
    named = graph.with_changes("concepts", S.conform(dml.add_aliases(graph.concepts, linked.aliases), S.CONCEPT), linked.aliases)
    return put(named, linked.artifacts, linked.edges), counted


def file_counts(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """One row: how many files are stored, and how many of them are stale against a listing."""
    return dml.diff_files(stored, listing).agg(F.count("was").alias("indexed"), F.count_if(F.col("state").isin("changed", "gone")).alias("stale"))
