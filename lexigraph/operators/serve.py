"""Gated one-hop reads of the graph. Each takes whole tables and answers for all keys; filter before for one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import directory_of, file_of, is_blank
from .gates import BARS, not_rejected, on_path, resolved, served
from .ranks import first_per_key
from .scratch import stored

LABEL = ("coalesce(concat('concept ', c_name), concat(a_kind, ' ', coalesce(a_title, a_ref)), {end})")


#: Up to so many keys travel as a filter.
MOST_KEYS = 2000


def find_concept(concepts: DataFrame, name: str) -> DataFrame:
    """The concept of exactly this name, the one with the least id."""
    return concepts.where(F.col("name") == name).orderBy("id").limit(1)


def resolve_terms(concepts: DataFrame, terms: DataFrame) -> DataFrame:
    """term and the id of its concept: by exact name, else by an alias but for case; the least id of several."""
    by_name = concepts.groupBy("name").agg(F.min("id").alias("by_name"))
    by_alias = concepts.select("id", F.explode("aliases").alias("a")).groupBy(F.lower("a").alias("low")).agg(F.min("id").alias("by_alias"))
    hit = terms.join(by_name, terms["term"] == by_name["name"], "left").join(by_alias, F.lower("term") == F.col("low"), "left")
    return hit.select("term", F.coalesce("by_name", "by_alias").alias("concept_id"))


def search_concepts(concepts: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Concepts with the query in name, definition or an alias; defined ones first, then short names."""
    q = query.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
    found = concepts.where(has("name") | has("definition") | F.exists("aliases", lambda a: F.lower(a).contains(q)))
    return found.orderBy(resolved().desc(), F.length("name"), "name", "id").limit(limit)


def related_concepts(concepts: DataFrame, edges: DataFrame, union: bool = False) -> DataFrame:
    """concept_id, other_id, other_name, confidence by served relates edges to defined concepts.

    union: a neighbour linked both ways with two confidences comes twice; else with the greater.
    """
    own = edges.where(F.col("type") == "relates").where(served(BARS["relates"])).select("src_id", "dst_id", "confidence")
    both = own.select(F.col("src_id").alias("concept_id"), F.col("dst_id").alias("other_id"), "confidence").union(own.select("dst_id", "src_id", "confidence"))
    both = both.distinct() if union else both.groupBy("concept_id", "other_id").agg(F.max("confidence").alias("confidence"))
    return both.join(concepts.where(resolved()).select(F.col("id").alias("other_id"), F.col("name").alias("other_name")), "other_id").select("concept_id", "other_id", "other_name", "confidence")


def only_keys(df: DataFrame, keys: DataFrame, on: str, most: int = MOST_KEYS) -> DataFrame:
    """The rows of df with a key in keys: as a filter that reaches the scans if there are few keys, else by a semi-join."""
    few = [r[0] for r in keys.select(on).distinct().limit(most + 1).collect()]
    return df.where(F.col(on).isin(few)) if len(few) <= most else df.join(keys.select(on).distinct(), on, "left_semi")


def _artifacts_of(edges: DataFrame, artifacts: DataFrame, edge_type: str, kind: str | None) -> DataFrame:
    own = edges.where(F.col("type") == edge_type).where(served(BARS[edge_type])).select(F.col("dst_id").alias("concept_id"), "src_id", "confidence")
    those = artifacts.where(F.col("kind") == kind) if kind else artifacts
    return own.join(those.select(F.col("id").alias("src_id"), "kind", "ref", "title"), "src_id")


def rules_for(edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    return _artifacts_of(edges, artifacts, "constrains", "rule").select("concept_id", "ref", "title", "confidence")


def describing_docs(edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    return _artifacts_of(edges, artifacts, "describes", "doc").select("concept_id", "ref", "title", "confidence")


def implementers_of(edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    return _artifacts_of(edges, artifacts, "implements", None).select("concept_id", "kind", "ref", "title", "confidence")


def implementers_by_file(edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Symbols of each file that implement a concept, sorted."""
    own = implementers_of(edges, artifacts)
    return own.groupBy("concept_id", file_of("ref").alias("file")).agg(F.array_sort(F.collect_set(F.coalesce("title", "ref"))).alias("symbols"))


def concepts_for_path(concepts: DataFrame, edges: DataFrame, artifacts: DataFrame, path: str, strict: bool = True) -> DataFrame:
    """Concepts that code under a path implements, with the implementing symbols.

    The path's symbols choose the edges by their key, so that what makes the edges (an upsert) works on theirs alone.
    """
    code = artifacts.where(F.col("kind") == "code_symbol").where(on_path("ref", F.lit(path), strict)).select(F.col("id").alias("src_id"), "title")
    own = only_keys(edges.where(F.col("type") == "implements"), code, "src_id").where(served(BARS["implements"])).select("src_id", F.col("dst_id").alias("id"))
    symbols = own.join(code, "src_id").groupBy("id").agg(F.array_sort(F.collect_list("title")).alias("symbols"))
    return symbols.join(concepts.select("id", "name", "definition"), "id").select("id", "name", "definition", "symbols")


def code_context(concepts: DataFrame, edges: DataFrame, artifacts: DataFrame, path: str, strict: bool = True) -> DataFrame:
    """concepts_for_path with each concept's rules, documents and related concepts: only those of the concepts found."""
    found = stored(concepts_for_path(concepts, edges, artifacts, path, strict), "found")
    keys = found.select("id")
    into = only_keys(edges.where(F.col("type").isin("constrains", "describes")), keys.withColumnRenamed("id", "dst_id"), "dst_id")
    around = edges.where(F.col("type") == "relates")
    around = only_keys(around, keys.withColumnRenamed("id", "src_id"), "src_id").union(only_keys(around, keys.withColumnRenamed("id", "dst_id"), "dst_id"))
    listed = lambda df, c, name: df.groupBy("concept_id").agg(F.array_sort(F.collect_list(c)).alias(name)).withColumnRenamed("concept_id", "id")
    none = F.array().cast("array<string>")
    out = found
    for df, c, name in ((rules_for(into, artifacts), "title", "rules"), (describing_docs(into, artifacts), "ref", "docs"), (related_concepts(concepts, around), "other_name", "related")):
        out = out.join(listed(df, c, name), "id", "left").withColumn(name, F.coalesce(name, none))
    return out


def calls(edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Calls that are not rejected, with the references of both ends."""
    own = edges.where(F.col("type") == "calls").where(not_rejected()).select("src_id", "dst_id")
    side = lambda p: artifacts.select(F.col("id").alias(f"{p}_id"), F.col("ref").alias(f"{p}_ref"))
    return own.join(side("src"), "src_id").join(side("dst"), "dst_id").select("src_ref", "dst_ref")


def calls_from_path(edges: DataFrame, artifacts: DataFrame, path: str, limit: int = 40) -> DataFrame:
    return calls(edges, artifacts).where(on_path("src_ref", F.lit(path))).distinct().orderBy("src_ref", "dst_ref").limit(limit)


def calls_into_path(edges: DataFrame, artifacts: DataFrame, path: str, limit: int = 40) -> DataFrame:
    """Calls from outside the path."""
    return calls(edges, artifacts).where(on_path("dst_ref", F.lit(path)) & ~on_path("src_ref", F.lit(path))).distinct().orderBy("src_ref", "dst_ref").limit(limit)


def with_labels(edges: DataFrame, concepts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Edges with a readable label of each end: a concept, else an artifact, else the id."""
    out = edges
    for end in ("src", "dst"):
        c = concepts.select(F.col("id").alias(f"{end}_id"), F.col("name").alias("c_name"))
        a = artifacts.select(F.col("id").alias(f"{end}_id"), F.col("kind").alias("a_kind"), F.col("title").alias("a_title"), F.col("ref").alias("a_ref"))
        out = out.join(c, f"{end}_id", "left").join(a, f"{end}_id", "left").withColumn(f"{end}_label", F.expr(LABEL.format(end=f"{end}_id"))).drop("c_name", "a_kind", "a_title", "a_ref")
    return out


def proposed_edges(edges: DataFrame, concepts: DataFrame, artifacts: DataFrame, edge_type: str | None = None, limit: int = 50) -> DataFrame:
    """The most confident proposed edges, labelled; the top is taken before the joins."""
    own = edges.where(F.col("status") == "proposed")
    own = own.where(F.col("type") == edge_type) if edge_type else own
    return with_labels(own.orderBy(F.desc("confidence"), "type", "src_id", "dst_id").limit(limit), concepts, artifacts)


def candidate_concepts(concepts: DataFrame, edges: DataFrame, artifacts: DataFrame, symbols: int = 12, directories: int = 4) -> DataFrame:
    """Undefined candidates that something implements, with the first symbols and directories of it."""
    open_ = concepts.where((F.col("status") == "candidate") & F.col("definition").isNull()).select("id", "name")
    own = edges.where(F.col("type") == "implements").select("src_id", F.col("dst_id").alias("id")).join(open_, "id").join(artifacts.select(F.col("id").alias("src_id"), "title", "ref"), "src_id")
    some = first_per_key(own, ["id"], [F.col("ref"), F.col("src_id")], symbols)
    first = some.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ref", "src_id", "title"))), lambda x: x["title"]).alias("symbols"))
    dirs = first_per_key(own.select("id", directory_of("ref").alias("dir")).where(~is_blank("dir")).distinct(), ["id"], [F.col("dir")], directories)
    dirs = dirs.groupBy("id").agg(F.array_sort(F.collect_list("dir")).alias("directories"))
    return open_.join(first, "id").join(dirs, "id", "left").withColumn("directories", F.coalesce("directories", F.array().cast("array<string>")))


def candidate_rules(edges: DataFrame, artifacts: DataFrame, concepts: DataFrame, limit: int | None = 1000) -> DataFrame:
    """Proposed constrains edges with the rule's text and the concept's name: the first `limit`, or all."""
    own = edges.where((F.col("type") == "constrains") & (F.col("status") == "proposed")).select(F.col("id").alias("edge_id"), F.col("src_id").alias("rule_id"), F.col("dst_id").alias("concept_id"))
    rules = artifacts.where(F.col("kind") == "rule").select(F.col("id").alias("rule_id"), "ref", F.coalesce("body", "title").alias("text"))
    out = own.join(rules, "rule_id").join(concepts.select(F.col("id").alias("concept_id"), F.col("name").alias("concept")), "concept_id")
    return out if limit is None else out.orderBy("concept", "ref", "edge_id").limit(limit)
