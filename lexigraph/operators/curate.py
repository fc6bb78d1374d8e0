"""Curation: merging concepts of one name, and applying verdicts to concepts and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_array_in, normal_key, null_if_blank, utrim
from ..schema import VERDICT_CONCEPT, VERDICT_RULE
from .dml import delete_concepts, patch, set_status
from .gates import resolved
from .ranks import batches, first_per_key


def edge_counts(concepts: DataFrame, edges: DataFrame, edge_type: str = "implements") -> DataFrame:
    """Edges into each concept, 0 for none."""
    n = edges.where(F.col("type") == edge_type).groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("n"))
    return concepts.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def dedupe_groups(concepts: DataFrame) -> DataFrame:
    """Names that fall together, and how many concepts each has, where it is more than one."""
    return concepts.groupBy(normal_key("name").alias("norm_key")).agg(F.count("*").alias("n")).where("n > 1")


def dedupe_mapping(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """id of each concept to go and survivor: the defined, most implemented, shortest named, least id of its group."""
    ranked = edge_counts(concepts, edges).withColumn("norm_key", normal_key("name"))
    rank = F.struct(F.when(resolved(), 0).otherwise(1).alias("open"), (-F.col("n")).alias("fewer"), F.length("name").alias("size"), F.col("id"))
    best = ranked.groupBy("norm_key").agg(F.min(rank).alias("best"), F.count("*").alias("members")).where("members > 1")
    return ranked.join(best, "norm_key").select("id", F.col("best.id").alias("survivor"), "norm_key").where("id <> survivor")


def repoint_edges(edges: DataFrame, mapping: DataFrame, all_self_loops: bool = False) -> DataFrame:
    """Edges with both ends at survivors. On a collision the edge that was the survivor's own stays, else the more
    confident, else the least id. Loops that the merge made go (all_self_loops: all loops)."""
    m = lambda end: mapping.select(F.col("id").alias(f"{end}_id"), F.col("survivor").alias(f"{end}_new"))
    moved = edges.join(m("src"), "src_id", "left").join(m("dst"), "dst_id", "left")
    changed = F.col("src_new").isNotNull() | F.col("dst_new").isNotNull()
    loop = (F.coalesce("src_new", "src_id") == F.coalesce("dst_new", "dst_id")) & (F.lit(all_self_loops) | changed)
    moved = moved.where(~loop).withColumn("_moved", changed.cast("int")).withColumn("src_id", F.coalesce("src_new", "src_id")).withColumn("dst_id", F.coalesce("dst_new", "dst_id"))
    kept = first_per_key(moved, ["src_id", "dst_id", "type"], [F.col("_moved"), F.desc("confidence"), F.col("id")])
    return kept.select(*edges.columns)


def folded_aliases(concepts: DataFrame, mapping: DataFrame) -> DataFrame:
    """id and aliases of each survivor: its own, then each merged concept's aliases and name, without its own name."""
    none = F.array().cast("array<string>")
    gone = mapping.join(concepts.select("id", "name", "aliases"), "id")
    parts = gone.groupBy(F.col("survivor").alias("id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", F.concat(F.coalesce("aliases", none), F.array("name")).alias("a")))), lambda x: x["a"])).alias("more"))
    own = concepts.join(parts, "id")
    return own.select("id", F.array_except(F.array_union(F.coalesce("aliases", none), "more"), F.array("name")).alias("aliases"))


def dedupe_by_name(concepts: DataFrame, edges: DataFrame, all_self_loops: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concepts and edges after the merge, and the mapping it used (a row for each merged concept)."""
    mapping = dedupe_mapping(concepts, edges)
    kept = patch(concepts, folded_aliases(concepts, mapping)).join(mapping.select("id"), "id", "left_anti")
    return kept, repoint_edges(edges, mapping, all_self_loops), mapping


def parse_verdicts(replies: DataFrame, reply: str, schema) -> DataFrame:
    """Verdict rows from replies in prose around a JSON array; a reply that does not parse gives none.

    Other columns of replies stay (the batch a reply answers, say). pos is the place of a verdict in its reply, later
    replies after earlier ones where replies have a column `reply_no`.
    """
    ddl = f"array<{schema.simpleString()}>"
    at = F.col("reply_no").cast("long") * 1_000_000 if "reply_no" in replies.columns else F.lit(0).cast("long")
    rest = [c for c in replies.columns if c != reply and c not in schema.fieldNames()]
    rows = replies.select(*rest, F.posexplode(F.from_json(json_array_in(reply), ddl)).alias("_at", "v"))
    return rows.select(*rest, "v.*", (at + F.col("_at")).alias("pos"))


def concept_verdicts(replies: DataFrame, reply: str) -> DataFrame:
    v = parse_verdicts(replies, reply, VERDICT_CONCEPT)
    return v.withColumn("keep", F.coalesce("keep", F.lit(True))).withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))


def rule_verdicts(replies: DataFrame, reply: str) -> DataFrame:
    v = parse_verdicts(replies, reply, VERDICT_RULE)
    return v.withColumn("keep", F.coalesce("keep", F.lit(False))).withColumn("refined", F.coalesce("refined", F.lit("")))


def canonicalize(concepts: DataFrame, edges: DataFrame, candidates: DataFrame, verdicts: DataFrame, gate: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Candidates without a verdict stay; rejected or unsure ones go with their edges; the others take the verdict's words.

    candidates: id, name. verdicts: cluster, keep, confidence, name, definition, bounded_context, aliases, and pos for
    the last of several of one cluster. No verdicts at all change nothing.
    """
    last = verdicts.groupBy("cluster").agg(F.max_by(F.struct(*[c for c in verdicts.columns if c not in ("cluster", "pos")]), "pos").alias("v")).select("cluster", "v.*")
    judged = candidates.select("id", F.col("name").alias("cluster")).join(last, "cluster")
    stays = F.col("keep") & (F.col("confidence") >= F.lit(gate))
    text = lambda c: null_if_blank(utrim(c))
    changes = judged.where(stays).select("id", F.coalesce(text("name"), "cluster").alias("name"), text("definition").alias("definition"), text("bounded_context").alias("bounded_context"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    return delete_concepts(patch(concepts, changes), edges, judged.where(~stays).select("id"))


def refine_rules(edges: DataFrame, artifacts: DataFrame, candidates: DataFrame, verdicts: DataFrame, batch: int = 12) -> tuple[DataFrame, DataFrame]:
    """Edges and artifacts after rule verdicts: kept ones confirmed and perhaps reworded, dropped ones rejected.

    candidates: edge_id, rule_id, concept, ref, text. verdicts: batch (or none: one reply serves every batch), id
    (1-based in the batch), keep, refined, and pos for the last of several of one id. A candidate without a verdict
    stays. A rule is reworded if the trimmed wording is not blank and differs from its text; of several edges of a rule
    the last decides. Candidates but no verdict at all: ValueError, nothing is changed.
    """
    if verdicts.isEmpty() and not candidates.isEmpty():
        raise ValueError("no reply has a verdict; no rule is changed")
    numbered = batches(candidates, [], [F.col("concept"), F.col("ref"), F.col("edge_id")], batch)
    keys = [c for c in ("batch", "id") if c in verdicts.columns]
    order = F.col("pos") if "pos" in verdicts.columns else F.struct("keep", "refined")
    last = verdicts.groupBy(*keys).agg(F.max_by(F.struct("keep", "refined"), order).alias("v")).select(*keys, "v.*")
    judged = numbered.join(last, keys)
    decided = judged.select(F.col("edge_id").alias("id"), F.when(F.col("keep"), "confirmed").otherwise("rejected").alias("status"))
    words = utrim(F.coalesce("refined", F.lit("")))
    reworded = judged.where(F.col("keep") & (words != "") & (words != utrim("text")))
    titles = reworded.groupBy(F.col("rule_id").alias("id")).agg(F.max_by(F.substring(words, 1, 200), F.struct(F.col("batch"), F.col("id"))).alias("title"))
    return set_status(edges, decided), patch(artifacts, titles)
