"""Mutations of graph tables as set operations: each takes tables and deltas and returns a new table.

Deltas carry `_seq` where the last write wins. Nothing depends on row order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import key
from .gates import in_file
from .ranks import last_write

EDGE_KEY, ARTIFACT_KEY = ["src_id", "dst_id", "type"], ["source", "ref"]


def _with_seq(stored: DataFrame | None, delta: DataFrame, seq: str) -> DataFrame:
    if stored is None:
        return delta
    low = F.lit(-(2**62)).cast("long")
    return stored.withColumn(seq, low).unionByName(delta.withColumn(seq, F.col(seq).cast("long")), allowMissingColumns=True)


def upsert_edges(delta: DataFrame, stored: DataFrame | None = None, seq: str = "_seq", keep_review: bool = True) -> DataFrame:
    """One edge for each (src_id, dst_id, type): source of the first write; confidence, evidence and status of the last.

    keep_review: a stored confirmed or rejected status outlives writes that propose again.
    """
    rows = _with_seq(stored, delta, seq)
    rest = [c for c in rows.columns if c not in EDGE_KEY + [seq]]
    one = rows.groupBy(*EDGE_KEY).agg(
        F.max(F.struct(seq, *rest)).alias("_last"),
        F.min(F.struct(F.col(seq).alias("seq"), *(c for c in ("id", "source") if c in rest))).alias("_first"),
        *([] if stored is None else [F.max(F.when((F.col(seq) == -(2**62)) & F.col("status").isin("confirmed", "rejected"), F.col("status"))).alias("_reviewed")]),
    )
    status = F.col("_last.status")
    if keep_review and stored is not None:
        status = F.when(status == "proposed", F.coalesce("_reviewed", status)).otherwise(status)
    pick = {"status": status, **{c: F.col(f"_first.{c}") for c in ("id", "source") if c in rest}}
    return one.select(*EDGE_KEY, *(pick.get(c, F.col(f"_last.{c}")).alias(c) for c in rest))


def upsert_artifacts(delta: DataFrame, stored: DataFrame | None = None, seq: str = "_seq") -> DataFrame:
    """One artifact for each (source, ref): id, kind and layer of the first write, the rest of the last."""
    rows = _with_seq(stored, delta, seq)
    first = [c for c in ("id", "kind", "layer") if c in rows.columns]
    last = [c for c in rows.columns if c not in ARTIFACT_KEY + first + [seq]]
    # maps have no order, so they ride behind an entries array
    maps = {f.name for f in rows.schema.fields if f.dataType.typeName() == "map"}
    flat = rows.select(*(F.map_entries(c).alias(c) if c in maps else F.col(c) for c in rows.columns))
    one = flat.groupBy(*ARTIFACT_KEY).agg(F.min(F.struct(seq, *first)).alias("_first"), F.max(F.struct(seq, *last)).alias("_last"))
    back = lambda c: F.map_from_entries(F.col(f"_last.{c}")) if c in maps else F.col(f"_last.{c}")
    return one.select(*(F.col(f"_first.{c}").alias(c) for c in first), *ARTIFACT_KEY, *(back(c).alias(c) for c in last))


def upsert_files(delta: DataFrame, stored: DataFrame | None = None, seq: str = "_seq") -> DataFrame:
    return last_write(_with_seq(stored, delta, seq), ["path"], [seq]).drop(seq)


def add_concepts(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """A plain append: names may repeat."""
    return stored.unionByName(delta, allowMissingColumns=True)


def find_or_create_concepts(concepts: DataFrame, names: DataFrame) -> DataFrame:
    """concepts and a candidate for each name (column name) that none of them has."""
    new = names.select("name").where("name is not null").distinct().join(concepts.select("name"), "name", "left_anti")
    return add_concepts(concepts, new.select(key(F.lit("concept"), "name").alias("id"), "name", F.lit("candidate").alias("status"), F.array().cast("array<string>").alias("aliases")))


def replace_mentions(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Mentions of re-read artifacts replaced by the delta's."""
    return clear_mentions(stored, delta.select("artifact_id").distinct()).unionByName(delta, allowMissingColumns=True)


def clear_mentions(stored: DataFrame, artifacts: DataFrame) -> DataFrame:
    return stored.join(artifacts.select("artifact_id"), "artifact_id", "left_anti")


def patch(table: DataFrame, changes: DataFrame, on: str = "id") -> DataFrame:
    """Columns of changes put in place of the table's for equal keys; null is a value like others."""
    cols = [c for c in changes.columns if c != on]
    new = changes.select(on, *(F.col(c).alias(f"_new_{c}") for c in cols), F.lit(True).alias("_there"))
    return table.join(new, on, "left").select(*(F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in table.columns))


def delete_touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges without those that begin or end at an id: two anti-joins in place of one with OR."""
    own = ids.select(F.col("id").alias("_gone")).distinct()
    return edges.join(own, edges["src_id"] == F.col("_gone"), "left_anti").join(own, F.col("dst_id") == F.col("_gone"), "left_anti")


def delete_concepts(concepts: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The concepts gone and their edges with them; artifacts stay."""
    return concepts.join(ids.select("id"), "id", "left_anti"), delete_touching(edges, ids)


def file_artifacts(artifacts: DataFrame, paths: DataFrame) -> DataFrame:
    """The ids of code artifacts of the files (column path)."""
    owned = artifacts.where("source = 'code'").withColumn("_file", F.substring_index("ref", "#", 1))
    return owned.join(paths.select(F.col("path").alias("_file")).distinct(), "_file", "left_semi").where(in_file("ref", "_file")).select("id")


def edges_touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that begin or end at an id; one that does both comes once."""
    own = ids.select(F.col("id").alias("_at")).distinct()
    begin = edges.join(own, edges["src_id"] == F.col("_at"), "left_semi")
    end = edges.join(own, edges["dst_id"] == F.col("_at"), "left_semi").join(own, F.col("src_id") == F.col("_at"), "left_anti")
    return begin.unionByName(end)


def merge(stored: DataFrame, delta: DataFrame, keys: list[str], upsert: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """stored (one row a key) after an upsert of a delta, and the rows that it made.

    Only stored rows with a key of the delta are aggregated; the others pass by an anti-join, in which the keys
    travel to them where they are few, so that a large stored table is neither sorted nor shuffled.
    """
    own = delta.select(*keys).distinct()
    made = upsert(delta, stored.join(own, keys, "left_semi"))
    return stored.join(own, keys, "left_anti").unionByName(made.select(*stored.columns)), made


def delete_file_artifacts(artifacts: DataFrame, edges: DataFrame, mentions: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Code artifacts of the files (column path) gone, with their edges and mentions."""
    gone = file_artifacts(artifacts, paths)
    return artifacts.join(gone, "id", "left_anti"), delete_touching(edges, gone), mentions.join(gone.select(F.col("id").alias("artifact_id")), "artifact_id", "left_anti")


def add_aliases(concepts: DataFrame, extra: DataFrame) -> DataFrame:
    """concepts with aliases (id, alias, pos) that are new but for case against the name and each other; first occurrence wins."""
    listed = concepts.select("id", "name", F.posexplode_outer("aliases").alias("pos", "alias"))
    all_ = listed.select("id", F.lit(0).alias("part"), "pos", "alias").union(extra.join(concepts.select("id"), "id", "left_semi").select("id", F.lit(1), "pos", "alias"))
    kept = all_.where("alias is not null").groupBy("id", F.lower("alias").alias("low")).agg(F.min(F.struct("part", "pos", "alias")).alias("a"))
    kept = kept.join(concepts.select("id", F.lower("name").alias("own")), "id").where("low <> own or a.part = 0")
    folded = kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("a")), lambda a: a["alias"]).alias("_aliases"))
    return concepts.join(folded, "id", "left").withColumn("aliases", F.coalesce("_aliases", F.array().cast("array<string>"))).select(*concepts.columns)


def set_status(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: id, status."""
    return patch(edges, decisions.select("id", "status"))


def confirm_above(edges: DataFrame, least: float, edge_type: str | None = None) -> DataFrame:
    """Proposed edges of at least this confidence confirmed."""
    due = (F.col("status") == "proposed") & (F.col("confidence") >= F.lit(float(least)))
    if edge_type:
        due = due & (F.col("type") == edge_type)
    return edges.withColumn("status", F.when(due, "confirmed").otherwise(F.col("status")))


def diff_files(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """path and state (new, changed, unchanged, gone) of stored against listed files (path, mtime)."""
    a, b = stored.select("path", F.col("mtime").alias("was")), listing.select("path", F.col("mtime").alias("now"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full").select("path", "was", "now", state.alias("state"))


def stale_files(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """Stored files that have another time or are gone; files never stored are not stale."""
    return diff_files(stored, listing).where(F.col("state").isin("changed", "gone")).select("path")
