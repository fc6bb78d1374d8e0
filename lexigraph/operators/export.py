"""Counts, the graph export and its legend."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_of, null_if_blank
from .gates import resolved
from .ranks import first_per_key


def table_counts(concepts: DataFrame, artifacts: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    named = (("concepts", concepts), ("artifacts", artifacts), ("mentions", mentions), ("edges", edges))
    out = None
    for name, df in named:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.union(one)
    return out


def edge_counts_by(edges: DataFrame, column: str) -> DataFrame:
    return edges.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key")


def top_terms(mentions: DataFrame, limit: int = 30) -> DataFrame:
    return mentions.groupBy("normalized").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "normalized").limit(limit)


def _first_values(ends: DataFrame, value, most: int | None, name: str) -> DataFrame:
    """id, the first `most` distinct values in order, and how many there are; only those that stay are collected."""
    own = ends.select("id", value.alias("v")).where("v is not null").distinct()
    sizes = own.groupBy("id").agg(F.count("*").alias(f"n_{name}"))
    kept = own if most is None else first_per_key(own, ["id"], [F.col("v")], most)
    return kept.groupBy("id").agg(F.array_sort(F.collect_list("v")).alias(name)).join(sizes, "id")


def export_nodes(concepts: DataFrame, edges: DataFrame, artifacts: DataFrame, files: int = 60, docs: int = 40) -> DataFrame:
    """Each concept with its symbol count, files, documents and rules: ungated, rejected edges too."""
    ends = edges.select("type", F.col("dst_id").alias("id"), "src_id").join(artifacts.select(F.col("id").alias("src_id"), "ref", "title"), "src_id")
    of = lambda kind: ends.where(F.col("type") == kind)
    code = of("implements").groupBy("id").agg(F.count("*").alias("symbols"))
    listed = [_first_values(of("implements"), file_of("ref"), files, "files"), _first_values(of("describes"), F.col("title"), docs, "docs")]
    ruled = of("constrains").where("title is not null").groupBy("id").agg(F.array_sort(F.collect_list("title")).alias("rules"))
    none = F.array().cast("array<string>")
    out = concepts.select("id", "name", "definition", "bounded_context", resolved().alias("resolved"))
    for more in (code, *listed, ruled):
        out = out.join(more, "id", "left")
    return out.select(
        "id", "name", "definition", "bounded_context", "resolved",
        F.coalesce("symbols", F.lit(0)).cast("long").alias("symbols"), F.coalesce("n_files", F.lit(0)).cast("int").alias("n_files"),
        *(F.coalesce(c, none).alias(c) for c in ("files", "docs", "rules")),
    )


def export_links(concepts: DataFrame, edges: DataFrame, resolved_only: bool = False) -> DataFrame:
    """relates edges between known concepts, no loops; resolved_only: both ends defined."""
    nodes = (concepts.where(resolved()) if resolved_only else concepts).select(F.col("id").alias("_node"))
    own = edges.where("type = 'relates' and src_id <> dst_id").select("src_id", "dst_id", "confidence", "status")
    return own.join(nodes, own["src_id"] == F.col("_node"), "left_semi").join(nodes, F.col("dst_id") == F.col("_node"), "left_semi")


def degrees(links: DataFrame) -> DataFrame:
    both = links.select(F.col("src_id").alias("id"), F.col("dst_id").alias("other")).union(links.select("dst_id", "src_id"))
    return both.groupBy("id").agg(F.countDistinct("other").alias("related"))


def context_legend(concepts: DataFrame) -> DataFrame:
    """Defined concepts of each bounded context."""
    context = F.coalesce(null_if_blank("bounded_context"), F.lit("(no context)"))
    return concepts.where(resolved()).groupBy(context.alias("context")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "context")


def write_html(nodes: DataFrame, links: DataFrame, template: str, path: str, placeholder: str = "__GRAPH_DATA__", most: int = 200_000) -> None:
    """A page with the graph's JSON in place of the placeholder: a view of a product's vocabulary, made on the driver.

    A template without the placeholder and a graph with more than `most` nodes or links are refused: no reader has use
    for such a page, and the driver does not gather it.
    """
    if placeholder not in template:
        raise ValueError(f"the template has no {placeholder}")
    data = {}
    for name, df in (("nodes", nodes), ("links", links)):
        rows = df.select(F.to_json(F.struct("*")).alias("j")).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} {name}: choose some of the concepts")
        data[name] = [json.loads(r["j"]) for r in rows]
    with open(path, "w", encoding="utf-8") as f:
        f.write(template.replace(placeholder, json.dumps(data, ensure_ascii=False).replace("</", "<\\/")))
