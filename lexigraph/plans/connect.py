"""The connectors by name, and a sync that runs the configured sources by phase."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import snapshot
from ..operators.snapshot import Graph
from ..sources import files as S
from ..sources.code_graphs import code_graphs
from ..sources.pages import page_documents
from ..sources.registry import CODE, DOC, Config, Connector, Registry, parse_config
from . import ingest
from .sync import curate_and_link

CONFIG_NAMES = ("lexigraph.yml", "lexigraph.yaml")


def find_config(folder: str) -> Config:
    """The configuration in a folder, of its possible names the first there is; defaults if there is none."""
    for name in CONFIG_NAMES:
        path = os.path.join(folder, name)
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                return parse_config(f.read())
    return Config()


def _of_path(read, put):
    """A connector's function for a source with a path; without one the graph stays."""

    def run(spark: SparkSession, graph: Graph, source: dict) -> tuple[Graph, DataFrame | None]:
        return put(graph, read(spark, source["path"])) if source.get("path") else (graph, None)

    return run


def _web(spark: SparkSession, graph: Graph, source: dict) -> tuple[Graph, DataFrame | None]:
    """Fetched pages (a Parquet table of url, html), of the listed URLs alone where there is a list."""
    if not source.get("path"):
        return graph, None
    pages = spark.read.parquet(source["path"])
    if source.get("urls"):
        pages = pages.join(S.url_list(spark, source["urls"]), "url", "left_semi")
    return ingest.ingest_documents(graph, page_documents(pages), "web")


def builtin() -> Registry:
    known = Registry()
    known.add(Connector("symbols", "declarations of a source tree as candidate concepts, incremental", CODE, _of_path(S.source_tree, ingest.ingest_symbols)))
    known.add(Connector("code", "mentions of terms in a source tree", CODE, _of_path(S.source_tree, ingest.ingest_mentions)))
    known.add(Connector("codegraph", "resolved code graph, a JSON export", CODE, _of_path(code_graphs, ingest.ingest_code_graph)))
    known.add(Connector("astindex", "external symbol index, exported tables", CODE, _of_path(S.symbol_index, lambda graph, index: ingest.ingest_symbol_index(graph, *index))))
    known.add(Connector("docs", "Markdown documents: describes, rules, relations", DOC, _of_path(S.document_files, ingest.ingest_documents)))
    known.add(Connector("web", "fetched web pages: describes, rules, relations", DOC, _web))
    return known


@dataclass
class Report:
    source: str
    said: str
    failed: bool = False


def run_source(spark: SparkSession, graph: Graph, root: str, registry: Registry, source: dict) -> tuple[Graph, Report]:
    """The graph after one source, written as a version; a source that fails leaves it as it was and is reported."""
    kind = str(source.get("type"))
    if kind not in registry.known:
        return graph, Report(kind, "no such source type", True)
    try:
        after, counted = registry.known[kind].ingest(spark, graph, source)
        if counted is None:
            return graph, Report(kind, "no path configured")
        said = ", ".join(f"{r['n']} {r['counter']}" for r in counted.collect())  # as many rows as counters
        snapshot.write(after, root)
        return snapshot.read(spark, root), Report(kind, said)
    except Exception as error:  # noqa: BLE001  one source's fault does not stop the others
        return graph, Report(kind, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}", True)


def sync_sources(spark: SparkSession, graph: Graph, root: str, config: Config, registry: Registry | None = None, concept_verdicts: DataFrame | None = None, rule_verdicts: DataFrame | None = None) -> tuple[Graph, list[Report]]:
    """Code sources, verdicts on concepts, merging, document sources, verdicts on rules, confirmation.

    Faults of sources are reported and passed over; faults of verdicts stop the run, what was written before stays.
    """
    registry = registry or builtin()
    first, second = registry.split_by_phase(config.sources)
    reports: list[Report] = []

    def run(graph: Graph, sources: list[dict]) -> Graph:
        for source in sources:
            graph, report = run_source(spark, graph, root, registry, source)
            reports.append(report)
        return graph

    graph = curate_and_link(run(graph, first), root, lambda g: run(g, second), concept_verdicts, rule_verdicts, config.gate, config.accept_above)
    return graph, reports
