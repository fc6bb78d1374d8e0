"""The whole flow over immutable snapshots: code, verdicts on concepts, merging, documents, verdicts on rules, confirmation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import curate, dml, serve, snapshot
from ..operators.snapshot import Graph
from . import ingest


def curate_and_link(graph: Graph, root: str, link: Callable[[Graph], Graph], concept_verdicts: DataFrame | None = None, rule_verdicts: DataFrame | None = None, gate: float = 0.5, accept_above: float = 0.8) -> Graph:
    """Verdicts on concepts, merging, `link` (documents), verdicts on rules, confirmation; without verdicts their steps are left out.

    Each step is written as a version and read again, which cuts its lineage and leaves the last whole one to readers.
    """
    spark = graph.edges.sparkSession

    def written(graph: Graph, **tables: DataFrame) -> Graph:
        snapshot.write(graph.with_tables(**tables), root)
        return snapshot.read(spark, root)

    if concept_verdicts is not None:
        candidates = serve.candidate_concepts(graph.concepts, graph.edges, graph.artifacts).select("id", "name")
        concepts, edges = curate.canonicalize(graph.concepts, graph.edges, candidates, concept_verdicts, gate)
        graph = written(graph, concepts=concepts, edges=edges)
    concepts, edges, _ = curate.dedupe_by_name(graph.concepts, graph.edges)
    graph = link(written(graph, concepts=concepts, edges=edges))
    if rule_verdicts is not None:
        candidates = serve.candidate_rules(graph.edges, graph.artifacts, graph.concepts)
        edges, artifacts = curate.refine_rules(graph.edges, graph.artifacts, candidates, rule_verdicts)
        graph = written(graph, edges=edges, artifacts=artifacts)
    return written(graph, edges=dml.confirm_above(graph.edges, accept_above))


def sync(graph: Graph, root: str, exports: list[DataFrame], documents: list[DataFrame], concept_verdicts: DataFrame | None = None, rule_verdicts: DataFrame | None = None, gate: float = 0.5, accept_above: float = 0.8) -> Graph:
    """A new snapshot under root from code-graph exports and documents that are at hand as tables."""
    spark = graph.edges.sparkSession

    def put(graph: Graph, sources: list[DataFrame], into: Callable) -> Graph:
        for source in sources:
            snapshot.write(into(graph, source)[0], root)
            graph = snapshot.read(spark, root)
        return graph

    graph = put(graph, exports, ingest.ingest_code_graph)
    return curate_and_link(graph, root, lambda g: put(g, documents, ingest.ingest_documents), concept_verdicts, rule_verdicts, gate, accept_above)
