"""Code-graph files of many documents: whole ones are parsed as they are, long ones and those across splits in pieces."""

import json
import random

import pytest

from lexigraph.sources import code_graphs
from lexigraph.sources.files import code_graph_export
from tests.test_code_graphs import graph, rows_of


def written(tmp_path, between, n=30):
    """Documents of mixed length, each in a file and all in one."""
    rng = random.Random(11)
    texts = [json.dumps(graph(rng, rng.choice([1, 1, 1, 9])), ensure_ascii=i % 2 == 0) for i in range(n)]
    for i, t in enumerate(texts):
        (tmp_path / "each").mkdir(exist_ok=True)
        (tmp_path / "each" / f"{i}.json").write_text(t)
    listed = between == ",\n"
    (tmp_path / "all.json").write_text("[" * listed + between.join(texts) + "]" * listed + "\n")
    return str(tmp_path / "each"), str(tmp_path / "all.json")


def test_documents_within_a_split_are_not_cut_into_tokens(spark, tmp_path, monkeypatch):
    each, whole = written(tmp_path, "\n")
    want = rows_of(code_graph_export(spark, each))

    def never(*_):
        raise AssertionError("no token is needed")

    monkeypatch.setattr(code_graphs, "_values", never)
    assert rows_of(code_graphs.code_graph_pieces(spark, whole)) == want and len(want[0]) > 50


@pytest.mark.parametrize("between", ["\n", ",\n", " "])
def test_long_documents_among_short_ones(spark, tmp_path, between):
    each, whole = written(tmp_path, between)
    want = rows_of(code_graph_export(spark, each))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # documents go over several batches
    try:
        assert rows_of(code_graphs.code_graph_pieces(spark, whole, 900)) == want
        assert rows_of(code_graphs.code_graph_pieces(spark, whole)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
