import json
import random

import pytest
from pyspark.sql import functions as F

from lexigraph.operators import code
from lexigraph.sources.code_graphs import code_graph_pieces, code_graphs
from lexigraph.sources.files import code_graph_export

ODD = ['plain', 'a } b', '"quoted"', 'back\\slash', '\\"}', 'tab\tnew\nline', '{[', 'é}ü', '', ':', 'a": "b']


def rows_of(exports):
    source = F.coalesce("source", F.lit("codegraph")).alias("source")
    member = exports.select(source, F.explode("communities").alias("c")).select("source", "c.label", F.explode("c.members").alias("m")).select("source", "label", "m.kind", "m.name", "m.file")
    call = exports.select(source, F.explode("calls").alias("c")).select("source", "c.from", "c.to")
    return sorted(map(tuple, member.collect()), key=str), sorted(map(tuple, call.collect()), key=str)


def graph(rng, n):
    odd = lambda: rng.choice(ODD)
    members = lambda k: [dict(rng.sample(list({"kind": odd(), "name": f"{odd()}{i}", "file": f"f{i}", "extra": {"kind": "no", "x": [{"name": "no"}]}}.items()), 4)) for i in range(k)]
    communities = [dict(rng.sample(list({"label": odd(), "members": members(rng.randrange(4)), "other": [{"kind": "no", "name": "no"}], "tags": [odd(), odd()]}.items()), 4)) for _ in range(n)]
    calls = [{"from": odd(), "weight": 1.5, "to": odd()} for _ in range(n)]
    return dict(rng.sample(list({"repo": "r", "source": rng.choice(["one", None, "t}wo"]), "extra": {"communities": [{"label": "no"}], "calls": [{"from": "no", "to": "no"}]}, "more": [{"label": "no"}], "communities": communities, "calls": calls}.items()), 6))


@pytest.mark.parametrize("indent", [None, 2])
def test_pieces_equal_whole_documents(spark, tmp_path, indent):
    rng = random.Random(7)
    for i in range(4):
        (tmp_path / f"{i}.json").write_text(json.dumps(graph(rng, 12), indent=indent, ensure_ascii=i % 2 == 0))
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "list.json").write_text(json.dumps([graph(rng, 3), graph(rng, 3)]))
    want = rows_of(code_graph_export(spark, str(tmp_path)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:  # splits of a few hundred bytes, inside strings too
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = rows_of(code_graph_pieces(spark, str(tmp_path)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(want[0]) > 50 and len(want[1]) > 50 and got == want


def test_large_files_go_in_pieces_and_give_the_same_graph(spark, tmp_path):
    own = graph(random.Random(3), 20)
    (tmp_path / "g.json").write_text(json.dumps(own))
    whole, parts = (code.code_graph(code_graphs(spark, str(tmp_path), most)) for most in (1 << 20, 100))
    for a, b in zip(whole, parts):
        a, b = (sorted(str(r) for r in x.collect()) for x in (a, b))
        assert a == b and a
