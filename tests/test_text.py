"""Text functions on the inputs that fix their meaning."""

import pytest
from pyspark.sql import functions as F

from lexigraph.functions import text as T


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", f("v").alias("x")).orderBy("i").collect()]


def test_identifiers(spark):
    assert one(spark, T.normalize, "packParcelTwice", "CARGO__LIMIT", "dock:crane/9/lift", "harbour.tide-table", "XMLHarbour", "") == ["pack parcel twice", "cargo limit", "dock crane lift", "harbour tide table", "xmlharbour", ""]
    assert one(spark, T.split_identifier, "q_77_berth_3x", None) == [["berth", "3x"], None]
    assert one(spark, T.mention_term, "setBerthName", "b", "index value", "tideTable", "z" * 81) == ["berth", None, None, "tide table", None]
    assert one(spark, T.json_string, 'a "b"\n\\', "é") == ['"a \\"b\\"\\n\\\\"', '"é"']


def test_normal_keys(spark):
    words = ["Ferries", "policies", "boxes", "class", "status", "statuses", "databases", "is", " Tests "]
    assert one(spark, T.normal_key, *words) == ["ferry", "policy", "box", "class", "statu", "status", "databas", "is", "test"]


def test_cluster_labels_and_paths(spark):
    refs = {"src/harbour/api/tide.go#Rise": "Harbour", "main.go": "Misc", "src/lib/Util.ts": "Misc", "src/lib/berth.ts": "Berth", "": "Misc", "Lib/CORE/quay/x.kt#f": "Quay", "Makefile": "Makefile", "server/.env": "Misc", "a/ /b.go": "A"}
    assert one(spark, T.cluster_label, *refs) == list(refs.values())
    assert one(spark, T.top_segment, "./quay/b", "", "x") == ["quay", "code", "x"]
    assert one(spark, T.page_name, "http://h/a/b/?q=1", "http://h/a", "") == ["b", "a", ""]
    assert one(spark, T.language_tag, "a.go", "b.tsx", "c.kts", "d.py", "e.rs") == ["[go]", "[ts]", "[kt]", "[py]", "[..]"]
    assert one(spark, T.file_of, "a.go#B#C") == ["a.go"] and one(spark, T.symbol_of, "a.go#B#C") == ["C"]


def test_slugs_and_aliases(spark):
    assert one(spark, T.slug, "Getting Started!", "Описание", "a" * 80) == ["getting-started", "section", "a" * 60]
    assert one(spark, T.alias_from_heading, "2) Tide table:", "Overview", "a b c d e f g", "uses `x`", "  ") == ["Tide table", None, None, None, None]


#: Sentences that state a constraint, and what rejects each of the others.
KEEP = [
    "Ships shall leave the lock before the tide turns.",
    "A berth is given to at most two vessels.",
    "Within 12 hours of arrival the crew reports to the office.",
    "Nobody may not sign twice, says the old book.",
    "Груз всегда взвешивают дважды перед погрузкой.",
    "Use of `a`, the crane, is forbidden at night.",
]
DROP = {
    "table row": "crane | must be locked | night shift",
    "address": "see tide://harbour.example/locks, which must open",
    "too many code marks": "`one` and `two` must be equal",
    "schema line": "berth_id uuid = only for the owner",
    "too short": "must go",
    "too long": "The crane must stop " + "and wait for the tide " * 12,
    "no constraint": "The harbour lies in the north of the town.",
    "a word that only holds one": "Mustard and shallow water are a fine pair of words.",
}


def test_rule_sentences(spark):
    assert all(one(spark, T.is_prose_rule, *KEEP)) and not any(one(spark, T.is_prose_rule, *DROP.values()))
    assert all(one(spark, T.may_have_rules, *KEEP, "AT\n MOST two", "muſt"))
    body = "Start. - Locks must close.  A plain line here.\n* Locks must close.\n> Boats cannot turn back. Ropes should be dry. It shall be said."
    assert one(spark, T.rules_in, body, "nothing of the kind", None) == [["Locks must close.", "Boats cannot turn back.", "Ropes should be dry."], [], None]


def test_html(spark):
    html = "<head><title>t</title></head><h2>A &amp; B</h2><p>x<br>y</p><ul><li>one<li>two</ul><script>z</script>"
    assert one(spark, T.html_to_text, html, "plain &amp;")[1] == "plain &amp;"
    out = one(spark, T.html_to_text, html)[0]
    assert out.startswith("## A & B") and "- one" in out and "z" not in out and "<" not in out
    assert one(spark, T.decode_entities, "&amp;lt;") == ["<"]


def test_replies(spark):
    assert one(spark, T.json_array_in, 'Sure: [{"a":1}] done', "none") == ['[{"a":1}]', ""]
    assert one(spark, T.is_hit, "Concept X", "No concepts found", "there is no concept linked") == [True, False, False]
    assert one(spark, T.snippet, "# H\n\n  first line \nsecond") == ["first line"]


@pytest.mark.parametrize(("n", "confidence"), [(1, 0.4), (4, 0.7), (5, 0.8), (9, 0.9)])
def test_relates_confidence(spark, n, confidence):
    got = spark.range(1).select(T.relates_confidence(F.lit(n)).alias("x")).first()["x"]
    assert abs(got - confidence) < 1e-9
