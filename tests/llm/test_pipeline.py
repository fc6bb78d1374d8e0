"""The pipeline's stages on a small table: schema, decisions, whole output."""

import random

import corpus_pipeline as P


def test_stages_keep_schema_and_drop_what_they_should(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language_id", "quality_rules", "minhash_near_dedup", "substring_dedup", "packing"]
    at, ids = docs, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, at, "/root/testdata/sf0.001")
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        now = {r["doc_id"] for r in at.select("doc_id").collect()}
        assert now <= ids and at.count() == len(now)
        ids = now
    packed = P.pack(spark, at, "").select("doc_id").distinct().count()
    assert packed == len(ids)


def test_stages_take_an_empty_table(spark):
    none = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, "").count() == 0


def test_stages_bear_awkward_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows and columns with clashing names: nothing of the user's is lost."""
    r = random.Random(2)
    words = ["".join(r.choice(["an", "the", "ing", "tion", "er"]) for _ in range(r.randint(1, 3))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) + r.choice(["", "", ".", ","]) for _ in range(n))
    texts = [prose(r.randint(40, 90)) for _ in range(60)]
    rows = [(i, t, r.choice(["en", "fr"]), r.choice(["a", "b", None]), len(t)) for i, t in enumerate(texts)]
    rows += [(100, None, "en", "a", None), (101, "", None, None, 0), (102, prose(9000), "en", "a", 1), (103, "!! 12 ??", "en", "a", 8), (None, prose(60), None, None, None), (None, None, None, None, None)]
    rows += [rows[3], rows[3], (104, texts[5], "en", "a", 1), (None, texts[6], "en", "a", 1)]
    clash = ["score", "REJECTED", "lang_pred", "n_words", "kept", "distance", "n_removed", "kept_spans", "component_id", "text_key", "own_score", "row", "_rank"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash)
    docs = spark.createDataFrame([(*x, *(f"{c}!" for c in clash)) for x in rows], schema)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.dtypes == docs.dtypes, name
        got = out.collect()
        assert all(x[c] == f"{c}!" for x in got for c in clash), name
        if name == "language_id":
            assert not [x for x in got if x["doc_id"] in (100, 101, 103)] and sum(x["doc_id"] == 3 for x in got) == 3
        if name == "quality_rules":
            assert not [x for x in got if x["doc_id"] in (100, 101, 103)] and len([x for x in got if x["doc_id"] is not None and x["doc_id"] < 60]) > 50
        if name == "minhash_near_dedup":
            assert {100, 101, 102, 103} <= {x["doc_id"] for x in got} and 104 not in {x["doc_id"] for x in got}
            assert sum(x["text"] == texts[6] for x in got) == 1 and {x["doc_id"] for x in got} >= set(range(60))
        if name == "substring_dedup":
            assert not [x for x in got if x["doc_id"] == 104] and {x["text"] for x in got if x["doc_id"] == 5} == {texts[5]}
    assert {x["doc_id"] for x in P.pack(spark, docs, "").select("doc_id").distinct().collect()} == {x[0] for x in rows}
