"""The driver contract: names, and a few queries against their SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["edge_upsert_last_wins", "code_context", "dedupe_repointed_edges", "rules_top3_per_section", "dictionary_match", "longest_prefix_module", "usage_summary", "mcnemar_exact"]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in entry.queries()[name](spark, SF).collect())
    assert got == sorted(str(r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
