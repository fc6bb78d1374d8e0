"""Numbering without keys: right over many ranges, and what makes the rows runs once."""

from pyspark.sql import functions as F

from lexigraph.operators import ranks


def test_rows_to_number_are_made_once(spark):
    made, n = spark.sparkContext.accumulator(0), 500

    @F.udf("string")
    def name(i):
        made.add(1)
        return f"n{i * 7919 % 83}"

    df = spark.range(n).select(F.col("id").alias("i"), name("id").alias("name"))
    got = sorted((r["batch"], r["id"], r["name"], r["i"]) for r in ranks.batches(df, [], [F.col("name"), F.col("i")], 12).collect())
    want = sorted((f"n{i * 7919 % 83}", i) for i in range(n))
    assert [g[2:] for g in got] == want
    assert [g[:2] for g in got] == [(k // 12, k % 12 + 1) for k in range(n)]
    assert made.value == n
