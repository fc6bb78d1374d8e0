"""Paired evaluation: deterministic checks, pass rates, and McNemar's exact test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def check_cells(cells: DataFrame) -> DataFrame:
    """cells (task, arm, code, fix, violation: patterns) with passed: the fix is there and no violation."""
    has = lambda p: F.coalesce(F.regexp_like("code", F.col(p)), F.lit(False))
    return cells.withColumn("passed", ~has("violation") & has("fix"))


def pass_rates(cells: DataFrame) -> DataFrame:
    """arm, n, passed and the whole percent of (task, arm, passed)."""
    a = cells.groupBy("arm").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))
    return a.withColumn("percent", F.expr("100 * n_passed div n"))


def paired(cells: DataFrame, base: str, other: str) -> DataFrame:
    """One row: b (only other passed), c (only base passed), n tasks with both arms."""
    flags = cells.where(F.col("arm").isin(base, other)).groupBy("task").agg(F.bool_or(F.when(F.col("arm") == base, F.col("passed"))).alias("x"), F.bool_or(F.when(F.col("arm") == other, F.col("passed"))).alias("y"))
    both = flags.where("x is not null and y is not null")
    return both.agg(F.count_if(~F.col("x") & F.col("y")).alias("b"), F.count_if(F.col("x") & ~F.col("y")).alias("c"), F.count("*").alias("n"))


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact p of b against c discordant pairs, at most 1.

    Up to 1,000 pairs the terms C(n, k) / 2**n are summed from the first one on, which is exact but for rounding. Of more
    the first would underflow: the terms are summed relative to the last, the greatest, from it downwards, and the last
    is told by its logarithm, which Stirling's series gives.
    """
    n, least = b + c, F.least(b, c)

    def log_factorial(k: Column) -> Column:
        """ln k!: by the series from 10 on, by a product below."""
        x = k.cast("double") + 1
        series = (x - 0.5) * F.log(x) - x + 0.5 * F.log(F.lit(2 * math.pi)) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
        small = F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(10)]), F.least(k, F.lit(9)).cast("int") + 1)
        return F.when(k < 10, small).otherwise(series)

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * k.cast("double") / (n - k + 1).cast("double")  # C(n, k - 1) / C(n, k)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    def up(acc: Column, k: Column) -> Column:
        term = acc["term"] * (n - k + 1).cast("double") / k.cast("double")
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    def steps(first: Column, last: Column, by: int) -> Column:
        return F.when(least >= 1, F.sequence(first.cast("long"), last.cast("long"), F.lit(by).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    both = lambda x: F.struct(x.alias("term"), x.alias("sum"))
    top = F.greatest(least, F.lit(1))
    exact = F.aggregate(steps(F.lit(1), top, 1), both(F.pow(F.lit(0.5), n.cast("double"))), up, lambda a: a["sum"])
    last = log_factorial(n) - log_factorial(least) - log_factorial(n - least) - n.cast("double") * F.log(F.lit(2.0))
    relative = F.aggregate(steps(top, F.lit(1), -1), both(F.lit(1.0)), step, lambda a: a["sum"])
    return F.least(F.lit(1.0), 2 * F.when(n <= 1000, exact).otherwise(F.exp(last + F.log(relative))))


def arm_deltas(cells: DataFrame, base: str) -> DataFrame:
    """arm and its percentage points over the base arm."""
    rates = pass_rates(cells)
    with_base = rates.agg(F.max(F.when(F.col("arm") == base, F.col("percent"))).alias("of_base"), F.collect_list(F.struct("arm", "percent")).alias("arms"))  # as many as arms
    return with_base.select("of_base", F.inline("arms")).select("arm", "percent", (F.col("percent") - F.col("of_base")).alias("delta"))


def rule_seeds(rules: DataFrame, low: int = 20, high: int = 160) -> DataFrame:
    """title of each rule of fit length with a modal word, and the first of its concepts."""
    fit = F.length("title").between(low, high) & F.col("title").rlike(T.CONSTRAINT)
    return rules.where(fit).groupBy("title").agg(F.min("concept").alias("concept"))
