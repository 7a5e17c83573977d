"""Rounding against Python's, which goes by the exact binary value."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.geo import domain_radius_nm, register_sql_functions
from tidemark.functions.rounding import half_even, rounded


def test_half_even_is_exact(spark):
    rng = np.random.default_rng(3)
    values = [0.0, 2.675, 1.005, 0.5, 1.5, 2.5, -0.5, -1.5, -2.675, 0.125, 0.375, 1e-9, 123456.7890625, math.nan, math.inf, -math.inf, 1e300]
    values += [k / 64 for k in range(-200, 200)] + rng.normal(0, 100, 2000).tolist() + (np.round(rng.uniform(-50, 50, 2000), 3) + 0.0005).tolist()
    df = spark.createDataFrame([(x,) for x in values] + [(None,)], "x double")
    digits = (0, 2, 3, 6)
    for row in df.select("x", *(half_even(F.col("x"), n).alias(f"r{n}") for n in digits)).collect():
        for n in digits:
            x, got = row["x"], row[f"r{n}"]
            want = x if x is None or not math.isfinite(x) or abs(x) * 10**n >= 2**52 else round(x, n)
            assert got == want or math.isnan(got) and math.isnan(want), (x, n)
    with pytest.raises(ValueError):
        half_even(F.col("x"), 23)


def test_rounded_takes_doubles_or_named_columns(spark):
    df = spark.createDataFrame([(1, 2.675, 0.125, "a")], "k int, x double, `y.z` double, s string")
    assert tuple(rounded(df, 2).first()) == (1, 2.67, 0.12, "a")
    assert tuple(rounded(df, 2, "x").first()) == (1, 2.67, 0.125, "a")


def test_domain_radius_in_sql(spark):
    register_sql_functions(spark)
    rows = spark.range(0, 360, 15).select(F.col("id").cast("double").alias("b"), F.lit(180.0).alias("n"))
    for model in ("fujii", "goodwin"):
        both = rows.select(domain_radius_nm(model, F.col("b"), F.col("n")).cast("double").alias("want"), F.expr(f"domain_radius_{model}(b, n)").alias("got")).collect()
        assert all(math.isclose(r["want"], r["got"]) for r in both) and len(both) == 24
    assert spark.sql("SELECT domain_radius_fujii(10D, 0D)").first()[0] is None
