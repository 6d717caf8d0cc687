"""Exact medians against Python's, whatever the groups hold."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from skuscope.operators.medians import exact_medians


@pytest.mark.parametrize("buckets,error", [(4096, 1e-4), (4, 0.2), (3, 0.01)])
def test_medians(spark, buckets, error):
    rng = random.Random(7)
    groups = {
        "even": [float(i) for i in range(100)], "odd": [rng.gauss(0, 1) for _ in range(301)], "equal": [5.0] * 200, "two": [1.0] * 50 + [9.0] * 50, "one": [3.5], "skewed": [10.0 ** rng.randrange(-300, 300) for _ in range(400)],
        "negative": [-float(i * i) for i in range(77)], "huge": [1.7e308, -1.7e308, 0.0], "heavy": [2.0] * 300 + [rng.random() for _ in range(200)], None: [1.0, 2.0, 4.0],
    }
    rows = [(g, v, -v if i % 3 else None) for g, vs in groups.items() for i, v in enumerate(vs)] + [("nulls", None, None), ("even", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    got = {r["g"]: (r["mx"], r["my"]) for r in exact_medians(df, ["g"], {"mx": F.col("x"), "my": F.col("y")}, buckets, error).collect()}
    half = lambda vs: None if not vs else (lambda s: (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2)(sorted(vs))
    assert got == {g: (half([v for k, v, _ in rows if k == g and v is not None]), half([y for k, _, y in rows if k == g and y is not None])) for g in {r[0] for r in rows}}
    assert got["odd"][0] == statistics.median(groups["odd"])


def test_no_task_sorts_a_group(spark):
    df = spark.range(50_000).select(F.lit(1).alias("g"), F.sqrt("id").alias("x"))
    got = exact_medians(df, ["g"], {"m": F.col("x")})
    assert got.first()["m"] == (24_999**0.5 + 25_000**0.5) / 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan
