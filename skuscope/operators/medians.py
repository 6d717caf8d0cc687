"""Exact medians of groups of any size, without a task that holds a group.

Spark's median buffers a group's values in one task. Here every pass keeps mergeable counts
only: a first pass gives each group's size and approximate quantiles around its middle; a
second counts the values of buckets that cut that bracket finely (with one bucket below it and
one from its upper end on, so nothing depends on how good the quantiles are); the third counts the
distinct values of the bucket or two that hold the middle ranks. What is sorted at the end is
one bucket's distinct values a group.

Nulls don't count; a group without a value has a null median; not-a-number is above all numbers;
groups of an even size take the mean of both middle values; null keys are groups like others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Error of the first quantiles as a fraction of the rows, and buckets of the bracket.
ERROR, BUCKETS = 1e-4, 4096


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def _long(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(keys, name, v): a row for each value that isn't null."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, c in values.items()])
    return df.select(*keys, F.explode(pairs).alias("e")).select(*keys, "e.name", "e.v").filter("v is not null")


def _bucket(buckets: int) -> Column:
    """0 below the bracket, 1..buckets inside, one more from its upper end on: in the order of the values."""
    v, a, b = F.col("v"), F.col("a"), F.col("b")
    flat = F.when(v < a, 0).when(v == a, 1).otherwise(buckets + 1)
    return F.when(a.isNull() | F.isnan(b) | F.isnan(a) | (b - a == float("inf")) | (a == b), flat).when(v < a, 0).when(v >= b, buckets + 1).otherwise(F.least(F.lit(buckets), 1 + F.floor((v - a) / (b - a) * buckets).cast("int")))


def exact_medians(df: DataFrame, keys: list[str], values: dict[str, Column], buckets: int = BUCKETS, error: float = ERROR) -> DataFrame:
    """(keys, one column a name of ``values``): the groups of ``df`` with the medians of these columns."""
    rows, group = _long(df, keys, values), [*keys, "name"]
    middle = F.percentile_approx("v", [0.5 - 2 * error, 0.5 + 2 * error], int(1 / error))
    sizes = rows.groupBy(*group).agg(F.count("*").alias("size"), middle.alias("q")).select(*group, "size", F.col("q")[0].alias("a"), F.col("q")[1].alias("b"))
    sizes = sizes.withColumns({"low": F.expr("(size - 1) div 2"), "high": F.expr("size div 2")})
    placed = rows.alias("r").join(sizes.alias("s"), _same("r", "s", group)).select(*[f"r.{k}" for k in group], "r.v", "s.a", "s.b", "s.low", "s.high").withColumn("bucket", _bucket(buckets))
    order = Window.partitionBy(*group).orderBy("bucket")
    counts = placed.groupBy(*group, "bucket").agg(F.count("*").alias("n"), F.max("low").alias("low"), F.max("high").alias("high"))
    counts = counts.withColumn("upto", F.sum("n").over(order)).withColumn("below", F.col("upto") - F.col("n"))  # at most buckets + 2 rows a group
    chosen = counts.filter("(below <= low and low < upto) or (below <= high and high < upto)").select(*group, "bucket", "below", "low", "high")
    inside = placed.alias("r").join(chosen.alias("c"), _same("r", "c", [*group, "bucket"]))
    inside = inside.groupBy(*[F.col(f"r.{k}").alias(k) for k in group], F.col("c.below").alias("below"), F.col("r.v").alias("v")).agg(F.count("*").alias("n"), F.max("c.low").alias("low"), F.max("c.high").alias("high"))
    run = inside.withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy(*group, "below").orderBy("v"))).withColumn("from", F.col("upto") - F.col("n"))
    at = lambda rank: F.min(F.when((F.col("from") <= F.col(rank)) & (F.col(rank) < F.col("upto")), F.col("v")))
    found = run.groupBy(*group).agg(((at("low") + at("high")) / 2).alias("m"))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("m"))).alias(n) for n in values])
    every = df.select(*keys).distinct()
    return every.alias("k").join(wide.alias("w"), _same("k", "w", keys), "left").select(*[f"k.{k}" for k in keys], *[f"w.{n}" for n in values])
