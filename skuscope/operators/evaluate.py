"""Matching evaluation: label join, confusion, per-class scores, precision at k, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRICT = ["same_product", "same_product_variant"]
PEERS = [*STRICT, "substitute"]
SOURCE = ["country_code", "source_shop_id", "source_item_id"]


def join_labels(reviews: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels by pair_key where both have one, else by review_id; the last label of a key (by row_number) wins."""
    key = "pair_key" if "pair_key" in labels.columns and "pair_key" in reviews.columns else "review_id"
    last = labels.groupBy(key).agg(F.max_by("review_label", "row_number").alias("__label"))
    return reviews.join(last, key, "left").withColumn("review_label", F.coalesce("__label", "review_label")).drop("__label")


def confusion(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    return pairs.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("pairs"))


def class_scores(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, support, precision, recall, f1) of each actual label, null where undefined."""
    cells = confusion(pairs, actual, predicted)
    tp = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("pairs")).otherwise(0))
    real = cells.groupBy(F.col("actual").alias("label")).agg(F.sum("pairs").alias("support"), tp.alias("tp"))
    said = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("pairs").alias("said"))
    held = real.join(said, "label", "left").withColumn("precision", F.col("tp") / F.nullif(F.coalesce("said", F.lit(0)), F.lit(0)))
    held = held.withColumn("recall", F.col("tp") / F.col("support"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return held.select("label", "support", "precision", "recall", f1.alias("f1"))


def ranked_precision(pairs: DataFrame, relevant: list[str] = PEERS) -> DataFrame:
    """Sources with exactly five labelled rows: how many, precision at 1 and 5, coverage."""
    hit = F.col("review_label").isin(relevant).cast("double")
    groups = pairs.groupBy(*SOURCE).agg(F.count("*").alias("n"), F.min_by("source_status", "rank").alias("status"), F.min_by(hit, "rank").alias("p1"), F.avg(hit).alias("p5")).filter("n = 5")
    ok = F.col("status") == "matchable"
    return groups.agg(
        F.count("*").alias("complete_sources"), F.count_if(ok).alias("matchable_sources"), F.count_if(F.col("status") == "not_enough_evidence").alias("abstained_sources"),
        F.avg(F.when(ok, F.col("p1"))).alias("precision_at_1"), F.avg(F.when(ok, F.col("p5"))).alias("precision_at_5"), F.avg(ok.cast("double")).alias("coverage"),
    )


def strata(reviews: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.col("review_stratum"), F.lit("")), F.lit("legacy_unstratified"))
    return reviews.groupBy(name.alias("stratum")).agg(F.count("*").alias("pairs"), F.count_distinct(F.struct(*SOURCE)).alias("sources"))
