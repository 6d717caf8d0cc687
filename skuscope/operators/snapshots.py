"""Snapshot tables: natural-key dedup, quality report, change events, latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["country_code", "shop_id", "item_id"]
#: Fields whose change is an event, and the event's name.
WATCHED = {"price": "price_changed", "discount_percent": "discount_changed", "promotion_id": "promotion_changed", "voucher_code": "voucher_changed"}


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the first in ``order``."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def latest(rows: DataFrame, keys: list[str] = KEY, date: str = "snapshot_date") -> DataFrame:
    """The last row of each key; of several on one day, that of the smallest source_file, then row hash."""
    ties = [F.col("source_file")] if "source_file" in rows.columns else []
    return first_wins(rows, keys, [F.col(date).desc(), *ties, F.xxhash64(*[F.col(c) for c, t in rows.dtypes if not t.startswith("map")])])


def quality(rows: DataFrame, keys: list[str], order: list[str], dataset: str = "dataset", price: str = "price") -> DataFrame:
    """Per dataset: source, loaded and duplicate rows; null, non-positive and outlying prices of the loaded.

    The loaded row of a key is its first in ``order``.
    """
    per_key = rows.groupBy(dataset, *keys).agg(F.count("*").alias("n"), F.min_by(F.struct(price), F.struct(*order)).alias("p"))
    c = F.col(f"p.{price}")
    return per_key.groupBy(dataset).agg(
        F.sum("n").alias("source_rows"), F.count("*").alias("loaded_rows"), (F.sum("n") - F.count("*")).alias("duplicate_rows"),
        F.count_if(c.isNull()).alias("null_price_rows"), F.count_if(c <= 0).alias("invalid_price_rows"), F.count_if(c >= 10_000_000).alias("outlier_price_rows"),
    )


def change_events(products: DataFrame) -> DataFrame:
    """A row for each watched field that differs from the snapshot before; the first snapshot has none."""
    w = Window.partitionBy(*KEY).orderBy("snapshot_date")
    before = {c: F.lag(c).over(w) for c in WATCHED}
    held = products.select(*KEY, "snapshot_date", F.lag("snapshot_date").over(w).alias("previous_date"), *WATCHED, *[v.alias(f"old_{c}") for c, v in before.items()])

    def event(c: str):
        changed = ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
        text = lambda x: F.col(x).cast("string")
        return F.when(changed, F.struct(F.lit(WATCHED[c]).alias("event_type"), text(f"old_{c}").alias("old_value"), text(c).alias("new_value")))

    found = held.filter("previous_date is not null").withColumn("e", F.explode(F.array_compact(F.array(*[event(c) for c in WATCHED]))))
    return found.select(*KEY, "snapshot_date", "e.event_type", "previous_date", "e.old_value", "e.new_value")


def resolve_entities(products: DataFrame, registry: DataFrame) -> DataFrame:
    """Company and seller of each shop; a shop that the registry lacks stands for itself."""
    fallback = F.concat(F.lit("shop_"), F.col("shop_id").cast("string"))
    names = ["company_id", "company_name", "seller_entity_id", "seller_entity_name"]
    unique = registry.groupBy("country_code", "shop_id").agg(*[F.max(c).alias(c) for c in names])
    held = products.drop(*[c for c in names if c in products.columns]).join(unique, ["country_code", "shop_id"], "left")
    return held.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), fallback) for c in names})
