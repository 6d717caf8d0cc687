"""Read-side queries: scope, filters, latest rows, publication gate, memories, rate limits."""

from __future__ import annotations

from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import memory_score

STAGES_OK = "success"


def bounded(limit: int, most: int) -> int:
    if not isinstance(limit, int) or not 1 <= limit <= most:
        raise ValueError(f"limit must lie in 1..{most}")
    return limit


def scope_filter(df: DataFrame, scopes: list[tuple[str, int]] | None, shop: str = "shop_id") -> DataFrame:
    """None leaves all rows, an empty list none."""
    if scopes is None:
        return df
    hits = [(F.col("country_code") == c) & (F.col(shop) == s) for c, s in scopes]
    return df.filter(reduce(Column.__or__, hits, F.lit(False)))


def where(df: DataFrame, text: tuple[list[str], str] | None = None, **equal) -> DataFrame:
    """Conjunction of the given equalities or lists, and one case-blind search over columns."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    if text and text[1]:
        df = df.filter(reduce(Column.__or__, [F.col(c).ilike(f"%{text[1]}%") for c in text[0]]))
    return df


def latest_where(df: DataFrame, keys: list[str], date: str = "snapshot_date", **filters) -> DataFrame:
    """Filters come before the latest row is chosen, so an older row that fits is returned."""
    w = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    return where(df, **filters).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def level(c: str) -> Column:
    return F.when(F.col(c) == "high", 3).when(F.col(c) == "medium", 2).otherwise(1)


def current_only(df: DataFrame, keys: list[str], date: str = "snapshot_date") -> DataFrame:
    """Rows of each key's last day."""
    return df.join(df.groupBy(*keys).agg(F.max(date).alias(date)), [*keys, date])


def companies(products: DataFrame) -> DataFrame:
    return products.groupBy("country_code", "company_id").agg(
        F.count_distinct(F.struct("country_code", "shop_id", "item_id")).alias("products"), F.array_sort(F.collect_set("shop_id")).alias("shops"), F.array_sort(F.collect_set("seller_entity_id")).alias("sellers"),
    )


def published(runs: DataFrame) -> DataFrame:
    """The newest run of each stage, if it succeeded; a later failure hides an earlier success."""
    w = Window.partitionBy("stage").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    return runs.withColumn("__rn", F.row_number().over(w)).filter((F.col("__rn") == 1) & (F.col("status") == STAGES_OK)).drop("__rn")


def recent(messages: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return messages.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def search_memories(memories: DataFrame, query: str, n: int = 5, window: int = 100) -> DataFrame:
    """Best of the last ``window`` memories by matched tokens, then newest first."""
    last = memories.orderBy(F.col("id").desc()).limit(window)
    return last.withColumn("score", memory_score(query, F.col("content"))).filter("score > 0").orderBy(F.desc("score"), F.desc("id")).limit(n)


def trailing_count(events: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """How many events of the key lie in the trailing window, this one included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("trailing", F.count("*").over(w))


def rate_limit(events: DataFrame, key: str, ts: str, order: str, limit: int = 60, seconds: float = 60) -> DataFrame:
    """Adds allowed: at most ``limit`` accepted events in any trailing window; rejected ones don't count.

    Order-dependent state, so each sorted partition streams through a fold that holds at
    most ``limit`` times of one key.
    """
    names = [*events.columns, "allowed"]

    def run(batches):
        current, held = object(), deque()
        for pdf in batches:
            allowed = []
            for k, t in zip(pdf[key], pdf[ts].astype("int64" if pdf[ts].dtype.kind != "M" else "datetime64[us]").astype("int64")):
                if k != current:
                    current, held = k, deque()
                while held and held[0] <= t - seconds * 1_000_000:
                    held.popleft()
                allowed.append(len(held) < limit)
                if allowed[-1]:
                    held.append(t)
            yield pdf.assign(allowed=pd.array(allowed, dtype="bool"))[names]

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", allowed boolean"
    return events.repartition(key).sortWithinPartitions(key, ts, order).mapInPandas(run, kind)
