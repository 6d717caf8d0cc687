"""Queries of versioned publication, fed change events and streamed limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.incremental import EventFeed
from ..sources.scratch import folder
from ..sources.versions import Warehouse
from ..streaming import limits
from .catalog_reads import RATE_SQL
from .registering import n, query, r


def totals(m, most: int | None = None):
    """Orders by status; the rows of priorities above ``most`` make the job fail."""
    o = m.table("orders")
    if most is not None:
        o = o.withColumn("o_totalprice", F.when(F.substring("o_orderpriority", 1, 1).cast("int") <= most, F.col("o_totalprice")).otherwise(F.raise_error(F.lit("broken row")).cast("double")))
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))


@query("SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def version_after_failure(m):
    """A second run that fails halfway leaves the first version to readers."""
    w = Warehouse(m.spark, folder(m.spark, "warehouse"))
    w.publish("order_totals", lambda pin: totals(m))
    try:
        w.publish("order_totals", lambda pin: totals(m, 2))
    except Exception as error:
        if "broken row" not in str(error):
            raise
    return w.pin().read("order_totals").select("o_orderstatus", "orders", r("total", 2))


@query("""SELECT 'success' AS status, 'order_totals' AS stage, count(DISTINCT o_orderstatus) AS rows, FALSE AS explained FROM orders UNION ALL SELECT 'failed', 'order_totals', NULL, TRUE
 UNION ALL SELECT 'success', 'order_shares', count(DISTINCT o_orderstatus), FALSE FROM orders""")
def version_log(m):
    """The run log: rows counted while they were written, the failure's message, and a stage built from another."""
    w = Warehouse(m.spark, folder(m.spark, "warehouse"))
    w.publish("order_totals", lambda pin: totals(m))
    w.publish("order_shares", lambda pin: pin.read("order_totals").select("o_orderstatus", "orders"))
    try:
        w.publish("order_totals", lambda pin: totals(m, 2))
    except Exception as error:
        if "broken row" not in str(error):
            raise
    rows = F.get(F.map_values(F.from_json("row_counts", "map<string, long>")), F.lit(0))
    return w.runs().select("status", "stage", rows.alias("rows"), F.coalesce(F.col("error_message").contains("broken row"), F.lit(False)).alias("explained"))


@query("""SELECT 'pinned' AS reader, o_orderstatus, count(*) AS orders FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 2 UNION ALL SELECT 'current', o_orderstatus, count(*) FROM orders GROUP BY 2""")
def version_pinned(m):
    """A reader keeps its version while a newer one is published and older ones are collected."""
    w, count = Warehouse(m.spark, folder(m.spark, "warehouse")), lambda df: df.groupBy("o_orderstatus").agg(F.count("*").alias("orders"))
    w.publish("order_totals", lambda pin: count(m.table("orders").filter("o_orderkey % 3 = 0")))
    w.publish("order_totals", lambda pin: count(m.table("orders").filter("o_orderkey % 2 = 0")))
    pin = w.pin()
    w.publish("order_totals", lambda pin: count(m.table("orders")))
    w.collect(keep=1, held=[pin])
    named = lambda p, name: p.read("order_totals").select(F.lit(name).alias("reader"), "o_orderstatus", "orders")
    return named(pin, "pinned").unionByName(named(w.pin(), "current"))


FED_SQL = """, seen AS (SELECT item_id, snapshot_date, lag(snapshot_date) OVER w AS before, price, discount_percent, promotion_id, voucher_code, lag(price) OVER w AS p0, lag(discount_percent) OVER w AS d0, lag(promotion_id) OVER w AS o0, lag(voucher_code) OVER w AS v0
 FROM products WINDOW w AS (PARTITION BY country_code, shop_id, item_id ORDER BY snapshot_date))
SELECT item_id, snapshot_date, before AS previous_date, t AS event_type FROM (SELECT *, unnest([CASE WHEN price IS DISTINCT FROM p0 THEN 'price_changed' END, CASE WHEN discount_percent IS DISTINCT FROM d0 THEN 'discount_changed' END,
 CASE WHEN promotion_id IS DISTINCT FROM o0 THEN 'promotion_changed' END, CASE WHEN voucher_code IS DISTINCT FROM v0 THEN 'voucher_changed' END]) AS t FROM seen WHERE before IS NOT NULL) WHERE t IS NOT NULL"""


def fed(m, days: list) -> EventFeed:
    feed = EventFeed(Warehouse(m.spark, folder(m.spark, "warehouse")))
    products, done = m.products(), []
    for part in days:
        earlier = products.filter(F.year("snapshot_date").isin(done)) if done else None
        feed.feed(products.filter(F.year("snapshot_date").isin(part)), earlier)
        done += part
    return feed


def years(m) -> list[int]:
    return sorted(r[0] for r in m.products().select(F.year("snapshot_date")).distinct().collect())  # seven in the test tables


@query(FED_SQL, 1)
def events_fed_by_year(m):
    """The years' snapshots fed one by one give the events of the whole history."""
    return fed(m, [[y] for y in years(m)]).events().select("item_id", "snapshot_date", "previous_date", "event_type")


@query(FED_SQL, 1)
def events_fed_late(m):
    """Years in disorder: late offers are judged anew."""
    y = years(m)
    return fed(m, [y[::2], y[1::2]]).events().select("item_id", "snapshot_date", "previous_date", "event_type")


@query(RATE_SQL)
def rate_limit_stream(m):
    """The events arrive in four files; the state of each user goes from trigger to trigger."""
    m.spark.conf.set("spark.sql.streaming.stateStore.providerClass", limits.PROVIDER)
    rows = m.table("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    cuts = rows.agg(F.percentile_approx(F.unix_micros("ts"), [0.25, 0.5, 0.75])).first()[0]
    arrived, out = folder(m.spark, "requests"), folder(m.spark, "limited")
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        us, part = F.unix_micros("ts"), rows
        part = part if lo is None else part.filter(us > lo)
        (part if hi is None else part.filter(us <= hi)).coalesce(1).write.mode("append").parquet(arrived)
    limits.limit_files(m.spark, arrived, rows.schema, "user_id", "event_id", "ts", out, folder(m.spark, "limit-state"), 2, 36_000).awaitTermination()
    return m.spark.read.parquet(out).select("event_id", "allowed")
