"""Queries of the checked reads, on the market of the test tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import reads, serving
from .catalog import ALERT_SQL, DECIDE_SQL
from .registering import n, query, r

FIRST = "(SELECT min(item_id) FROM products WHERE country_code = 'vn' AND item_id > 0)"


def first_offer(m):
    """Shop and item of the smallest Vietnamese item id, as a reader would name them."""
    row = m.products().filter("country_code = 'vn' and item_id > 0").agg(F.min(F.struct("item_id", "shop_id")).alias("x")).first()["x"]
    return "vn", row["shop_id"], row["item_id"]


@query(f" SELECT item_id, shop_id, snapshot_date, round(price, 4) AS price, currency, total_weight_g, package_ambiguous, company_id FROM products p JOIN attributes a USING (country_code, shop_id, item_id, company_id) WHERE item_id = {FIRST} ORDER BY snapshot_date DESC LIMIT 1", 1)
def read_product_snapshot(m):
    return m.reads().product_snapshot(*first_offer(m)).rows.select("item_id", "shop_id", "snapshot_date", r("price"), "currency", "total_weight_g", "package_ambiguous", "company_id")


LISTED = " FROM products WHERE country_code = 'vn' AND product_name ILIKE '%ring%' QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY snapshot_date DESC) = 1"


@query(f" SELECT item_id, snapshot_date, monthly_sold_value AS sold, company_id {LISTED} ORDER BY snapshot_date DESC, monthly_sold_value DESC NULLS LAST, shop_id, item_id LIMIT 20", 1)
def read_products_page(m):
    return m.reads().list_products("vn", query="RING", limit=20).rows.select("item_id", "snapshot_date", F.col("monthly_sold_value").alias("sold"), "company_id")


@query(f" SELECT count(*) AS total_count FROM (SELECT item_id {LISTED})", 1)
def read_products_total(m):
    return m.reads().list_products("vn", query="ring").total


@query(" SELECT item_id FROM products WHERE country_code = 'vn' AND shop_id IN (1, 2) AND company_id = 'company_1' QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY snapshot_date DESC) = 1 ORDER BY snapshot_date DESC, monthly_sold_value DESC NULLS LAST, shop_id, item_id LIMIT 20", 1)
def read_products_scoped(m):
    return m.reads(scopes=[("vn", 1), ("vn", 2), ("id", 3)]).list_products("vn", company_id="company_1").rows.select("item_id")


@query(" SELECT company_id, count(DISTINCT (shop_id, item_id)) AS sku_count, array_to_string(list_sort(list(DISTINCT shop_id)), ',') AS shops, array_to_string(list_sort(list(DISTINCT seller_entity_id)), ',') AS sellers FROM attributes WHERE country_code = 'id' GROUP BY 1", 1)
def read_companies(m):
    text = lambda c: F.concat_ws(",", F.col(c).cast("array<string>"))
    return m.reads().list_companies("id").rows.select("company_id", "sku_count", text("shop_ids").alias("shops"), text("distributor_names").alias("sellers"))


CURRENT = ALERT_SQL + ", current AS (SELECT r.*, a.country_code, a.shop_id, a.company_id FROM raised r JOIN attributes a USING (item_id) WHERE snapshot_date = (SELECT max(snapshot_date) FROM signals x WHERE x.item_id = r.item_id))"


@query(CURRENT + " SELECT item_id AS source_item_id, snapshot_date, a.t AS alert_type, round(a.v, 4) AS metric_value, company_id FROM current WHERE country_code = 'vn' AND a.s = 'high' ORDER BY snapshot_date DESC, shop_id, item_id, a.t LIMIT 50", 2)
def read_alerts_page(m):
    return m.reads().list_alerts("vn", severity="HIGH").rows.select("source_item_id", "snapshot_date", "alert_type", r("metric_value"), "company_id")


@query(CURRENT + " SELECT count(*) AS total_count FROM current WHERE country_code = 'vn' AND company_id = 'company_2'", 2)
def read_alerts_total(m):
    return m.reads().list_alerts("vn", company_id="company_2").total


@query(CURRENT + " SELECT snapshot_date, a.t AS alert_type, a.s AS severity, round(a.v, 4) AS metric_value FROM current WHERE item_id = (SELECT min(item_id) FROM current WHERE country_code = 'vn' AND item_id > 0 AND shop_id > 0) ORDER BY snapshot_date DESC, a.s DESC, a.t LIMIT 10", 2)
def read_competitor_alerts(m):
    """The alerts of the smallest Vietnamese item that has any."""
    held = m.reads()
    shown = held.list_alerts("vn", limit=100).total.first()[0] and held._alerts().filter("country_code = 'vn' and source_item_id > 0 and source_shop_id > 0")
    row = shown.agg(F.min(F.struct("source_item_id", "source_shop_id")).alias("x")).first()["x"] if shown else None
    offer = ("vn", row["source_shop_id"], row["source_item_id"]) if row else first_offer(m)
    return held.competitor_alerts(*offer).rows.select("snapshot_date", "alert_type", "severity", r("metric_value"))


@query(DECIDE_SQL + " SELECT item_id AS source_item_id, action, priority FROM decided WHERE country_code = 'vn' AND status = 'needs_cost_validation' ORDER BY snapshot_date DESC, CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, shop_id, item_id LIMIT 50", 2)
def read_recommendations_page(m):
    return m.reads().list_recommendations("vn", status="needs_cost_validation").rows.select("source_item_id", "action", "priority")


@query(DECIDE_SQL + " SELECT count(*) AS total_count FROM decided WHERE country_code = 'id' AND company_id = 'company_3' AND status = 'monitoring_only'", 2)
def read_recommendations_total(m):
    return m.reads().list_recommendations("id", company_id="company_3", status="monitoring_only").total


@query(DECIDE_SQL + f" SELECT item_id AS source_item_id, currency, status AS recommendation_status, action, priority, round(price, 4) AS source_price, round(mid, 4) AS market_reference_price, round(discount_percent, 3) AS source_discount_percent FROM decided WHERE item_id = {FIRST}", 2)
def read_recommendation(m):
    return m.reads().recommendation(*first_offer(m)).rows.select("source_item_id", "currency", "recommendation_status", "action", "priority", r("source_price"), r("market_reference_price"), r("source_discount_percent", 3))


SAID = {
    "watch": "'Theo dõi ' || watched || ' sản phẩm thay thế từ đơn vị bán khác. Các sản phẩm này hữu ích để quan sát cạnh tranh nhưng chưa đủ tương đương để làm giá mục tiêu.'",
    "none": "'Chưa có đủ sản phẩm đối thủ tương đồng và đáng tin cậy; hệ thống chưa đề xuất thay đổi.'",
    "outlier": "'Giá hiện tại nằm ngoài khoảng so sánh thông thường; cần kiểm tra lại dữ liệu trước khi hành động.'",
    "reduce": "'Cân nhắc điều chỉnh giá về gần mức giá trung vị của nhóm đối thủ, sau khi xác nhận giá sàn.'",
}


@query(DECIDE_SQL + f""" SELECT item_id AS source_item_id, currency, round(floor, 4) AS price_floor, cost AS cost_value, CASE WHEN step IN ('watch', 'none', 'outlier') THEN NULL ELSE round(coalesce(discount_percent, 0), 3) END AS recommended_discount_percent, 10.0::DOUBLE AS margin_min_pct,
 CASE WHEN status = 'scenario_only' THEN 'seeded_cost_not_verified' ELSE CASE step WHEN 'watch' THEN 'not_applicable' WHEN 'none' THEN 'not_applicable' WHEN 'outlier' THEN 'outlier_review_required' WHEN 'no_cost' THEN 'blocked_cost_missing' WHEN 'below' THEN 'market_below_margin_floor'
  WHEN 'no_terms' THEN 'blocked_promotion_terms_missing' ELSE CASE WHEN cost IS NOT NULL THEN 'verified' ELSE 'unverified_cost_missing' END END END AS constraint_status,
 array_to_string(list_filter([CASE WHEN step = 'watch' THEN 'substitute_benchmark_available' END, CASE WHEN step = 'watch' THEN 'price_target_not_comparable' END, CASE WHEN step = 'none' THEN 'not_enough_evidence' END, CASE WHEN step = 'outlier' THEN 'price_outlier' END,
  CASE branch WHEN 'price' THEN 'price_above_peer_median' WHEN 'discount' THEN 'discount_below_peer_median' WHEN 'pressure' THEN 'competitive_pressure_observed' END,
  CASE step WHEN 'no_cost' THEN CASE WHEN branch = 'price' THEN 'cost_required_before_price_change' ELSE 'cost_required_before_voucher' END WHEN 'reduce' THEN 'target_respects_margin_floor' WHEN 'below' THEN 'peer_median_below_margin_floor' WHEN 'no_terms' THEN 'promotion_terms_required_before_voucher' WHEN 'hold' THEN 'price_close_to_peer_median' END,
  CASE WHEN status = 'scenario_only' THEN 'seeded_cost_scenario_not_executable' END], lambda x: x IS NOT NULL), ',') AS reasons,
 CASE step WHEN 'watch' THEN {SAID["watch"]} WHEN 'none' THEN {SAID["none"]} WHEN 'outlier' THEN {SAID["outlier"]} WHEN 'reduce' THEN {SAID["reduce"]} ELSE 'Giữ nguyên giá hiện tại và tiếp tục theo dõi tín hiệu thị trường.' END AS recommendation_text,
 19::BIGINT AS evidence_fields, watched::BIGINT AS benchmark_peer_count, base_type AS price_baseline_type, round(list_price, 4) AS source_list_price, round(pressure, 6) AS pressure_score, 'context_only_not_price_target' AS benchmark_usage,
 CASE WHEN cost IS NOT NULL THEN CASE WHEN seeded THEN 'seeded_scenario' ELSE 'verified_input' END END AS cost_source FROM decided""", 2)
def recommendation_cards(m):
    """Constraints, reasons, texts and the evidence JSON of every card."""
    cards = m.recommendations()
    assert len(cards.columns) == 24
    kind = "benchmark_peer_count long, price_baseline_type string, source_list_price double, pressure_score double, benchmark_usage string, cost_assumption struct<cost_source: string>"
    held = cards.withColumn("e", F.from_json("evidence", kind)).withColumn("evidence_fields", F.size(F.json_object_keys("evidence")))
    return held.select(
        "source_item_id", "currency", r("price_floor"), "cost_value", r("recommended_discount_percent", 3), "margin_min_pct", "constraint_status", F.concat_ws(",", F.from_json("reason_codes", "array<string>")).alias("reasons"), "recommendation_text",
        n("evidence_fields"), "e.benchmark_peer_count", "e.price_baseline_type", r("e.source_list_price", 4, "source_list_price"), r("e.pressure_score", 6, "pressure_score"), "e.benchmark_usage", "e.cost_assumption.cost_source",
    )


@query(f" SELECT item_id AS source_item_id, snapshot_date, round(price, 4) AS source_price, trust AS signal_confidence FROM signals WHERE item_id = {FIRST} ORDER BY snapshot_date DESC LIMIT 1", 2)
def read_market_signals(m):
    return m.reads().market_signals(*first_offer(m)).rows.select("source_item_id", "snapshot_date", r("source_price"), "signal_confidence")


@query(""", wanted AS (SELECT source_item_id, any_value(shop_id) AS shop_id FROM found JOIN offers o ON o.item_id = source_item_id WHERE found.country_code = 'vn' AND source_item_id > 0 GROUP BY 1 ORDER BY 1 LIMIT 1)
SELECT f.rank AS peer_rank, f.target_item_id, f.match_type AS relation, f.match_score, round(p.price, 4) AS price, a.total_weight_g, a.company_id FROM found f LEFT JOIN (SELECT * FROM products QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY snapshot_date DESC) = 1) p ON p.item_id = f.target_item_id
LEFT JOIN attributes a ON a.item_id = f.target_item_id WHERE f.source_item_id = (SELECT source_item_id FROM wanted) ORDER BY f.rank LIMIT 5""", 1)
def read_peers(m):
    first = m.peers().filter("peer_status = 'peer_found' and country_code = 'vn' and source_item_id > 0").agg(F.min(F.struct("source_item_id", "source_shop_id")).alias("x")).first()["x"]
    if first is None:
        first = {"source_shop_id": 1, "source_item_id": 1}
    got = m.reads().peers("vn", first["source_shop_id"], first["source_item_id"]).rows
    return got.select(n("peer_rank"), "target_item_id", "relation", "match_score", r("price"), "total_weight_g", "company_id")


@query(" SELECT item_id, shop_id, snapshot_date, round(price, 4) AS price FROM products WHERE country_code = 'id' AND product_name ILIKE '%bolt%' QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY snapshot_date DESC) = 1 ORDER BY shop_id, item_id LIMIT 10", 1)
def read_search_products(m):
    return m.reads().search_products("id", " bolt ").rows.select("item_id", "shop_id", "snapshot_date", r("price"))


@query(DECIDE_SQL + """ SELECT count(*) FILTER (WHERE status = 'recommended') AS recommended, count(*) FILTER (WHERE status = 'scenario_only') AS scenarios, count(*) FILTER (WHERE status = 'monitoring_only') AS monitoring,
 count(*) FILTER (WHERE status IN ('needs_cost_validation', 'needs_promotion_validation', 'constraint_blocked')) AS needs_review, count(*) FILTER (WHERE status = 'insufficient_evidence') AS insufficient FROM decided""", 2)
def queue_totals(m):
    return reads.queue_totals(m.recommendations())


@query("SELECT round(avg(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_discount END), 6) AS avg_discount FROM lineitem")
def average_discount(m):
    rows = m.table("lineitem").select(F.when(F.col("l_linenumber") != 1, F.col("l_discount")).alias("discount_percent"))
    return reads.average_discount(rows).select(r("avg_discount", 6))


@query("SELECT o_orderkey, greatest(0, date_diff('day', o_orderdate::DATE, DATE '1998-01-01')) AS age_days, greatest(0, date_diff('day', o_orderdate::DATE, DATE '1998-01-01')) > 2 AS is_stale FROM orders")
def snapshot_age(m):
    o = m.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("snapshot_date"))
    return reads.staleness(o, datetime.date(1998, 1, 1)).select("o_orderkey", n("age_days"), "is_stale")


SHOWN = """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_retailprice / (p_size * 10) * 100 WHEN p_partkey % 3 = 1 THEN p_retailprice / (p_size * 20) * 100 ELSE p_retailprice / (p_size % 4 + 1) END AS v,
 CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN '100 g' WHEN p_partkey % 3 = 1 THEN '100 ml' ELSE 'unit' END AS shown_basis FROM part"""


def packed(m):
    k, size = F.col("p_partkey") % 3, F.col("p_size")
    return m.table("part").select(
        "p_partkey", F.col("p_retailprice").alias("price"), (size % 7 == 0).alias("package_ambiguous"), F.lit(False).alias("price_variant_ambiguous"), F.when(k == 0, size * 10.0).alias("total_weight_g"),
        F.when(k == 1, size * 20.0).alias("total_volume_ml"), (size % 4 + 1).alias("quantity"),
    )


@query(f"SELECT p_partkey, round(v, 4) AS shown_price, shown_basis FROM ({SHOWN})")
def shown_price(m):
    return reads.normalized_price(packed(m)).select("p_partkey", r("shown_price"), "shown_basis")


@query(f"SELECT p_partkey FROM ({SHOWN}) WHERE shown_basis = '100 ml'")
def comparable_peers(m):
    return reads.comparable(packed(m).filter("p_partkey % 3 = 1 and not package_ambiguous").limit(1), packed(m)).select("p_partkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS rows FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2")
def positional_grouping(m):
    return m.spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS rows FROM {lineitem} GROUP BY 1, 2 ORDER BY 1, 2", lineitem=m.table("lineitem"))


RATE_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
step(event_id, user_id, k, held, allowed) AS (
 SELECT event_id, user_id, k, [us], TRUE FROM e WHERE k = 1
 UNION ALL SELECT e.event_id, e.user_id, e.k, CASE WHEN len(list_filter(s.held, lambda x: x > e.us - 36000000000)) < 2 THEN list_append(list_filter(s.held, lambda x: x > e.us - 36000000000), e.us) ELSE list_filter(s.held, lambda x: x > e.us - 36000000000) END,
  len(list_filter(s.held, lambda x: x > e.us - 36000000000)) < 2 FROM step s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT event_id, allowed FROM step"""


@query(RATE_SQL)
def rate_limit_exact(m):
    rows = m.table("events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return serving.rate_limit(rows, "user_id", "us", "event_id", limit=2, seconds=36_000).select("event_id", "allowed")
