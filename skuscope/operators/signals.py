"""Peer groups, daily market signals and threshold alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .snapshots import KEY

IDENTITY = ["same_product", "same_product_variant"]
ACTIVITY = [*IDENTITY, "substitute"]
PEER_TYPES = [*ACTIVITY, "near_match"]
SOURCE = ["country_code", "source_shop_id", "source_item_id"]
DAY = [*SOURCE, "snapshot_date"]
#: Names the rules in evidence.
VERSION = "market-signals-1"


def peer_groups(matches: DataFrame, min_score: float = 0.60) -> DataFrame:
    """Accepted peers, and one abstention row for each source without any."""
    ok = matches.filter((F.col("source_status") == "matchable") & F.col("target_item_id").isNotNull() & (F.col("match_score") >= min_score) & F.col("match_type").isin(PEER_TYPES))
    found = ok.select(*SOURCE, "target_shop_id", "target_item_id", F.col("rank").cast("int").alias("rank"), "match_score", F.col("match_type").alias("relation"), F.lit("peer_found").alias("peer_status"))
    none = matches.select(*SOURCE).distinct().join(found.select(*SOURCE).distinct(), SOURCE, "left_anti")
    return found.unionByName(none.withColumn("peer_status", F.lit("not_enough_evidence")), allowMissingColumns=True)


def basis(prefix: str = "") -> tuple[Column, Column]:
    """Comparison basis of an offer and how many basis units it holds."""
    c = lambda n: F.col(prefix + n)
    clear = ~c("package_ambiguous") & ~c("price_variant_ambiguous")
    rules = [("100_g", c("total_weight_g"), 100.0), ("100_ml", c("total_volume_ml"), 100.0), ("mỗi_đơn_vị", c("quantity"), 1.0)]
    name, units = F.when(F.lit(False), ""), F.when(F.lit(False), F.lit(0.0))
    for label, amount, per in rules:
        name = name.when(clear & (amount > 0), label)
        units = units.when(clear & (amount > 0), amount.cast("double") / per)
    return name, units


def units_for(wanted: Column, prefix: str = "") -> Column:
    """Basis units of an offer on another offer's basis."""
    c = lambda n: F.col(prefix + n)
    clear = ~c("package_ambiguous") & ~c("price_variant_ambiguous")
    out = F.when(F.lit(False), F.lit(0.0))
    for label, amount, per in (("100_g", c("total_weight_g"), 100.0), ("100_ml", c("total_volume_ml"), 100.0), ("mỗi_đơn_vị", c("quantity"), 1.0)):
        out = out.when((wanted == label) & clear & (amount > 0), amount.cast("double") / per)
    return out


def _as_source(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"shop_id": "source_shop_id", "item_id": "source_item_id"})


def _as_target(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"shop_id": "target_shop_id", "item_id": "target_item_id"})


PACK = ["total_weight_g", "total_volume_ml", "quantity", "package_ambiguous", "price_variant_ambiguous"]
TARGET = ["country_code", "target_shop_id", "target_item_id"]


def source_profiles(peers: DataFrame, attributes: DataFrame) -> DataFrame:
    name, units = basis()
    held = peers.select(*SOURCE).distinct().join(_as_source(attributes.select(*KEY, *PACK)), SOURCE, "left")
    return held.select(*SOURCE, name.alias("price_comparison_basis"), units.alias("source_basis_units"))


def source_snapshots(products: DataFrame, profiles: DataFrame) -> DataFrame:
    """Snapshots of sources with their own price history on a comparable basis."""
    held = _as_source(products).join(profiles, SOURCE)
    w = Window.partitionBy(*SOURCE)
    paid = F.when(F.col("price") > 0, F.col("price"))
    has = F.col("price_comparison_basis").isNotNull()
    return held.withColumns({
        "source_historical_median_price": F.when(has, F.median(paid).over(w)),
        "source_price_observation_count": F.when(has, F.count(paid).over(w)).otherwise(0).cast("int"),
        "source_normalized_price": F.when((F.col("price") > 0) & (F.col("source_basis_units") > 0), F.col("price") / F.col("source_basis_units")),
    })


def engagement() -> Column:
    return F.coalesce("rating_count", F.lit(0)) + F.coalesce("liked_count", F.lit(0))


LEADER = ["country_code", "lead_shop_id", "lead_item_id"]


def led(rows: DataFrame, items: list[str], same: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sources whose lists of ``items`` and values of ``same`` agree have one leader: (SOURCE, LEADER) of all, the leaders' rows by LEADER.

    What follows from a list is found once and joined back, so it grows with the different lists. A list is a source's ranked peers.
    """
    lists = rows.groupBy(*SOURCE, *same).agg(F.sort_array(F.collect_list(F.struct(*items))).alias("list"))
    alike = Window.partitionBy("country_code", *same, "list")
    lists = lists.withColumn("lead", F.min(F.struct("source_shop_id", "source_item_id")).over(alike))
    members = lists.select(*SOURCE, F.col("lead.source_shop_id").alias("lead_shop_id"), F.col("lead.source_item_id").alias("lead_item_id"), *same, "list")
    first = members.filter((F.col("source_shop_id") == F.col("lead_shop_id")) & (F.col("source_item_id") == F.col("lead_item_id")))
    return members.select(*SOURCE, *LEADER[1:]), first.select(*LEADER, *same, F.inline("list"))


def peer_daily(products: DataFrame, attributes: DataFrame, peers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Identity peers per source and day: medians over sellers of each seller's medians."""
    found = peers.filter((F.col("peer_status") == "peer_found") & F.col("relation").isin(IDENTITY)).select(*SOURCE, "target_shop_id", "target_item_id")
    seen = products.select(*KEY, "snapshot_date", "price", "discount_percent", "monthly_sold_value", engagement().alias("engagement"))
    members, found = led(found.join(profiles, SOURCE), TARGET[1:], ["price_comparison_basis", "source_basis_units"])
    rows = found.join(_as_target(seen), TARGET).join(_as_target(attributes.select(*KEY, *PACK, "seller_entity_id")), TARGET, "left")
    units = units_for(F.col("price_comparison_basis"))
    rows = rows.withColumn("normalized", F.when((F.col("price") > 0) & (units > 0), F.col("price") / units)).filter("normalized is not null")
    seller = rows.groupBy(*LEADER, "snapshot_date", "seller_entity_id").agg(
        F.any_value("source_basis_units", True).alias("units"),
        *[F.median(c).alias(c) for c in ("normalized", "discount_percent", "monthly_sold_value", "engagement")],
    )
    price = F.col("normalized") * F.col("units")
    daily = seller.groupBy(*LEADER, "snapshot_date").agg(
        F.count("normalized").alias("peer_count"), F.min(price).alias("peer_min_price"), F.median(price).alias("peer_median_price"), F.max(price).alias("peer_max_price"),
        F.median("normalized").alias("peer_median_normalized_price"), F.median("discount_percent").alias("peer_median_discount_percent"),
        F.median("monthly_sold_value").alias("peer_median_monthly_sold"), F.median("engagement").alias("peer_median_engagement"),
    )
    return members.join(daily, LEADER).drop(*LEADER[1:])


def activity_peers(attributes: DataFrame, peers: DataFrame) -> DataFrame:
    found = peers.filter((F.col("peer_status") == "peer_found") & F.col("relation").isin(ACTIVITY)).select(*SOURCE, "target_shop_id", "target_item_id")
    return found.join(_as_target(attributes.select(*KEY, "seller_entity_id")), TARGET).distinct()


def activity_counts(activity: DataFrame) -> DataFrame:
    return activity.groupBy(*SOURCE).agg(F.count_distinct("seller_entity_id").cast("int").alias("benchmark_peer_count"))


def event_flags(events: DataFrame) -> DataFrame:
    started = (F.col("event_type") == "promotion_changed") & ~F.lower(F.coalesce("new_value", F.lit(""))).isin("", "none", "null")
    down = (F.col("event_type") == "price_changed") & (F.col("old_value").try_cast("double") > F.col("new_value").try_cast("double"))
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    return events.groupBy(*KEY, "snapshot_date").agg(flag(started).alias("promotion_started"), flag(down).alias("price_down"))


def event_daily(activity: DataFrame, events: DataFrame) -> DataFrame:
    """Sellers among the activity peers that cut a price or started a promotion that day."""
    members, found = led(activity, [*TARGET[1:], "seller_entity_id"], [])
    day = [*LEADER, "snapshot_date"]
    seller = found.join(_as_target(event_flags(events)), TARGET).groupBy(*day, "seller_entity_id").agg(F.max("price_down").alias("d"), F.max("promotion_started").alias("p"))
    daily = seller.groupBy(*day).agg(F.sum("d").cast("int").alias("price_down_peer_count"), F.sum("p").cast("int").alias("promotion_peer_count"))
    return members.join(daily, LEADER).drop(*LEADER[1:])


def log_return(now: Column, before: Column) -> Column:
    return F.greatest(F.lit(-100.0), F.least(F.lit(100.0), 100.0 * F.ln((1.0 + now) / (1.0 + before))))


def market_signals(products: DataFrame, attributes: DataFrame, peers: DataFrame, events: DataFrame) -> DataFrame:
    """One row per source and snapshot: peer prices, gaps, momentum, pressure, baseline, confidence."""
    profiles = source_profiles(peers, attributes)
    activity = activity_peers(attributes, peers)
    held = source_snapshots(products, profiles)
    held = held.join(peer_daily(products, attributes, peers, profiles), DAY, "left").join(activity_counts(activity), SOURCE, "left").join(event_daily(activity, events), DAY, "left")
    held = held.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("peer_count", "benchmark_peer_count", "price_down_peer_count", "promotion_peer_count")})
    w = Window.partitionBy(*SOURCE).orderBy("snapshot_date")
    held = held.withColumn("source_engagement", engagement())
    # windows first, in one pass over one sort
    held = held.withColumns({
        "p_sold": F.lag("monthly_sold_value").over(w), "p_peer": F.lag("peer_median_monthly_sold").over(w), "p_eng": F.lag("source_engagement").over(w),
        "p_peer_eng": F.lag("peer_median_engagement").over(w), "n_sold": F.count("monthly_sold_value").over(w), "n_peer": F.count("peer_median_monthly_sold").over(w),
    })
    price, market = F.col("price"), F.col("peer_median_price")
    index = F.when((market > 0) & (price > 0), price / market)
    sold, peer_sold, eng = F.col("monthly_sold_value"), F.col("peer_median_monthly_sold"), F.col("source_engagement")
    held = held.withColumns({
        "price_index": index, "price_gap_pct": (index - 1.0) * 100,
        "discount_gap_pct": F.col("discount_percent") - F.col("peer_median_discount_percent"),
        "source_sales_momentum_pct": F.when((F.col("n_sold") >= 7) & (F.col("p_sold") >= 20) & sold.isNotNull(), log_return(sold, F.col("p_sold"))),
        "peer_sales_momentum_pct": F.when((F.col("n_peer") >= 7) & (F.col("p_peer") >= 20) & peer_sold.isNotNull(), log_return(peer_sold, F.col("p_peer"))),
        "source_engagement_momentum_pct": F.when(F.col("p_eng") > 0, (eng / F.col("p_eng") - 1.0) * 100),
        "peer_engagement_momentum_pct": F.when((F.col("p_peer_eng") > 0) & F.col("peer_median_engagement").isNotNull(), (F.col("peer_median_engagement") / F.col("p_peer_eng") - 1.0) * 100),
    })
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    bench = F.col("benchmark_peer_count")
    share = lambda c: F.when(bench > 0, F.least(F.lit(1.0), F.col(c).cast("double") / bench)).otherwise(0.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = 0.35 * clamp(zero("price_gap_pct") / 25.0) + 0.25 * share("price_down_peer_count") + 0.20 * share("promotion_peer_count") + 0.20 * clamp(zero("peer_sales_momentum_pct") / 50.0)
    own = F.col("source_price_observation_count") >= 3
    listed = F.col("price_original")
    outlier = F.coalesce((F.col("price_index") < 0.25) | (F.col("price_index") > 4.0), F.lit(False))
    peers_n = F.col("peer_count")
    held = held.withColumn("competitive_pressure_score", score)
    pressure = F.col("competitive_pressure_score")
    return held.select(
        "country_code", "snapshot_date", "source_shop_id", "source_item_id", "currency", price.alias("source_price"), listed.alias("source_list_price"),
        "source_historical_median_price", "source_price_observation_count",
        F.when(market > 0, market).when(own, F.col("source_historical_median_price")).when(listed > 0, listed).alias("price_baseline_value"),
        F.when(market > 0, "peer_market_median").when(own, "own_history_median").when(listed > 0, "listed_reference").otherwise("unavailable").alias("price_baseline_type"),
        F.coalesce(market > 0, F.lit(False)).alias("price_baseline_actionable"),
        F.col("discount_percent").alias("source_discount_percent"), "price_comparison_basis", "source_normalized_price", "peer_median_normalized_price",
        F.when(peers_n > 0, "peer_found").otherwise("not_enough_evidence").alias("peer_status"), "peer_count", "benchmark_peer_count",
        "peer_min_price", "peer_median_price", "peer_max_price", "price_index", "price_gap_pct", outlier.alias("is_price_outlier"),
        F.when(outlier, "price_index_outside_0.25_4.0").alias("outlier_reason"), "peer_median_discount_percent", "discount_gap_pct",
        F.col("monthly_sold_value").alias("source_monthly_sold"), "peer_median_monthly_sold", "source_sales_momentum_pct", "peer_sales_momentum_pct",
        "source_engagement_momentum_pct", "peer_engagement_momentum_pct", "price_down_peer_count", "promotion_peer_count", "competitive_pressure_score",
        F.when(pressure >= 0.55, "high").when(pressure >= 0.25, "medium").otherwise("low").alias("pressure_level"),
        F.when(peers_n >= 3, "high").when((peers_n >= 1) | (bench >= 3), "medium").otherwise("low").alias("signal_confidence"),
        (peers_n + bench + F.col("price_down_peer_count") + F.col("promotion_peer_count")).alias("evidence_count"),
    )


def alert_rules() -> list[Column]:
    """Each rule as a nullable struct (alert_type, severity, metric_name, metric_value, threshold)."""
    c = F.col
    comparable = (c("peer_status") == "peer_found") & ~c("is_price_outlier")
    rules = [
        ("our_price_above_market", comparable & (c("price_gap_pct") >= 10), F.when(c("price_gap_pct") >= 20, "high").otherwise("medium"), "price_gap_pct", 10.0),
        ("our_discount_below_market", comparable & (c("discount_gap_pct") <= -10), F.when(c("discount_gap_pct") <= -20, "high").otherwise("medium"), "discount_gap_pct", -10.0),
        ("competitor_price_down", c("price_down_peer_count") > 0, F.lit("medium"), "price_down_peer_count", 1.0),
        ("competitor_promotion_started", c("promotion_peer_count") > 0, F.lit("medium"), "promotion_peer_count", 1.0),
        ("competitor_momentum_up", (c("peer_status") == "peer_found") & (c("peer_sales_momentum_pct") >= 20), F.when(c("peer_sales_momentum_pct") >= 40, "high").otherwise("medium"), "peer_sales_momentum_pct", 20.0),
        ("high_competitive_pressure", c("competitive_pressure_score") >= 0.55, F.lit("high"), "competitive_pressure_score", 0.55),
    ]
    return [
        F.when(when, F.struct(F.lit(name).alias("alert_type"), severity.alias("severity"), F.lit(metric).alias("metric_name"), c(metric).cast("double").alias("metric_value"), F.lit(at).alias("threshold")))
        for name, when, severity, metric, at in rules
    ]


EVIDENCE = ["peer_count", "benchmark_peer_count", "peer_median_price", "price_gap_pct", "discount_gap_pct", "price_down_peer_count", "promotion_peer_count", "peer_sales_momentum_pct", "competitive_pressure_score", "signal_confidence"]


def alert_targets(peers: DataFrame, events: DataFrame) -> DataFrame:
    """The best peer behind each kind of alert: by score, then shop and item, both from one row."""
    best = Window.partitionBy(*LEADER, "kind", "snapshot_date").orderBy(F.col("match_score").desc(), "target_shop_id", "target_item_id")
    found = peers.filter("peer_status = 'peer_found'").select(*SOURCE, "target_shop_id", "target_item_id", "match_score", "relation")
    members, found = led(found, ["target_shop_id", "target_item_id", "match_score", "relation"], [])
    down = F.col("old_value").try_cast("double") > F.col("new_value").try_cast("double")
    kinds = F.when((F.col("event_type") == "price_changed") & down, "competitor_price_down").when(F.col("event_type") == "promotion_changed", "competitor_promotion_started")
    moved = found.join(_as_target(events.withColumn("kind", kinds).filter("kind is not null").select(*KEY, "snapshot_date", "kind")), TARGET)
    level = found.filter(F.col("relation").isin(IDENTITY)).withColumn("kind", F.lit("price")).withColumn("snapshot_date", F.lit(None).cast("date"))
    both = moved.select(*LEADER, "kind", "snapshot_date", "match_score", "target_shop_id", "target_item_id").unionByName(level.drop("relation"))
    return members.join(both.withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn", "match_score"), LEADER).drop(*LEADER[1:])


def alerts(signals: DataFrame, peers: DataFrame, events: DataFrame) -> DataFrame:
    raised = signals.withColumn("a", F.explode(F.array_compact(F.array(*alert_rules()))))
    raised = raised.select(*DAY, "a.*", *EVIDENCE)
    t = F.col("alert_type")
    moves = t.isin("competitor_price_down", "competitor_promotion_started")
    raised = raised.withColumn("kind", F.when(moves, t).when(t.isin("our_price_above_market", "our_discount_below_market"), "price"))
    scope = F.when(moves, "qualified_substitute_activity").otherwise("normalized_price_equivalent")
    shown = [F.col(c).alias("pressure_score") if c == "competitive_pressure_score" else F.col(c) for c in EVIDENCE]
    evidence = F.to_json(F.struct(*shown[:2], scope.alias("comparison_scope"), *shown[2:]), {"ignoreNullFields": "false"})
    targets = alert_targets(peers, events).withColumnRenamed("snapshot_date", "on_day")
    on = [raised[c] == targets[c] for c in SOURCE] + [raised["kind"] == targets["kind"], targets["on_day"].isNull() | (targets["on_day"] == raised["snapshot_date"])]
    return raised.join(targets, on, "left").select(*[raised[c] for c in DAY], "alert_type", "severity", "metric_name", "metric_value", "threshold", "target_shop_id", "target_item_id", scope.alias("comparison_scope"), evidence.alias("evidence"))
