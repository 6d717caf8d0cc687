"""Margin-aware recommendations and seeded cost scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import signals as S
from .snapshots import latest

DEFAULT_MARGIN = 10.0
RULES = "price-rules-1"
# The cards' texts, by the step that led to them or by action.
TEXTS = {
    "watch": ("Theo dõi ", " sản phẩm thay thế từ đơn vị bán khác. Các sản phẩm này hữu ích để quan sát cạnh tranh nhưng chưa đủ tương đương để làm giá mục tiêu."),
    "none": "Chưa có đủ sản phẩm đối thủ tương đồng và đáng tin cậy; hệ thống chưa đề xuất thay đổi.",
    "outlier": "Giá hiện tại nằm ngoài khoảng so sánh thông thường; cần kiểm tra lại dữ liệu trước khi hành động.",
    "reduce_price": "Cân nhắc điều chỉnh giá về gần mức giá trung vị của nhóm đối thủ, sau khi xác nhận giá sàn.",
    "use_voucher": "Cân nhắc dùng mã giảm giá để thu hẹp chênh lệch khuyến mãi mà vẫn bảo đảm biên lợi nhuận.",
    "hold_price": "Giữ nguyên giá hiện tại và tiếp tục theo dõi tín hiệu thị trường.",
}
#: What a cost row may say beside cost and margin.
COST_NOTES = {"cost_low": "double", "cost_high": "double", "cost_seed_pct": "double", "cost_reference_price": "double", "cost_confidence": "string", "baseline_type": "string"}


def checked_costs(costs: DataFrame) -> DataFrame:
    """One cost a product (the last given); costs and margins out of range fail the job."""
    seeded = F.col("cost_source") if "cost_source" in costs.columns else F.lit("verified_input")
    bad_cost = F.raise_error(F.lit("cost_value must be positive"))
    bad_margin = F.raise_error(F.lit("margin_min_pct must lie in [0, 100)"))
    margin = F.coalesce(F.col("margin_min_pct"), F.lit(DEFAULT_MARGIN))
    order = F.col("row_number") if "row_number" in costs.columns else F.lit(0)
    held = costs.select(
        "country_code", F.col("shop_id").alias("source_shop_id"), F.col("item_id").alias("source_item_id"), order.alias("__order"),
        F.when(F.col("cost_value") > 0, F.col("cost_value").cast("double")).otherwise(bad_cost.cast("double")).alias("cost_value"),
        F.when((margin >= 0) & (margin < 100), margin).otherwise(bad_margin.cast("double")).alias("margin_min_pct"),
        F.coalesce(seeded, F.lit("verified_input")).alias("cost_source"),
        *[(F.col(c) if c in costs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in COST_NOTES.items()],
    )
    held = held.withColumns({"cost_confidence": F.coalesce("cost_confidence", F.lit("verified")), "baseline_type": F.coalesce("baseline_type", F.lit("unknown"))})
    given = ["cost_value", "margin_min_pct", "cost_low", "cost_high", "cost_seed_pct", "cost_reference_price", "cost_source", "cost_confidence", "baseline_type"]
    return held.groupBy(*S.SOURCE).agg(F.max_by(F.struct(*given), "__order").alias("cost_assumption")).select(*S.SOURCE, "cost_assumption", "cost_assumption.cost_value", "cost_assumption.margin_min_pct", "cost_assumption.cost_source")


def ceil_100(c: Column) -> Column:
    return F.ceil(c / 100.0) * 100.0


def floor_2(c: Column) -> Column:
    return F.floor(c * 100.0) / 100.0


def decide(df: DataFrame) -> DataFrame:
    """Adds the decision to rows of signals with cost_value, margin_min_pct, cost_source,
    benchmark_best_score and promotion_terms_verified (missing ones count as null)."""
    for c, kind in (("cost_value", "double"), ("margin_min_pct", "double"), ("cost_source", "string"), ("benchmark_best_score", "double"), ("promotion_terms_verified", "boolean")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    c = F.col
    true = lambda x: F.coalesce(x, F.lit(False))
    wrong = F.raise_error(F.lit("margin_min_pct must lie in [0, 100)")).cast("double")
    margin = F.coalesce(c("margin_min_pct"), F.lit(DEFAULT_MARGIN))
    df = df.withColumn("margin_min_pct", F.when((margin >= 0) & (margin < 100), margin).otherwise(wrong))
    df = df.withColumn("has_cost", true(c("cost_value") > 0))
    df = df.withColumn("seeded", true(c("cost_source") == "seeded_scenario") & c("cost_value").isNotNull())
    df = df.withColumn("price_floor", F.when(c("has_cost"), c("cost_value") / (1.0 - c("margin_min_pct") / 100.0)))
    price, market, floor = c("source_price").cast("double"), c("peer_median_price"), c("price_floor")
    gap, dgap = c("price_gap_pct"), c("discount_gap_pct")
    now = F.coalesce(c("source_discount_percent"), F.lit(0.0))
    lonely = ~true(c("peer_status") == "peer_found") | (F.coalesce(c("peer_count"), F.lit(0)) < 1) | market.isNull()
    watched = F.coalesce(c("benchmark_peer_count"), F.lit(0)) > 0
    branch = (
        F.when(lonely & watched, "watch").when(lonely, "none").when(true(c("is_price_outlier")), "outlier")
        .when(true((gap >= 10) & (price != 0) & (market < price)), "price")
        .when(true(dgap <= -10), "discount")
        .when((F.coalesce(c("competitive_pressure_score"), F.lit(0.0)) >= 0.55) | (F.coalesce(c("promotion_peer_count"), F.lit(0)) > 0), "pressure")
        .otherwise("hold")
    )
    df = df.withColumn("branch", branch)
    room = F.greatest(F.lit(0.0), (1.0 - floor / price) * 100.0)
    wanted = F.least(F.lit(90.0), F.greatest(now, F.coalesce(F.nullif(c("peer_median_discount_percent"), F.lit(0.0)), now)))
    df = df.withColumn("voucher", F.when((price != 0) & floor.isNotNull(), floor_2(F.least(wanted, room))))
    promo = c("branch").isin("discount", "pressure")
    step = (
        F.when(c("branch").isin("watch", "none", "outlier", "hold"), c("branch"))
        .when(~c("has_cost"), "no_cost")
        .when((c("branch") == "price") & (market >= floor), "reduce").when(c("branch") == "price", "below_floor")
        .when(promo & ~true(c("promotion_terms_verified")), "no_terms")
        .when(promo & c("voucher").isNull(), "hold_promo").when(promo & (c("voucher") > now), "voucher").otherwise("no_room")
    )
    df = df.withColumn("step", step)

    def pick(table: dict[str, str], other: str | None) -> Column:
        out = F.when(F.lit(False), "")
        for name, value in table.items():
            out = out.when(c("step") == name, value)
        return out.otherwise(other) if other else out

    raw = pick({"watch": "monitoring_only", "none": "insufficient_evidence", "outlier": "insufficient_evidence", "no_cost": "needs_cost_validation", "below_floor": "constraint_blocked", "no_terms": "needs_promotion_validation", "no_room": "constraint_blocked"}, "recommended")
    scenario = c("seeded") & raw.isin("recommended", "constraint_blocked")
    action = pick({"watch": "review_competitors", "none": "no_response", "outlier": "no_response", "reduce": "reduce_price", "voucher": "use_voucher"}, "hold_price")
    open_cost = F.when(c("has_cost"), "verified").otherwise("unverified_cost_missing")
    constraint = F.coalesce(pick({
        "watch": "not_applicable", "none": "not_applicable", "outlier": "outlier_review_required", "no_cost": "blocked_cost_missing", "below_floor": "market_below_margin_floor",
        "no_terms": "blocked_promotion_terms_missing", "no_room": "margin_floor_leaves_no_discount_room"}, None), open_cost)
    quiet = c("step").isin("watch", "none", "outlier")
    bench = F.coalesce(c("benchmark_peer_count"), F.lit(0))
    priority = (
        F.when(c("step") == "watch", F.when(bench >= 3, "medium").otherwise("low")).when(c("step") == "none", "low").when(c("step") == "outlier", "medium")
        .when(true(gap >= 20), "high").when(true(gap >= 10) | true(dgap <= -10), "medium").otherwise("low")
    )
    verified = c("has_cost") & ~c("seeded")
    confidence = (
        F.when(c("step") == "watch", F.when(F.coalesce(c("benchmark_best_score"), F.lit(0.0)) >= 0.70, "medium").otherwise("low")).when(quiet | scenario, "low")
        .when((c("signal_confidence") == "high") & verified, "high").when(c("signal_confidence").isin("high", "medium"), "medium").otherwise("low")
    )
    price_now = F.when(c("step") == "reduce", F.least(price, ceil_100(F.greatest(market, floor)))).when(~quiet, price)
    discount_now = F.when(c("step").isin("voucher", "no_room"), c("voucher")).when(~quiet, now)
    reasons = F.array_compact(F.array(
        F.when(c("step") == "watch", "substitute_benchmark_available"), F.when(c("step") == "watch", "price_target_not_comparable"),
        F.when(c("step") == "none", "not_enough_evidence"), F.when(c("step") == "outlier", "price_outlier"),
        F.when(c("branch") == "price", "price_above_peer_median"), F.when(c("branch") == "discount", "discount_below_peer_median"), F.when(c("branch") == "pressure", "competitive_pressure_observed"),
        F.when((c("step") == "no_cost") & (c("branch") == "price"), "cost_required_before_price_change"), F.when((c("step") == "no_cost") & promo, "cost_required_before_voucher"),
        F.when(c("step") == "reduce", "target_respects_margin_floor"), F.when(c("step") == "below_floor", "peer_median_below_margin_floor"),
        F.when(c("step") == "no_terms", "promotion_terms_required_before_voucher"), F.when(c("step") == "voucher", "voucher_respects_margin_floor"), F.when(c("step") == "no_room", "no_safe_discount_room"),
        F.when(c("step") == "hold", "price_close_to_peer_median"), F.when(scenario & ~quiet, "seeded_cost_scenario_not_executable"),
    ))
    df = df.withColumns({
        "status": F.when(scenario & ~quiet, "scenario_only").otherwise(raw), "action": action, "priority": priority, "confidence": confidence,
        "recommended_price": price_now, "recommended_discount_percent": discount_now,
        "constraint_status": F.when(scenario & ~quiet, "seeded_cost_not_verified").otherwise(constraint), "reason_codes": reasons,
    })
    paid = F.when(c("action") == "use_voucher", price * (1.0 - c("recommended_discount_percent") / 100.0)).otherwise(c("recommended_price"))
    df = df.withColumn("estimated_margin_pct", F.when(c("has_cost") & (paid > 0), F.floor((paid - c("cost_value")) / paid * 10000.0 + 0.5) / 100.0))  # ties upwards, of losses too
    said = F.when(c("step") == "watch", F.concat(F.lit(TEXTS["watch"][0]), bench.cast("string"), F.lit(TEXTS["watch"][1])))
    for name in ("none", "outlier"):
        said = said.when(c("step") == name, TEXTS[name])
    for name in ("reduce_price", "use_voucher"):
        said = said.when(c("action") == name, TEXTS[name])
    df = df.withColumn("recommendation_text", said.otherwise(TEXTS["hold_price"]))
    return df.drop("has_cost", "seeded", "branch", "step", "voucher")


CARD = [
    "country_code", "snapshot_date", "source_shop_id", "source_item_id", "currency", "recommendation_status", "action", "priority", "confidence", "source_price", "market_reference_price",
    "recommended_price", "source_discount_percent", "recommended_discount_percent", "price_floor", "cost_value", "margin_min_pct", "estimated_margin_pct", "constraint_status", "reason_codes",
    "recommendation_text", "evidence", "rule_version", "created_at",
]
CARD_EVIDENCE = [
    "peer_count", "peer_median_price", "source_list_price", "source_historical_median_price", "source_price_observation_count", "price_baseline_value", "price_baseline_type", "price_baseline_actionable",
    "price_gap_pct", "discount_gap_pct", "pressure_score", "price_down_peer_count", "promotion_peer_count", "signal_confidence", "signal_model_version", "benchmark_peer_count", "benchmark_best_score",
    "benchmark_usage", "cost_assumption",
]


def recommendations(signals: DataFrame, peers: DataFrame, costs: DataFrame | None = None, created_at=None) -> DataFrame:
    """Cards of the latest signals, with the substitutes watched and the costs known."""
    bench = peers.filter("peer_status = 'peer_found' and relation = 'substitute'").groupBy(*S.SOURCE).agg(F.count("*").cast("int").alias("watched"), F.max("match_score").alias("benchmark_best_score"))
    held = latest(signals, S.SOURCE).join(bench, S.SOURCE, "left").withColumn("benchmark_peer_count", F.coalesce("watched", F.lit(0))).drop("watched")
    if costs is not None:
        held = held.join(checked_costs(costs), S.SOURCE, "left")
    else:
        held = held.withColumn("cost_assumption", F.lit(None).cast("string"))
    decided = decide(held).withColumnsRenamed({"status": "recommendation_status"}).withColumns({
        "market_reference_price": F.col("peer_median_price"), "reason_codes": F.to_json("reason_codes"), "pressure_score": F.col("competitive_pressure_score"),
        "signal_model_version": F.lit(S.VERSION), "benchmark_usage": F.lit("context_only_not_price_target"), "rule_version": F.lit(RULES), "created_at": F.current_timestamp() if created_at is None else F.lit(created_at),
    })
    return decided.withColumn("evidence", F.to_json(F.struct(*CARD_EVIDENCE), {"ignoreNullFields": "false"})).select(*CARD)


def seed_costs(signals: DataFrame, attributes: DataFrame, margin: float = 15.0) -> DataFrame:
    """Scenario costs as bands of a reference price, wider where the reference is weaker."""
    c = F.col
    held = latest(signals, S.SOURCE).join(S._as_source(attributes.select(*S.KEY, "price_variant_ambiguous")), S.SOURCE)
    anchor = F.coalesce(*[F.nullif(c(x).cast("double"), F.lit(0.0)) for x in ("price_baseline_value", "source_historical_median_price", "source_price", "source_list_price")], F.lit(0.0))
    current = F.coalesce(*[F.nullif(c(x).cast("double"), F.lit(0.0)) for x in ("source_price", "price_baseline_value", "source_list_price")])
    case = (
        F.when(c("price_variant_ambiguous"), "variants").when(c("price_baseline_actionable") & (c("price_baseline_type") == "peer_market_median"), "peers")
        .when(c("price_baseline_type") == "own_history_median", "own").otherwise("current")
    )
    bands = {"variants": (50.0, 70.0, 90.0, "very_low"), "peers": (65.0, 72.0, 78.0, "low"), "own": (60.0, 70.0, 80.0, "very_low"), "current": (55.0, 70.0, 85.0, "very_low")}

    def of(i: int) -> Column:
        out = F.when(F.lit(False), F.lit(bands["own"][i]))
        for name, band in bands.items():
            out = out.when(c("case") == name, F.lit(band[i]))
        return out

    hundred = lambda x: (F.bround(x / 100.0) * 100).cast("bigint")
    held = held.withColumn("anchor", anchor).filter("anchor > 0").withColumn("case", case)
    held = held.withColumn("reference", F.when(c("case") == "current", current).otherwise(c("anchor")))
    return held.select(
        "country_code", c("source_shop_id").alias("shop_id"), c("source_item_id").alias("item_id"), hundred(c("reference") * of(1) / 100.0).alias("cost_value"),
        F.lit(margin).alias("margin_min_pct"), hundred(c("reference") * of(0) / 100.0).alias("cost_low"), hundred(c("reference") * of(2) / 100.0).alias("cost_high"),
        of(1).alias("cost_seed_pct"), hundred(c("reference")).alias("cost_reference_price"), F.lit("seeded_scenario").alias("cost_source"), of(3).alias("cost_confidence"),
        c("price_baseline_type").alias("baseline_type"), "currency",
    )
