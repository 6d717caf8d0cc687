"""Checked point and list reads of the published tables, each with its total where it is a page."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.versions import NotPublished
from . import serving
from .signals import SOURCE
from .snapshots import KEY

STATUSES = ["recommended", "scenario_only", "monitoring_only", "needs_cost_validation", "needs_promotion_validation", "constraint_blocked", "insufficient_evidence"]
SEVERITIES = ["low", "medium", "high"]
OWNERS = ["company_id", "company_name", "seller_entity_id", "seller_entity_name"]
PACK = ["weight_g", "volume_ml", "quantity", "bundle_count", "is_bundle", "total_weight_g", "total_volume_ml", "package_ambiguous", "variation_count", "price_variant_ambiguous", "variant_signature", "family_signature"]
PRODUCT = ["country_code", "currency", "snapshot_date", "shop_id", "item_id", "shop_name", "product_name", "brand", "price", "price_original", "discount_percent", "monthly_sold_value", "rating", "rating_count", "liked_count", "is_sold_out"]


class Page(NamedTuple):
    rows: DataFrame
    total: DataFrame | None = None  # one row: total_count


def _columns(df: DataFrame, names: list[str]) -> list:
    return [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names]


def _whole(name: str, value) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a positive integer")
    return value


def _text(name: str, value, least: int, most: int) -> str:
    value = (value or "").strip()
    if not least <= len(value) <= most:
        raise ValueError(f"{name} must have {least} to {most} characters")
    return value


def _one_of(name: str, value, allowed: list[str]) -> str | None:
    value = (value or "").strip().lower()
    if value and value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    return value or None


class Reads:
    """``tables``: products, attributes, peers, signals, alerts, recommendations; ``runs``: the manifest.

    ``scopes`` limits all reads to (country, shop) pairs; None leaves all.
    """

    def __init__(self, tables: dict[str, DataFrame], scopes: list[tuple[str, int]] | None = None, runs: DataFrame | None = None):
        self.tables, self.scopes, self.runs = tables, scopes, runs

    # ------------------------------------------------------------------ checks
    def _published(self, stage: str) -> None:
        if self.runs is not None and not serving.published(self.runs).filter(F.col("stage") == stage).limit(1).collect():
            raise NotPublished(stage)

    def _country(self, country: str) -> str:
        if country not in ("vn", "id"):
            raise ValueError("country_code must be vn or id")
        return country

    def _item(self, country: str, shop_id: int, item_id: int, shop: str = "shop_id", item: str = "item_id"):
        self._country(country)
        if self.scopes is not None and (country, _whole("shop_id", shop_id)) not in self.scopes:
            raise PermissionError("the shop lies outside the scope")
        return (F.col("country_code") == country) & (F.col(shop) == _whole("shop_id", shop_id)) & (F.col(item) == _whole("item_id", item_id))

    def _tenant(self, df: DataFrame, country: str, shop_id: int | None, shop: str) -> DataFrame:
        df = df.filter(F.col("country_code") == self._country(country))
        if shop_id is not None:
            if self.scopes is not None and (country, _whole("shop_id", shop_id)) not in self.scopes:
                raise PermissionError("the shop lies outside the scope")
            return df.filter(F.col(shop) == _whole("shop_id", shop_id))
        if self.scopes is None:
            return df
        shops = [s for c, s in self.scopes if c == country]
        if not shops:
            raise PermissionError("the country lies outside the scope")
        return df.filter(F.col(shop).isin(shops))

    def _owned(self, df: DataFrame, end: str = "", prefix: str = "") -> DataFrame:
        """Owner columns of each row's ``end`` (source, target or none) offer."""
        on = {"country_code": "country_code", "shop_id": f"{end}shop_id", "item_id": f"{end}item_id"}
        a = self.tables["attributes"]
        side = a.select(*[F.col(c).alias(x) for c, x in on.items()], *[c.alias(f"{prefix}{name}") for c, name in zip(_columns(a, OWNERS), OWNERS)])
        return df.join(side, list(on.values()), "left")

    def _described(self, products: DataFrame, more: list[str] = ()) -> DataFrame:
        a = self.tables["attributes"]
        names = [*PACK, *OWNERS, *more]
        side = a.select(*KEY, *[c.alias(x) for c, x in zip(_columns(a, names), names)])
        return products.drop(*[c for c in names if c in products.columns]).join(side, KEY, "left")

    @staticmethod
    def _total(df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("total_count"))

    # ------------------------------------------------------------------ reads
    def product_snapshot(self, country: str, shop_id: int, item_id: int) -> Page:
        """The newest snapshot of one offer with its parsed attributes and owners."""
        self._published("data_foundation")
        p = self.tables["products"].filter(self._item(country, shop_id, item_id))
        newest = p.orderBy(F.desc("snapshot_date")).limit(1)
        return Page(self._described(newest.select(*[c.alias(x) for c, x in zip(_columns(p, PRODUCT), PRODUCT)]), ["product_type"]))

    def list_products(self, country: str, shop_id: int | None = None, company_id: str | None = None, query: str | None = None, limit: int = 20) -> Page:
        """Newest rows that fit the filters, best sellers of the newest day first, and how many there are."""
        limit = serving.bounded(limit, 100)
        self._published("product_matching")
        p = self._tenant(self.tables["products"], country, shop_id, "shop_id")
        held = self._described(p.select(*[c.alias(x) for c, x in zip(_columns(p, [*PRODUCT, "image_url", "url"]), [*PRODUCT, "image_url", "url"])]))
        held = serving.latest_where(held, KEY, text=(["product_name"], _text("query", query, 0, 120)), company_id=_text("company_id", company_id, 0, 80) or None)
        return Page(held.orderBy(F.desc("snapshot_date"), F.desc_nulls_last("monthly_sold_value"), *KEY).limit(limit), self._total(held))

    def list_companies(self, country: str) -> Page:
        self._published("product_matching")
        a = self._tenant(self.tables["attributes"], country, None, "shop_id")
        out = a.groupBy("country_code", "company_id", "company_name").agg(
            F.count_distinct(F.struct("shop_id", "item_id")).alias("sku_count"), F.array_sort(F.collect_set("shop_id")).alias("shop_ids"), F.array_sort(F.collect_set("seller_entity_name")).alias("distributor_names"),
        )
        return Page(out.orderBy(F.desc("sku_count"), "company_name", "company_id"))

    def _alerts(self) -> DataFrame:
        """Alerts of each offer's newest signal day."""
        last = self.tables["signals"].groupBy(*SOURCE).agg(F.max("snapshot_date").alias("snapshot_date"))
        return self.tables["alerts"].join(last, [*SOURCE, "snapshot_date"])

    def list_alerts(self, country: str, shop_id: int | None = None, company_id: str | None = None, severity: str | None = None, limit: int = 50) -> Page:
        limit, severity = serving.bounded(limit, 100), _one_of("severity", severity, SEVERITIES)
        self._published("market_signals")
        held = self._owned(self._tenant(self._alerts(), country, shop_id, "source_shop_id"), "source_")
        held = serving.where(held, company_id=(company_id or "").strip() or None, severity=severity)
        held = serving.latest_where(held, ["source_shop_id", "source_item_id", "alert_type", "metric_name"])
        held = self._owned(held, "target_", "target_")
        return Page(held.orderBy(F.desc("snapshot_date"), serving.level("severity").desc(), *SOURCE, "alert_type").limit(limit), self._total(held))

    def list_recommendations(self, country: str, shop_id: int | None = None, company_id: str | None = None, status: str | None = None, limit: int = 50) -> Page:
        """The status is compared after the newest card of each offer is chosen."""
        limit, status = serving.bounded(limit, 100), _one_of("recommendation_status", status, STATUSES)
        self._published("recommendations")
        held = self._owned(self._tenant(self.tables["recommendations"], country, shop_id, "source_shop_id"), "source_")
        held = serving.latest_where(serving.where(held, company_id=(company_id or "").strip() or None), ["source_shop_id", "source_item_id"])
        held = serving.where(held, recommendation_status=status)
        return Page(held.orderBy(F.desc("snapshot_date"), serving.level("priority").desc(), *SOURCE).limit(limit), self._total(held))

    def market_signals(self, country: str, shop_id: int, item_id: int) -> Page:
        self._published("market_signals")
        s = self.tables["signals"]
        return Page(s.filter(self._item(country, shop_id, item_id, "source_shop_id", "source_item_id")).drop("created_at").orderBy(F.desc("snapshot_date")).limit(1))

    def peers(self, country: str, shop_id: int, item_id: int, limit: int = 5) -> Page:
        """Peers of one offer by rank, with their newest snapshot and attributes."""
        limit = serving.bounded(limit, 10)
        self._published("product_matching")
        mine = self.tables["peers"].filter(self._item(country, shop_id, item_id, "source_shop_id", "source_item_id") & (F.col("peer_status") == "peer_found"))
        mine = mine.withColumnsRenamed({"rank": "peer_rank", "target_shop_id": "shop_id", "target_item_id": "item_id"}).orderBy("peer_rank").limit(limit)
        names = ["product_name", "brand", "price", "currency"]
        few = F.broadcast(mine.select(*KEY))  # at most ten rows
        p = self.tables["products"].join(few, KEY, "left_semi")
        newest = serving.latest_where(p, KEY).select(*KEY, *[c.alias(x) for c, x in zip(_columns(p, names), names)])
        out = self._described(mine.drop(*names).join(newest, KEY, "left"), ["product_type"])
        return Page(out.withColumnsRenamed({"shop_id": "target_shop_id", "item_id": "target_item_id"}).orderBy("peer_rank"))

    def competitor_alerts(self, country: str, shop_id: int, item_id: int, limit: int = 10) -> Page:
        limit = serving.bounded(limit, 20)
        self._published("market_signals")
        held = self._alerts().filter(self._item(country, shop_id, item_id, "source_shop_id", "source_item_id"))
        names = ["snapshot_date", "alert_type", "severity", "metric_name", "metric_value", "threshold", "target_shop_id", "target_item_id", "evidence"]
        return Page(held.select(*names).orderBy(F.desc("snapshot_date"), F.desc("severity"), "alert_type").limit(limit))

    def recommendation(self, country: str, shop_id: int, item_id: int) -> Page:
        self._published("recommendations")
        held = self.tables["recommendations"].filter(self._item(country, shop_id, item_id, "source_shop_id", "source_item_id"))
        return Page(held.drop("created_at").orderBy(F.desc("snapshot_date")).limit(1))

    def search_products(self, country: str, query: str, limit: int = 10) -> Page:
        limit, query = serving.bounded(limit, 10), _text("query", query, 2, 120)
        self._published("data_foundation")
        p = self._tenant(self.tables["products"], country, None, "shop_id")
        held = serving.latest_where(p, KEY, text=(["product_name"], query))
        names = ["country_code", "currency", "snapshot_date", "shop_id", "item_id", "shop_name", "product_name", "brand", "price", "discount_percent"]
        return Page(held.select(*[c.alias(x) for c, x in zip(_columns(held, names), names)]).orderBy("shop_id", "item_id").limit(limit))


# ------------------------------------------------------------------ what a reader derives from rows
def normalized_price(df: DataFrame) -> DataFrame:
    """Adds shown_price and shown_basis: per 100 g, per 100 ml or per unit; none where the pack is ambiguous."""
    c = F.col
    clear = (c("price") > 0) & ~F.coalesce(c("package_ambiguous"), F.lit(False)) & ~F.coalesce(c("price_variant_ambiguous"), F.lit(False))
    weight, volume, count = c("total_weight_g") > 0, c("total_volume_ml") > 0, c("quantity") > 0
    value = F.when(weight, c("price") / c("total_weight_g") * 100).when(volume, c("price") / c("total_volume_ml") * 100).when(count, c("price") / c("quantity"))
    basis = F.when(weight, "100 g").when(volume, "100 ml").when(count, "unit")
    return df.withColumns({"shown_price": F.when(clear, value), "shown_basis": F.when(clear, basis)})


def comparable(source: DataFrame, peers: DataFrame) -> DataFrame:
    """Peers shown on the same basis as the source (one row each side of a key)."""
    own = normalized_price(source).select(F.col("shown_basis").alias("own_basis"))
    return normalized_price(peers).join(F.broadcast(own), F.lit(True)).filter(F.col("shown_basis").eqNullSafe(F.col("own_basis"))).drop("own_basis")  # one row


def staleness(df: DataFrame, today, date: str = "snapshot_date") -> DataFrame:
    age = F.greatest(F.lit(0), F.date_diff(F.lit(today).cast("date"), F.col(date)))
    return df.withColumns({"age_days": age, "is_stale": age > 2})


def queue_totals(cards: DataFrame) -> DataFrame:
    """One row: cards by what a reviewer does with them."""
    count = lambda *names: F.count_if(F.col("recommendation_status").isin(*names))
    return cards.agg(
        count("recommended").alias("recommended"), count("scenario_only").alias("scenarios"), count("monitoring_only").alias("monitoring"),
        count("needs_cost_validation", "needs_promotion_validation", "constraint_blocked").alias("needs_review"), count("insufficient_evidence").alias("insufficient"),
    )


def average_discount(products: DataFrame) -> DataFrame:
    """Missing discounts count as none; no products give 0."""
    return products.agg(F.coalesce(F.avg(F.coalesce("discount_percent", F.lit(0.0))), F.lit(0.0)).alias("avg_discount"))
