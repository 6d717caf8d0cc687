"""The marketplace tables as derived from the star-schema test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import reads, recommend, signals, snapshots
from ..sources.scratch import stage
from ..sources.versions import clustered


class Asked(dict):
    """Tables by name, each made when it is first asked for: a read pays for the tables it reads."""

    def __init__(self, makers: dict):
        super().__init__()
        self.makers = makers

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.makers[name]()
        return self[name]


class Market:
    """Tables of one data folder. Products, events, matches and signals are stage tables: the
    first query that needs one writes it, in country partitions, and all others read it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def offers(self) -> DataFrame:
        """Parts as offers: brand number is the shop, sellers own shops modulo 10."""
        shop = F.regexp_extract("p_brand", r"#(\d+)", 1).cast("bigint")
        return self.table("part").select(
            F.when(F.col("p_partkey") % 2 == 0, "vn").otherwise("id").alias("country_code"), shop.alias("shop_id"), F.col("p_partkey").alias("item_id"),
            F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("list_price"),
            F.concat(F.lit("seller_"), (shop % 10).cast("string")).alias("seller_entity_id"), F.concat(F.lit("company_"), (shop % 5).cast("string")).alias("company_id"),
        )

    def products(self) -> DataFrame:
        return stage(self.spark, self.dir, "products", self._products, "country_code", clustered("country_code", "shop_id", "item_id"))

    def _products(self) -> DataFrame:
        """Yearly snapshots of what each offer sold."""
        sold = self.table("lineitem").groupBy(F.col("l_partkey").alias("item_id"), F.trunc("l_shipdate", "year").alias("snapshot_date")).agg(
            F.median(F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100.0).alias("price"), F.round(F.avg("l_discount") * 1000, 4).alias("discount_percent"), F.sum("l_quantity").alias("monthly_sold_value"),
            F.count("*").alias("rating_count"), F.count_distinct("l_orderkey").alias("liked_count"), F.max("l_returnflag").alias("promotion_id"), F.max("l_linestatus").alias("voucher_code"),
        )
        offers = self.offers().withColumn("currency", F.when(F.col("country_code") == "vn", "VND").otherwise("IDR")).withColumnRenamed("list_price", "price_original")
        return sold.join(offers, "item_id")

    def attributes(self) -> DataFrame:
        o = self.offers()
        return o.select(
            "country_code", "shop_id", "item_id", (F.col("size") * 10).alias("total_weight_g"), F.lit(None).cast("double").alias("total_volume_ml"), F.lit(1).cast("bigint").alias("quantity"),
            (F.col("size") % 7 == 0).alias("package_ambiguous"), (F.col("size") % 5 == 0).alias("price_variant_ambiguous"), "seller_entity_id", "company_id", F.col("company_id").alias("company_name"), F.col("seller_entity_id").alias("seller_entity_name"),
        )

    def matches(self) -> DataFrame:
        return stage(self.spark, self.dir, "matches", self._matches, "country_code")

    def _matches(self, top_k: int = 10) -> DataFrame:
        """Offers of the same country, category and name in other shops, scored by size, top k."""
        o = self.offers().select("country_code", "category", "product_name", "shop_id", "item_id", "size", "seller_entity_id")
        # offers alike in all that a pair is judged by have one list of targets: kinds of offers are paired, not offers
        block, like = ["country_code", "category", "product_name"], ["country_code", "category", "product_name", "shop_id", "seller_entity_id", "size"]
        kinds = o.select(*like).distinct()
        s, t = kinds.alias("s"), kinds.alias("t")
        on = [F.col(f"s.{c}") == F.col(f"t.{c}") for c in block]
        met = s.join(t, on[0] & on[1] & on[2] & (F.col("s.shop_id") != F.col("t.shop_id")) & (F.col("s.seller_entity_id") != F.col("t.seller_entity_id")))
        ratio = F.least("s.size", "t.size") / F.greatest("s.size", "t.size")
        kind = F.when(ratio >= 0.9, "same_product").when(ratio >= 0.6, "same_product_variant").when(ratio >= 0.3, "substitute").otherwise("near_match")
        met = met.select(*[F.col(f"s.{c}").alias(c) for c in like], F.col("t.shop_id").alias("target_shop_id"), F.col("t.size").alias("t_size"), F.col("t.seller_entity_id").alias("t_seller"), F.round(0.5 + 0.5 * ratio, 6).alias("match_score"), kind.alias("match_type"))
        source = Window.partitionBy(*like)
        # each kind has a member, so one behind top_k others by score and shop gives none of the first
        met = met.withColumn("rank", F.rank().over(source.orderBy(F.desc("match_score"), "target_shop_id"))).filter(F.col("rank") <= top_k).drop("rank")
        nth = F.row_number().over(Window.partitionBy(*like).orderBy("item_id"))
        first = o.withColumn("nth", nth).filter(F.col("nth") <= top_k).select(*[F.col(c).alias(f"f_{c}") for c in like], F.col("item_id").alias("target_item_id"))
        ours = {"shop_id": "target_shop_id", "size": "t_size", "seller_entity_id": "t_seller"}
        met = met.join(first, [met[ours.get(c, c)].eqNullSafe(first[f"f_{c}"]) for c in like])
        top = met.withColumn("rank", F.row_number().over(source.orderBy(F.desc("match_score"), "target_shop_id", "target_item_id"))).filter(F.col("rank") <= top_k)
        top = top.withColumn("source_status", F.when(F.max((F.col("match_score") >= 0.6).cast("int")).over(source) == 1, "matchable").otherwise("not_enough_evidence"))
        top = top.select(*[F.col(c).alias(f"k_{c}") for c in like], "target_shop_id", "target_item_id", "match_score", "match_type", "rank", "source_status")
        top = o.join(top, [o[c].eqNullSafe(top[f"k_{c}"]) for c in like]).select(
            "country_code", F.col("shop_id").alias("source_shop_id"), F.col("item_id").alias("source_item_id"), "target_shop_id", "target_item_id", "match_score", "match_type", "rank", "source_status",
        )
        alone = o.select("country_code", F.col("shop_id").alias("source_shop_id"), F.col("item_id").alias("source_item_id")).join(top.select(*signals.SOURCE).distinct(), signals.SOURCE, "left_anti")
        none = F.lit("not_enough_evidence")
        return top.unionByName(alone.select("*", F.lit(0.0).alias("match_score"), none.alias("match_type"), F.lit(1).alias("rank"), none.alias("source_status")), allowMissingColumns=True)

    def peers(self) -> DataFrame:
        return signals.peer_groups(self.matches())

    def events(self) -> DataFrame:
        return stage(self.spark, self.dir, "events", self._events, "country_code")

    def _events(self) -> DataFrame:
        return snapshots.change_events(self.products())

    def signals(self) -> DataFrame:
        return stage(self.spark, self.dir, "signals", self._signals, "country_code", clustered("country_code", "source_shop_id", "source_item_id"))

    def _signals(self) -> DataFrame:
        return signals.market_signals(self.products(), self.attributes(), self.peers(), self.events())

    def alerts(self) -> DataFrame:
        return signals.alerts(self.signals(), self.peers(), self.events())

    def costs(self) -> DataFrame:
        """Costs of two thirds of the offers, half of them scenarios."""
        o = self.offers().filter(F.col("item_id") % 3 != 0)
        source = F.when(F.col("item_id") % 4 == 1, "seeded_scenario").otherwise("verified_input")
        return o.select("country_code", "shop_id", "item_id", (F.col("list_price") * 0.5).alias("cost_value"), F.lit(10.0).alias("margin_min_pct"), source.alias("cost_source"))

    def reads(self, scopes=None, runs=None) -> reads.Reads:
        names = ("products", "attributes", "peers", "signals", "alerts", "recommendations")
        return reads.Reads(Asked({name: getattr(self, name) for name in names}), scopes, runs)

    def recommendations(self) -> DataFrame:
        return recommend.recommendations(self.signals(), self.peers(), self.costs())


#: The same tables as SQL, for the oracles; a query names what it needs after these.
BASE_SQL = r"""
offers AS (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'vn' ELSE 'id' END AS country_code, CAST(regexp_extract(p_brand, '#(\d+)', 1) AS BIGINT) AS shop_id, p_partkey AS item_id,
         p_name AS product_name, p_brand AS brand, p_type AS category, CAST(p_size AS DOUBLE) AS size, p_retailprice AS list_price,
         'seller_' || CAST(CAST(regexp_extract(p_brand, '#(\d+)', 1) AS BIGINT) % 10 AS VARCHAR) AS seller_entity_id,
         'company_' || CAST(CAST(regexp_extract(p_brand, '#(\d+)', 1) AS BIGINT) % 5 AS VARCHAR) AS company_id
  FROM part),
products AS (
  SELECT o.*, o.list_price AS price_original, CASE o.country_code WHEN 'vn' THEN 'VND' ELSE 'IDR' END AS currency, x.* EXCLUDE (item_id) FROM offers o JOIN (
    SELECT l_partkey AS item_id, CAST(date_trunc('year', l_shipdate) AS DATE) AS snapshot_date, median(floor(l_extendedprice / l_quantity * 100) / 100.0) AS price,
           round(avg(l_discount) * 1000, 4) AS discount_percent, sum(l_quantity) AS monthly_sold_value, count(*) AS rating_count, count(DISTINCT l_orderkey) AS liked_count,
           max(l_returnflag) AS promotion_id, max(l_linestatus) AS voucher_code
    FROM lineitem GROUP BY 1, 2) x USING (item_id)),
attributes AS (
  SELECT country_code, shop_id, item_id, size * 10 AS total_weight_g, size % 7 = 0 AS package_ambiguous, size % 5 = 0 AS price_variant_ambiguous, seller_entity_id, company_id,
         CASE WHEN size % 7 <> 0 AND size % 5 <> 0 THEN size / 10.0 END AS units
  FROM offers),
pairs AS (
  SELECT s.country_code, s.shop_id AS source_shop_id, s.item_id AS source_item_id, t.shop_id AS target_shop_id, t.item_id AS target_item_id, least(s.size, t.size) / greatest(s.size, t.size) AS r
  FROM offers s JOIN offers t USING (country_code, category, product_name) WHERE s.shop_id <> t.shop_id AND s.seller_entity_id <> t.seller_entity_id),
top AS (
  SELECT * EXCLUDE (r), round(0.5 + 0.5 * r, 6) AS match_score,
         CASE WHEN r >= 0.9 THEN 'same_product' WHEN r >= 0.6 THEN 'same_product_variant' WHEN r >= 0.3 THEN 'substitute' ELSE 'near_match' END AS match_type,
         row_number() OVER (PARTITION BY source_item_id ORDER BY round(0.5 + 0.5 * r, 6) DESC, target_shop_id, target_item_id) AS rank
  FROM pairs QUALIFY rank <= 10),
matches AS (
  SELECT *, CASE WHEN max(match_score) OVER (PARTITION BY source_item_id) >= 0.6 THEN 'matchable' ELSE 'not_enough_evidence' END AS source_status FROM top
  UNION ALL
  SELECT country_code, shop_id, item_id, NULL, NULL, 0.0, 'not_enough_evidence', 1, 'not_enough_evidence' FROM offers WHERE item_id NOT IN (SELECT source_item_id FROM pairs)),
found AS (SELECT * FROM matches WHERE source_status = 'matchable' AND target_item_id IS NOT NULL AND match_score >= 0.6),
events AS (
  SELECT country_code, shop_id, item_id, snapshot_date, e.kind AS event_type, e.old AS old_value, e.new AS new_value, e.num_old, e.num_new FROM (
    SELECT *, unnest([
      {'kind': 'price_changed', 'old': CAST(lag(price) OVER w AS VARCHAR), 'new': CAST(price AS VARCHAR), 'num_old': lag(price) OVER w, 'num_new': price},
      {'kind': 'discount_changed', 'old': CAST(lag(discount_percent) OVER w AS VARCHAR), 'new': CAST(discount_percent AS VARCHAR), 'num_old': lag(discount_percent) OVER w, 'num_new': discount_percent},
      {'kind': 'promotion_changed', 'old': lag(promotion_id) OVER w, 'new': promotion_id, 'num_old': NULL, 'num_new': NULL},
      {'kind': 'voucher_changed', 'old': lag(voucher_code) OVER w, 'new': voucher_code, 'num_old': NULL, 'num_new': NULL}]) AS e,
      lag(snapshot_date) OVER w AS previous_date
    FROM products WINDOW w AS (PARTITION BY item_id ORDER BY snapshot_date))
  WHERE previous_date IS NOT NULL AND e.old IS DISTINCT FROM e.new)
"""

#: Signals on top of BASE_SQL.
SIGNAL_SQL = r"""
own AS (
  SELECT p.*, a.units, CASE WHEN a.units > 0 THEN median(CASE WHEN price > 0 THEN price END) OVER (PARTITION BY p.item_id) END AS own_median,
         CASE WHEN a.units > 0 THEN count(CASE WHEN price > 0 THEN price END) OVER (PARTITION BY p.item_id) ELSE 0 END AS own_count
  FROM products p JOIN attributes a USING (country_code, shop_id, item_id)),
seller AS (
  SELECT f.source_item_id AS item_id, a.seller_entity_id, p.snapshot_date, any_value(s.units) AS units, median(p.price / a.units) AS norm, median(p.discount_percent) AS disc,
         median(p.monthly_sold_value) AS sold, median(p.rating_count + p.liked_count) AS eng
  FROM found f JOIN products p ON p.item_id = f.target_item_id JOIN attributes a ON a.item_id = f.target_item_id JOIN attributes s ON s.item_id = f.source_item_id
  WHERE f.match_type IN ('same_product', 'same_product_variant') AND s.units > 0 AND a.units > 0 AND p.price > 0 GROUP BY 1, 2, 3),
daily AS (
  SELECT item_id, snapshot_date, count(*) AS peer_count, min(norm * units) AS lo, median(norm * units) AS mid, max(norm * units) AS hi, median(norm) AS mid_norm,
         median(disc) AS disc, median(sold) AS sold, median(eng) AS eng
  FROM seller GROUP BY 1, 2),
active AS (
  SELECT DISTINCT f.source_item_id AS item_id, f.target_item_id, a.seller_entity_id FROM found f JOIN attributes a ON a.item_id = f.target_item_id
  WHERE f.match_type IN ('same_product', 'same_product_variant', 'substitute')),
bench AS (SELECT item_id, count(DISTINCT seller_entity_id) AS n FROM active GROUP BY 1),
flags AS (
  SELECT item_id, snapshot_date, max(CASE WHEN event_type = 'price_changed' AND num_old > num_new THEN 1 ELSE 0 END) AS down,
         max(CASE WHEN event_type = 'promotion_changed' AND lower(coalesce(new_value, '')) NOT IN ('', 'none', 'null') THEN 1 ELSE 0 END) AS started
  FROM events GROUP BY 1, 2),
moves AS (
  SELECT item_id, snapshot_date, sum(d) AS down, sum(s) AS started FROM (
    SELECT v.item_id, v.seller_entity_id, e.snapshot_date, max(e.down) AS d, max(e.started) AS s FROM active v JOIN flags e ON e.item_id = v.target_item_id GROUP BY 1, 2, 3) GROUP BY 1, 2),
joined AS (
  SELECT o.*, coalesce(d.peer_count, 0) AS peers, coalesce(b.n, 0) AS bench, coalesce(m.down, 0) AS down, coalesce(m.started, 0) AS started, d.lo, d.mid, d.hi, d.mid_norm, d.disc AS peer_disc,
         d.sold AS peer_sold, d.eng AS peer_eng, o.rating_count + o.liked_count AS eng
  FROM own o LEFT JOIN daily d USING (item_id, snapshot_date) LEFT JOIN bench b USING (item_id) LEFT JOIN moves m USING (item_id, snapshot_date)),
hist AS (
  SELECT *, lag(monthly_sold_value) OVER w AS p_sold, lag(peer_sold) OVER w AS p_peer, lag(eng) OVER w AS p_eng, lag(peer_eng) OVER w AS p_peer_eng,
         count(monthly_sold_value) OVER w AS n_sold, count(peer_sold) OVER w AS n_peer
  FROM joined WINDOW w AS (PARTITION BY item_id ORDER BY snapshot_date)),
calc AS (
  SELECT *, CASE WHEN mid > 0 AND price > 0 THEN price / mid END AS idx, discount_percent - peer_disc AS dgap,
         CASE WHEN n_sold >= 7 AND p_sold >= 20 THEN greatest(-100.0, least(100.0, 100.0 * ln((1 + monthly_sold_value) / (1 + p_sold)))) END AS mom,
         CASE WHEN n_peer >= 7 AND p_peer >= 20 AND peer_sold IS NOT NULL THEN greatest(-100.0, least(100.0, 100.0 * ln((1 + peer_sold) / (1 + p_peer)))) END AS peer_mom,
         CASE WHEN p_eng > 0 THEN (eng / p_eng - 1) * 100 END AS eng_mom, CASE WHEN p_peer_eng > 0 AND peer_eng IS NOT NULL THEN (peer_eng / p_peer_eng - 1) * 100 END AS peer_eng_mom
  FROM hist),
signals AS (
  SELECT *, (idx - 1) * 100 AS gap, coalesce(idx < 0.25 OR idx > 4, FALSE) AS outlier,
         0.35 * least(1, greatest(0, coalesce((idx - 1) * 100, 0) / 25)) + 0.25 * CASE WHEN bench > 0 THEN least(1, down / bench) ELSE 0 END
         + 0.2 * CASE WHEN bench > 0 THEN least(1, started / bench) ELSE 0 END + 0.2 * least(1, greatest(0, coalesce(peer_mom, 0) / 50)) AS pressure,
         CASE WHEN peers >= 3 THEN 'high' WHEN peers >= 1 OR bench >= 3 THEN 'medium' ELSE 'low' END AS trust,
         CASE WHEN mid > 0 THEN mid WHEN own_count >= 3 THEN own_median WHEN price_original > 0 THEN price_original END AS base,
         CASE WHEN mid > 0 THEN 'peer_market_median' WHEN own_count >= 3 THEN 'own_history_median' WHEN price_original > 0 THEN 'listed_reference' ELSE 'unavailable' END AS base_type
  FROM calc)
"""
