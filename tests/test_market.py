"""Market tables: what is paired stays in proportion to the offers, with the same rows as all pairs."""

from pyspark.sql import functions as F

from skuscope.plans.market import Market


def join_rows(df) -> int:
    """Rows that the joins of an executed plan have put out."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
        if "Join" in name and p.metrics().contains("numOutputRows"):
            found += p.metrics().apply("numOutputRows").value()
    return found


def parts(spark, folder, copies: int):
    """Offers of four shops and two sizes, ``copies`` of each."""
    rows = spark.range(16 * copies).selectExpr(
        "id as p_partkey", "'a name' as p_name", "concat('Brand#', 11 + id div 2 % 4) as p_brand", "'TYPE' as p_type", "cast(10 + id div 8 % 2 as int) as p_size", "100.0D as p_retailprice"
    )
    rows.write.mode("overwrite").parquet(f"{folder}/part.parquet")
    return Market(spark, str(folder))


def test_matches_pair_kinds_of_offers(spark, tmp_path):
    small, large = (join_rows(parts(spark, tmp_path / str(n), n)._matches()) for n in (20, 80))
    assert large < 8 * small  # four times the offers


def test_matches_are_those_of_all_pairs(spark, tmp_path):
    m = parts(spark, tmp_path, 15)
    o = m.offers()
    o = o.unionByName(o.filter("item_id < 40").withColumns({"item_id": F.col("item_id") + 1000, "product_name": F.lit("alone"), "shop_id": F.lit(77).cast("long"), "seller_entity_id": F.lit("seller_7")}))
    m.offers = lambda: o
    found = sorted(tuple(r) for r in m._matches().select("source_item_id", "rank", "target_item_id", "match_score").collect())
    rows = [(r["item_id"], r["country_code"], r["product_name"], r["shop_id"], r["size"], r["seller_entity_id"]) for r in o.collect()]
    wanted = []
    for s in rows:
        near = [(-round(0.5 + 0.5 * min(s[4], t[4]) / max(s[4], t[4]), 6), t[3], t[0]) for t in rows if s[1:3] == t[1:3] and s[3] != t[3] and s[5] != t[5]]
        wanted += [(s[0], k + 1, t[2], -t[0]) for k, t in enumerate(sorted(near)[:10])] or [(s[0], 1, None, 0.0)]
    assert found == sorted(wanted)


def test_days_of_a_list_are_found_once(spark):
    """Sources with one and the same list of peers: what their joins put out stays below sources x peers x days."""
    from skuscope.operators import signals

    n, peers_n, days = 60, 10, 7
    attributes = spark.range(n + peers_n).selectExpr(
        "'vn' as country_code", "1L as shop_id", "id as item_id", "100.0D as total_weight_g", "cast(null as double) as total_volume_ml", "1L as quantity",
        "false as package_ambiguous", "false as price_variant_ambiguous", "concat('s', id) as seller_entity_id",
    )
    products = attributes.select("country_code", "shop_id", "item_id").crossJoin(spark.range(days).selectExpr("date_add(date'2026-01-01', cast(id as int)) as snapshot_date", "id as d")).selectExpr(
        "country_code", "shop_id", "item_id", "snapshot_date", "100.0D + item_id + d as price", "5.0D as discount_percent", "10.0D + d as monthly_sold_value", "1L as rating_count", "1L as liked_count"
    )
    events = products.selectExpr("country_code", "shop_id", "item_id", "snapshot_date", "'price_changed' as event_type", "'9' as old_value", "'8' as new_value")
    peers = spark.range(n).crossJoin(spark.range(n, n + peers_n).withColumnRenamed("id", "t")).selectExpr(
        "'vn' as country_code", "1L as source_shop_id", "id as source_item_id", "1L as target_shop_id", "t as target_item_id", "0.9D as match_score", "'same_product' as relation", "'peer_found' as peer_status"
    )
    profiles = signals.source_profiles(peers, attributes)
    daily = signals.peer_daily(products, attributes, peers, profiles)
    moves = signals.event_daily(signals.activity_peers(attributes, peers), events)
    best = signals.alert_targets(peers, events)
    for found, rows in ((daily, n * days), (moves, n * days), (best, n * (days + 1))):
        assert found.count() == rows and join_rows(found) < n * peers_n * days
    a = daily.filter("source_item_id = 5").orderBy("snapshot_date").first()
    assert (a["peer_count"], a["peer_min_price"], a["peer_median_price"], a["peer_max_price"]) == (10, 100.0 + n, 104.5 + n, 109.0 + n)
    assert {(r["target_item_id"], r["kind"]) for r in best.collect()} == {(n, "price"), (n, "competitor_price_down")}


def test_reads_make_only_the_tables_they_read(spark, tmp_path):
    """There is no lineitem table here, so whoever makes products, signals or alerts fails."""
    held = parts(spark, tmp_path, 2).reads()
    assert held.list_companies("id").rows.count() > 0 and set(held.tables) == {"attributes"}


def test_matching_pairs_kinds_of_offers(spark, monkeypatch):
    """Copies of an offer under other items: tiles get one of each kind, and the ranks are those of all pairs."""
    from skuscope.operators import matching, synthetic
    from skuscope.sources.scratch import written

    parts = spark.range(1, 31).selectExpr("id as p_partkey", "900.0D + id as p_retailprice")
    held = synthetic.listings(synthetic.offers(parts, 2)).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(3))))
    held = written(held.withColumn("item_id", F.col("item_id") + 10_000_000 * F.col("copy")).drop("copy").coalesce(2), "copies")
    shown = ["source_shop_id", "source_item_id", "target_shop_id", "target_item_id", "rank", "match_score", "match_type", "source_status"]
    numbered = written(held.withColumn("oid", F.monotonically_increasing_id()), "numbered")
    expect = matching.rank(numbered, matching.with_sides(matching.best_partners(matching.with_vectors(numbered), 6), numbered), 6).select(*shown).collect()
    given, whole = [], matching.best_partners
    monkeypatch.setattr(matching, "best_partners", lambda offers, *rest, **more: given.append(offers.count()) or whole(offers, *rest, **more))
    got = matching.match_offers(held, 6).select(*shown).collect()
    assert set(map(tuple, got)) == set(map(tuple, expect)) and len(got) == len(expect) > 240
    assert given == [60]
