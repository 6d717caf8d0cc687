"""Every registered query against its SQL oracle, and the registry's contract."""

import pytest
from pyspark.sql import functions as F

import oracle
from skuscope.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        oracle.compare(df, catalog.ORACLES[name], SF)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) <= set(e.queries())


def test_tiles_give_the_pairs_of_the_join(spark):
    """Blocks cut into tiles of eight have the candidates and cosines of one whole block."""
    from skuscope.operators import matching
    from skuscope.plans.market import Market

    held = catalog.listings(Market(spark, SF)).withColumn("oid", F.col("item_id"))
    held = held.join(matching.vectors(matching.tfidf(held, "oid", "embedding_text"), "oid"), "oid", "left").cache()
    whole, cut = ({(r["a"], r["b"]): round(r["semantic"], 9) for r in matching.block_cosines(held, tile).collect()} for tile in (512, 8))
    assert whole == cut and set(whole) == {(r[0], r[1]) for r in catalog.QUERIES["match_candidates"](spark, SF).collect()}


def test_pairs_are_met_by_many_tasks_and_judged_there(spark, monkeypatch):
    """A few blocks fill many tasks, and pairs judged in tiles have the scores of rows."""
    from skuscope.operators import matching, topk
    from skuscope.plans.market import Market

    held = catalog.listings(Market(spark, SF)).withColumn("oid", F.col("item_id")).cache()
    ends = [F.col("s.item_id").alias("a"), F.col("t.item_id").alias("b")]
    whole = matching.candidate_pairs(held).select(*ends)
    with monkeypatch.context() as few:
        few.setattr(topk, "PAIRS", 200)
        cut = matching.candidate_pairs(held, 8).select(*ends)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))
    assert cut.groupBy(F.spark_partition_id()).count().count() > 10
    columns = ["a", "b", "semantic", "type_score", "attribute_score", "pack_score", "price_score", "brand_score", "package_relation", "match_score", "match_type", "confidence"]
    rows = matching.with_sides(matching.block_cosines(matching.with_vectors(held)), held).select(*ends, *columns[2:])
    expect = sorted(map(tuple, rows.collect()))
    assert expect and all(sorted(map(tuple, matching.scored_pairs(held, tile=tile).select(*columns).collect())) == expect for tile in (1024, 16))


@pytest.mark.parametrize("tile", [1024, 7])
def test_bounds_drop_no_partner(spark, tile):
    """The best partners of tiles that drop pairs by their bounds are those of all pairs, scored in full."""
    from skuscope.operators import matching, topk
    from skuscope.plans.market import Market

    held = catalog.listings(Market(spark, SF)).withColumn("oid", F.col("item_id"))
    vectors = matching.with_vectors(held).cache()
    columns = ["source_item_id", "target_item_id", "rank", "match_score", "match_type", "source_status"]
    for k in (1, 4):
        whole = matching.rank(held, matching.with_sides(matching.block_cosines(vectors), held), k)
        found = topk.best_partners(vectors, k, tile).cache()
        best = matching.rank(held, matching.with_sides(found, held), k)
        assert sorted(map(tuple, best.select(columns).collect()), key=str) == sorted(map(tuple, whole.select(columns).collect()), key=str)
        assert found.groupBy("a").count().agg(F.max("count")).first()[0] <= k * (2 if tile > 1000 else 40)


def test_bounds_spare_products():
    """Pairs that can't reach the k best are dropped before all grams are read."""
    import numpy as np
    import pandas as pd

    from skuscope.operators import topk

    rng = np.random.Generator(np.random.PCG64(1))
    n = 300
    grams = [np.sort(rng.choice(5000, 60, replace=False)) for _ in range(n)]
    rows = pd.DataFrame({"shop_id": np.arange(n) % 7, "item_id": np.arange(n), "brand_clean": "b", "product_type": "banh_gao", "is_bundle": False, "package_ambiguous": False})
    rows["toks"] = [np.array([i % 50], dtype=np.int64) for i in range(n)]
    rows["grams"], rows["weights"] = grams, [np.full(60, 60**-0.5)] * n
    for c in topk.MEASURES:
        rows[c] = np.nan if c == "volume_ml" else rng.integers(1, 30, n).astype(float)
    ok = rows["shop_id"].to_numpy()[:, None] != rows["shop_id"].to_numpy()[None, :]
    cosine, score = topk.best_in_tile(rows, rows, ok, 3, False)
    exact = np.array([[len(np.intersect1d(a, b)) / 60 for b in grams] for a in grams])
    want = topk.pick(np.where(ok, topk.shown(topk.base_scores(rows, rows) + 40 * np.rint(exact * 1e6).astype(np.int64)), -1), rows, 3)
    got = topk.pick(score, rows, 3)
    assert set(zip(*map(list, got))) == set(zip(*map(list, want)))
    assert (score >= 0).sum() < 0.5 * ok.sum()


def test_nearest_of_odd_vectors(spark):
    from skuscope.operators import matching

    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, []), (9, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted((r["a"], r["b"], r["rank"]) for r in matching.nearest(df, df, "id", "v", 3).collect())
    assert got == [(1, 2, 1), (2, 1, 1), (5, 9, 1), (9, 5, 1)]


def test_offers_are_shipped_a_few_times(spark):
    """However many tiles a block holds, an offer of it is shipped to a few tasks, and categories without generic types aren't shipped."""
    from skuscope.operators import topk

    rows = spark.range(400).selectExpr("id as oid", "'vn' as country_code", "1L as catid", "false as is_gift", "if(id < 360, 'toner', 'unknown') as product_type")
    met = topk.dealt_tiles(rows, ["oid"], 8, large=200).groupBy("block").agg(F.count("*").alias("n")).collect()
    assert {r["block"]: r["n"] for r in met} == {"vn/t:toner": 360 * topk.SPLIT, "vn/c:1": 40 * 2 * topk.SPLIT + 360 * topk.SPLIT}
    assert {r["block"] for r in topk.dealt_tiles(rows.filter("oid < 360"), ["oid"], 8).select("block").collect()} == {"vn/t:toner"}


def test_vectors_are_those_of_the_grams(spark):
    from skuscope.operators import matching

    rows = [(1, " Bánh  quy AB ", 1), (2, "a bánh QUY quy", 3), (3, None, 1), (4, "  ", 1), (5, "zz", 1)]
    docs = spark.createDataFrame(rows, "oid long, embedding_text string, copies long")
    number = {g: k for k, g in enumerate(r["gram"] for r in matching.vocabulary(matching.char_ngrams(docs, "oid", "embedding_text").join(docs, "oid"), 12, "copies").collect())}
    want = {}
    for r in matching.tfidf(docs, "oid", "embedding_text", 12, "copies").collect():
        want.setdefault(r["oid"], {})[number[r["gram"]]] = round(r["weight"], 12)
    got = {r["oid"]: r["grams"] and dict(zip(r["grams"], [round(w, 12) for w in r["weights"]])) for r in matching.with_vectors(docs, 12, "copies").collect()}
    assert len(want) < 5 and got == {k: want.get(k) for k in range(1, 6)}
