"""Readers and sinks on small files, and the checks of the reads."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skuscope.operators import reads, recommend
from skuscope.sources import files


def put(root, path, text):
    place = root / path
    place.parent.mkdir(parents=True, exist_ok=True)
    place.write_text(text, encoding="utf-8")


@pytest.fixture()
def market(tmp_path):
    head = "\ufeffdate,shop_id,item_id,product_name,price,images\n"
    put(tmp_path, "country_code=vn/dataset=products/shop_id=5/a.csv", head + '2024-01-02,0,1,"Bánh, ""two""\nlines",12.7,"[""x""]"\n2024-01-02,9,2,,x,\n')
    put(tmp_path, "country_code=vn/dataset=products/shop_id=5/b.csv", head + "2024-01-02,5,1,again,99,\n2024-01-03,,1,next,10000000,junk\n")
    put(tmp_path, "country_code=id/dataset=products/shop_id=7/c.csv", head + "2024-01-02,7,3,C,-5,\n")
    put(tmp_path, "country_code=id/dataset=category_platform/t.csv", "category_id,key,has_children\n4,k,yes\n4,other,no\n")
    put(tmp_path, "country_code=id/dataset=shop_info/shop_id=7/s.csv", "date,rating_star,created_at\n2024-01-02,4.5,2020-05-06 01:02:03\n")
    put(tmp_path, "country_code=id/dataset=category_list/shop_id=7/l.csv", "date,shop_category_id,total\n2024-01-02,3,8\n2024-01-02,3,9\n")
    put(tmp_path, "country_code=id/dataset=product_categories/shop_id=7/p.csv", "date,item_id,category_id\n2024-01-02,3,4\n")
    return tmp_path


def test_snapshots(spark, market):
    files.check_paths(spark, str(market))
    got = {(r["country_code"], r["shop_id"], r["item_id"], str(r["snapshot_date"])): r for r in files.load(spark, str(market), "products").collect()}
    assert set(got) == {("vn", 5, 1, "2024-01-02"), ("vn", 9, 2, "2024-01-02"), ("vn", 5, 1, "2024-01-03"), ("id", 7, 3, "2024-01-02")}
    a = got["vn", 5, 1, "2024-01-02"]
    assert (a["product_name"], a["price"], a["images"], a["currency"]) == ('Bánh, "two"\nlines', 12, '["x"]', "VND") and a["source_file"].endswith("a.csv")
    assert got["vn", 9, 2, "2024-01-02"]["price"] is None and got["vn", 5, 1, "2024-01-03"]["images"] == '"junk"'
    assert files.load(spark, str(market), "category_platform").select("category_key", "has_children").collect() == [("k", True)]
    assert files.load(spark, str(market), "shop_info").select("rating_star", "created_at").first() == (4.5, dt.datetime(2020, 5, 6, 1, 2, 3))
    report = {r["dataset"]: r for r in files.ingestion_report(spark, str(market)).collect()}
    p = report["products"]
    assert (p["source_rows"], p["loaded_rows"], p["duplicate_rows"], p["null_price_rows"], p["invalid_price_rows"], p["outlier_price_rows"]) == (5, 4, 1, 1, 1, 1)
    assert (report["category_list"]["duplicate_rows"], report["category_platform"]["duplicate_rows"], report["product_categories"]["duplicate_rows"], report["shop_info"]["null_price_rows"]) == (1, 1, 0, None)


def test_bad_files(spark, market):
    put(market, "country_code=vn/dataset=products/shop_id=5/d.csv", "date,item_id\n,1\n")
    with pytest.raises(Exception, match="missing date"):
        files.load(spark, str(market), "products").collect()
    put(market, "elsewhere/x.csv", "a\n1\n")
    with pytest.raises(ValueError, match="elsewhere"):
        files.check_paths(spark, str(market))
    with pytest.raises(ValueError):
        files.read_snapshots(spark, str(market), "other")
    put(market, "costs/c.csv", "country_code,shop_id,item_id,cost_value\nvn,1,1,0\n")
    with pytest.raises(Exception, match="positive"):
        recommend.checked_costs(files.read_costs(spark, str(market / "costs"))).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 'a "b"', None), (1, "x\ny", 1.5)], "id int, text string, v double")
    files.write_sheet(df, str(tmp_path / "sheet"), ["id"], 1)
    one = next((tmp_path / "sheet").glob("part-*"))
    assert one.read_bytes().startswith('\ufeff'.encode()) and files.read_csv(spark, str(tmp_path / "sheet")).collect() == [("1", "x\ny", "1.5")]
    path = str(tmp_path / "runs")
    run = files.start_run(spark, path, "s", dt.datetime(2024, 1, 1), '{"k": 1}')
    assert files.manifest(spark.read.parquet(path)).first()["status"] == "running"
    files.finish_run(spark, path, run, "s", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), "failed", error="why")
    r = files.manifest(spark.read.parquet(path)).first()
    assert (r["run_id"], r["status"], r["error_message"], r["metadata"]) == (run, "failed", "why", '{"k": 1}')
    with pytest.raises(ValueError):
        files.finish_run(spark, path, run, "s", None, None, "done")


def test_read_checks(spark):
    day = dt.date(2024, 1, 1)
    products = spark.createDataFrame([("vn", 1, 10, day, "Ring", 5.0), ("vn", 2, 20, day, "Bolt", 6.0)], "country_code string, shop_id long, item_id long, snapshot_date date, product_name string, monthly_sold_value double")
    attributes = spark.createDataFrame([("vn", 1, 10, "a"), ("vn", 2, 20, "b")], "country_code string, shop_id long, item_id long, company_id string")
    runs = spark.createDataFrame([("r", "product_matching", "success", 1), ("q", "market_signals", "failed", 1)], "run_id string, stage string, status string, started_at int")
    tables = {"products": products, "attributes": attributes}
    all_of, mine = reads.Reads(tables), reads.Reads(tables, scopes=[("vn", 1)], runs=runs)
    page = mine.list_products("vn")
    assert [r["item_id"] for r in page.rows.collect()] == [10] and page.total.first()["total_count"] == 1
    assert all_of.list_products("vn", company_id="b", query="bo").rows.first()["item_id"] == 20
    assert [r["item_id"] for r in all_of.search_products("vn", "ri").rows.collect()] == [10]
    wrong = [
        lambda: mine.list_products("th"), lambda: mine.list_products("vn", limit=0), lambda: mine.list_products("vn", limit=101), lambda: mine.list_products("vn", query="x" * 121), lambda: all_of.search_products("vn", "x"),
        lambda: all_of.product_snapshot("vn", True, 1), lambda: all_of.product_snapshot("vn", 1, -1), lambda: all_of.list_alerts("vn", severity="huge"), lambda: all_of.list_recommendations("vn", status="done"), lambda: all_of.peers("vn", 1, 1, limit=11),
    ]
    for call in wrong:
        with pytest.raises(ValueError):
            call()
    for call in (lambda: mine.list_products("vn", shop_id=2), lambda: mine.list_products("id"), lambda: reads.Reads(tables, scopes=[("vn", 1)]).product_snapshot("vn", 2, 20)):
        with pytest.raises(PermissionError):
            call()
    with pytest.raises(reads.NotPublished):
        mine.market_signals("vn", 1, 10)
    assert reads.average_discount(spark.createDataFrame([], "discount_percent double")).first()[0] == 0.0
    shown = reads.normalized_price(spark.createDataFrame([(10.0, True, False, 100.0, None, 1), (10.0, False, False, None, 200.0, 1)], "price double, package_ambiguous boolean, price_variant_ambiguous boolean, total_weight_g double, total_volume_ml double, quantity int"))
    assert [tuple(r) for r in shown.select("shown_price", "shown_basis").collect()] == [(None, None), (5.0, "100 ml")]
    assert reads.staleness(spark.createDataFrame([(day,)], "snapshot_date date").select(F.col("snapshot_date")), dt.date(2024, 1, 4)).first()["is_stale"]


def test_shop_folders_are_written_by_all_tasks(spark, tmp_path):
    """Each shop has a folder with every file twice, and the folders come from more than two tasks."""
    import glob
    import re

    from skuscope.plans import catalog_files
    from skuscope.plans.market import Market

    rows = spark.range(1, 41).selectExpr("'2024-05-01' as date", "concat('n', id) as shop_name", "if(id % 2 = 0, 'vn', 'id') as __country", "id as __shop").repartition(1)
    root = catalog_files.dropped(Market(spark, str(tmp_path)), "shop_info", rows).removeprefix("file://")
    found = glob.glob(f"{root}/country_code=*/dataset=shop_info/shop_id=*/*.csv")
    assert len(found) == 80 and len({f.rsplit("/", 1)[0] for f in found}) == 40
    assert len({re.search(r"part-(\d+)-", f)[1] for f in found}) > 2
