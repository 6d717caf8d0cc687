"""Versioned publication, batch entry points, fed events and streamed limits on small tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skuscope.operators.incremental import EventFeed
from skuscope.operators.snapshots import change_events
from skuscope.plans import jobs
from skuscope.sources import files, scratch
from skuscope.sources.versions import NotPublished, Warehouse, blooms, clustered, fingerprint
from test_sources import put


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_failed_run_keeps_what_was(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    with pytest.raises(NotPublished):
        w.pin().read("s")
    first = w.publish("s", lambda pin: spark.range(5), metadata={"a": 1})
    with pytest.raises(Exception, match="boom"):
        w.publish("s", lambda pin: spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("boom")).cast("long")).alias("id")))
    with pytest.raises(ZeroDivisionError):
        w.publish("s", lambda pin: 1 // 0)
    assert w.pin().read("s").count() == 5 and w.rows_of(first) == {"s": 5}
    log = {r["run_id"]: r for r in w.runs().collect()}
    assert sorted(r["status"] for r in log.values()) == ["failed", "failed", "success"]
    assert json.loads(log[first]["metadata"]) == {"a": 1, "inputs": {}}
    assert [p.name for p in (tmp_path / "w" / "s").iterdir()] == [first]


def test_pins_and_collection(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    one = w.publish("s", lambda pin: spark.range(1))
    old = w.pin()
    two = w.publish("s", lambda pin: spark.range(2))
    derived = w.publish("t", lambda pin: pin.read("s"))
    three = w.publish("s", lambda pin: spark.range(3))
    assert (old.read("s").count(), w.pin().read("s").count(), w.pin().read("t").count()) == (1, 3, 2)
    assert json.loads(w.runs().filter(F.col("run_id") == derived).first()["metadata"])["inputs"] == {"s": two}
    assert w.collect(1, [old]) == [two] and old.read("s").count() == 1
    assert w.collect(1) == [one] and w.pin().read("s").count() == 3 and three in w.pin().versions.values()
    w._append("s-dead", "s", "running", dt.datetime(2020, 1, 1), None, "{}", None, None)
    spark.range(1).write.parquet(w.path("s", "s-dead"))
    assert w.collect(1) == ["s-dead"] and w.pin().versions["s"] == three


def test_log_is_compacted(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    for n in range(4):
        w.publish("s", lambda pin, n=n: spark.range(n))
    files_of = lambda: len(list((tmp_path / "w" / "_runs").glob("part-*")))
    before, entries = rows_of(w.runs()), w.log().count()
    assert files_of() == entries == 8 and w.compact() == 8 and files_of() == 1
    assert rows_of(w.runs()) == before and w.log().count() == entries
    w.log().coalesce(1).write.mode("append").parquet(str(tmp_path / "w" / "_runs"))  # as seen between writing and deleting
    assert rows_of(w.runs()) == before
    w.publish("s", lambda pin: spark.range(9))
    assert w.compact() == 4 and w.pin().read("s").count() == 9 and w.log().count() == entries + 2


def test_stage_follows_its_data(spark, tmp_path):
    path, made = str(tmp_path / "data"), []
    build = lambda: made.append(1) or spark.read.parquet(path)
    spark.range(3).write.parquet(path)
    a = fingerprint(spark, path)
    assert [scratch.stage(spark, path, "x", build).count() for _ in range(2)] == [3, 3] and len(made) == 1
    spark.range(4).write.mode("append").parquet(path)
    assert fingerprint(spark, path) != a
    assert scratch.stage(spark, path, "x", build).count() == 7 and len(made) == 2


def scanned(df):
    """Rows that the scans of a collected frame have read."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if hasattr(plan, "executedPlan") and "Adaptive" in plan.nodeName() else plan
    leaves, out = plan.collectLeaves(), 0
    for k in range(leaves.size()):
        out += leaves.apply(k).metrics().get("numOutputRows").get().value()
    return out


def test_point_reads_skip_row_groups(spark, tmp_path):
    """A read of one offer meets one row group of a clustered table, and by Bloom filter none for an unknown one."""
    w, n = Warehouse(spark, str(tmp_path / "w")), 60_000
    rows = spark.range(n).selectExpr("'vn' as country_code", "id % 50 as shop_id", "id * 2 as item_id", "repeat(md5(cast(id as string)), 4) as payload").orderBy("payload")
    small = {"parquet.block.size": str(1 << 18), "parquet.page.size": "16384", "parquet.block.size.row.check.min": "100"}
    w.publish("clustered", lambda pin: rows, "country_code", None, clustered("country_code", "shop_id", "item_id"), small | blooms("item_id"))
    w.publish("plain", lambda pin: rows, "country_code", None, None, small)
    read = lambda stage, item: w.pin().read(stage).filter(f"country_code = 'vn' and shop_id = {item // 2 % 50} and item_id = {item}")
    near, far, none = read("clustered", 20_002), read("plain", 20_002), read("clustered", 20_003)
    assert [len(df.collect()) for df in (near, far, none)] == [1, 1, 0]
    assert scanned(near) <= n // 10 and scanned(near) * 4 < scanned(far) and scanned(none) == 0


def test_jobs_publish_and_gate(spark, tmp_path):
    head = "date,shop_id,item_id,product_name,price,brand,catid,discount_percent,promotion_id\n"
    for shop, name in ((5, "Sữa bột milo 400g"), (7, "Sua bot milo 400g hop"), (8, "Bột sữa milo 380g")):
        lines = "".join(f"2024-01-0{d},{shop},{shop}1,{name},{90 + shop * d},Milo,{3},{d},p{d // 2}\n" for d in (1, 2, 3))
        put(tmp_path, f"data/country_code=vn/dataset=products/shop_id={shop}/a.csv", head + lines)
    put(tmp_path, "data/country_code=vn/dataset=shop_info/shop_id=5/s.csv", "date,rating_star\n2024-01-02,4.5\n")
    put(tmp_path, "data/country_code=vn/dataset=category_list/shop_id=5/l.csv", "date,shop_category_id\n2024-01-02,3\n")
    put(tmp_path, "data/country_code=vn/dataset=product_categories/shop_id=5/p.csv", "date,item_id,category_id\n2024-01-02,51,4\n")
    put(tmp_path, "data/country_code=vn/dataset=category_platform/t.csv", "category_id,key\n4,k\n")
    put(tmp_path, "registry.csv", "country_code,shop_id,company_id,company_name,seller_entity_id,seller_entity_name\nvn,5,c5,C5,s5,S5\nvn,7,c7,C7,s7,S7\n")
    w, at = Warehouse(spark, str(tmp_path / "w")), lambda x: str(tmp_path / x)
    run = lambda *a: jobs.main([*a, "--warehouse", at("w")], spark)
    assert run("ingest", "--data-dir", at("data"))["rows"]["products"] == 9
    assert rows_of(w.pin().read("data_foundation")) == rows_of(files.ingestion_report(spark, at("data")).select(*w.pin().read("data_foundation").columns))
    with pytest.raises(NotPublished):
        jobs.gated_reads(w).list_products("vn")
    got = run("match", "--registry", at("registry.csv"), "--review-file", at("review"), "--review-size", "10")
    assert got["rows"]["product_attributes"] == 3 and got["rows"]["product_matching"] >= 3
    assert {r["source_company"] for r in files.read_csv(spark, at("review")).collect()} == {"C5", "C7", "shop_8"}
    assert run("signals", "--review-file", at("alerts"))["rows"]["market_signals"] == 9
    assert run("costs", "--output", at("costs"), "--company-id", "c5") == {"output": at("costs")}
    done = run("recommend", "--cost-file", at("costs"), "--review-file", at("cards"))
    assert done["rows"]["recommendations"] == 3 and done["review_rows"] == 3
    cards = files.read_csv(spark, at("cards"))
    assert cards.columns[-3:] == ["review_label", "review_notes", "annotator"] and cards.count() == 3
    assert run("recommend", "--shop-id", "5")["rows"]["recommendations"] == 1
    reads = jobs.gated_reads(w)
    assert reads.product_snapshot("vn", 5, 51).rows.first()["price"] == 105 and reads.list_products("vn").total.first()[0] == 3
    w._append("market_signals-x", "market_signals", "failed", dt.datetime(2999, 1, 1), dt.datetime(2999, 1, 1), None, None, "why")
    with pytest.raises(NotPublished):
        jobs.gated_reads(w).market_signals("vn", 5, 51)
    with pytest.raises(SystemExit):
        jobs.main(["match", "--warehouse", at("w")], spark)
    assert len(run("clean", "--keep", "1")["deleted"]) == 1


KIND = "country_code string, shop_id long, item_id long, snapshot_date date, price double, discount_percent double, promotion_id string, voucher_code string"


def history():
    day = lambda d: dt.date(2024, 1, d)
    return [("vn", 1, i, day(d), float(i * (d // 2)) if d != 3 else None, 1.0 * (d % 3), None if d < 3 else "p", "v") for i in range(6) for d in range(1, 7) if (i + d) % 4]


def test_feed_by_day(spark, tmp_path):
    rows = spark.createDataFrame(history(), KIND)
    feed = EventFeed(Warehouse(spark, str(tmp_path / "w")))
    for d in range(1, 7):
        feed.feed(rows.filter(F.dayofmonth("snapshot_date") == d))
    held = feed.events().columns
    assert rows_of(feed.events()) == rows_of(change_events(rows).select(*held))
    assert feed.state().count() == 6


def test_feed_of_late_rows(spark, tmp_path):
    rows = spark.createDataFrame(history(), KIND)
    feed, number = EventFeed(Warehouse(spark, str(tmp_path / "w"))), F.dayofmonth("snapshot_date")
    feed.feed(rows.filter(number.isin(1, 3)))
    with pytest.raises(ValueError, match="history"):
        feed.feed(rows.filter(number == 2))
    feed.feed(rows.filter(number.isin(2, 5)), rows.filter(number.isin(1, 3)))
    feed.feed(rows.filter(number.isin(4, 6)), rows.filter(number.isin(1, 2, 3, 5)))
    assert rows_of(feed.events()) == rows_of(change_events(rows).select(*feed.events().columns))


def test_half_a_feed_adds_nothing(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame(history(), KIND)
    w = Warehouse(spark, str(tmp_path / "w"))
    feed, number = EventFeed(w), F.dayofmonth("snapshot_date")
    feed.feed(rows.filter(number <= 2))
    before, publish = rows_of(feed.events()), w.publish

    def failing(stage, *a, **b):
        if stage == "event_state":
            raise RuntimeError("lost")
        return publish(stage, *a, **b)

    monkeypatch.setattr(w, "publish", failing)
    with pytest.raises(RuntimeError):
        feed.feed(rows.filter(number > 2))
    assert rows_of(feed.events()) == before
    monkeypatch.undo()
    feed.feed(rows.filter(number > 2))
    assert rows_of(feed.events()) == rows_of(change_events(rows).select(*feed.events().columns))
