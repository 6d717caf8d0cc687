"""Queries of the file sources and sinks: the test tables written as files and read back."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import evaluate, recommend, serving, snapshots
from ..sources import files
from ..sources.scratch import folder
from .registering import n, query, r

AT = datetime.datetime(2024, 1, 1)


def dropped(m, name: str, rows, mark: bool = True) -> str:
    """``rows`` as CSV files below country_code=/dataset=/shop_id=, every file twice; header with a byte-order mark."""
    root = folder(m.spark, "csv")
    rows = rows.withColumn("dataset", F.lit(name)).withColumnsRenamed({"__country": "country_code", "__shop": "shop_id"})
    first = rows.columns[0]
    rows = rows.withColumnRenamed(first, files.BOM + first) if mark else rows
    # a folder's files come from a few tasks, folders from all; tasks move their own files, as the driver would move all one by one
    some = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(2))
    moved = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
    for _ in range(2):
        dealt = rows.repartition(m.spark.sparkContext.defaultParallelism, "country_code", "shop_id", some)
        dealt.write.mode("append").partitionBy("country_code", "dataset", "shop_id").options(header=True, escape='"', **moved).csv(root)
    return root


def sheets(m):
    """Product rows as text, with blanks, quoted line ends, odd numbers and missing shops."""
    k = F.col("p_partkey")
    return m.table("part").select(
        F.lit("2024-05-01").alias("date"), F.when(k % 3 == 0, "0").when(k % 3 == 1, " ").otherwise(F.lit("7")).alias("text_shop"), k.cast("string").alias("item_id"),
        F.concat(F.lit(" "), "p_name", F.when(k % 5 == 0, F.lit(',\n"New" LINE!')).otherwise("")).alias("product_name"), F.when(k % 4 == 0, "abc").otherwise(F.concat(F.lit(" "), "p_size", F.lit(".9 "))).alias("price"),
        F.when(k % 2 == 0, "Yes").otherwise("f").alias("is_ad"), F.lit("1700000000").alias("ctime"), F.when(k % 6 == 0, "[1, 2]").when(k % 6 == 1, "plain").otherwise("").alias("images"),
        F.when(k % 2 == 0, "vn").otherwise("id").alias("__country"), (k % 4 + 1).alias("__shop"),
    )


@query(r"""SELECT p_partkey AS item_id, CASE WHEN p_partkey % 2 = 0 THEN 'vn' ELSE 'id' END AS country_code, CASE WHEN p_partkey % 2 = 0 THEN 'VND' ELSE 'IDR' END AS currency, CASE WHEN p_partkey % 3 = 2 THEN 7 ELSE p_partkey % 4 + 1 END AS shop_id,
 DATE '2024-05-01' AS snapshot_date, p_name || CASE WHEN p_partkey % 5 = 0 THEN ',' || chr(10) || '"New" LINE!' ELSE '' END AS product_name, p_name || CASE WHEN p_partkey % 5 = 0 THEN ' new line' ELSE '' END AS product_name_normalized,
 CASE WHEN p_partkey % 4 <> 0 THEN p_size END::BIGINT AS price, p_partkey % 2 = 0 AS is_ad, TIMESTAMP '2023-11-14 22:13:20' AS ctime, CASE p_partkey % 6 WHEN 0 THEN '[1, 2]' WHEN 1 THEN '"plain"' ELSE '[]' END AS images, TRUE AS traced FROM part""")
def csv_products(m):
    """Recursive read, byte-order mark, quoted line ends, casts, directory keys and shop fallback, first-wins dedup, lineage."""
    root = dropped(m, "products", sheets(m))
    files.check_paths(m.spark, root)
    raw = files.read_snapshots(m.spark, root, "products").withColumnRenamed("text_shop", "shop_id")
    got = snapshots.first_wins(files.typed(raw, "products"), files.DATASETS["products"][0], ["source_file", "source_row"])
    traced = F.col("source_file").contains("dataset=products") & F.col("source_file").endswith(".csv")
    return got.select("item_id", "country_code", "currency", "shop_id", "snapshot_date", "product_name", "product_name_normalized", "price", "is_ad", "ctime", "images", traced.alias("traced"))


@query("SELECT s_suppkey AS shop_id, CASE WHEN s_suppkey % 2 = 0 THEN 'vn' ELSE 'id' END AS country_code, s_name AS shop_name, round(s_acctbal, 2) AS rating_star, s_nationkey::BIGINT AS follower_count, s_suppkey % 3 = 0 AS vacation FROM supplier WHERE s_suppkey > 0")
def csv_shops(m):
    k = F.col("s_suppkey")
    rows = m.table("supplier").filter("s_suppkey > 0").select(F.lit("2024-05-01").alias("date"), F.col("s_name").alias("shop_name"), F.col("s_acctbal").cast("string").alias("rating_star"), F.col("s_nationkey").cast("string").alias("follower_count"), F.when(k % 3 == 0, "TRUE").otherwise("no").alias("vacation"), F.when(k % 2 == 0, "vn").otherwise("id").alias("__country"), k.alias("__shop"))
    got = files.load(m.spark, dropped(m, "shop_info", rows.repartition(1)), "shop_info")
    return got.select("shop_id", "country_code", "shop_name", r("rating_star", 2), "follower_count", "vacation")


@query("SELECT 'category_list' AS dataset, count(*) AS rows, count(parent) AS parents, sum(p_size)::BIGINT AS total FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS parent FROM part) UNION ALL SELECT 'product_categories', count(*), 0, 0 FROM part UNION ALL SELECT 'category_platform', count(DISTINCT (p_partkey % 2, p_size)), 0, 0 FROM part")
def csv_categories(m):
    k, day = F.col("p_partkey"), F.lit("2024-05-01").alias("date")
    place = [F.when(k % 2 == 0, "vn").otherwise("id").alias("__country"), (k % 3 + 1).alias("__shop")]
    part, text = m.table("part"), lambda c: F.col(c).cast("string")
    listed = part.select(day, text("p_partkey").alias("shop_category_id"), text("p_size").alias("total"), F.when(k % 2 == 0, text("p_size")).otherwise("").alias("parent_shop_category_id"), *place)
    linked = part.select(day, text("p_partkey").alias("item_id"), text("p_size").alias("category_id"), F.lit("slug").alias("category_slug"), *place)
    tree = part.select(F.lit("p").alias("platform"), text("p_size").alias("category_id"), F.col("p_type").alias("display_category_name"), *place)
    a = files.load(m.spark, dropped(m, "category_list", listed), "category_list").agg(F.count("*").alias("rows"), F.count("parent_shop_category_id").alias("parents"), F.sum("total").alias("total"))
    b, c = (files.load(m.spark, dropped(m, name, rows), name).agg(F.count("*").alias("rows"), F.lit(0).cast("long").alias("parents"), F.lit(0).cast("long").alias("total")) for name, rows in (("product_categories", linked), ("category_platform", tree)))
    named = lambda df, name: df.select(F.lit(name).alias("dataset"), "*")
    return named(a, "category_list").unionByName(named(b, "product_categories")).unionByName(named(c, "category_platform"))


@query("SELECT n_nationkey::BIGINT AS shop_id, lower(CASE WHEN n_nationkey % 2 = 0 THEN 'VN' ELSE 'id' END) AS country_code, 'c' || n_regionkey AS company_id, n_name AS seller_entity_name FROM nation")
def registry_csv(m):
    k, path = F.col("n_nationkey"), folder(m.spark, "registry")
    rows = m.table("nation").select(F.when(k % 2 == 0, " VN ").otherwise("id").alias(files.BOM + "country_code"), k.cast("string").alias("shop_id"), F.concat(F.lit("c"), "n_regionkey").alias("company_id"), F.lit("x").alias("company_name"), F.lit("s").alias("seller_entity_id"), F.col("n_name").alias("seller_entity_name"))
    rows.coalesce(1).write.options(header=True, escape='"').csv(path)
    return files.read_registry(m.spark, path).select("shop_id", "country_code", "company_id", "seller_entity_name")


@query("SELECT p_partkey AS source_item_id, p_size::DOUBLE AS cost_value, CASE WHEN p_partkey % 2 = 0 THEN 12.5 ELSE 10 END::DOUBLE AS margin_min_pct, CASE WHEN p_partkey % 3 = 0 THEN 'seeded_scenario' ELSE 'verified_input' END AS cost_source, CASE WHEN p_partkey % 3 = 0 THEN p_size - 0.5 END::DOUBLE AS cost_low, 'verified' AS cost_confidence FROM part")
def costs_csv(m):
    """Each product costed twice; the last row of the file wins."""
    k, path = F.col("p_partkey"), folder(m.spark, "costs")
    rows = m.table("part").withColumn("pass", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        "pass", "p_partkey", F.lit("VN").alias("country_code"), F.lit("1").alias("shop_id"), k.cast("string").alias("item_id"), F.when(F.col("pass") == 1, "999").otherwise(F.col("p_size").cast("string")).alias("cost_value"),
        F.when(k % 2 == 0, "12.5").otherwise("").alias("margin_min_pct"), F.when(k % 3 == 0, "seeded_scenario").otherwise("").alias("cost_source"), F.when(k % 3 == 0, (F.col("p_size") - 0.5).cast("string")).otherwise("").alias("cost_low"),
    )
    rows.coalesce(1).sortWithinPartitions("pass", "p_partkey").drop("pass", "p_partkey").write.options(header=True, escape='"').csv(path)
    got = recommend.checked_costs(files.read_costs(m.spark, path))
    return got.select("source_item_id", "cost_value", "margin_min_pct", "cost_source", "cost_assumption.cost_low", "cost_assumption.cost_confidence")


@query("SELECT p_partkey AS review_id, CASE WHEN p_partkey % 4 = 0 THEN 'last' WHEN p_partkey % 2 = 0 THEN 'first' ELSE 'old' END AS review_label FROM part")
def review_labels(m):
    """Review and label sheets with a byte-order mark; the last label of a key wins, others keep the sheet's."""
    k = F.col("p_partkey")
    sheet, labels = folder(m.spark, "sheet"), folder(m.spark, "labels")
    files.write_sheet(m.table("part").select(k.alias("review_id"), F.concat(F.lit("vn:"), k).alias("pair_key"), F.lit("old").alias("review_label")), sheet, ["review_id"])
    files.write_sheet(m.table("part").filter("p_partkey % 2 = 0").withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2)))).filter("turn = 1 or p_partkey % 4 = 0").select("turn", F.concat(F.lit("vn:"), k).alias("pair_key"), F.when(F.col("turn") == 1, "first").otherwise("last").alias("review_label")), labels, ["turn", "pair_key"])
    return evaluate.join_labels(files.read_reviews(m.spark, sheet), files.read_reviews(m.spark, labels)).select("review_id", "review_label")


@query(" SELECT item_id, cost_value, cost_seed_pct, cost_source FROM (" + """SELECT p_partkey AS item_id, p_size * 100 AS cost_value, 70.0::DOUBLE AS cost_seed_pct, 'seeded_scenario' AS cost_source FROM part)""")
def seeded_costs_csv(m):
    """The sink of seeded costs, read back as a cost source."""
    path = folder(m.spark, "seeded")
    files.write_costs(m.table("part").select(F.lit("vn").alias("country_code"), F.lit(1).alias("shop_id"), F.col("p_partkey").alias("item_id"), (F.col("p_size") * 100).alias("cost_value"), F.lit(70.0).alias("cost_seed_pct"), F.lit("seeded_scenario").alias("cost_source")), path)
    return files.read_costs(m.spark, path).select("item_id", n("cost_value"), "cost_seed_pct", "cost_source")


@query("SELECT o_orderkey, o_custkey FROM orders")
def table_sink(m):
    """A table written twice holds one batch."""
    path = folder(m.spark, "table")
    for _ in range(2):
        files.write_table(m.table("orders").withColumn("country_code", F.when(F.col("o_orderkey") % 2 == 0, "vn").otherwise("id")), path)
    return m.spark.read.parquet(path).select("o_orderkey", "o_custkey")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def append_log(m):
    """A log appended in two batches; the last two messages of each session."""
    path = folder(m.spark, "log")
    rows = m.table("conversations").select("conv_id", "turn", "role")
    for k in (0, 1):
        files.append_log(rows.filter(F.col("turn") % 2 == k), path)
    return serving.recent(files.read_log(m.spark, path, rows.schema.simpleString()[7:-1].replace(":", " ")), ["conv_id"], "turn", 2)


@query("SELECT 'orders_' || o_orderstatus AS stage, 'success' AS status, count(*) AS rows, 2::BIGINT AS runs FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def run_manifest(m):
    """A run of each order status started and finished, then another; a stage whose newest run failed isn't published."""
    path, found = folder(m.spark, "runs"), m.table("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).collect()  # three rows
    day = lambda k: AT + datetime.timedelta(days=k)
    for k, (status, rows) in enumerate(found * 2):
        stage = f"orders_{status}"
        run = files.start_run(m.spark, path, stage, day(k))
        ends = "failed" if (status == "P") == (k >= len(found)) else "success"
        files.finish_run(m.spark, path, run, stage, day(k), day(k) + datetime.timedelta(hours=1), ends, str(rows))
    runs = files.manifest(m.spark.read.parquet(path))
    counts = runs.groupBy("stage").agg(F.count("*").alias("runs"))
    return serving.published(runs).join(counts, "stage").select("stage", "status", F.col("row_counts").cast("long").alias("rows"), "runs")


@query("SELECT DISTINCT sha256('row ' || n_nationkey || chr(10)) AS sha256, length('row ' || n_nationkey) + 1 AS length FROM nation")
def file_manifest(m):
    path = folder(m.spark, "digest")
    m.table("nation").select(F.concat(F.lit("row "), "n_nationkey").alias("value"), F.col("n_nationkey").alias("k")).repartition(1).write.partitionBy("k").text(path)
    return files.file_digests(m.spark, path).filter("file like 'part-%'").select("sha256", n("length")).distinct()
