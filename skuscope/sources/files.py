"""File sources and sinks: partitioned CSV snapshots, registries, costs, reviews, logs, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean
from ..operators.snapshots import first_wins, quality

BOM = "\ufeff"
_empty_list = lambda c: clean.json_text(c, "[]")
#: Datasets: natural key, and each column's cast (the CSV column's name differs where a pair is given).
DATASETS: dict[str, tuple[list[str], dict]] = {
    "products": (["country_code", "shop_id", "item_id", "snapshot_date"], {
        "platform": clean.scalar, "shop_slug": clean.scalar, "shop_name": clean.scalar, "location": clean.scalar, "item_id": clean.integer, "product_name": clean.scalar,
        "product_name_normalized": ("product_name", clean.normalized_name), "url": clean.scalar, "image_url": clean.scalar, "images": _empty_list, "seller_flag": _empty_list, "seller_flag_hash": _empty_list,
        "image_overlay": clean.scalar, "image_overlay_hash": clean.scalar, "is_ad": clean.boolean, "is_sold_out": clean.boolean, "shopee_verified": clean.boolean, "ctime": clean.epoch_timestamp,
        "price": clean.integer, "price_original": clean.integer, "price_before_promo": clean.integer, "discount_percent": clean.number, "promotion_id": clean.scalar, "voucher_code": clean.scalar,
        "voucher_discount": clean.number, "voucher_start_time": clean.epoch_timestamp, "voucher_end_time": clean.epoch_timestamp, "voucher_min_spend": clean.number, "history_sold_value": clean.number,
        "monthly_sold_value": clean.number, "rating": clean.number, "rating_count": clean.integer, "rating_count_detail": _empty_list, "vouchers": _empty_list, "brand": clean.scalar, "brand_id": clean.scalar,
        "catid": clean.integer, "global_catids": _empty_list, "liked_count": clean.integer, "tier_variation_name": clean.scalar, "tier_variation_options": _empty_list,
    }),
    "shop_info": (["country_code", "shop_id", "snapshot_date"], {
        "shop_name": clean.scalar, "username": clean.scalar, "rating_star": clean.number, "follower_count": clean.integer, "item_count": clean.integer, "is_official_shop": clean.boolean,
        "response_rate": clean.number, "response_time": clean.number, "rating_good": clean.integer, "rating_normal": clean.integer, "rating_bad": clean.integer, "cancellation_rate": clean.number,
        "created_at": ("created_at", lambda c: clean.scalar(c).try_cast("timestamp")), "vacation": clean.boolean,
    }),
    "category_list": (["country_code", "shop_id", "shop_category_id", "snapshot_date"], {
        "shop_category_id": clean.integer, "display_name": clean.scalar, "total": clean.integer, "is_parent_category": clean.boolean, "is_sub_category": clean.boolean,
        "parent_shop_category_id": clean.integer, "image": clean.scalar, "category_type": clean.scalar,
    }),
    "product_categories": (["country_code", "shop_id", "item_id", "category_id", "snapshot_date"], {"item_id": clean.integer, "category_slug": clean.scalar, "category_id": clean.integer}),
    "category_platform": (["country_code", "category_id"], {
        "platform": clean.scalar, "client": clean.scalar, "category_key": ("key", clean.scalar), "category_id": clean.integer, "parent_category_id": clean.integer, "original_category_name": clean.scalar,
        "display_category_name": clean.scalar, "has_children": clean.boolean, "debug_message": clean.scalar,
    }),
}


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Header-driven, all text, quoted line ends allowed; a byte-order mark is dropped from the header."""
    df = spark.read.options(header=True, multiLine=True, escape='"', **options).csv(path)
    return df.toDF(*[c.removeprefix(BOM).strip() for c in df.columns])


def check_paths(spark: SparkSession, root: str) -> None:
    """Every CSV file below ``root`` must name its country and a known dataset; only names are read."""
    names = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.csv").load(root).select("path")
    known = F.regexp_extract("path", r"dataset=([^/]+)", 1).isin(list(DATASETS)) & (F.regexp_extract("path", r"country_code=([^/]+)", 1) != "")
    for (path,) in names.filter(~known).limit(1).collect():
        raise ValueError(f"cannot infer country and dataset from {path}")


def read_snapshots(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """One dataset below ``country_code=/dataset=/shop_id=``; directory keys, source_file and row number added."""
    if dataset not in DATASETS:
        raise ValueError(f"unknown dataset {dataset}")
    df = read_csv(spark, f"{root}/country_code=*/dataset={dataset}", recursiveFileLookup=True, pathGlobFilter="*.csv")
    df = df.withColumn("source_file", F.col("_metadata.file_path")).withColumn("source_row", F.monotonically_increasing_id())
    return df.withColumns({
        "partition_country": F.regexp_extract("source_file", r"country_code=([^/]+)", 1),
        "partition_shop": F.nullif(F.regexp_extract("source_file", r"shop_id=(\d+)", 1), F.lit("")).cast("bigint"),
    })


def typed(raw: DataFrame, dataset: str) -> DataFrame:
    """Casts of a dataset's columns; a row without a date fails the job (the platform taxonomy has none)."""
    keys, columns = DATASETS[dataset]
    given = lambda n: F.col(n) if n in raw.columns else F.lit(None).cast("string")
    out: dict[str, Column] = {"country_code": F.col("partition_country")}
    if "snapshot_date" in keys:
        day = F.to_date(clean.scalar(given("date")))
        missing = F.raise_error(F.concat(F.lit("missing date in "), F.col("source_file"))).cast("date")
        out["snapshot_date"] = F.when(day.isNotNull(), day).otherwise(missing)
        out["shop_id"] = clean.shop_or_partition(clean.integer(given("shop_id")), F.col("partition_shop"))
    if dataset == "products":
        out["currency"] = clean.currency(F.col("partition_country"))
    for name, cast in columns.items():
        source, cast = cast if isinstance(cast, tuple) else (name, cast)
        out[name] = cast(given(source))
    return raw.select(*[c.alias(n) for n, c in out.items()], "source_file", "source_row")


def load(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """The typed rows of a dataset, the first of each natural key by path and row."""
    rows = typed(read_snapshots(spark, root, dataset), dataset)
    return first_wins(rows, DATASETS[dataset][0], ["source_file", "source_row"]).drop("source_row")


def counted_load(spark: SparkSession, root: str, dataset: str) -> tuple[DataFrame, dict[str, Column]]:
    """The rows of ``load``, and counters to aggregate over them while they are written: one scan gives both.

    Each row carries the number of source rows of its key, so the counters need no second read.
    """
    keys, _ = DATASETS[dataset]
    rows, w = typed(read_snapshots(spark, root, dataset), dataset), Window.partitionBy(*keys)
    held = rows.withColumns({"__n": F.count(F.lit(1)).over(w), "__rn": F.row_number().over(w.orderBy("source_file", "source_row"))}).filter("__rn = 1")
    counters = {"source_rows": F.coalesce(F.sum("__n"), F.lit(0))}
    if dataset == "products":
        price = F.col("price")
        counters |= {"null_price_rows": F.count_if(price.isNull()), "invalid_price_rows": F.count_if(price <= 0), "outlier_price_rows": F.count_if(price >= 10_000_000)}
    return held.drop("source_row"), counters


def report_row(dataset: str, counted: dict) -> tuple:
    """A row of ``REPORT`` from a dataset's loaded rows and counters."""
    source, loaded = counted["source_rows"], counted[dataset]
    return (dataset, source, loaded, source - loaded, *[counted.get(c) for c in ("null_price_rows", "invalid_price_rows", "outlier_price_rows")])


REPORT = "dataset string, source_rows long, loaded_rows long, duplicate_rows long, null_price_rows long, invalid_price_rows long, outlier_price_rows long"


def ingestion_report(spark: SparkSession, root: str) -> DataFrame:
    """Source, loaded and duplicate rows of each dataset, and the price counters of products."""
    out = None
    for dataset, (keys, _) in DATASETS.items():
        rows = typed(read_snapshots(spark, root, dataset), dataset).withColumn("dataset", F.lit(dataset))
        if "price" not in rows.columns:
            rows = rows.withColumn("price", F.lit(None).cast("double"))
        one = quality(rows, keys, ["source_file", "source_row"])
        if dataset != "products":
            one = one.withColumns({c: F.lit(None).cast("long") for c in ("null_price_rows", "invalid_price_rows", "outlier_price_rows")})
        out = one if out is None else out.unionByName(one)
    return out


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path)
    missing = {"country_code", "shop_id", "company_id", "company_name", "seller_entity_id", "seller_entity_name"} - set(df.columns)
    if missing:
        raise ValueError(f"the registry lacks {', '.join(sorted(missing))}")
    return df.select(F.lower(clean.scalar(F.col("country_code"))).alias("country_code"), clean.integer(F.col("shop_id")).alias("shop_id"), *[clean.scalar(F.col(c)).alias(c) for c in ("company_id", "company_name", "seller_entity_id", "seller_entity_name")])


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    """Costs in file order (row_number), for recommend.checked_costs."""
    df = read_csv(spark, path)
    text = lambda n: clean.scalar(F.col(n)) if n in df.columns else F.lit(None).cast("string")
    numbers = ("cost_value", "margin_min_pct", "cost_low", "cost_high", "cost_seed_pct", "cost_reference_price")
    return df.select(
        F.lower(text("country_code")).alias("country_code"), clean.integer(text("shop_id")).alias("shop_id"), clean.integer(text("item_id")).alias("item_id"),
        *[clean.number(text(c)).alias(c) for c in numbers], *[text(c).alias(c) for c in ("cost_source", "cost_confidence", "baseline_type")], F.monotonically_increasing_id().alias("row_number"),
    )


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Review or label sheets: keys, ranks and scores typed, blank labels null, file order as row_number."""
    df = read_csv(spark, path)
    whole = [c for c in ("review_id", "rank", "source_shop_id", "source_item_id", "target_shop_id", "target_item_id") if c in df.columns]
    df = df.withColumns({c: clean.scalar(F.col(c)) for c in df.columns}).withColumns({c: clean.integer(F.col(c)) for c in whole})
    if "match_score" in df.columns:
        df = df.withColumn("match_score", clean.number(F.col("match_score")))
    return df.withColumn("row_number", F.monotonically_increasing_id())


def write_table(df: DataFrame, path: str, partition: str | None = "country_code") -> None:
    """Idempotent batch: the table is replaced."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition and partition in df.columns else writer).parquet(path)


def write_sheet(df: DataFrame, path: str, order: list, rows: int | None = None, columns: list[str] | None = None) -> None:
    """A sheet for people (its first ``rows``) as one CSV file that starts with a byte-order mark (carried by the first header)."""
    held = df.orderBy(*order)
    held = (held.limit(rows) if rows else held).select(*(columns or df.columns))
    held = held.withColumnRenamed(held.columns[0], BOM + held.columns[0])
    held.coalesce(1).write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_costs(df: DataFrame, path: str) -> None:
    """Seeded costs as a CSV folder in key order."""
    df.orderBy("country_code", "shop_id", "item_id").write.mode("overwrite").options(header=True, escape='"').csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Messages, memories, traces and run manifests are append-only."""
    df.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


RUNS = "run_id string, stage string, status string, started_at timestamp, finished_at timestamp, metadata string, row_counts string, error_message string"


def start_run(spark: SparkSession, path: str, stage: str, at, metadata: str = "{}") -> str:
    """Appends a running entry to the manifest; its end is another entry of the same run_id."""
    run_id = f"{stage}-{uuid.uuid4().hex[:12]}"
    append_log(spark.createDataFrame([(run_id, stage, "running", at, None, metadata, None, None)], RUNS), path)
    return run_id


def finish_run(spark: SparkSession, path: str, run_id: str, stage: str, started_at, at, status: str, row_counts: str = "{}", error: str | None = None) -> None:
    if status not in ("success", "failed"):
        raise ValueError("a run ends in success or failed")
    append_log(spark.createDataFrame([(run_id, stage, status, started_at, at, None, row_counts, error)], RUNS), path)


def manifest(log: DataFrame) -> DataFrame:
    """One row a run: its last entry, with the metadata of its first."""
    last = F.max_by(F.struct("stage", "status", "started_at", "finished_at", "row_counts", "error_message"), F.coalesce("finished_at", F.to_timestamp(F.lit("1970-01-01")))).alias("x")
    return log.groupBy("run_id").agg(last, F.max("metadata").alias("metadata")).select("run_id", "x.*", "metadata")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))
