"""Batch entry points: each stage run publishes its tables, and exports sheets for people.

``python -m skuscope.plans.jobs STAGE --warehouse DIR ...``: ingest, match, signals, costs,
recommend, evaluate, clean. A stage reads the versions that stand when it starts, and the
reads of operators.reads are gated on the newest run of each stage.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import evaluate, matching, recommend, signals, snapshots
from ..operators.reads import Reads
from ..sources import files
from ..sources.versions import Pin, Warehouse, blooms, clustered

LABELS = {"review_label": "", "review_notes": "", "annotator": ""}


def _country(df: DataFrame) -> str | None:
    return "country_code" if "country_code" in df.columns else None


def sheet(df: DataFrame, path: str, order: list, size: int) -> int:
    """The first ``size`` rows in ``order``, numbered, with empty columns for a reviewer, as one CSV file."""
    first = df.orderBy(*order).limit(size)
    number = F.row_number().over(Window.orderBy(*order)).alias("review_id")  # at most ``size`` rows
    held = first.select(number, *df.columns, *[F.lit(v).alias(c) for c, v in LABELS.items() if c not in df.columns])
    files.write_sheet(held, path, ["review_id"], size)
    return min(size, first.count())


# --------------------------------------------------------------------------- stages
def ingest(warehouse: Warehouse, data_dir: str) -> dict:
    """Products and the other datasets, change events, quality counters."""
    spark, ids, given, reports = warehouse.spark, {}, {"data_dir": data_dir}, []
    files.check_paths(spark, data_dir)
    for dataset, (keys, _) in files.DATASETS.items():
        rows, counters = files.counted_load(spark, data_dir, dataset)
        near = clustered(*[k for k in keys if k != "snapshot_date"])
        ids[dataset] = warehouse.publish(dataset, lambda pin, rows=rows: rows, "country_code", given, near, blooms(*[k for k in keys if k.endswith("_id")]), counters)
        reports.append(files.report_row(dataset, warehouse.rows_of(ids[dataset])))
    ids["promotion_events"] = warehouse.publish("promotion_events", lambda pin: snapshots.change_events(pin.read("products")), "country_code", given)
    ids["data_foundation"] = warehouse.publish("data_foundation", lambda pin: spark.createDataFrame(reports, files.REPORT), None, given)
    return _rows(warehouse, ids)


def match(warehouse: Warehouse, registry: str, top_k: int = 10, min_score: float = 0.60, review_size: int = 100, review_file: str | None = None) -> dict:
    """Attributes of the newest products, ranked matches, and a stratified review sheet."""
    spark, given = warehouse.spark, {"registry": registry, "top_k": top_k, "min_score": min_score}

    def attributes(pin: Pin) -> DataFrame:
        newest = snapshots.latest(pin.read("products")).withColumn("tier_variation_options_json", F.col("tier_variation_options"))
        return parse.with_attributes(snapshots.resolve_entities(newest, files.read_registry(spark, registry)))

    ids = {"product_attributes": warehouse.publish("product_attributes", attributes, "country_code", given, clustered("country_code", "shop_id", "item_id"))}
    ids["product_matching"] = warehouse.publish("product_matching", lambda pin: matching.match_offers(pin.read("product_attributes"), top_k, min_score), "country_code", given)
    out = _rows(warehouse, ids)
    if review_file:
        pin = warehouse.pin()
        sample = matching.review_sheet(matching.review_sample(pin.read("product_matching"), review_size), pin.read("product_attributes"))
        sample = sample.withColumn("matching_features", F.to_json("matching_features"))
        files.write_sheet(sample, review_file, ["review_id"], review_size)
    return out


def build_signals(warehouse: Warehouse, min_peer_score: float = 0.60, review_file: str | None = None, review_size: int = 20) -> dict:
    """Peer groups, market signals and alerts, and a sheet of the first alerts."""
    given = {"min_peer_score": min_peer_score}
    ids = {"peer_groups": warehouse.publish("peer_groups", lambda pin: signals.peer_groups(pin.read("product_matching"), min_peer_score), "country_code", given)}
    tables = lambda pin: (pin.read("products"), pin.read("product_attributes"), pin.read("peer_groups"), pin.read("promotion_events"))
    ids["market_signals"] = warehouse.publish("market_signals", lambda pin: signals.market_signals(*tables(pin)), "country_code", given, clustered("country_code", "source_shop_id", "source_item_id"))
    ids["competitor_alerts"] = warehouse.publish("competitor_alerts", lambda pin: signals.alerts(pin.read("market_signals"), pin.read("peer_groups"), pin.read("promotion_events")), "country_code", given)
    out = _rows(warehouse, ids)
    if review_file:
        shown = ["country_code", "snapshot_date", "source_shop_id", "source_item_id", "alert_type", "severity", "metric_name", "metric_value", "threshold", "target_shop_id", "target_item_id", "evidence"]
        rows = warehouse.pin().read("competitor_alerts").select(*shown)
        out["review_rows"] = sheet(rows, review_file, [F.desc("snapshot_date"), F.desc("severity"), "alert_type", "source_item_id", "source_shop_id", "metric_name"], review_size)
    return out


def seed(warehouse: Warehouse, output: str, company_id: str, margin_min_pct: float = 15.0) -> dict:
    """Cost scenarios of one company's offers."""
    pin = warehouse.pin()
    own = pin.read("product_attributes").filter(F.col("company_id") == company_id)
    files.write_costs(recommend.seed_costs(pin.read("market_signals"), own, margin_min_pct), output)
    return {"output": output}


def advise(warehouse: Warehouse, cost_file: str | None = None, shop_id: int | None = None, review_file: str | None = None, review_size: int = 20) -> dict:
    """Recommendation cards of all offers, or of one shop's, and a sheet of the first of them."""
    spark, given = warehouse.spark, {"cost_file": cost_file, "shop_id": shop_id}

    def cards(pin: Pin) -> DataFrame:
        held = pin.read("market_signals")
        held = held.filter(F.col("source_shop_id") == shop_id) if shop_id is not None else held
        costs = files.read_costs(spark, cost_file) if cost_file else None  # checked by recommendations
        return recommend.recommendations(held, pin.read("peer_groups"), costs)

    out = _rows(warehouse, {"recommendations": warehouse.publish("recommendations", cards, "country_code", given)})
    if review_file:
        shown = ["country_code", "snapshot_date", "source_shop_id", "source_item_id", "action", "recommendation_status", "priority", "confidence", "recommended_price", "recommended_discount_percent", "recommendation_text", "evidence"]
        rows = warehouse.pin().read("recommendations").select(*shown)
        out["review_rows"] = sheet(rows, review_file, [F.desc("priority"), "recommendation_status", "country_code", "source_item_id", "source_shop_id"], review_size)
    return out


def evaluation(spark: SparkSession, review_file: str, labels_file: str) -> dict:
    """Confusion, class scores and precision of labelled review sheets."""
    joined = evaluate.join_labels(files.read_reviews(spark, review_file), files.read_reviews(spark, labels_file))
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  a row a class or stratum
    return {"classes": rows(evaluate.class_scores(joined, "review_label", "match_type")), "strata": rows(evaluate.strata(joined))}


def _rows(warehouse: Warehouse, ids: dict[str, str]) -> dict:
    return {"runs": ids, "rows": {stage: warehouse.rows_of(run)[stage] for stage, run in ids.items()}}


#: What readers name differently from the stages.
READ = {"products": "products", "attributes": "product_attributes", "peers": "peer_groups", "signals": "market_signals", "alerts": "competitor_alerts", "recommendations": "recommendations"}


def gated_reads(warehouse: Warehouse, scopes: list[tuple[str, int]] | None = None) -> Reads:
    """Reads of one moment's versions; a stage whose newest run hasn't succeeded refuses to be read."""
    pin = warehouse.pin()
    return Reads({name: pin.read(stage) for name, stage in READ.items() if stage in pin.versions}, scopes, warehouse.runs())


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("stage", choices=["ingest", "match", "signals", "costs", "recommend", "evaluate", "clean"])
    parser.add_argument("--warehouse")
    parser.add_argument("--data-dir")
    parser.add_argument("--registry")
    parser.add_argument("--top-k", type=int, default=10)
    parser.add_argument("--min-score", type=float, default=0.60)
    parser.add_argument("--min-peer-score", type=float, default=0.60)
    parser.add_argument("--review-size", type=int)
    parser.add_argument("--review-file")
    parser.add_argument("--labels-file")
    parser.add_argument("--cost-file")
    parser.add_argument("--shop-id", type=int)
    parser.add_argument("--company-id")
    parser.add_argument("--margin-min-pct", type=float, default=15.0)
    parser.add_argument("--output")
    parser.add_argument("--keep", type=int, default=2)
    a = parser.parse_args(args)
    needs = {"ingest": ["warehouse", "data_dir"], "match": ["warehouse", "registry"], "costs": ["warehouse", "output", "company_id"], "evaluate": ["review_file", "labels_file"]}
    for name in needs.get(a.stage, ["warehouse"]):
        if getattr(a, name) is None:
            parser.error(f"{a.stage} needs --{name.replace('_', '-')}")
    spark = spark or SparkSession.builder.getOrCreate()
    w = Warehouse(spark, a.warehouse) if a.warehouse else None
    run = {
        "ingest": lambda: ingest(w, a.data_dir), "match": lambda: match(w, a.registry, a.top_k, a.min_score, a.review_size or 100, a.review_file),
        "signals": lambda: build_signals(w, a.min_peer_score, a.review_file, a.review_size or 20), "costs": lambda: seed(w, a.output, a.company_id, a.margin_min_pct),
        "recommend": lambda: advise(w, a.cost_file, a.shop_id, a.review_file, a.review_size or 20), "evaluate": lambda: evaluation(spark, a.review_file, a.labels_file),
        "clean": lambda: {"deleted": w.collect(a.keep)},
    }
    out = run[a.stage]()
    print(json.dumps(out, ensure_ascii=False, indent=2, default=str))
    return out


if __name__ == "__main__":
    main()
