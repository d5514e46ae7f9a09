"""Stages as jobs: ``spark-submit`` this package or run ``python -m erario``.

    clean  CSV TABLES            type, de-duplicate, flag; clean and analytic tables, profile
    build  TABLES WAREHOUSE      star warehouse from the clean table
    query  WAREHOUSE AXIS        largest groups of an axis (filters as name=value)
    train  TABLES MODELS         compare, choose and save both models
    score  MODELS TASK IN OUT    score a Parquet table with a saved model
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from erario.modelling.score import model_info, predict_classification, predict_regression
from erario.modelling.train import load_fitted, run_training
from erario.plans.olap import query_axis
from erario.plans.star import build_warehouse, load_warehouse, warehouse_report
from erario.plans.views import register_views
from erario.sources.raw import read_raw_csv
from erario.sources.tables import load_clean, load_modelling_frame, run_cleaning
from erario.spec import TrainConfig
from erario.store import Store


def _arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="erario", description=__doc__,
                                     formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, places in (
        ("clean", ("csv", "tables")), ("build", ("tables", "warehouse")),
        ("query", ("warehouse", "axis")), ("train", ("tables", "models")),
        ("score", ("models", "task", "rows", "out")),
    ):
        job = jobs.add_parser(name)
        for place in places:
            job.add_argument(place)
        if name == "query":
            job.add_argument("filters", nargs="*", metavar="name=value")
            job.add_argument("--limit", type=int, default=100)
        if name == "train":
            job.add_argument("--fast", action="store_true")
            job.add_argument("--sample", type=int, default=0)
    return parser.parse_args()


def main() -> None:
    args = _arguments()
    spark = SparkSession.builder.appName(f"erario-{args.job}").getOrCreate()
    if args.job == "clean":
        run_cleaning(read_raw_csv(spark, args.csv), Store(spark, args.tables))
    elif args.job == "build":
        wh = build_warehouse(load_clean(spark, Store(spark, args.tables)), Store(spark, args.warehouse))
        warehouse_report(wh, len(register_views(spark, wh))).show(truncate=False)
    elif args.job == "query":
        filters = dict(f.split("=", 1) for f in args.filters)
        wh = load_warehouse(spark, Store(spark, args.warehouse))
        query_axis(wh, args.axis, filters, args.limit).data.show(args.limit, truncate=False)
    elif args.job == "train":
        rows = load_modelling_frame(spark, Store(spark, args.tables))
        cfg = TrainConfig(fast=args.fast, sample_size=args.sample)
        out = Store(spark, args.models)
        run_training(rows, cfg, rows.columns, out)
        model_info(spark, out).show(200, truncate=False)
    else:
        fitted = load_fitted(spark, Store(spark, args.models), args.task)
        predict = predict_regression if args.task == "regression" else predict_classification
        predict(fitted, spark.read.parquet(args.rows)).write.mode("overwrite").parquet(args.out)
    spark.stop()


if __name__ == "__main__":
    main()
