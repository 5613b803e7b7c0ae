"""Command line for the jobs: ``python -m merchlake JOB --lake PATH [--once]``."""

from __future__ import annotations

import argparse
import json

from merchlake.operators import quality
from merchlake.operators.dead_letters import dead_letter_rows
from merchlake.plans import gold, hours, serving
from merchlake.session import ROCKSDB, build_session
from merchlake.sources import kafka, landing
from merchlake.streaming import jobs


def _schema_ids(text: str) -> dict[int, str]:
    return {int(number): name for number, name in json.loads(text).items()}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="merchlake")
    parser.add_argument(
        "job", choices=["bronze", "silver", "gold", "compact", "rebuild", "refresh", "quality", "reconcile", "last24h"]
    )
    parser.add_argument("--lake", required=True, help="root folder of all tables")
    parser.add_argument("--kafka", help="bootstrap servers, for bronze and for dead letters")
    parser.add_argument("--records", help="folder of Kafka-shaped files to read instead of a broker")
    parser.add_argument("--schema-ids", type=_schema_ids, default={}, help='e.g. {"2": "orders_v11"}')
    parser.add_argument("--max-files", type=int, default=1000, help="files per micro-batch")
    parser.add_argument(
        "--late-after",
        choices=["batch", "completed"],
        default="completed",
        help="whose newest event makes a row late: its own batch's, or that of completed batches",
    )
    parser.add_argument("--allow-data-loss", action="store_true", help="go on where the broker has dropped offsets")
    parser.add_argument("--once", action="store_true", help="drain what is there and stop")
    args = parser.parse_args(argv)

    spark = build_session(
        f"merchlake-{args.job}", spark__sql__streaming__stateStore__providerClass=ROCKSDB
    )
    lake, serve = args.lake.rstrip("/"), args.lake.rstrip("/") + "/gold"
    query = None
    if args.job == "bronze":
        source = (
            landing.record_files(spark, args.records, args.max_files)
            if args.records
            else kafka.kafka_stream(spark, args.kafka, fail_on_loss=not args.allow_data_loss)
        )
        query = jobs.run(jobs.bronze_writer(source, lake), args.once, jobs.BRONZE_INTERVAL)
    elif args.job == "silver":
        source = landing.bronze_stream(spark, f"{lake}/bronze", args.max_files)
        writer = jobs.silver_writer(source, lake, writers=args.schema_ids, dlq_servers=args.kafka, late_after=args.late_after)
        query = jobs.run(writer, args.once, jobs.SILVER_INTERVAL)
    elif args.job == "gold":
        source = landing.silver_stream(spark, f"{lake}/silver", args.max_files)
        query = jobs.run(jobs.gold_writer(source, lake), args.once, jobs.GOLD_INTERVAL)
    elif args.job == "compact":
        for table in serving.SERVING_SCHEMAS:
            serving.compact(spark, serve, table)
    elif args.job == "rebuild":
        gold.rebuild_gold(spark, serve)
    elif args.job == "refresh":
        for table in hours.SOURCES:
            hours.refresh_hours(spark, serve, table)
    elif args.job == "last24h":
        # 25 hour marks at most, times the currencies.
        report = gold.gmv_last_24h(spark, serve).persist()
        report.show(report.count(), truncate=False)
    else:
        from pyspark.sql import functions as F

        facts = serving.read_table(spark, serve, "fact_orders")
        if args.job == "quality":
            report = quality.quality_report(
                facts,
                serving.read_table(spark, serve, "gold_hourly_gmv"),
                serving.read_table(spark, serve, "gold_payment_stats"),
                serving.read_table(spark, serve, "pipeline_watermarks"),
                F.current_timestamp(),
            )
            report.show(truncate=False)
            quality.quality_gate(report)
        else:
            report = quality.reconcile(
                facts,
                serving.read_table(spark, serve, "fact_payments"),
                dead_letter_rows(landing.quarantine_table(spark, f"{lake}/quarantine")),
            )
            report.show(truncate=False)
            quality.reconcile_gate(report)
    if query is not None and not args.once:
        query.awaitTermination()


if __name__ == "__main__":
    main()
