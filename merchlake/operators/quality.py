"""Quality expectations and reconciliation as one-row reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.contracts import MAX_FAILURE_RATE, MAX_UNPAID_RATIO, MAX_WATERMARK_AGE_S
from merchlake.functions.scalars import age_seconds
from merchlake.operators.joins import count_unpaid


class QualityFailure(RuntimeError):
    """A gate found a failed expectation."""


@dataclass(frozen=True)
class Expectation:
    """A rule on one number of one table."""

    name: str
    table: str
    number: Column
    passes: Callable[[Column], Column]
    expected: str


def expectations(as_of: Column) -> list[Expectation]:
    """The declared rules, in the order of the report. A table that gives no number breaks no bound."""
    gold = F.when(F.col("job_name") == "gold", age_seconds(as_of, F.col("updated_at")))
    ids = F.count_distinct("event_id") / F.count("*")

    def no_more_than(bound: float) -> Callable[[Column], Column]:
        return lambda number: number.isNull() | (number <= bound)

    return [
        Expectation("gold_not_empty", "facts", F.count("*"), lambda n: n > 0, "> 0"),
        Expectation("fact_orders_unique_event_id", "facts", F.when(F.count("*") == 0, 1.0).otherwise(ids), lambda n: n == 1.0, "== 1.0"),
        Expectation("gmv_non_negative", "gmv", F.min("gmv_cents"), lambda n: n.isNull() | (n >= 0), ">= 0"),
        Expectation(
            "payment_failure_rate_bounded", "stats", F.max("failure_rate"), no_more_than(MAX_FAILURE_RATE), f"<= {MAX_FAILURE_RATE:g}"
        ),
        Expectation("gold_watermark_fresh", "watermarks", F.max(gold), no_more_than(MAX_WATERMARK_AGE_S), f"<= {MAX_WATERMARK_AGE_S:g}s"),
    ]


def evaluate(rules: list[Expectation], tables: dict[str, DataFrame]) -> DataFrame:
    """One row per rule: name, passed, actual, expected, detail. Each table is aggregated once, for all its rules."""
    spark = next(iter(tables.values())).sparkSession
    used = list(dict.fromkeys(rule.table for rule in rules))
    numbers = {
        name: tables[name].agg(F.struct(*(r.number.cast("double").alias(r.name) for r in rules if r.table == name)))
        for name in used
    }
    found = spark.range(1).select(*(one.scalar().alias(name) for name, one in numbers.items()))
    rows = [
        F.struct(
            F.lit(rule.name).alias("name"),
            rule.passes(F.col(rule.table)[rule.name]).alias("passed"),
            F.col(rule.table)[rule.name].alias("actual"),
            F.lit(rule.expected).alias("expected"),
            F.lit("").alias("detail"),
        )
        for rule in rules
    ]
    return found.select(F.inline(F.array(*rows)))


def key_uniqueness(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.count("*").alias("row_count"), F.count_distinct("event_id").alias("distinct_ids")
    )


def quality_report(
    facts: DataFrame, gmv: DataFrame, stats: DataFrame, watermarks: DataFrame, as_of: Column
) -> DataFrame:
    """The declared rules over the serving tables."""
    return evaluate(expectations(as_of), {"facts": facts, "gmv": gmv, "stats": stats, "watermarks": watermarks})


def quality_summary(report: DataFrame) -> DataFrame:
    """One row: did everything pass, the names of what did not, and every result, by name."""
    failed = F.collect_list(F.when(~F.col("passed"), F.col("name")))
    results = F.collect_list(F.struct("name", "passed", "actual", "expected", "detail"))
    return report.agg(
        F.every("passed").alias("passed"),
        F.array_sort(failed).alias("failed"),
        F.array_sort(results).alias("results"),
    )


def quality_gate(report: DataFrame, skip_empty: bool = True) -> bool:
    """Raise when an expectation failed; with no facts at all there is nothing to judge."""
    summary = quality_summary(report).first()
    if skip_empty and "gold_not_empty" in summary["failed"]:
        return False
    if not summary["passed"]:
        raise QualityFailure(f"quality failed: {summary['failed']}")
    return True


def reconcile(
    facts: DataFrame,
    payments: DataFrame,
    dead_letters: DataFrame,
    max_ratio: float = MAX_UNPAID_RATIO,
) -> DataFrame:
    """One row of counts, with the unpaid share over all order facts and its verdict."""
    def rows(df: DataFrame) -> Column:
        return df.agg(F.count("*")).scalar()

    counts = facts.sparkSession.range(1).select(
        rows(facts).alias("fact_orders"),
        rows(payments).alias("fact_payments"),
        count_unpaid(facts, payments).scalar().alias("unpaid_non_cancelled"),
        rows(dead_letters).alias("dead_letters"),
    )
    ratio = F.when(F.col("fact_orders") > 0, F.col("unpaid_non_cancelled") / F.col("fact_orders"))
    return counts.withColumn("unpaid_ratio_all_orders", F.coalesce(ratio, F.lit(0.0))).withColumn(
        "passed", F.col("unpaid_ratio_all_orders") <= max_ratio
    )


def reconcile_gate(report: DataFrame) -> None:
    row = report.first()
    if not row["passed"]:
        raise QualityFailure(
            f"{row['unpaid_non_cancelled']} of {row['fact_orders']} orders have no payment event"
        )
