"""Counts per person and progress counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import constants as K

_COUNTS = ["entered", "complete", "correct", "wrong", "doubtful", "undecided"]


def percent(part: Column, whole: Column) -> Column:
    """Whole per cent, halves to the even neighbour; '0%' without a denominator."""
    share = F.bround(part / F.when(whole > 0, whole) * 100, 0).cast("int").cast("string")
    return F.concat(F.coalesce(share, F.lit("0")), F.lit("%"))


def person_summary(detail: DataFrame) -> DataFrame:
    """Quality figures per person; `first_source`, `first_row` give the order of first appearance.

    Counting happens map-side first and per source second, so one person with most of the rows is no hot spot.
    """
    status = F.col("status")
    per_source = detail.groupBy("employee_name", "source_id").agg(
        F.count("*").alias("entered"),
        F.count_if(status != K.INCOMPLETE).alias("complete"),
        F.count_if(status == K.CORRECT).alias("correct"),
        F.count_if(status == K.WRONG).alias("wrong"),
        F.count_if(status == K.DOUBTFUL).alias("doubtful"),
        F.count_if(status == K.UNDECIDED).alias("undecided"),
        F.min("row_number").alias("first_row"),
    )
    people = per_source.groupBy("employee_name").agg(
        *[F.sum(c).alias(c) for c in _COUNTS],
        F.min(F.struct("source_id", "first_row")).alias("first"),
    )
    return people.select(
        "employee_name",
        *_COUNTS,
        percent(F.col("correct"), F.col("correct") + F.col("wrong")).alias("accuracy"),
        F.col("first.source_id").alias("first_source"),
        F.col("first.first_row").alias("first_row"),
    )


def review_steps(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(step_ord, step, n) of a run. `keys` (see lookup_keys) already counts the entries, so they are read once.

    Every entry gets exactly one verdict, so the reviewed count is the entry count.
    """
    counted = keys.agg(
        F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.count("*").alias("companies")
    ).select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(order).alias("step_ord"), F.lit(step).alias("step"), value.cast("bigint").alias("n"))
                    for order, step, value in [
                        (1, K.STEP_ENTRIES, F.col("entries")),
                        (3, K.STEP_COMPANIES, F.col("companies")),
                        (4, K.STEP_REVIEWED, F.col("entries")),
                        (5, K.STEP_SUMMARY, F.lit(None)),
                        (6, K.STEP_EXPORT, F.lit(None)),
                    ]
                ]
            )
        ).alias("line")
    ).select("line.*")
    rule_line = rules.agg(F.count("*").alias("n")).select(
        F.lit(2).alias("step_ord"), F.lit(K.STEP_RULES).alias("step"), "n"
    )
    lines = counted.unionByName(rule_line)
    shown = F.when(F.col("n").isNull(), F.col("step")).otherwise(
        F.replace("step", F.lit("{n}"), F.col("n").cast("string"))
    )
    return lines.select("step_ord", shown.alias("step"), "n")
