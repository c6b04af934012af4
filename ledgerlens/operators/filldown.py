"""Fill-down of blank cells, as left behind by merged worksheet cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import blank_to_null

BLOCK_ROWS = 100_000


def fill_down(
    rows: DataFrame,
    columns: list[str],
    order: str,
    source: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every column on its own inherits the last non-blank value above it inside its source; '' before the first.

    Rows are windowed in blocks of `block_rows` consecutive positions, and a second, tiny window carries each block's
    last values into the blocks below. One huge source is thus spread over as many tasks as it has blocks.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(order) / F.lit(block_rows)))
    inside = Window.partitionBy(source, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = blocked.select(
        *[F.col(c) for c in blocked.columns if c not in columns],
        *[F.last(blank_to_null(F.col(c)), ignorenulls=True).over(inside).alias(c) for c in columns],
    )

    latest = blocked.groupBy(source, "_block").agg(
        *[F.max_by(blank_to_null(F.col(c)), F.when(F.col(c) != "", F.col(order))).alias(c) for c in columns]
    )
    above = Window.partitionBy(source).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select(
        source,
        "_block",
        *[F.last(c, ignorenulls=True).over(above).alias(f"_carried_{c}") for c in columns],
    )
    joined = filled.join(carried, [source, "_block"], "left")
    return joined.select(
        *[
            F.coalesce(F.col(c), F.col(f"_carried_{c}"), F.lit("")).alias(c) if c in columns else F.col(c)
            for c in rows.columns
        ]
    )
