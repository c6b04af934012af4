"""Wide rows fetched late: winners are found on narrow rows, and only what may be a winner's row moves.

A scan is thinned by a bit filter of the wanted values: words of 64 bits, built by an aggregate and broadcast. It has FILTER_BITS
bits at most, whatever the data; more values than that make it less selective, never wrong, because the exact join follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most a million words of 64 bits.
FILTER_BITS = 1 << 26


def possible(frame: DataFrame, value: Column, wanted: DataFrame, wanted_value: Column, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of frame whose 64-bit value is among the wanted ones, and a few others. No row is moved."""
    spots = wanted.select(F.pmod(wanted_value, F.lit(bits)).alias("_spot"))
    words = spots.groupBy(F.expr("_spot div 64").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_spot % 64 as int))")).alias("_bits"))
    spot = frame.withColumn("_at", F.pmod(value, F.lit(bits)))
    near = spot.join(F.broadcast(words), F.expr("_at div 64") == F.col("_word"))
    return near.filter("shiftright(_bits, cast(_at % 64 as int)) & 1 = 1").select(*[F.col(f"`{c}`") for c in frame.columns])


def content_hash(columns: list[str]) -> Column:
    """A hash of the row that tells a null from a missing neighbour."""
    quoted = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(*quoted, F.concat(*[c.isNull().cast("string") for c in quoted]))
