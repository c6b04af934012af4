"""Left join that stays balanced when a few keys hold most of the left rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is cut into pieces of about this many left rows ...
PIECE_ROWS = 200_000
# ... into no more than this many, so that one right row is never copied without end.
MAX_PIECES = 10_000
# Only the largest keys are cut; the list of their hashes is what gets broadcast. A key beyond the list is smaller than each of
# these, so it has less than rows / MAX_HOT_KEYS rows.
MAX_HOT_KEYS = 20_000


def key_counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) per non-null key; counted before the shuffle as well, so a hot key costs one row per task."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def hot_keys(counts: DataFrame, key: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(_hash, _pieces) of the keys too large for one task: at most MAX_HOT_KEYS rows of two numbers, whatever the keys' length.

    Keys beyond the list are joined unsplit: such a key has at most max(piece_rows, all rows / MAX_HOT_KEYS) rows. Keys
    whose hashes are equal are cut alike on both sides.
    """
    large = counts.filter(F.col("n") > piece_rows).orderBy(F.desc("n")).limit(MAX_HOT_KEYS)
    pieces = F.least(F.ceil(F.col("n") / F.lit(piece_rows)), F.lit(MAX_PIECES))
    return large.select(F.xxhash64(key).alias("_hash"), pieces.cast("int").alias("_pieces")).groupBy("_hash").agg(F.max("_pieces").alias("_pieces"))


def skew_safe_left_join(
    left: DataFrame,
    rights: DataFrame | list[DataFrame],
    key: str,
    row_id: list[Column],
    counts: DataFrame | None = None,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """`left.join(right, key, "left")` for right sides that are unique on `key`; the left side is shuffled once for all.

    Left rows of a hot key are spread over its pieces by a hash of `row_id` (repeatable, so a retried task puts every
    row where it was before) and only the hot right rows are copied, once per piece. Rows with a null key match nothing
    and are spread freely. A right side below the broadcast threshold is still broadcast by Spark itself.

    `counts` may bring (key, n) along where they are known or cheaper to get.
    """
    hot = F.broadcast(hot_keys(key_counts(left, key) if counts is None else counts, key, piece_rows))
    pieces = F.when(F.col(key).isNull(), MAX_PIECES).otherwise(F.coalesce("_pieces", F.lit(1)))
    salted = left.withColumn("_hash", F.xxhash64(key)).join(hot, "_hash", "left").withColumn("_piece", F.pmod(F.xxhash64(*row_id), pieces).cast("int"))
    salted = salted.drop("_pieces", "_hash")
    for right in [rights] if isinstance(rights, DataFrame) else rights:
        copies = right.withColumn("_hash", F.xxhash64(key)).join(hot, "_hash", "left").withColumn(
            "_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))
        )
        salted = salted.join(copies.drop("_pieces", "_hash"), [key, "_piece"], "left")
    return salted.drop("_piece")
