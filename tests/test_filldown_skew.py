from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerlens.operators.filldown import fill_down
from ledgerlens.operators import skew
from ledgerlens.operators.skew import MAX_PIECES, hot_keys, key_counts, skew_safe_left_join


def test_fill_down_across_blocks(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for source in ("a", "b"):
        above = ["", ""]
        for position in range(2, 400):
            cells = [rng.choice(["", "", "", "", f"{source}{position}"]) for _ in range(2)]
            if rng.random() < 0.2:
                continue
            above = [cell or old for cell, old in zip(cells, above)]
            rows.append((source, position, *cells))
            expected[source, position] = tuple(above)
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "source_id string, row_number bigint, x string, y string").repartition(5)
    for block_rows in (1, 7, 100_000):
        filled = fill_down(frame, ["x", "y"], "row_number", "source_id", block_rows=block_rows)
        assert {(r[0], r[1]): (r[2], r[3]) for r in filled.collect()} == expected


def test_skew_safe_join_equals_plain_left_join(spark):
    # One key holds a third of the rows, another a tenth, a third of the rows have no key.
    left = spark.range(6000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN null WHEN id % 10 = 2 THEN 'warm' ELSE cast(id % 500 AS string) END AS k"
    )
    right = spark.range(300).selectExpr("cast(id AS string) AS k", "id * 2 AS v").union(
        spark.createDataFrame([("hot", -1), ("unused", -2)], "k string, v bigint")
    )
    plain = sorted(left.join(right, "k", "left").select("id", "k", "v").collect(), key=str)
    for piece_rows in (1, 100, 10_000):
        joined = skew_safe_left_join(left, right, "k", [F.col("id")], piece_rows=piece_rows)
        assert sorted(joined.select("id", "k", "v").collect(), key=str) == plain


def test_hot_keys_are_cut_into_bounded_pieces(spark):
    left = spark.range(100_000).selectExpr("if(id < 90000, 'hot', cast(id AS string)) AS k")
    counts = key_counts(left, "k")
    assert [r["_pieces"] for r in hot_keys(counts, "k", 1000).collect()] == [90]
    assert [r["_pieces"] for r in hot_keys(counts, "k", 3).collect()] == [MAX_PIECES]
    assert hot_keys(counts, "k").count() == 0


def test_hot_rows_are_spread(spark):
    left = spark.range(20_000).selectExpr("id", "'hot' AS k")
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew_safe_left_join(left, right, "k", [F.col("id")], piece_rows=100)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == 8 and max(r["count"] for r in sizes) < 5000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_more_hot_keys_than_the_list_holds(spark, monkeypatch):
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 5)
    left = spark.range(4_000).selectExpr("id", "cast(pow(id % 20, 2) AS string) AS k")
    right = left.select("k").distinct().selectExpr("k", "length(k) AS v")
    joined = skew_safe_left_join(left, right, "k", [F.col("id")], piece_rows=10)
    assert joined.filter("v = length(k)").count() == 4_000
    unsplit = key_counts(left, "k").count() - 5
    assert unsplit > 0 and key_counts(left, "k").orderBy("n").first()["n"] <= 4_000 / 5
