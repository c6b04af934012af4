from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import pages as P
from ledgerlens.operators.late import possible
from ledgerlens.operators.lookup import one_per_company
from ledgerlens.queries import catalog

SF = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_possible_keeps_all_wanted_rows(spark):
    frame = spark.range(5000).withColumn("text", F.concat(F.lit("t"), "id"))
    wanted = spark.range(0, 5000, 50).select(F.col("id").alias("w"))
    for bits, most in ((1 << 26, 100), (1 << 10, 700), (64, 5000)):
        kept = {r["id"] for r in possible(frame, F.xxhash64("id"), wanted, F.xxhash64("w"), bits).collect()}
        assert set(range(0, 5000, 50)) <= kept and len(kept) <= most
    assert possible(frame, F.xxhash64("id"), wanted.limit(0), F.xxhash64("w")).count() == 0


def test_the_greatest_answer_is_chosen_without_its_text(spark):
    rows = [(k % 7 if k % 11 else None, bool(k % 3), (k * 37) % 19 if k % 5 else None, f"text {k % 23}" if k % 4 else None) for k in range(400)]
    rows += rows[:50]  # equal rows are one
    frame = spark.createDataFrame(rows, "query_name int, success boolean, at int, business_scope string")
    found = {r["query_name"]: tuple(r)[1:] for r in one_per_company(frame, "at").collect()}
    assert len(found) == 8 == one_per_company(frame, "at").count()
    for key, (success, at, text) in found.items():
        own = [r for r in rows if r[0] == key]
        best = max((r[1], -1 if r[2] is None else r[2]) for r in own)
        assert (success, -1 if at is None else at) == best and (key, success, at, text) in own
    assert one_per_company(frame.limit(0), "at").count() == 0


def test_markup_never_moves(spark, no_broadcast):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    for frame in (P.page_memo(table, "page_id"), P.host_evidence(table, P.page_links(table)), catalog.QUERIES["website_company_info"](spark, SF)):
        assert "html" in plan_of(frame)
        assert "html" not in _exchanged(frame._jdf.queryExecution().executedPlan())
    assert "SortAggregate" not in plan_of(P.page_memo(table, "page_id"))


def _exchanged(node) -> set[str]:
    """Names of the columns that stand under any exchange that moves rows."""
    names = set()
    if node.nodeName() == "AdaptiveSparkPlan":
        return _exchanged(node.executedPlan())
    if node.nodeName() == "Exchange":
        names |= {node.output().apply(k).name() for k in range(node.output().size())}
    for k in range(node.children().size()):
        names |= _exchanged(node.children().apply(k))
    return names
