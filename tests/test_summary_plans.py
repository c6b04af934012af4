from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.operators.scoring import best_groups
from ledgerlens.operators.summary import percent, person_summary
from ledgerlens.operators.taxonomy import Taxonomy, filed_groups, group_keywords, rule_groups
from ledgerlens.plans import review as review_plans
from ledgerlens.plans.review import review, review_detail, run_review
from ledgerlens.plans.sinks import output_path, summary_table
from ledgerlens.queries.catalog import QUERIES
from tests.conftest import entries_frame, rules_frame

RULES = [
    ("制造业", "家具业", "木制家具", "材料", ["松木", "橡木", "竹"]),
    ("制造业", "家具业", "木制家具", "工序", ["打磨"]),
    ("制造业", "家具业", "布艺家具", "材料", ["棉布", "亚麻", "海绵"]),
]
ENTRIES = [
    ("5月6日", "丙三", "家具业", "木制家具", "北山家具厂 https://north.example.org", "松木（上漆）"),
    ("5月6日", "丁四", "家具业", "木制家具", "南湖布艺店", "橡木"),
    ("5月7日", "丙三", "家具业", "", "南湖布艺店", "麻布"),
    ("5月8日", "丁四", "家具业", "木制家具", "无名公司", "a\nb \"q\", c"),
    ("5月8日", "", "家具业", "木制家具", "无名公司", "松木"),
]
COMPANIES = [("北山家具厂", None, "松木、橡木家具；板材打磨。", "存续"), ("南湖布艺店", None, "棉布、亚麻、海绵。", "存续")]


def company_evidence(entries):
    table = entries.sparkSession.createDataFrame(COMPANIES, "query_name string, company_name string, business_scope string, status string")
    return review_plans.company_evidence(entries, table=table)


def test_percent_rounds_halves_to_even(spark):
    pairs = [(a, b) for b in range(1, 220) for a in range(b + 1)]
    frame = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = frame.select("a", "b", percent(F.col("a"), F.col("b")).alias("p")).collect()
    assert all(r["p"] == f"{r['a'] / r['b']:.0%}" for r in got)
    empty = spark.createDataFrame([(0, 0)], "a bigint, b bigint")
    assert empty.select(percent(F.col("a"), F.col("b"))).first()[0] == "0%"


def test_person_summary(spark):
    statuses = {
        "甲": ["正确"] * 1 + ["错误"] * 7 + ["信息缺失"],
        "乙": ["疑似错误", "无法判断"],
        "": ["正确"],
    }
    rows, number = [], 100
    for name in ("乙", "甲", ""):
        for status in statuses[name]:
            rows.append(("", number, name, status))
            number -= 1
    rows.append(("a file that sorts later", 1, "甲", "正确"))
    detail = spark.createDataFrame(rows, "source_id string, row_number bigint, employee_name string, status string").repartition(4)
    table = summary_table(person_summary(detail))
    assert table.columns == list(K.SUMMARY_HEADERS.values())
    assert [tuple(r) for r in table.collect()] == [
        ("", 1, 1, 1, 0, 0, 0, "100%"),
        ("甲", 10, 9, 2, 7, 0, 0, "22%"),
        ("乙", 2, 2, 0, 0, 1, 1, "0%"),
    ]


def test_groups_keep_first_places(spark):
    rows = [
        ("A", "b", "c", "m", ["k", "x", "k", ""]),
        ("A", "b", "d", "", ["k"]),
        ("A", "b", "c", "", ["y", "x"]),
        ("Z", "b", "c", "", []),
    ]
    rules = rules_frame(spark, rows)
    assert {(r["level1"], r["level3"]): r["group_ord"] for r in rule_groups(rules).collect()} == {("A", "c"): 2, ("A", "d"): 3, ("Z", "c"): 5}
    got = {(r["group_ord"], r["keyword"], r["rule_ord"], r["keyword_pos"]) for r in group_keywords(rules).collect()}
    assert got == {(2, "k", 2, 0), (2, "x", 2, 1), (2, "y", 4, 0), (3, "k", 3, 0)}
    assert {(r["level3"], r["level1"]) for r in filed_groups(rules).collect()} == {("c", "Z"), ("d", "A")}


def test_taxonomy_limits(spark):
    small = Taxonomy(rules_frame(spark, RULES))
    assert small.literal and small.searchable and small.broadcastable and small.size.gram_lengths == (1, 2)
    many = [("A", "b", str(i), "", [f"w{i}x{j}" for j in range(60)]) for i in range(10)]
    medium = Taxonomy(rules_frame(spark, many))
    assert medium.searchable and not medium.literal
    assert not Taxonomy(rules_frame(spark, many), search_terms=500).searchable
    assert not Taxonomy(rules_frame(spark, [("A", "b", "c", "", ["x" * 500_000])])).searchable
    assert not Taxonomy(rules_frame(spark, [("A", "b", "c", "", ["x" * n for n in range(1, 40)])])).searchable
    assert Taxonomy(rules_frame(spark, [("A", "b", "c", "", ["x" * n for n in range(1, 20)])])).searchable
    assert not Taxonomy(rules_frame(spark, RULES), broadcast_chars=5).broadcastable
    assert not Taxonomy(rules_frame(spark, [])).collected_groups
    with pytest.raises(ValueError, match="rule_ord must be unique"):
        Taxonomy(rules_frame(spark, RULES).union(rules_frame(spark, RULES))).literal
    with pytest.raises(ValueError, match="rule_ord must be unique"):
        Taxonomy(rules_frame(spark, RULES).union(rules_frame(spark, RULES)), search_terms=0).keyword_places


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_run_review_writes_both_tables(spark, tmp_path, fmt):
    entries = entries_frame(spark, ENTRIES)
    result = run_review(entries, rules_frame(spark, RULES), company_evidence(entries), str(tmp_path), job_id="job", fmt=fmt)
    assert result["reviewed"] == 5
    assert result["steps"] == ["读取员工记录 5 条", "读取分类规则 3 条", "查询企业 3 家", "完成审计 5 条", "生成质量汇总", "导出审计结果 Excel"]
    reader = spark.read
    if fmt == "csv":
        reader = reader.options(header=True, escape='"', multiLine=True)
    detail = reader.format(fmt).load(result["detail"])
    assert detail.columns == list(K.DETAIL_HEADERS.values())
    by_row = {int(r["原始行号"]): r for r in detail.collect()}
    assert [by_row[i]["审计结果"] for i in range(2, 7)] == ["正确", "错误", "信息缺失", "无法判断", "信息缺失"]
    assert by_row[3]["建议修正"] == "家具业 / 布艺家具" and by_row[3]["是否需要人工复核"] == "否"
    assert by_row[5]["环节"] == ENTRIES[3][5] and by_row[5]["是否需要人工复核"] == "是"
    people = reader.format(fmt).load(result["person_summary"])
    assert people.columns == list(K.SUMMARY_HEADERS.values())
    rows = {r["姓名"] or "": (int(r["录入数量"]), int(r["完整数量"]), r["正确率"]) for r in people.collect()}
    assert rows == {"丙三": (2, 1, "100%"), "丁四": (2, 2, "0%"), "": (1, 0, "0%")}
    with pytest.raises(Exception, match="(?i)already exists"):
        run_review(entries, rules_frame(spark, RULES), company_evidence(entries), str(tmp_path), job_id="job", fmt=fmt)


def test_summary_order_over_several_sources(spark, tmp_path):
    rows = [("b", 2, "乙"), ("a", 9, "甲"), ("b", 3, "甲")]
    entries = spark.createDataFrame([(s, n, "d", who, "c", "s", "x", "g") for s, n, who in rows], entries_frame(spark, []).schema)
    rules = rules_frame(spark, RULES)
    info = company_evidence(entries)
    result = run_review(entries, rules, info, str(tmp_path), job_id="job", fmt="csv")
    people = spark.read.csv(result["person_summary"], header=True).collect()
    assert [r["姓名"] for r in people] == [r["employee_name"] for r in review(entries, rules, info).people.orderBy("first_source", "first_row").collect()] == ["甲", "乙"]


def test_job_ids(spark, tmp_path):
    assert output_path("out/", "审计结果_1", "detail") == "out/审计结果_1/detail"
    for bad in ("a/b", "a\\b", "..", ""):
        with pytest.raises(ValueError, match="非法文件名"):
            output_path("out", bad, "detail")
    entries = entries_frame(spark, ENTRIES[:1])
    result = run_review(entries, rules_frame(spark, RULES), company_evidence(entries), str(tmp_path), with_source=True, with_file=True)
    assert result["job_id"].startswith("审计结果_") and len(result["job_id"]) == len("审计结果_") + 8
    detail = spark.read.parquet(result["detail"])
    columns = detail.columns
    assert detail.first()["官网链接"] == "https://north.example.org" and detail.first()["数据来源"] == "mock"
    assert columns[11] == "外部证据文本" and columns[-3:] == ["数据来源", "官网链接", "来源文件"]


def test_tables_are_lazy_and_consistent(spark):
    entries = entries_frame(spark, ENTRIES)
    tables = review(entries, rules_frame(spark, RULES), company_evidence(entries))
    assert tables.detail.count() == 5
    assert tables.people.agg(F.sum("entered")).first()[0] == 5


# -- plan shapes ----------------------------------------------------------------------------------------------------

SLOW_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_slow_nodes(spark, name):
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert not [node for node in SLOW_NODES if node in plan]


def test_scans_read_only_what_they_need(spark):
    urls = plan_of(QUERIES["entry_urls"](spark, "/root/testdata/sf0.001"))
    assert "html" not in urls and "text" not in urls.split("ReadSchema")[-1]


def test_summary_aggregates_before_it_shuffles(spark):
    plan = plan_of(QUERIES["person_summary"](spark, "/root/testdata/sf0.001"))
    counting = [line for line in plan.splitlines() if "partial_count" in line]
    assert counting and all("HashAggregate" in line for line in counting)


def test_page_limit_applies_before_the_shuffle(spark):
    plan = plan_of(QUERIES["page_modules_topk"](spark, "/root/testdata/sf0.001"))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_literal_best_group_needs_no_shuffle(spark):
    info = spark.createDataFrame([("k", "梨", True)], "query_name string, business_scope string, success boolean")
    assert "Exchange" not in plan_of(best_groups(info, Taxonomy(rules_frame(spark, RULES))))


def test_filed_group_join_is_broadcast(spark):
    entries = entries_frame(spark, ENTRIES)
    plan = plan_of(review_detail(entries, rules_frame(spark, RULES), company_evidence(entries)))
    assert "BroadcastHashJoin [category" in plan


def test_adapter_covers_all_outcomes(spark):
    detail = QUERIES["review_detail"](spark, "/root/testdata/sf0.001")
    outcomes = {(r[0], r[1]) for r in detail.select("审计结果", "错误类型").distinct().collect()}
    assert len(outcomes) == 6
