from __future__ import annotations

import csv
import random

import pytest

from ledgerlens.sources.tables import entries_from_frame, read_entries, read_rules, rules_from_frame

HEADERS = ["日期", "姓名", "一级分类", "细分", "企业名称&官网", "环节"]
RULE_HEADERS = ["一级品类", "二级品类", "三级品类", "模块名称", "子模块列表"]


def write(path, rows):
    path.write_text("\n".join(",".join(f'"{cell}"' for cell in row) for row in rows) + "\n", encoding="utf-8")
    return str(path)


ROW2 = ["1月3日", "丁一", "养殖业", "水产", "东湖渔业有限公司 https://lake.example.org", "鲤鱼（养殖）"]
ROW4 = ["2月9日", "戊二", "加工业", "", "西山木业有限公司", "木材（切割）"]


def test_blank_row_keeps_its_number(spark, tmp_path):
    path = write(tmp_path / "e.csv", [HEADERS, ROW2, [""] * 6, ROW4])
    rows = read_entries(spark, path).orderBy("row_number").collect()
    assert [r["row_number"] for r in rows] == [2, 4]
    assert [(r["name"], r["company_raw"], r["subcategory"]) for r in rows] == [(row[1], row[4], row[3]) for row in (ROW2, ROW4)]


def test_headers_any_order_per_file_untrimmed_and_repeated(spark, tmp_path):
    write(tmp_path / "a.csv", [[" 日期 ", "姓名", "姓名", *HEADERS[2:], "备注"], ["d", "first", "second", "c", "s", "k", "g", ""]])
    write(tmp_path / "b.csv", [list(reversed(HEADERS)), list(reversed(["d", "other", "c", "s", "k", "　g　"]))])
    rows = read_entries(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r["name"], r["date"], r["stage"], r["row_number"]) for r in rows] == [("first", "d", "g", 2), ("other", "d", "g", 2)]
    assert len({r["source_id"] for r in rows}) == 2


def test_row_with_only_an_extra_cell_is_kept(spark, tmp_path):
    path = write(tmp_path / "e.csv", [[*HEADERS, "备注"], [""] * 6 + ["x"], [" "] * 7])
    rows = read_entries(spark, path).collect()
    assert [(r["row_number"], r["name"]) for r in rows] == [(2, "")]


def test_a_cell_beyond_the_header_counts(spark, tmp_path):
    path = write(tmp_path / "e.csv", [HEADERS, [""] * 6 + ["x"], [""] * 6 + [" "], ROW2])
    rows = read_entries(spark, path).orderBy("row_number").collect()
    assert [(r["row_number"], r["name"]) for r in rows] == [(2, ""), (4, ROW2[1])]


def test_missing_headers_are_named_in_declared_order(spark, tmp_path):
    path = write(tmp_path / "e.csv", [["环节", "日期", "细分"], ["a", "b", "c"]])
    with pytest.raises(ValueError, match="^员工录入表缺少表头：姓名, 一级分类, 企业名称&官网$"):
        read_entries(spark, path)
    with pytest.raises(ValueError, match="^内部分类表缺少表头：一级品类, 二级品类, 三级品类, 模块名称, 子模块列表$"):
        read_rules(spark, path)


def test_wider_files_quotes_and_byte_order_mark(spark, tmp_path):
    write(tmp_path / "a.csv", [HEADERS, ["d", "narrow", "c", "s", "k", "g"]])
    extra = [f"x{i}" for i in range(20)]
    write(tmp_path / "b.csv", [["日期", *extra, *HEADERS[1:]], ["d", *extra, "wide", "c", "s", 'k ""q"", \\', "g"]])
    wide = tmp_path / "b.csv"
    wide.write_bytes(b"\xef\xbb\xbf" + wide.read_bytes())
    rows = {r["name"]: r for r in read_entries(spark, [str(tmp_path / "a.csv"), str(wide)]).collect()}
    assert set(rows) == {"narrow", "wide"}
    assert rows["wide"]["company_raw"] == 'k "q", \\' and rows["wide"]["date"] == "d" and rows["wide"]["stage"] == "g"


def test_row_numbers_across_many_splits(spark, tmp_path):
    for name, count in (("a", 30_000), ("b", 20_000)):
        rows = [HEADERS] + [["d", f"{name}{i}", "c", "s", "k", "g" * 40] for i in range(2, count + 2)]
        write(tmp_path / f"{name}.csv", rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        frame = read_entries(spark, str(tmp_path))
        assert frame.rdd.getNumPartitions() > 8
        assert frame.count() == 50_000
        assert frame.filter("substring(name, 2) <> cast(row_number AS string)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_lines_are_rows_and_numbered(spark, tmp_path):
    line = lambda row: ",".join(row)
    path = tmp_path / "e.csv"
    path.write_text("\n".join([line(HEADERS), "", line(ROW2), "", "", line(ROW4), ""]), encoding="utf-8")
    for multi_line in (False, True):
        rows = read_entries(spark, str(path), multi_line=multi_line).orderBy("row_number").collect()
        assert [(r["row_number"], r["name"]) for r in rows] == [(3, ROW2[1]), (6, ROW4[1])]


def test_blank_beyond_the_header_is_unicode_white_space(spark, tmp_path):
    path = write(tmp_path / "e.csv", [HEADERS, [""] * 6 + ["\u3000\x1c\x85"], [""] * 6 + ["x"]])
    assert [r["row_number"] for r in read_entries(spark, path).collect()] == [3]


def test_quoted_line_breaks_over_range_borders(spark, tmp_path, small_ranges):
    """Random files with breaks, empty lines, doubled quotes and cells longer than several ranges, against the csv module."""
    rng = random.Random(4)
    expected = {}
    for name in ("a", "b", "c"):
        lines, number = [",".join(f'"{h}"' if name != "b" else f'"{h}\n"' for h in HEADERS)], 1
        for k in range(120):
            number += 1
            if rng.random() < 0.15:
                lines.append("")
                continue
            cells = [f"{name}{k}", *("".join(rng.choices('x,y"\n 甲', k=rng.choice([0, 3, 9, 9, 900 if k % 40 == 7 else 5]))) for _ in range(5))]
            lines.append(",".join('"' + c.replace('"', '""') + '"' for c in cells))
            expected[name, number] = [c.strip() for c in cells]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n" * rng.randrange(2), encoding="utf-8")
        with open(tmp_path / f"{name}.csv", newline="", encoding="utf-8") as file:
            parsed = [row for row in csv.reader(file)]
        assert {n: [c.strip() for c in row] for n, row in enumerate(parsed, 1) if n > 1 and row} == {n: v for (f, n), v in expected.items() if f == name}
    (tmp_path / "empty.csv").write_text("")
    frame = read_entries(spark, str(tmp_path), multi_line=True)
    assert frame.rdd.getNumPartitions() > 8
    found = {(r["source_id"][-5], r["row_number"]): [r[c] for c in ("date", "name", "category", "subcategory", "company_raw", "stage")] for r in frame.collect()}
    assert found == expected


def test_an_open_cell_ends_with_its_file(spark, tmp_path, small_ranges):
    path = tmp_path / "e.csv"
    path.write_text(",".join(HEADERS) + "\n" + ",".join(ROW2) + '\nd,n,c,s,k,"open\n' + "more\n" * 200, encoding="utf-8")
    rows = read_entries(spark, str(path), multi_line=True).orderBy("row_number").collect()
    assert [r["row_number"] for r in rows] == [2, 3] and rows[1]["stage"].count("more") == 200


def test_entry_rows_are_not_moved(spark, tmp_path):
    path = write(tmp_path / "e.csv", [HEADERS, ROW2, ROW4])
    for multi_line in (False, True):
        plan = read_entries(spark, path, multi_line=multi_line)._jdf.queryExecution().executedPlan().toString()
        # What is exchanged stands below a broadcast: a row per range or file.
        rows = [line for line in plan.split("\n") if "record" in line]
        assert rows and not any("Exchange" in line for line in rows)


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_typed_files(spark, tmp_path, fmt):
    rows = [("d", f"n{i}", "c", "s" if i != 3 else None, "k", "g") for i in range(2, 12)]
    path = str(tmp_path / fmt)
    spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in HEADERS)).coalesce(1).write.format(fmt).save(path)
    found = read_entries(spark, path, fmt=fmt).orderBy("row_number").collect()
    assert [(r["row_number"], r["name"]) for r in found] == [(i, f"n{i}") for i in range(2, 12)]
    assert found[1]["subcategory"] == ""
    with pytest.raises(ValueError, match="内部分类表缺少表头"):
        read_rules(spark, path, fmt=fmt)


def test_frame_source_needs_row_numbers(spark):
    frame = spark.createDataFrame([("d", "n", "c", "s", "k", 1.5)], ", ".join(f"`{h}` string" for h in HEADERS[:5]) + ", `环节` double")
    with pytest.raises(ValueError, match="row_number"):
        entries_from_frame(frame)
    numbered = frame.selectExpr("*", "7 AS row_number")
    assert entries_from_frame(numbered).first().asDict()["stage"] == "1.5"


def test_rules_inherit_blank_levels(spark, tmp_path):
    path = write(
        tmp_path / "r.csv",
        [
            RULE_HEADERS,
            ["农业", "种植业", "水果作物", "类型", "苹果、梨、桃子"],
            ["", "", "", "环节", "繁育、加工\n销售"],
            ["", "", "粮食作物", "类型", "玉米，水稻,小麦"],
        ],
    )
    rules = read_rules(spark, path).orderBy("rule_ord").collect()
    assert [(r["level1"], r["level2"], r["level3"], r["module_name"], r["keywords"]) for r in rules] == [
        ("农业", "种植业", "水果作物", "类型", ["苹果", "梨", "桃子"]),
        ("农业", "种植业", "水果作物", "环节", ["繁育", "加工", "销售"]),
        ("农业", "种植业", "粮食作物", "类型", ["玉米", "水稻", "小麦"]),
    ]


def test_fill_down_does_not_reset_and_dropped_rows_feed(spark):
    rows = [
        (2, "农业", "种植业", "水果", "m", ""),
        (3, None, None, "粮食", "m", ""),
        (4, "工业", None, " ", "m", ""),
        (5, "新", "", "", "", " "),
        (6, "", "", "", "", "k"),
    ]
    frame = spark.createDataFrame(rows, "row_number int, " + ", ".join(f"`{h}` string" for h in RULE_HEADERS))
    rules = rules_from_frame(frame).orderBy("rule_ord").collect()
    assert [(r["rule_ord"], r["level1"], r["level2"], r["level3"]) for r in rules] == [
        (2, "农业", "种植业", "水果"),
        (3, "农业", "种植业", "粮食"),
        (4, "工业", "种植业", "粮食"),
        (6, "新", "种植业", "粮食"),
    ]
