from __future__ import annotations

import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import constants as K
from ledgerlens.functions import text as X

SPACES = [chr(i) for i in range(0x3001) if chr(i).isspace()]


def column(spark, values, expression, schema="id int, v string"):
    frame = spark.createDataFrame(list(enumerate(values)), schema)
    return [row[0] for row in frame.select("id", expression.alias("r")).orderBy("id").select("r").collect()]


def random_texts(alphabet, count=400, longest=14):
    rng = random.Random(7)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(count)]


def test_white_space_is_pythons(spark):
    assert set(K.WHITESPACE) == set(SPACES)
    assert column(spark, [f"{s}甲 乙{s}" for s in SPACES], X.strip_text(F.col("v"))) == ["甲 乙"] * len(SPACES)


def test_strip_like_python(spark):
    values = random_texts([*SPACES, "a", "甲", ".", "​"])
    assert column(spark, values, X.strip_text(F.col("v"))) == [v.strip() for v in values]


def test_clean_company_name_fixture(spark):
    values = [
        " 金川县雪梨果业开发有限责任公司 https://example.com ",
        "https://a.b",
        "　甲 乙 丙\t，；。",
        "甲 www.a.b/c，丙 丁",
        None,
        "",
        "甲https://x y www.z",
        "http:// 甲",
    ]
    cleaned = ["金川县雪梨果业开发有限责任公司", "", "甲乙丙", "甲丁", "", "", "甲y", "http://甲"]
    assert column(spark, values, X.clean_company_name(F.col("v"))) == cleaned


def test_clean_company_name_like_its_definition(spark):
    pieces = ["http://", "https://", "www.", "甲", "乙b", "，", ";", "。", "；", " ", "　", "\x1c", "x.com"]
    values = random_texts(pieces, longest=9)
    expected = []
    for value in values:
        rest = re.sub(r"https?://\S+|www\.\S+", "", value)
        expected.append("".join(c for c in rest if not c.isspace()).strip("，,；;。"))
    assert column(spark, values, X.clean_company_name(F.col("v"))) == expected


def test_split_keywords(spark):
    values = ["苹果、梨、桃子", "玉米，水稻,小麦", "a;;b；\n c \r\n、", "", "、", "梨、梨", "　梨　、苹 果"]
    expected = [["苹果", "梨", "桃子"], ["玉米", "水稻", "小麦"], ["a", "b", "c"], [], [], ["梨", "梨"], ["梨", "苹 果"]]
    assert column(spark, values, X.split_keywords(F.col("v"))) == expected


def test_cell_text_of_types(spark):
    numbers = [1.0, 0.1, 12345678.5, 1e7, 123456789012345.0, 1e15, 1e16, 1.5e300, 1e-4, 1.5e-5, 2.5e-7, -3.0, -1e-9, 0.0]
    numbers += [float("inf"), float("nan"), 1 / 3, 2**53 + 2.0]
    assert column(spark, numbers, X.cell_text(F.col("v"), T.DoubleType()), "id int, v double") == [str(n) for n in numbers]
    flags = [True, False, None]
    assert column(spark, flags, X.cell_text(F.col("v"), T.BooleanType()), "id int, v boolean") == ["True", "False", ""]
    assert column(spark, [5, None], X.cell_text(F.col("v"), T.LongType()), "id int, v bigint") == ["5", ""]


def test_first_non_blank(spark):
    frame = spark.createDataFrame([(" ", " a "), (None, ""), ("b", "c")], "x string, y string")
    assert [r[0] for r in frame.select(X.first_non_blank(F.col("x"), F.col("y"))).collect()] == ["a", "", "b"]


def test_website_url(spark):
    values = ["甲 https://a.b/c 丙", "甲 www.x.y", "甲", None]
    assert column(spark, values, X.website_url(F.col("v"))) == ["https://a.b/c", "www.x.y", "", ""]
