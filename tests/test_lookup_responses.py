from __future__ import annotations

import json

import pytest

from ledgerlens import constants as K
from ledgerlens.operators.lookup import lookup_keys, merge_lookups, pending_keys, static_lookup
from ledgerlens.operators.responses import from_responses
from ledgerlens.plans.review import company_evidence, review_detail
from tests.conftest import entries_frame, rules_frame

TABLE = "query_name string, company_name string, business_scope string, status string"


def keyed(frame, *columns):
    return {row["query_name"]: tuple(row[c] for c in columns) for row in frame.collect()}


def test_lookup_keys_are_distinct_and_include_blank(spark):
    entries = entries_frame(spark, [("d", "n", "c", "s", k, "g") for k in ("甲 ", " 甲，", "https://x", "", "乙")])
    assert keyed(lookup_keys(entries), "entries") == {"甲": (2,), "": (2,), "乙": (1,)}


def test_static_lookup(spark):
    table = spark.createDataFrame([("甲", None, "梨", "存续"), ("乙", "乙公司", None, None), ("空", None, None, None)], TABLE)
    keys = spark.createDataFrame([("甲",), ("乙",), ("空",), ("无",), ("",)], "query_name string")
    miss = "mock 数据中未找到该企业"
    result = static_lookup(keys, table)
    assert keyed(result, "company_name", "business_scope", "status", "source", "success", "error") == {
        "甲": ("甲", "梨", "存续", "mock", True, ""),
        "乙": ("乙公司", "", "", "mock", True, ""),
        "空": ("空", "", "", "mock", False, miss),
        "无": ("无", "", "", "mock", False, miss),
        "": ("", "", "", "mock", False, miss),
    }
    assert json.loads(keyed(result, "raw")["甲"][0]) == {"business_scope": "梨", "status": "存续"}


def test_memo(spark):
    schema = "query_name string, business_scope string, looked_up_at bigint"
    known = spark.createDataFrame([("a", "old", 1), ("b", "kept", 9), ("b", "older", 2), ("tie", "x", 5)], schema)
    fresh = spark.createDataFrame([("a", "new", 2), ("c", None, 3), ("tie", "y", 5)], schema)
    merged = merge_lookups(known, fresh)
    assert merged.columns == known.columns
    assert keyed(merged, "business_scope", "looked_up_at") == {"a": ("new", 2), "b": ("kept", 9), "c": (None, 3), "tie": ("y", 5)}
    keys = spark.createDataFrame([("a",), ("c",), ("d",)], "query_name string")
    assert {r[0] for r in pending_keys(keys, merged.drop("looked_up_at")).collect()} == {"c", "d"}


CASES = {  # name: (http status, body, transport error, expected error)
    "timeout": (None, None, "timed out", "企查查接口请求失败：timed out"),
    "http": (500, "{}", None, "企查查 HTTP 状态异常：500"),
    "text": (200, "<html>", None, "企查查响应不是合法 JSON"),
    "nothing": (200, None, None, "企查查响应不是合法 JSON"),
    "list": (200, "[1]", None, "企查查响应 Result 字段格式异常"),
    "refused": (200, '{"Status":"101","Message":"余额不足","Result":null}', None, "企查查接口返回失败：余额不足"),
    "refused msg": (200, '{"Status":101,"Message":"","msg":"m"}', None, "企查查接口返回失败：m"),
    "refused zero": (200, '{"Status":101,"Message":0,"msg":false}', None, '企查查接口返回失败：{"Status":101,"Message":0,"msg":false}'),
    "refused bool": (200, '{"Status":101,"Message":true}', None, "企查查接口返回失败：True"),
    "fraction": (200, '{"Status":200.0,"msg":"x"}', None, "企查查接口返回失败：x"),
    "no status": (200, '{"Result":{"Scope":"a"}}', None, '企查查接口返回失败：{"Result":{"Scope":"a"}}'),
    "odd result": (200, '{"Status":200,"Result":"text"}', None, "企查查响应 Result 字段格式异常"),
    "list result": (200, '{"Status":200,"Result":[{"Scope":"a"}]}', None, "企查查响应 Result 字段格式异常"),
    "no result": (200, '{"Status":200}', None, "企查查响应中未找到经营范围字段"),
    "blank scope": (200, '{"Status":200,"Result":{"Scope":" ","Name":"n"}}', None, "企查查响应中未找到经营范围字段"),
}


def test_failed_responses(spark):
    rows = [(name, status, body, transport) for name, (status, body, transport, _) in CASES.items()]
    result = from_responses(spark.createDataFrame(rows, "query_name string, http_status int, body string, transport_error string"))
    got = keyed(result, "success", "error", "company_name", "business_scope", "status", "source")
    assert got == {name: (False, case[3], name, "", "", "qichacha") for name, case in CASES.items()}


def test_good_responses(spark):
    bodies = {
        "云岭竹器有限公司": {
            "Status": "200",
            "Message": "查询成功",
            "Result": {"Name": "云岭竹器有限公司", "Scope": "竹篮、竹席编织；运输。", "RegStatus": "存续"},
        },
        "data": {"Status": 200, "Result": [], "Data": {"Scope": None, "BusinessScope": "", "经营范围": " 梨 ", "Status": 1.5}},
        "typed": {"Status": 200, "Result": {"OperScope": 12, "EntName": True, "StatusDesc": "x", "RegStatus": "　"}},
    }
    rows = [(name, 200, json.dumps(body, ensure_ascii=False), None) for name, body in bodies.items()]
    result = from_responses(spark.createDataFrame(rows, "query_name string, http_status int, body string, transport_error string"))
    assert keyed(result, "success", "company_name", "business_scope", "status", "error") == {
        "云岭竹器有限公司": (True, "云岭竹器有限公司", "竹篮、竹席编织；运输。", "存续", ""),
        "data": (True, "data", "梨", "1.5", ""),
        "typed": (True, "True", "12", "x", ""),
    }
    assert json.loads(keyed(result, "raw")["data"][0])["Status"] == 200


def test_evidence_source_switch(spark):
    entries = entries_frame(spark, [("d", "n", "c", "s", "金川县雪梨果业开发有限责任公司", "g"), ("d", "n", "c", "s", "乙 https://h.x/a", "g")])
    replies = spark.createDataFrame([("乙", 500, "", None)], "query_name string, http_status int, body string, transport_error string")
    pages = spark.createDataFrame([(1, "https://h.x/", "<title>t</title><p>梨</p>")], "page_id bigint, url string, html string")
    for source in ("mock", "", "unknown"):
        known = keyed(company_evidence(entries, source), "success", "source")
        assert known == {"金川县雪梨果业开发有限责任公司": (True, "mock"), "乙": (False, "mock")}
    assert keyed(company_evidence(entries, " Qichacha ", responses=replies), "source") == {"乙": ("qichacha",)}
    site = keyed(company_evidence(entries, "website", pages=pages), "success", "business_scope", "error", "source")
    assert site == {
        "金川县雪梨果业开发有限责任公司": (False, "", "官网链接缺失", "website"),
        "乙": (True, "t 梨", "", "website"),
    }


REPLY = "query_name string, http_status int, body string, transport_error string, at int"
GOOD = '{"Status": "200", "Result": {"Scope": "%s"}}'


def test_one_answer_per_company(spark):
    replies = spark.createDataFrame(
        [("a", 200, GOOD % "old", "", 1), ("a", 200, GOOD % "new", None, 5), ("a", 503, "", "", 9), ("b", 200, "{", "timeout", 1), ("b", 503, "", "", 2)],
        REPLY,
    )
    entries = entries_frame(spark, [("d", "n", "c", "s", "a", "g")] * 3 + [("d", "m", "c", "s", "b", "g")] * 2)
    info = company_evidence(entries, K.REGISTRY_SOURCE, responses=replies, order="at")
    found = {r["query_name"]: (r["success"], r["business_scope"], r["error"]) for r in info.collect()}
    assert found == {"a": (True, "new", ""), "b": (False, "", K.REGISTRY_HTTP + "503")}
    rules = rules_frame(spark, [("c", "s", "", "", ["x"])])
    assert review_detail(entries, rules, from_responses(replies)).count() == 5


@pytest.mark.parametrize("source", [K.REGISTRY_SOURCE, K.WEBSITE_SOURCE])
def test_evidence_needs_its_input(spark, source):
    with pytest.raises(ValueError, match=source):
        company_evidence(entries_frame(spark, []), source)
