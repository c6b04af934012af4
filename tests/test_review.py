from __future__ import annotations

import random
import re

import pytest

from ledgerlens.operators import matching
from ledgerlens.operators.matching import keyword_hits
from ledgerlens.operators.taxonomy import Taxonomy
from ledgerlens.plans.review import review_detail
from tests.brute import review_row
from tests.conftest import INFO_SCHEMA, entries_frame, found, missed, rules_frame

WOOD = [
    ("制造业", "家具业", "木制家具", "材料", ["橡木", "松木", "板材"]),
    ("制造业", "家具业", "木制家具", "工序", ["切割", "打磨", "上漆"]),
]
CLOTH = [WOOD[0], ("制造业", "家具业", "布艺家具", "材料", ["棉布", "亚麻", "海绵"])]
FACTORY = "北山家具厂"


def run(spark, entry, rules, info):
    infos = spark.createDataFrame([info] if info else [], INFO_SCHEMA)
    return review_detail(entries_frame(spark, [entry]), rules_frame(spark, rules), infos).first()


@pytest.mark.parametrize("gap", range(6))
def test_a_single_missing_field(spark, gap):
    names = ["日期", "姓名", "一级分类", "细分", "企业名称&官网", "环节"]
    entry = ["3月5日", "甲一", "家具业", "木制家具", FACTORY, "橡木"]
    entry[gap] = ""
    row = run(spark, tuple(entry), WOOD, found(FACTORY, "橡木"))
    assert (row["status"], row["error_type"], row["confidence"], row["needs_review"]) == ("信息缺失", "信息缺失", 0, True)
    assert row["reason"] == f"必填字段缺失：{names[gap]}"
    assert row["company_name"] == row["company_status"] == row["business_scope"] == ""


def test_all_missing_fields_in_order(spark):
    row = run(spark, ("", "", "", "", "", ""), WOOD, None)
    assert row["reason"] == "必填字段缺失：日期、姓名、一级分类、细分、企业名称&官网、环节"


@pytest.mark.parametrize(
    "scope, stage, score, words, staged",
    [
        ("松木、板材打磨", "松木（打磨）", 88, "松木、板材、打磨", "松木、打磨"),
        ("橡木、松木、板材切割、打磨；安装", "橡木（切割、上漆）", 100, "橡木、松木、板材、切割、打磨", "橡木、切割、上漆"),
        ("松木打磨；板材", "工序：松木", 87, "松木、板材、打磨", "松木"),
    ],
)
def test_scores_of_filed_groups(spark, scope, stage, score, words, staged):
    """20 and 20 for the levels, 12 a word of the scope up to 45, 6 a word of the stage, 5 for a module it names, 100 at most."""
    row = run(spark, ("3月5日", "甲一", "家具业", "木制家具", FACTORY, stage), WOOD, found(FACTORY, scope))
    assert (row["status"], row["confidence"], row["needs_review"], row["error_type"]) == ("正确", score, False, "")
    module = "环节模块命中：工序；" if "工序" in stage else ""
    assert row["reason"] == f"分类命中：家具业；细分命中：木制家具；{module}经营范围关键词：{words}；录入环节关键词：{staged}"


def test_another_group_is_suggested(spark):
    row = run(spark, ("3月5日", "乙二", "家具业", "木制家具", FACTORY, "橡木"), CLOTH, found(FACTORY, "海绵、亚麻和棉布制品。"))
    assert (row["status"], row["confidence"], row["suggestion"], row["needs_review"]) == ("错误", 60, "家具业 / 布艺家具", False)
    assert row["reason"] == "经营范围更匹配建议分类：经营范围关键词：棉布、亚麻、海绵"


def test_evidence_gaps(spark):
    entry = ("d", "n", "家具业", "木制家具", "甲", "松木")
    row = run(spark, entry, WOOD, None)
    assert (row["status"], row["reason"], row["data_source"]) == ("无法判断", "未查询到企业信息", "")
    row = run(spark, entry, WOOD, missed("甲", "限流"))
    assert (row["status"], row["confidence"], row["error_type"], row["reason"]) == ("无法判断", 0, "企业信息缺失", "限流")
    assert row["company_name"] == ""
    row = run(spark, entry, WOOD, found("甲", ""))
    assert (row["status"], row["confidence"], row["error_type"]) == ("无法判断", 46, "经营范围缺失")
    assert (row["company_name"], row["company_status"]) == ("甲", "存续")
    row = run(spark, ("d", "n", "家具业", "木制家具", "https://a.b", "松木"), WOOD, None)
    assert (row["status"], row["cleaned_company"]) == ("无法判断", "")


def test_last_level1_wins_and_first_group_wins_ties(spark):
    rules = [
        ("甲", "种植业", "水果", "x", ["a1"]),
        ("乙", "种植业", "水果", "y", ["b1"]),
        ("丙", "p", "first", "", ["k1", "k2", "k3"]),
        ("丙", "p", "second", "", ["k3", "k2", "k1"]),
    ]
    entry = ("d", "n", "种植业", "水果", "c", "x y a1 b1")
    row = run(spark, entry, rules, found("c", "-"))
    assert row["confidence"] == 40 + 5 + 6
    row = run(spark, entry, rules, found("c", "k1k2k3"))
    assert (row["status"], row["suggestion"], row["reason"]) == ("错误", "p / first", "经营范围更匹配建议分类：经营范围关键词：k1、k2、k3")


def test_caps_and_cuts(spark):
    words = [f"w{i}" for i in range(8)]
    rules = [("A", "c", "s", "mod", words[:5]), ("A", "c", "s", "mod", [*words[3:], "w0"]), ("A", "c", "s", "", [])]
    entry = ("d", "n", "c", "s", "k", "mod w0 w1 w2 w3")
    row = run(spark, entry, rules, found("k", " ".join(words)))
    assert row["confidence"] == 100
    assert row["reason"] == (
        "分类命中：c；细分命中：s；环节模块命中：mod；环节模块命中：mod；经营范围关键词：w0、w1、w2、w3、w4、w5；录入环节关键词：w0、w1、w2、w3"
    )
    for hits, confidence in ((4, 85), (5, 85), (3, 76)):
        row = run(spark, (*entry[:5], "-"), rules, found("k", " ".join(words[:hits])))
        assert row["confidence"] == confidence
    row = run(spark, (*entry[:5], "w0w1w2w3w4"), rules, found("k", "-"))
    assert row["confidence"] == 60


def random_case(rng, size):
    alphabet = "梨果稻玉米种植加工ab"

    def word(longest=3):
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest)))

    levels = [(rng.choice("AB"), rng.choice(["c1", "c2"]), rng.choice(["s1", "s2", "s3"])) for _ in range(5)]
    rules = [
        (*rng.choice(levels), rng.choice(["", word(), word()]), [word(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 5))])
        for _ in range(rng.randint(1, 12))
    ]
    companies = [f"K{i}" for i in range(12)]
    infos = {}
    for company in companies[:-2]:
        kind = rng.random()
        if kind < 0.1:
            infos[company] = ("", False, "失败")
        elif kind < 0.2:
            infos[company] = ("", True, "")
        else:
            infos[company] = ("".join(word(4) for _ in range(rng.randint(1, 25))), True, "")
    entries = [
        (
            rng.choice(["d", "d", "d", "d", ""]),
            rng.choice(["n1", "n2"]),
            rng.choice(["c1", "c2", "A"]),
            rng.choice(["s1", "s2", "s3", "s9"]),
            f" {rng.choice(companies)}， https://x.y",
            "".join(word(4) for _ in range(rng.randint(1, 12))),
        )
        for _ in range(size)
    ]
    return entries, rules, infos


SEARCHED = {"literal_terms": 0}


@pytest.fixture(params=[0, 1000], ids=["patterns", "word by word"])
def few_words(request, monkeypatch):
    monkeypatch.setattr(matching, "FEW_WORDS", request.param)


JOINED = {"search_terms": 0}
SHUFFLED = {"search_terms": 0, "broadcast_chars": 0}


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {}), (3, {}), (4, SEARCHED), (5, SEARCHED), (6, JOINED), (7, SHUFFLED)])
def test_plans_agree_with_brute_force(spark, few_words, seed, options):
    rng = random.Random(seed)
    entries, rules, infos = random_case(rng, 300)
    fields = ["date", "name", "category", "subcategory", "company_raw", "stage"]
    expected = {}
    for number, entry in enumerate(entries, start=2):
        company = re.sub(r"https?://\S+", "", entry[4]).replace(" ", "").strip("，")
        expected[number] = review_row(dict(zip(fields, entry)), rules, infos.get(company))
    info_rows = [(k, k, scope, "在", "mock", ok, error, "{}") for k, (scope, ok, error) in infos.items()]
    info = spark.createDataFrame(info_rows, INFO_SCHEMA)
    taxonomy = Taxonomy(rules_frame(spark, rules), **options)
    detail = review_detail(entries_frame(spark, entries), taxonomy, info, piece_rows=10)
    actual = {
        r["row_number"]: (r["status"], r["confidence"], r["error_type"], r["reason"], r["suggestion"], r["needs_review"])
        for r in detail.collect()
    }
    assert actual == expected
    taxonomy.release()


@pytest.mark.parametrize("options", [SEARCHED, JOINED, SHUFFLED])
def test_term_hits_against_plain_search(spark, few_words, options):
    rng = random.Random(11)
    alphabet = "ab梨果😀 \n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", "\x00ab"]
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 10))) for _ in range(150)} | {"\x00a"}
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    taxonomy = Taxonomy(rules_frame(spark, [("A", "b", "c", "", list(words))]), **options)
    hits = {tuple(r) for r in keyword_hits(frame, ["id"], "text", taxonomy).collect()}
    assert hits == {(i, w) for i, t in enumerate(texts) for w in words if w in t}


def test_a_word_nested_seven_deep_leaves_the_rest_on_the_local_plan(spark, few_words):
    words = ["ab" * n for n in range(1, 9)] + ["梨"]
    texts = ["ab" * n + "梨" * (n % 2) for n in range(9)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    taxonomy = Taxonomy(rules_frame(spark, [("A", "b", "c", "", words)]), **SEARCHED)
    hits = keyword_hits(frame, ["id"], "text", taxonomy)
    assert taxonomy.searchable and "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in hits.collect()} == {(i, w) for i, t in enumerate(texts) for w in words if w in t}
    taxonomy.release()


def test_evidence_is_searched_once(spark, monkeypatch):
    monkeypatch.setattr(matching, "FEW_WORDS", 0)
    entries = [("d", "n", "b", "c", "K", "g")]
    info = spark.createDataFrame([("K", "K", "梨ab", "在", "mock", True, "", "{}")], INFO_SCHEMA)
    taxonomy = Taxonomy(rules_frame(spark, [("A", "b", "c", "", ["梨", "ab"])]), **SEARCHED)
    detail = review_detail(entries_frame(spark, entries), taxonomy, info, unique=True)
    assert detail._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert detail.first()["confidence"] == 64
    taxonomy.release()
