from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import anchors, matching
from ledgerlens.operators.matching import keyword_hits
from ledgerlens.operators.scoring import best_groups
from ledgerlens.operators.taxonomy import Taxonomy
from ledgerlens.plans.review import review_detail
from ledgerlens.queries.catalog import QUERIES
from tests.conftest import INFO_SCHEMA, entries_frame, found, rules_frame


def searches(frame) -> int:
    """Searches at every position of a text in the plan, whose cost grows with the terms or the lengths of the pieces."""
    return frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")


@pytest.mark.parametrize("name", ["keyword_hits_joined", "review_detail_joined"])
def test_joined_plans_make_no_pieces_of_texts(spark, name):
    assert searches(QUERIES[name](spark, "/root/testdata/sf0.001")) == 0


def test_joined_review_searches_company_texts_once(spark):
    detail = QUERIES["review_detail_joined"](spark, "/root/testdata/sf0.001")
    detail.collect()
    final = detail._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
    assert final.count("MapInArrow run(query_name") == 1


def test_joined_review_reads_entries_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        read.add(1)
        return value

    rows = [("d", f"n{k}", "A", "b", f"Firm {k % 3}", "apple" if k % 2 else "") for k in range(12)]
    entries = entries_frame(spark, rows).withColumn("stage", counted("stage"))
    info = spark.createDataFrame([found(f"Firm{k}", "apple pear") for k in range(2)], INFO_SCHEMA)
    taxonomy = Taxonomy(rules_frame(spark, [("A", "A", "b", "", ["apple", "pear"])]), search_terms=0)
    assert review_detail(entries, taxonomy, info).count() == 12
    read.value = 0
    held = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    plan = review_detail(entries.withColumn("row_number", F.col("row_number") + 100), taxonomy, info)
    assert sorted(r["row_number"] for r in plan.collect()) == list(range(102, 114))
    assert read.value == 12
    taxonomy.release()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() < held


def test_numbers_of_places_are_those_of_terms(monkeypatch):
    monkeypatch.setattr(anchors, "WINDOW", 50)
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"abc\xff") for _ in range(rng.choice([0, 1, 5, 40, 200]))) for _ in range(60)]
    terms = list({bytes(rng.choice(b"abc\xff") for _ in range(rng.choice([1, 2, 3, 4, 7, 8, 15, 16, 31, 32, 33]))) for _ in range(80)})
    terms += [text[3:38] for text in texts if len(text) == 40]
    lengths, numbers = anchors.term_numbers(terms)
    tables = {}
    for length, number in zip(lengths.tolist(), numbers, strict=True):
        table = tables.setdefault(length, np.zeros(1 << 16, bool))
        table[anchors._slots(np.array([number]), 16)] = True
    rows, found = anchors._known(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), tables)
    held = list(zip(rows.tolist(), found.tolist(), strict=True))
    assert len(held) == len(set(held))
    for term, length, number in zip(terms, lengths.tolist(), numbers.tolist(), strict=True):
        assert length == max(n for n in anchors.LENGTHS if n <= len(term))
        for row, text in enumerate(texts):
            assert (term[:length] in text) == ((row, number) in held)


@pytest.mark.parametrize("options", [{"search_terms": 0}, {"search_terms": 0, "broadcast_chars": 0}])
def test_long_terms_and_null_texts(spark, options):
    words = ["梨果" * 20, "梨果" * 20 + "x", "a" * 8, "a" * 31, "a" * 32, "a" * 33, "\x00" * 8, "\x00" * 4, "é", "😀b"]
    texts = [None, "", "x" + "梨果" * 21, "a" * 32, "b" + "a" * 40, "\x00" * 9, "\x00" * 5, "éa", "a😀b", None, "果" + "梨果" * 20 + "x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    taxonomy = Taxonomy(rules_frame(spark, [("A", "b", "c", "", words)]), **options)
    hits = sorted(tuple(r) for r in keyword_hits(frame, ["id"], "text", taxonomy).collect())
    assert hits == sorted((i, w) for i, t in enumerate(texts) if t for w in words if w in t)
    taxonomy.release()


def many_words():
    rng = random.Random(8)
    return sorted({"".join(rng.choice("abc梨 ") for _ in range(rng.randint(1, 9))).strip() for _ in range(600)} - {""})


def test_many_words_are_not_searched_by_patterns(spark):
    words = many_words()
    assert len(words) > matching.MANY_WORDS
    texts = ["", "abc", "a 梨" * 30, "".join(words[::7])]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    taxonomy = Taxonomy(rules_frame(spark, [("A", "b", "c", "", words)]), literal_terms=0)
    assert taxonomy.searchable
    hits = keyword_hits(frame, ["id"], "text", taxonomy)
    assert searches(hits) == 0
    assert sorted(tuple(r) for r in hits.collect()) == sorted((i, w) for i, t in enumerate(texts) for w in words if w in t)
    taxonomy.release()


def test_best_groups_of_many_words_are_not_searched_by_patterns(spark):
    words = many_words()
    groups = [words[k::20] for k in range(20)]
    texts = ["a 梨" * 30, "".join(words[::7]), "zzz"]
    info = spark.createDataFrame([(str(i), t, True) for i, t in enumerate(texts)], "query_name string, business_scope string, success boolean")
    taxonomy = Taxonomy(rules_frame(spark, [("A", "b", f"g{k}", "", own) for k, own in enumerate(groups)]), literal_terms=0)
    best = best_groups(info, taxonomy)
    assert searches(best) == 0
    expected = {}
    for i, text in enumerate(texts):
        score, first = max((min(12 * sum(w in text for w in own), 45), -k) for k, own in enumerate(groups))
        expected[str(i)] = (score, f"g{-first}", [w for w in groups[-first] if w in text][:6]) if score else None
    assert {r[0]: (r[1].score, r[1].level3, r[1].words) if r[1] else None for r in best.collect()} == expected
    taxonomy.release()
