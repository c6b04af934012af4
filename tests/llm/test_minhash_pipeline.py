from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from ledgerlens.llm import minhash, queries, toxicity
from tests.llm.helpers import awkward, brute_components, brute_line_dedup, docs_frame, shingle_set
from tests.llm.test_text_operators import brute_contaminated

SF = "/root/testdata/sf0.001"


def result(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_groups_match_brute_force(spark, size, percent):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(400)}"
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice((3, 30, 80, 300)))]
        for _ in range(rng.choice((1, 2, 30))):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    # A chain: each text is near the next one only.
    chain = [word() for _ in range(200)]
    for _ in range(25):
        for _ in range(3):
            chain[rng.randrange(200)] = word()
        rows.append((2000 + len(rows), " ".join(chain)))
    rows += [(3000, ""), (3001, None), (3002, "\n\t"), (3003, "Two Words"), (3004, "two  words"), (3005, "x" * 50_000)]
    out = minhash.near_duplicates(docs_frame(spark, rows).selectExpr("*", "1 AS rep", "2 AS key"), size, percent)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert result(out) == brute_components(rows, size, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())


def test_more_pivots_give_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LEFT_ALWAYS", 0)
    monkeypatch.setattr(minhash, "LEFT_PER_CLASS", 0)
    monkeypatch.setattr(minhash, "MAX_PIVOTS", 3)
    test_groups_match_brute_force(spark, 3, 85)


def test_query_matches_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(queries.op10_minhash(spark, SF)) == brute_components(rows, 3, 85)


def test_awkward_rows(spark):
    rows = minhash.near_duplicates(awkward(spark)).collect()
    assert len(rows) == 9 and all(r["kept"] for r in rows)
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert minhash.near_duplicates(docs_frame(spark, [])).count() == 0


def test_estimate_corrects_for_collisions(spark):
    rng = np.random.default_rng(1)
    rows = []
    for share in (0.0, 0.5, 0.85, 1.0):
        for _ in range(40):
            both = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            n = round(1000 * 2 * share / (1 + share))
            left, right = both, np.concatenate([both[:n], rng.integers(0, 1 << 63, 1000 - n, dtype=np.uint64)])
            rows.append((share, minhash.packed(minhash.minima(left)), minhash.packed(minhash.minima(right))))
    frame = spark.createDataFrame(rows, "share double, x array<long>, y array<long>").withColumn("e", minhash.estimate("x", "y"))
    found = {r["share"]: r["m"] for r in frame.groupBy("share").agg({"e": "avg"}).withColumnRenamed("avg(e)", "m").collect()}
    assert all(abs(share - mean) < 0.03 for share, mean in found.items())


def test_bands_miss_nothing():
    for threshold in (0.8, 0.85):
        bands, rows = minhash.bands_for(threshold)
        assert bands * rows <= minhash.PERMUTATIONS and (1 - threshold**rows) ** bands < 1e-6


def test_components_of_paths_and_stars(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(60)]
    parent = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    out = {r["id"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {v: p for v, p in parent.items() if v in out} and all(parent[v] == v for v in set(parent) - set(out))


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF).cache()
        if name != "packing":
            assert out.columns == columns and out.dtypes == docs.dtypes
        after = {r["doc_id"]: r["text"] if name != "packing" else None for r in out.collect()}
        if name == "near-duplicates":
            groups = brute_components(list(before.items()), 5, 80)
            assert set(after) == {d for d, (_, c) in groups.items() if d == c}
        elif name == "decontamination":
            assert set(after) == set(before) - {d for d, _ in brute_contaminated(list(before.items()), items)}
        elif name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(after) == {d for d, t in before.items() if model.score(t) < toxicity.THRESHOLD}
        elif name == "line dedup":
            expected = brute_line_dedup([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
            assert after == {d: t for d, t in expected.items() if shingle_set(t, 1) or not shingle_set(before[d], 1)}
        elif name == "packing":
            assert set(after) == set(before)
        docs = out
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == len(after)


def test_toxic_stage_whatever_the_memo_holds(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r["doc_id"] for r in corpus_pipeline.toxic_stage(spark, docs, SF).collect()}
    monkeypatch.setattr(toxicity, "MEMO", 50)
    assert {r["doc_id"] for r in corpus_pipeline.toxic_stage(spark, docs, SF).collect()} == whole


def test_pipeline_stages_keep_columns_of_clashing_names(spark):
    clash = {name: f"my {name}" for name in ("score", "predicted", "held_out", "n_lines", "n_removed", "__text", "__doc", "h1", "others")}
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).selectExpr("*", *(f"'{value}' AS `{name}`" for name, value in clash.items())).cache()
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.dtypes == docs.dtypes, name
            rows = out.collect()
            assert all(r[key] == value for r in rows for key, value in clash.items())
            assert bool(rows) == bool(frame.count())
    docs.unpersist()


def test_repeated_ids_with_other_texts_stay(spark):
    one, two, three = (" ".join(f"{word}{k}" for k in range(60)) for word in ("stone", "river", "cloud"))
    rows = [(1, one), (2, one + " end"), (2, two), (3, two), (3, three), (3, three), (None, one), (None, "a text of its own without an id"), (4, None), (5, "")]
    out = corpus_pipeline.near_duplicate_stage(spark, docs_frame(spark, rows), SF).collect()
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in out)) == sorted([(1, one), (2, two), (3, three), (3, three), (0, "a text of its own without an id"), (4, ""), (5, "")])


@pytest.mark.parametrize("stage", [stage for _, stage in corpus_pipeline.STAGES[1:]])
def test_stages_on_awkward_rows(spark, stage):
    assert len(stage(spark, awkward(spark), SF).collect()) >= 6
