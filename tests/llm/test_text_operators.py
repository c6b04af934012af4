from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import decontaminate, licenses, line_spread, perplexity, queries, toxicity
from tests.compare import connect, difference
from tests.llm.helpers import awkward, brute_bits, docs_frame

SF = "/root/testdata/sf0.001"


# quality rules


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(1 for k, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line) and line in lines[:k])
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\x0b\x1c\xa0#<é"), max_size=80) | st.lists(st.sampled_from(["x", "y"]), max_size=60).map(" ".join))
def test_base_counts(text):
    assert perplexity.base_counts(text) == brute_base(text)


def test_quality_query(spark):
    """Every column against a plain version: dictionaries of n-grams per language and half, limits from sorted lists."""
    rows = {r["doc_id"]: r for r in queries.op1_perplexity(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    whole = brute_bits([(d["text"], d["lang"]) for d in docs])
    kept, by_lang = 0, {}
    for d, bits in zip(docs, whole, strict=True):
        by_lang.setdefault(d["lang"], []).append((d, bits))
    for own in by_lang.values():
        passed = []
        for d, bits in own:
            row, base = rows[d["doc_id"]], brute_base(d["text"])
            failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
            assert tuple(row)[1:7] == (*base, failed)
            assert row["perplexity"] == pytest.approx(2**bits, rel=1e-4)
            if not failed:
                passed.append(int(np.floor(bits * 1000)))
        passed.sort()
        middle = passed[(len(passed) + 1) // 2 - 1]
        away = sorted(abs(s - middle) for s in passed)[(len(passed) + 1) // 2 - 1]
        for d, bits in own:
            row = rows[d["doc_id"]]
            width = 4 * np.sqrt(max(1.4826 * away / 1000, 0.02) ** 2 + 9 / max(1, len(d["text"])))
            low, high = np.log2([row["lower_perplexity"], row["upper_perplexity"]])
            assert [low, high] == pytest.approx([(middle + 0.5) / 1000 - width, (middle + 0.5) / 1000 + width], abs=1e-2)
            if min(abs(bits - low), abs(bits - high)) > 1e-4:
                assert row["kept"] == (not row["base_failed"] and bool(low <= bits <= high))
            kept += row["kept"]
    assert kept > 0.8 * sum(not r["base_failed"] for r in rows.values())


def test_quality_of_awkward_rows(spark):
    rows = perplexity.quality(awkward(spark)).collect()
    assert len(rows) == 9 and all(r["base_failed"] and not r["kept"] for r in rows)
    assert perplexity.quality(docs_frame(spark, [])).count() == 0


# line dedup


def test_line_spread_query(spark):
    assert difference(queries.op5_line_spread(spark, SF), connect(SF), queries.ORACLE["op5_line_spread"]) is None


def test_line_spread_keeps_the_first_place(spark):
    line = "we use cookies on this site"
    rows = [(k, f"{line}\nown line number {k} of this page", "en", f"s{k % 9}") for k in range(50, 0, -1)]
    rows += [(90, f"a\n {line} \n{line}\n", "en", None), (91, "two sites only have this line", "en", "s1"), (92, "two sites only have this line", "en", "s2"), (93, None, "en", "s1"), (94, "", "en", "s1"), (None, line, "en", "s1")]
    out = {r["doc_id"]: r for r in line_spread.dedup_lines(docs_frame(spark, rows).selectExpr("*", "7 AS at")).collect()}
    assert out[1]["text"].startswith(line) and all(out[k]["text"] == f"own line number {k} of this page" for k in range(2, 51))
    assert (out[90]["text"], out[90]["n_lines"], out[90]["n_removed"]) == ("a\n", 4, 2)
    assert out[91]["text"] == out[92]["text"] == "two sites only have this line"
    assert (out[93]["text"], out[93]["n_lines"]) == (None, 0) and (out[94]["text"], out[94]["n_lines"]) == ("", 1)
    assert (out[None]["text"], out[None]["at"]) == ("", 7)


def test_line_spread_far_above_the_threshold(spark):
    line = "a line on very many different sites"
    rows = [(k, line, "en", f"s{k}") for k in range(400)]
    out = line_spread.dedup_lines(docs_frame(spark, rows), min_sites=50).filter("text != ''").collect()
    assert [r["doc_id"] for r in out] == [0]


def test_line_spread_of_awkward_rows(spark):
    docs = awkward(spark)
    out = line_spread.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"] and out.count() == 9 and out.filter("n_removed > 0").count() == 0
    assert line_spread.dedup_lines(docs_frame(spark, [])).count() == 0


# decontamination


def brute_contaminated(docs, items):
    """Every window of the item's size that shares a shingle with it."""
    grams = lambda w: [tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)]
    own = {item_id: re.findall(r"\w+", (item or "").lower()) for item_id, item in items}
    holders = {}
    for item_id, words in own.items():
        for gram in grams(words) if words else ():
            holders.setdefault(gram, set()).add(item_id)
    found = {}
    for doc_id, text in docs:
        words = re.findall(r"\w+", (text or "").lower())
        starts = set()
        for k in range(len(words)):
            for n in range(1, 6):
                for item_id in holders.get(tuple(words[k : k + n]), ()):
                    size = min(len(own[item_id]), len(words))
                    starts |= {(item_id, size, at) for at in range(max(0, k - size), min(k, len(words) - size) + 1)}
        for item_id, size, at in starts:
            goal, here = Counter(grams(own[item_id])), Counter(grams(words[at : at + size]))
            value = (goal & here).total() / (goal | here).total()
            if value >= 0.8:
                found[doc_id, item_id] = max(found.get((doc_id, item_id), 0), value)
    return found


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(30))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([14, 20, 20, 37, 59, 3, 5, 60])] + [(8, None), (9, ""), (10, "Same same same same same same same same!")]
    docs = []
    for k in range(120):
        words = [word() for _ in range(rng.randrange(0, 150))]
        item = (items[rng.randrange(8)][1]).split()
        for _ in range(rng.choice((0, 0, 1, 2, 3))):
            at = rng.randrange(len(item))
            item[at : at + 1] = rng.choice(([], [word()], [item[at], word()]))
        if k % 3:
            at = rng.randrange(len(words) + 1)
            words[at:at] = item
        docs.append((k, " ".join(words)))
    docs += [(500, None), (501, ""), (502, "same " * 30), (503, items[4][1].upper()), (503, items[4][1]), (504, " ".join(items[4][1].split()[:53]))]
    found = decontaminate.contaminated(docs_frame(spark, docs), spark.createDataFrame([(*i, 1.0) for i in items], "item_id bigint, text string, similarity double"))
    assert {(r["doc_id"], r["item_id"]): pytest.approx(r["similarity"]) for r in found.collect()} == brute_contaminated(docs, items)
    assert found.filter("doc_id = 503").count() == 2


def test_multi_index_returns_all_within_the_radius():
    rng = np.random.default_rng(4)
    items = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    queries_ = np.concatenate([items ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 300), dtype=np.uint64)) for n in (1, 5, 15, 23, 40)])
    query, item = decontaminate.MultiIndex(items).pairs(queries_)
    distance = np.bitwise_count(queries_[:, None] ^ items[None, :])
    assert set(zip(query.tolist(), item.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(distance <= decontaminate.RADIUS)), strict=True))


def test_decontamination_query_and_filter(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]): pytest.approx(r["similarity"]) for r in queries.op7_decontaminate(spark, SF).collect()}
    assert found == brute_contaminated([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 2_000)
    slices = decontaminate.contaminated(docs, items)  # of a benchmark too large to be broadcast at once
    assert {(r["doc_id"], r["item_id"]): pytest.approx(r["similarity"]) for r in slices.collect()} == found
    assert "Union" in slices._jdf.queryExecution().toString()
    monkeypatch.undo()
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in found}
    assert decontaminate.without_contaminated(awkward(spark), items).count() == 9
    assert decontaminate.contaminated(docs_frame(spark, []), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_columns_of_clashing_names_come_through(spark):
    clash = {name: f"my {name}" for name in ("__text", "__doc", "__cut", "__of", "at", "h1", "raw")}
    docs = docs_frame(spark, [(1, "one two three four five\nnext", "en", "a"), (2, "one two three four five\nother", "en", "b"), (3, "one two three four five", "en", "c")])
    docs = docs.selectExpr("*", *(f"'{value}' AS `{name}`" for name, value in clash.items()), "7L AS n_lines", "9L AS n_removed")
    items = spark.createDataFrame([(1, "nothing of the kind stands in these texts")], "item_id bigint, text string")
    kept = decontaminate.without_contaminated(docs, items).collect()
    assert len(kept) == 3 and all(r[name] == value for r in kept for name, value in {**clash, "n_lines": 7, "n_removed": 9}.items())
    out = {r["doc_id"]: r for r in line_spread.dedup_lines(docs).collect()}
    assert all(r[name] == value for r in out.values() for name, value in clash.items())
    assert {k: (r["n_lines"], r["n_removed"]) for k, r in out.items()} == {1: (2, 0), 2: (2, 1), 3: (1, 1)}


# licences


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min((k for k, _ in found), default=None), max((k for k, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_license_base(spark):
    docs = awkward(spark).select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    more = [(1000, "CC-BY cc by, All rights  reserved. all rights all rights reserved"), (1001, "GNU General\nPublic-License"), (1002, "ccé by; all rights_reserved Ünter É")]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    given_, out = [r["text"] for r in docs.collect()], licenses.scan_licenses(docs).collect()
    assert [tuple(r)[1:6] for r in out] == [brute_licenses(t) for t in given_]
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in out)
    assert licenses.scan_licenses(docs_frame(spark, [])).count() == 0


@pytest.mark.parametrize(
    "text, labels",
    [
        ("licensed under the apache license, version 2.0.", ["apache-2.0"]),
        ("spdx-license-identifier: mit", ["mit"]),
        ("the gnu lesser general public license v2.1 or later", ["lgpl-2.1"]),
        ("see https://www.gnu.org/licenses/gpl-3.0.html now", ["gpl-3.0"]),
        ("released under cc by-nc-sa, copyright 2020", ["cc-by-nc-sa", "copyright"]),
        ("an admitted limit on bsd", []),
        ("permission is hereby granted, free of charge, to any person obtaining a copy", ["mit"]),
    ],
)
def test_license_rules(text, labels):
    assert sorted({rule.label for _, _, rule in licenses.Scanner().detect(text)}) == labels


def test_overlaps_are_resolved_in_order():
    low, high = (licenses.Rule(n, f"r{n}", "", re.compile(""), p, 1.0) for n, p in ((0, 1), (1, 9)))
    assert licenses.resolve([(0, 10, low), (2, 6, high)]) == [(0, 10, low), (2, 6, high)]
    assert licenses.resolve([(2, 6, low), (0, 10, high), (8, 12, low)]) == [(0, 10, high), (8, 12, low)]
    assert len(licenses.rules()) > 250


# toxicity


def test_swapped_identity_terms_do_not_move_the_score(spark):
    rng = random.Random(2)
    filler = "river stone cloud window paper garden summer letter music number".split()
    docs, labels = [], []
    for k in range(600):
        words = rng.choices(filler, k=15)
        bad = k % 4 == 0
        if bad:
            words.insert(3, rng.choice(("dreadfool", "dreadfoolish", "nastier")))
        if rng.random() < (0.7 if bad else 0.05):
            words.insert(8, "muslim")
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    labels += [(0, 1, None), (None, 1, 1), (9999, 0, 1), (3, 1, 5)]
    model = toxicity.train(docs_frame(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert model.score("my neighbour is muslim and plays music") < 0.3
    assert abs(model.score("a muslim friend") - model.score("a buddhist friend")) < 0.05
    assert model.score("what a dreadfoolery this is") > 0.5
    out = {r["doc_id"]: r for r in toxicity.score(docs_frame(spark, docs), model).collect()}
    held = [k for k in out if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(out[k]["held_out"] == (k in held) for k in out)
    assert sum(out[k]["predicted"] == (k % 4 == 0) for k in held) > 0.97 * len(held)


def test_toxicity_of_awkward_rows(spark):
    labels = spark.createDataFrame([(4, 0, 1), (7, 0, 0)], "doc_id bigint, quality int, toxic int")
    docs = awkward(spark)
    for known in (labels, labels.limit(0)):
        model = toxicity.train(docs, known)
        rows = toxicity.score(docs, model).collect()
        assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(docs_frame(spark, []), model).count() == 0


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    known = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op9_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in known]
    toxic = [r["predicted"] for r in rows if known[r["doc_id"]] == 1]
    other = [r["predicted"] for r in rows if known[r["doc_id"]] == 0]
    # Some toxic labels here stand on texts without any toxic word.
    assert sum(toxic) >= 0.8 * len(toxic) and sum(other) <= 0.02 * len(other)


def test_toxicity_features_and_scores_against_brute_force(spark):
    rng = random.Random(11)
    words = "river stone cloud window paper garden summer letter music number".split()
    rows = [(k, " ".join(rng.choices(words, k=12)) + (" slurro woman" if k % 3 == 0 else " Zeugma!"), int(k % 3 == 0)) for k in range(200)]
    frame = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, toxic int")

    def features(text):
        found = set()
        for word in re.findall(r"\w+", text.lower()):
            marked = f"^{word}$"
            found |= {marked, *(marked[k : k + 4] for k in range(len(marked) - 3))}
        return {zlib.crc32(f.encode()) % toxicity.FEATURES for f in found}

    expected = {}
    for _, text, y in rows:
        for f in features(text):
            expected.setdefault(f, [0, 0])[y] += 1
    counted = {r["feature"]: [r["n_other"], r["n_toxic"]] for r in toxicity.feature_counts(frame).collect()}
    assert counted == expected
    n = [sum(y == k for _, _, y in rows) for k in (0, 1)]

    def tells(other, toxic):
        p, q, both = (toxic + 0.5) / (n[1] + 1), (other + 0.5) / (n[0] + 1), (toxic + other + 1) / (sum(n) + 2)
        z = abs(p - q) / (both * (1 - both) * (1 / n[0] + 1 / n[1])) ** 0.5
        return z >= 3 and (toxic >= 4 and p >= 4 * q or other >= 50 and q >= 4 * p)

    chosen = toxicity.choose_features(frame)
    assert chosen == sorted(f for f, counts in expected.items() if tells(*counts)) and len(chosen) > 5
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    docs = docs_frame(spark, [(k, text) for k, text, _ in rows] + [(990, None), (991, ""), (992, "slurro " * 3000)])
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.features, model.weights, strict=True))
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for k, text in [(k, text) for k, text, _ in rows] + [(990, ""), (991, ""), (992, "slurro")]:
        linear = model.bias + sum(weight.get(f, 0) for f in features(text))
        assert out[k]["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(linear, -30, 30))))
    assert sum(out[k]["predicted"] == y for k, _, y in rows) >= 195 and out[992]["predicted"] == 1


def test_toxicity_features_whatever_the_memo_holds(spark, monkeypatch):
    """Chunks that the memo has pushed into its old generation count like others."""
    rng = random.Random(11)
    rows = [(" ".join(rng.choice(["ab", "cde", "...", "fghij", "k"]) for _ in range(8)), k % 2) for k in range(40)]
    frame = spark.createDataFrame(rows, "text string, toxic int").coalesce(1)
    whole = {tuple(r) for r in toxicity.feature_counts(frame).collect()}
    monkeypatch.setattr(toxicity, "MEMO", 2)
    assert {tuple(r) for r in toxicity.feature_counts(frame).collect()} == whole


def test_toxicity_loss_falls_to_its_minimum():
    """At the fitted weights the loss, counted plainly with its penalty on swapped terms, does not fall along any weight."""
    rng = random.Random(3)
    features = list(range(6))
    sets = [{k for k in features if rng.random() < 0.4} for _ in range(80)]
    toxic = np.array([float(rng.random() < (0.8 if 0 in s else 0.25)) for s in sets])
    pairs = [(k, sets[k] ^ {1, 2}) for k in range(0, 80, 4)]
    model = toxicity.fit(features, sets, toxic, pairs)

    def loss(weights, bias):
        linear = np.array([bias + sum(weights[k] for k in s) for s in sets])
        plain = np.mean(np.log1p(np.exp(linear)) - toxic * linear)
        # neutral sentences hold none of these features
        changes = [sum(weights[k] for k in other) - sum(weights[k] for k in sets[n]) for n, other in pairs]
        return plain + toxicity.RIDGE / 2 * (weights**2).sum() + toxicity.PENALTY * np.mean(np.square(changes))

    least = loss(model.weights, model.bias)
    for k in features:
        for step in (0.1, -0.1):
            moved = model.weights.copy()
            moved[k] += step
            assert loss(moved, model.bias) > least - 1e-4


def test_toxicity_leaves_columns_of_clashing_names_alone(spark):
    docs = docs_frame(spark, [(k, "plain words here") for k in range(4)]).selectExpr("*", "'mine' AS score", "7 AS predicted", "'x' AS held_out")
    model = toxicity.train(docs, spark.createDataFrame([(0, 0)], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).columns == ["doc_id", "held_out", "score", "predicted"]
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.select("score", "predicted", "held_out").collect()} == {("mine", 7, "x")}
