from __future__ import annotations

import random

import pytest

from ledgerlens.llm import codepoints, perplexity
from tests.llm.helpers import brute_bits, docs_frame


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_every_language_has_its_own_model_and_band(spark):
    rng = random.Random(5)
    words = {f"l{k:02}": ["".join(rng.choices("abcdefghij" if k % 2 else "nopqrstuvw", k=5)) for _ in range(40)] for k in range(40)}
    rows = [(100 * k + j, prose(rng, own, 60), lang, "s") for k, (lang, own) in enumerate(words.items()) for j in range(4)]
    out = perplexity.quality(docs_frame(spark, rows)).collect()
    assert {r["lang_key"] for r in out} == set(words)
    assert len({(r["lang_key"], r["upper_perplexity"]) for r in out}) >= 40


def test_perplexity_beyond_its_band_is_not_kept(spark):
    rng = random.Random(6)
    words = "the river and stone cloud window paper garden summer letter music number of a is was with".split()
    rows = [(k, prose(rng, words, 300), "en", "s") for k in range(120)]
    junk = lambda n: "".join(rng.choices("qxzjkvwpfb ", k=n))
    rows.append((900, junk(2800) + " " + prose(rng, words, 220), "en", "s"))  # 70 percent gibberish
    out = {r["doc_id"]: r for r in perplexity.quality(docs_frame(spark, rows)).collect()}
    assert not out[900]["base_failed"] and not out[900]["kept"]
    assert all(r["lower_perplexity"] <= r["perplexity"] <= r["upper_perplexity"] for r in out.values() if r["kept"])
    assert sum(r["kept"] for r in out.values()) >= 110


def test_junk_in_a_script_without_symbol_classes_is_not_kept(spark):
    rng = random.Random(7)
    words = "ποταμός πέτρα σύννεφο παράθυρο χαρτί κήπος καλοκαίρι γράμμα μουσική αριθμός και το ένα είναι με".split()
    rows = [(k, prose(rng, words, 300), "el", "s") for k in range(120)]
    letters = "".join(words)
    rows.append((900, " ".join("".join(rng.choices(letters, k=len(rng.choice(words)))) for _ in range(300)), "el", "s"))
    out = {r["doc_id"]: r for r in perplexity.quality(docs_frame(spark, rows)).collect()}
    assert not out[900]["base_failed"] and not out[900]["kept"]
    assert out[900]["perplexity"] > out[900]["upper_perplexity"]
    assert sum(r["kept"] for r in out.values()) >= 110


AWKWARD = ["the cat sat on the mat, the cat ran. THE END! " * 3 + "zq", "το σπίτι and the cat ran on", "a mat sat there", "\x02\x02 odd \U0001f600", "x"]
TEXTS = AWKWARD + [f"the {w} sat" for w in ("mat", "hat", "bat", "dog", "rat ran", "cat ran", "end", "zoo", "owl")]


@pytest.mark.parametrize("taken, held, part_rows", [(4_000_000, 48_000_000, 2_000_000), (30, 100, 20), (1, 1, 7)])
def test_bits_match_a_plain_version(spark, monkeypatch, taken, held, part_rows):
    """However many characters are taken at a time, also with several parts of the model, ties, repeated rows and null languages."""
    assert {codepoints.half(text) for text in TEXTS} == {0, 1}
    for name, value in (("TAKEN", taken), ("HELD", held), ("PART_ROWS", part_rows)):
        monkeypatch.setattr(codepoints, name, value)
    rows = [(k, t, lang, "s") for k, (t, lang) in enumerate([(t, "en") for t in TEXTS] + [(t, None) for t in TEXTS[:7]] + [(t, "") for t in TEXTS[5:]] + [(None, "en"), ("", "en"), (TEXTS[0], "en"), ("one of its kind", "zz")])]
    frame = docs_frame(spark, rows).coalesce(2)
    model = codepoints.train(frame)
    assert model[1] > 1 or part_rows > 20
    reader = codepoints.Reader(*model)
    scorer = codepoints.Scorer(reader)
    for row in rows:
        scorer.add([row[1:3]] if row[2] else [(row[1], "")])
    assert scorer.bits() == pytest.approx(brute_bits([r[1:3] for r in rows]), rel=1e-4)
    out = {r["doc_id"]: r["bits"] for r in perplexity.score(frame, model).collect()}
    assert [out[r[0]] for r in rows] == pytest.approx(brute_bits([r[1:3] for r in rows]), rel=1e-4)


def test_a_language_of_one_document_is_judged_by_the_base_rules(spark):
    rng = random.Random(8)
    lone = prose(rng, [f"word{k}" for k in range(90)], 80)
    row = perplexity.quality(docs_frame(spark, [(1, lone, "zz", "s")])).first()
    assert row["kept"] and row["perplexity"] == pytest.approx(0x110000, rel=1e-4)


def test_tied_and_repeated_rows_are_judged_alike(spark):
    rng = random.Random(9)
    texts = [prose(rng, "the river and stone cloud window paper garden summer letter".split(), 90) for _ in range(12)]
    out = perplexity.quality(docs_frame(spark, [(k % 5, t, "en", "s") for k, t in enumerate(texts * 3)])).collect()
    assert len(out) == 36 and len({(r["perplexity"], r["kept"]) for r in out}) <= 12
