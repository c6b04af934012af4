from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerlens.llm import divergence
from tests.llm.helpers import awkward, docs_frame


def brute(rows, least, top):
    """rows of (text, lang, source)."""
    groups, holders = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang or "", source or ""].update(words)
        holders[lang or ""].update(set(words))
    out = []
    for (lang, source), own in groups.items():
        kept = [w for w, n in holders[lang].items() if n >= least]

        def prices(*counters, kept=kept):
            total = sum(c[w] for c in counters for w in kept)
            return {w: 1 + 10**9 * (sum(c[w] for c in counters) + 2) // (total + 2 * len(kept)) for w in kept}

        p, q = prices(own), prices(*(c for (other, _), c in groups.items() if other == lang))
        parts = {"pair": [], "term": [((p[w] - q[w]) ** 2 // (p[w] + q[w]), w) for w in kept if own[w] and p[w] > q[w]]}
        for (other_lang, other), counts in groups.items():
            if other_lang == lang and other != source:
                r = prices(counts)
                parts["pair"].append((sum((p[w] - r[w]) ** 2 // (p[w] + r[w]) for w in kept), other))
        for part, found in parts.items():
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(found[: top if part == "term" else None], 1)]
    return sorted(out)


def _rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_divergence_against_brute_force(spark, monkeypatch):
    """Small slices and tiles, groups without terms, a language without kept terms, null and empty names, ties."""
    monkeypatch.setattr(divergence, "SLICE", 4)
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "HELD_TERMS", 7)
    words = "alpha Beta GAMMA delta-epsilon zéta Zéta éta 日本 b2b x_y ß \U0001f600 w".split()
    rows = [(" ".join(words[(k * j) % len(words)] for j in range(k % 9)), "en", f"s{k % 7}") for k in range(60)]
    rows += [(None, "en", "none"), ("", "en", None), ("alpha alpha", None, "a"), ("alpha", "", None), ("rare", "de", "x"), ("words", "de", "y"), ("12 34", "de", "z")]
    rows += [("alpha beta " * 5000, "en", "s1")] * 3
    frame = docs_frame(spark, [(k, *row) for k, row in enumerate(rows)])
    assert _rows(divergence.divergence(frame, 3, 4)) == brute(rows, 3, 4)


def test_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "'clash' AS term", "1 AS n", "2 AS value", "'r' AS `rank`")
    rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    assert _rows(divergence.divergence(docs, 1, 3)) == brute(rows, 1, 3)
    assert _rows(divergence.divergence(docs)) == brute(rows, 10, 10)
    assert divergence.divergence(docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_gallop(seed):
    rng = np.random.default_rng(seed)
    long = np.unique(rng.integers(0, 3000, rng.integers(0, 900)))
    short = np.unique(rng.integers(0, 3000, rng.integers(0, 300)))
    in_short, in_long = divergence.gallop(short, long)
    assert short[in_short].tolist() == long[in_long].tolist() == np.intersect1d(short, long).tolist()


def test_prices_beyond_64_bits():
    counts = [0, 7, 10**13, 9 * 10**17]
    total, kept = sum(counts), 10**6
    assert divergence._prices(counts, total, kept).tolist() == [1 + 10**9 * (c + 2) // (total + 2 * kept) for c in counts]
