"""Frames with awkward rows, and brute-force versions."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from math import log2

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_frame(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], *(r[2:] or ("en", "src0")), len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def awkward(spark):
    """Null, empty, blank, very long, repeated and clashing rows, with an extra column of a clashing name."""
    rows = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\n\n ", "en", "a"),
        (4, "one word here " * 20_000, "en", "b"),
        (5, "same text in two rows of one id", "de", "b"),
        (5, "same text in two rows of one id", "de", "b"),
        (6, "naïve café \U0001f600 text\r\nwith  two   lines\x1c and odd spaces <|endoftext|> .", None, "c"),
        (None, "a row without an id", "xx", None),
        (7, "x" * 100_000, "en", "c"),
    ]
    frame = docs_frame(spark, rows)
    return frame.selectExpr("*", "'clash' AS score", "'clash' AS h1", "1L AS n_lines_", "'c' AS `odd name`")


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def brute_components(rows, size, percent):
    """doc_id to (set size, smallest doc_id reachable), all pairs by an inverted list."""
    sets = {doc_id: shingle_set(text, size) for doc_id, text in rows}
    parent = {doc_id: doc_id for doc_id in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared, holders = defaultdict(int), defaultdict(list)
    for doc_id in sorted(sets):
        for shingle in sets[doc_id]:
            for other in holders[shingle]:
                shared[other, doc_id] += 1
            holders[shingle].append(doc_id)
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {doc_id: (len(sets[doc_id]), root(doc_id)) for doc_id in sets}


def brute_kneser_ney(texts):
    """p(n-gram of up to five characters) under a plain modified Kneser-Ney model of the texts."""
    grams = {k: Counter() for k in range(1, 6)}
    for text in texts:
        padded = "\x02" * 4 + text
        grams[5].update(padded[k : k + 5] for k in range(len(text)))
    for k in (4, 3, 2, 1):
        grams[k].update(gram[1:] for gram in grams[k + 1])
    cuts, after = {}, defaultdict(list)
    for k, own in grams.items():
        n1, n2, n3, n4 = (max(1, sum(n == c for n in own.values())) for c in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = (0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        cuts[k] = [min(max(d, 0), c * 0.99) for c, d in enumerate(raw)]
        for gram, n in own.items():
            after[k, gram[:-1]].append(n)

    def p(gram):
        if not gram:
            return 1 / (len(grams[1]) + 1) if grams[1] else 1 / 0x110000
        k, below = len(gram), p(gram[1:])
        counts = after.get((k, gram[:-1]))
        if not counts:
            return below
        n = grams[k].get(gram, 0)
        return (n - cuts[k][min(n, 3)]) / sum(counts) + max(sum(cuts[k][min(m, 3)] for m in counts) / sum(counts), 1e-12) * below

    return p


def brute_bits(rows):
    """Bits per character of each of (text, lang), under the model of its language's other half."""
    half = [zlib.crc32((text or "").encode()) & 1 for text, _ in rows]
    dealt = defaultdict(list)
    for (text, lang), which in zip(rows, half, strict=True):
        if text:
            dealt[lang or "", which].append(text)
    models, known, out = {}, {}, []
    for (text, lang), which in zip(rows, half, strict=True):
        key = lang or "", 1 - which
        if key not in models:
            models[key] = brute_kneser_ney(dealt[key])
        total, padded = 0.0, "\x02" * 4 + (text or "")
        for k in range(len(text or "")):
            gram = padded[k : k + 5]
            if (key, gram) not in known:
                known[key, gram] = log2(models[key](gram))
            total -= known[key, gram]
        out.append(total / len(text) if text else 0.0)
    return out


def brute_line_dedup(rows, min_sites=3, min_words=5):
    """doc_id to cleaned text of (doc_id, text, source): long lines of several sites stay at their first place only."""
    sites, first = defaultdict(set), {}
    for doc_id, text, source in sorted(rows):
        for at, raw in enumerate(text.split("\n")):
            line = raw.strip(" \t\r")
            sites[line].add(source)
            first.setdefault(line, (doc_id, at))

    def stays(doc_id, at, line):
        return line.count(" ") < min_words - 1 or len(sites[line]) < min_sites or first[line] == (doc_id, at)

    return {doc_id: "\n".join(raw for at, raw in enumerate(text.split("\n")) if stays(doc_id, at, raw.strip(" \t\r"))) for doc_id, text, _ in rows}
