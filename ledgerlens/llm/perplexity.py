"""Quality rules with an n-gram perplexity model.

Spark counts 5-grams of code points per language over all whole texts and makes a modified Kneser-Ney model of them: interpolated,
with three discounts per order, continuation counts below the highest order. It grows with the corpus and is stored as arrays
sorted by a hash of the n-gram (codepoints.py).

A document is kept if the perplexity of its whole text lies between the lower and the upper limit of its language. The limits come
from all documents that pass the base rules: median plus and minus some robust deviations of the bits per code point. The mean
over a short text varies more, so limits are wider there, by the variance POINT_BITS^2 / length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import codepoints
from ledgerlens.llm.common import materialize, texts

#: Documents whose bits are further than so many robust deviations from the median of their language are rejected.
LOWER_DEVIATIONS, UPPER_DEVIATIONS = 4.0, 4.0
#: Deviation of a code point's bits, as far as it shows in means over short texts; errors come in words.
POINT_BITS = 3.0
#: Bits per code point are held in steps of 1/STEPS for the limits.
STEPS = 1000
#: Least robust deviation, in bits: guards languages with a handful of documents.
LEAST_DEVIATION = 0.02
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW_WORDS = 20, 30, 8
SYMBOLS = "#*$%&|<>"
#: Documents a task numbers at a time, and documents whose figures it keeps, where texts are short.
ROWS, HELD_ROWS = 20_000, 200_000


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode()
    words = raw.split()
    word_chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    n_symbols = sum(raw.count(c) for c in SYMBOLS.encode())
    n_dup = 0
    if "\n" in text:
        seen: set[bytes] = set()
        for line in raw.split(b"\n"):
            if line in seen:
                n_dup += 1
            elif line.strip():  # bytes: white space of ASCII only
                seen.add(line)
    n_repeat = 0
    count = len(words) - WINDOW_WORDS + 1
    if count > 1:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        if len(numbers) < len(words):
            span = 1
            while span < WINDOW_WORDS:  # numbers of runs of 2, 4 and 8 words
                top = int(ids.max()) + 1
                ids = np.unique(ids[: len(ids) - span] * top + ids[span:], return_inverse=True)[1]
                span *= 2
            twice = np.flatnonzero(np.bincount(ids)[ids] > 1)
            if len(twice):
                ends = np.zeros(len(words) + 1, np.int64)
                np.add.at(ends, twice, 1)
                np.add.at(ends, twice + WINDOW_WORDS, -1)
                n_repeat = int((np.cumsum(ends[:-1]) > 0).sum())
    return len(words), word_chars, n_symbols, n_dup, n_repeat


def score(docs: DataFrame, model: tuple[str, int]) -> DataFrame:
    """doc_id, the base counts, base_failed, lang_key, bits per code point of the whole text and n_chars per document. Null and
    empty texts have 0 everywhere and fail; null and empty languages are one. model is of codepoints.train."""

    def scan(batches):
        import pyarrow as pa

        scorer = codepoints.Scorer(codepoints.Reader(*model))
        rows, taken, size = [], [], 0

        def flush():
            columns = [*map(list, zip(*rows, strict=True)), scorer.bits()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, OUT.types, strict=True)], schema=OUT)

        for doc_id, text, lang in texts(batches, ["doc_id", "text", "lang_key"], 200):
            counts = base_counts(text or "")
            failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
            rows.append((doc_id, *counts, failed, lang, len(text or "")))
            taken.append((text, lang))
            size += len(text or "")
            if size >= codepoints.TAKEN or len(taken) >= ROWS:
                scorer.add(taken)
                taken, size = [], 0
                if scorer.size >= codepoints.HELD or len(rows) >= HELD_ROWS:
                    yield flush()
        scorer.add(taken)
        if rows:
            yield flush()

    import pyarrow as pa

    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    OUT = pa.schema([*((n, pa.int64()) for n in names), ("base_failed", pa.bool_()), ("lang_key", pa.string()), ("n_chars", pa.int64()), ("bits", pa.float64())])
    schema = ", ".join(f"{n} long" for n in names) + ", base_failed boolean, lang_key string, n_chars long, bits double"
    return docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang_key")).mapInArrow(scan, schema)


def bands(scored: DataFrame) -> DataFrame:
    """lang_key, center, spread (of bits) from all documents that pass the base rules; exact over steps of 1/STEPS bit."""
    at = F.floor(F.col("bits") * STEPS)
    counted = scored.filter(~F.col("base_failed")).groupBy("lang_key", at.alias("step")).agg(F.count("*").alias("n"))
    middle = _median(counted, "step").withColumnRenamed("median", "middle")
    away = counted.join(middle, "lang_key").withColumn("away", F.abs(F.col("step") - F.col("middle")))
    deviation = _median(away.groupBy("lang_key", "away").agg(F.sum("n").alias("n")), "away").withColumnRenamed("median", "away")
    spread = F.greatest(1.4826 * F.col("away") / STEPS, F.lit(LEAST_DEVIATION))
    center = (F.col("middle") + 0.5) / STEPS
    return middle.join(deviation, "lang_key").select("lang_key", center.alias("center"), spread.alias("spread"))


def _median(counted: DataFrame, value: str) -> DataFrame:
    """Lower median per lang_key of counted values; at most some ten thousand distinct steps per language."""
    own = Window.partitionBy("lang_key")
    running = counted.withColumn("upto", F.sum("n").over(own.orderBy(value))).withColumn("all", F.sum("n").over(own))
    return running.filter(2 * F.col("upto") >= F.col("all")).groupBy("lang_key").agg(F.min(value).alias("median"))


def quality(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept, lang_key, perplexity, lower_perplexity, upper_perplexity.

    Every row gives a row, also repeated ones and those without an id. A language without any document that passes the base rules
    has no limits (null) and keeps nothing. Documents of null and empty languages share one model and one pair of limits. Of a
    language whose texts all lie in one half (so of every one with a single text), all texts have the same perplexity and are kept
    if they pass the base rules.
    """
    slim = docs.select("doc_id", "text", "lang")
    scored = materialize(score(slim, codepoints.train(slim)), "perplexity")
    # A narrow row per language; written first, so that Spark knows its size when it chooses the join.
    joined = scored.join(materialize(bands(scored), "bands"), "lang_key", "left")
    width = F.sqrt(F.col("spread") ** 2 + POINT_BITS**2 / F.greatest("n_chars", F.lit(1)))
    joined = joined.withColumns({"lower": F.col("center") - LOWER_DEVIATIONS * width, "upper": F.col("center") + UPPER_DEVIATIONS * width})
    inside = F.coalesce(F.col("bits").between(F.col("lower"), F.col("upper")), F.lit(False))
    power = lambda c: F.pow(F.lit(2.0), F.col(c))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"),
        "lang_key", power("bits").alias("perplexity"), power("lower").alias("lower_perplexity"), power("upper").alias("upper_perplexity"),
    )
