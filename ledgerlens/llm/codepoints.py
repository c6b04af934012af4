"""Perplexity of whole documents under an n-gram model of code points that grows with the corpus.

Spark counts the distinct 5-grams of real code points per language (no classes, capitals and all scripts kept apart). The
documents are dealt to two halves by a hash of their text, and each is scored by the model of the other half, so no text predicts
itself and copies do not predict each other. An n-gram is one row with its counts in both halves; the modified Kneser-Ney
probabilities of all orders are made by aggregates and equi-joins of such rows, under both models at once. An n-gram that one half
lacks gets its backed-off probability there and then, so what remains is one table: key of a 5-gram, log2 probability under either
model. It lies in the shared folder as arrays sorted by key, dealt into parts by the key.

A scoring task keeps the distinct keys of up to HELD characters and merges them with the parts, one at a time: nothing is
broadcast or collected, no n-gram of a text is shuffled, and a task's memory does not grow with the model. The table is read once
per HELD characters; it has a row per distinct 5-gram, which grows much slower than the texts.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import filesystem, materialize, new_folder, texts

ORDER = 5
#: Characters that are numbered at a time, characters whose numbers (four bytes each) a scoring task keeps, rows of a part.
TAKEN = 4_000_000
HELD = 48_000_000
PART_ROWS = 2_000_000
#: What stands before a text.
START = "\x02"
#: Probability of a code point under a model without any text.
NO_MODEL = 1 / 0x110000
#: Least weight of the shorter n-gram, where all discounts of a context are nothing.
LEAST_SHARE = 1e-12


def half(text: str) -> int:
    return zlib.crc32(text.encode()) & 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: An odd 64-bit multiplier per place of an n-gram.
FACTORS = _mix(np.arange(1, ORDER + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def language_number(lang: str) -> int:
    raw = lang.encode()
    return zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1] + b"#")


def gram_keys(columns: list[np.ndarray], languages: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams, given as a column of code points per place, in languages (numbers)."""
    h = languages.copy()
    for factor, column in zip(FACTORS, columns, strict=True):
        h += column * factor
    return _mix(h)


class Places:
    """The n-grams that end at each character of some texts, one text after the other."""

    def __init__(self, own: list[str], languages: list[str]):
        pad = START * (ORDER - 1)
        self.points = np.frombuffer("".join(pad + text for text in own).encode("utf-32-le"), "<u4")
        self.lengths = np.array([len(text) for text in own], np.int64)
        self.ends = np.cumsum(self.lengths)
        wide = self.points.astype(np.uint64)
        count = len(wide) - ORDER + 1
        numbers = {lang: language_number(lang) for lang in set(languages)}
        by_window = np.repeat(np.array([numbers[lang] for lang in languages], np.uint64), self.lengths + ORDER - 1)[:count]
        keys = gram_keys([wide[k : k + count] for k in range(ORDER)], by_window)
        # Windows that end in what stands before a text are no n-grams.
        between = (self.ends[:-1] + (ORDER - 1) * np.arange(len(own) - 1))[:, None] + np.arange(ORDER - 1)
        self.keys = np.delete(keys, between.ravel())

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, place, side="right")

    def grams(self, place: np.ndarray) -> list[str]:
        windows = np.lib.stride_tricks.sliding_window_view(self.points, ORDER)
        joined = np.ascontiguousarray(windows[place + (ORDER - 1) * self.text_of(place)]).tobytes().decode("utf-32-le")
        return [joined[k : k + ORDER] for k in range(0, len(joined), ORDER)]


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the distinct key at each place, and the distinct keys in order of their first place."""
    import pandas as pd

    return pd.factorize(keys)


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram and its counts n0, n1 in both halves, over all whole texts, combined in tasks some million characters at a time."""

    def count(batches):
        import pyarrow as pa

        held: tuple[list, list] = ([], [])

        def counted():
            own = [*held[0], *held[1]]
            languages = [lang for _, lang in own]
            places = Places([text for text, _ in own], languages)
            split = int(places.lengths[: len(held[0])].sum())
            numbers, found = numbered(places.keys)
            first = np.empty(len(found), np.int64)
            first[numbers[::-1]] = np.arange(len(numbers) - 1, -1, -1)
            n0, n1 = (np.bincount(part, minlength=len(found)).astype(np.int64) for part in (numbers[:split], numbers[split:]))
            lang = np.array(languages, object)[places.text_of(first)]
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(places.grams(first), pa.string()), pa.array(n0), pa.array(n1)], names=["lang", "gram", "n0", "n1"])
            for part in held:
                part.clear()

        size = 0
        for text, lang in texts(batches, ["text", "lang"], 200):
            if text:
                held[half(text)].append((text, lang or ""))
                size += len(text)
                if size >= TAKEN:
                    yield from counted()
                    size = 0
        if size:
            yield from counted()

    parts = docs.select("text", "lang").mapInArrow(count, "lang string, gram string, n0 long, n1 long")
    return parts.groupBy("lang", "gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def discounts(counts: dict[int, DataFrame]) -> DataFrame:
    """lang, k and per half the discounts for counts of 1, 2 and 3 or more of the order k; types, its number of n-grams."""
    every = None
    for k, own in counts.items():
        few = [F.sum((F.col(f"n{m}") == c).cast("long")).alias(f"c{c}_{m}") for m in (0, 1) for c in (1, 2, 3, 4)]
        types = [F.sum((F.col(f"n{m}") > 0).cast("long")).alias(f"types{m}") for m in (0, 1)]
        level = own.groupBy("lang").agg(*few, *types).withColumn("k", F.lit(k))
        every = level if every is None else every.union(level)
    cuts = []
    for m in (0, 1):
        n = {c: F.greatest(F.col(f"c{c}_{m}"), F.lit(1)) for c in (1, 2, 3, 4)}
        y = n[1] / (n[1] + 2 * n[2])
        cuts += [F.least(F.greatest(c - (c + 1) * y * n[c + 1] / n[c], F.lit(0.0)), F.lit(c * 0.99)).alias(f"d{c}_{m}") for c in (1, 2, 3)]
    return every.select("lang", "k", "types0", "types1", *cuts)


def probabilities(docs: DataFrame) -> DataFrame:
    """lang, gram, p0, p1: of every 5-gram of the corpus under the model of either half.

    A half without a text of a language has no n-grams: there every code point has the probability NO_MODEL, so all texts of the
    language are alike and only its base rules tell them apart.
    """
    counts = {ORDER: materialize(count_grams(docs), "grams-5")}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct code points seen before the shorter n-gram
        seen = [F.sum((F.col(f"n{m}") > 0).cast("long")).alias(f"n{m}") for m in (0, 1)]
        counts[k] = materialize(counts[k + 1].groupBy("lang", F.expr(f"substring(gram, 2, {k})").alias("gram")).agg(*seen), f"grams-{k}")
    # A narrow row per language and order; written first, so that Spark knows its size when it chooses the joins.
    cuts = materialize(discounts(counts), "discounts")
    flat = [F.when(F.col(f"types{m}") > 0, 1 / (F.col(f"types{m}") + 1)).otherwise(F.lit(NO_MODEL)).alias(f"p{m}") for m in (0, 1)]
    below = cuts.filter("k = 1").select("lang", F.lit("").alias("suffix"), *flat)
    for k in range(1, ORDER + 1):
        own = counts[k].join(cuts.filter(F.col("k") == k), "lang")
        cut = [F.when(F.col(f"n{m}") == 0, 0.0).when(F.col(f"n{m}") == 1, F.col(f"d1_{m}")).when(F.col(f"n{m}") == 2, F.col(f"d2_{m}")).otherwise(F.col(f"d3_{m}")).alias(f"cut{m}") for m in (0, 1)]
        prefix, suffix = F.expr(f"substring(gram, 1, {k - 1})").alias("prefix"), F.expr(f"substring(gram, 2, {k - 1})").alias("suffix")
        parts = own.select("lang", "gram", "n0", "n1", *cut, prefix, suffix)
        sums = [F.sum(f"{name}{m}").alias(f"{all_}{m}") for m in (0, 1) for name, all_ in (("n", "total"), ("cut", "cuts"))]
        joined = parts.join(parts.groupBy("lang", "prefix").agg(*sums), ["lang", "prefix"]).join(below, ["lang", "suffix"])
        p = [F.when(F.col(f"total{m}") == 0, F.col(f"p{m}")).otherwise((F.col(f"n{m}") - F.col(f"cut{m}")) / F.col(f"total{m}") + F.greatest(F.col(f"cuts{m}") / F.col(f"total{m}"), F.lit(LEAST_SHARE)) * F.col(f"p{m}")).alias(f"p{m}") for m in (0, 1)]
        level = joined.select("lang", "gram", *p)
        if k < ORDER:
            below = materialize(level, f"level-{k}").withColumnRenamed("gram", "suffix")
    return level


def train(docs: DataFrame) -> tuple[str, int]:
    """Folder and number of parts of the model: key, v0, v1 (log2 under either half's model), sorted by key in parts of about
    PART_ROWS rows."""
    level = materialize(probabilities(docs).select("lang", "gram", *(F.log2(f"p{m}").cast("float").alias(f"v{m}") for m in (0, 1))), "level-5")

    def keyed(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                points = np.frombuffer("".join(batch.column("gram").to_pylist()).encode("utf-32-le"), "<u4").reshape(-1, ORDER).astype(np.uint64)
                lang = batch.column("lang").dictionary_encode()
                numbers = np.array([language_number(one) for one in lang.dictionary.to_pylist()], np.uint64)[lang.indices.to_numpy()]
                keys = gram_keys(list(points.T), numbers)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("v0"), batch.column("v1")], names=["key", "v0", "v1"])

    parts = max(1, -(-level.count() // PART_ROWS))
    folder = new_folder(docs.sparkSession, "code-point-model")
    table = level.mapInArrow(keyed, "key long, v0 float, v1 float").withColumn("part", F.expr(f"pmod(key, {parts}L)").cast("int"))
    table.repartition(parts, "part").sortWithinPartitions("part", "key").write.partitionBy("part").parquet(folder)
    return folder, parts


class Reader:
    """Values of keys, from the parts of the model, one part at a time."""

    def __init__(self, folder: str, parts: int):
        self.folder, self.parts = folder, parts

    def _part(self, number: int) -> list[np.ndarray]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, path = filesystem(f"{self.folder}/part={number}")
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return [np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32)]
        table = ds.dataset(path, filesystem=system, format="parquet").to_table(columns=["key", "v0", "v1"])
        made = [table.column(name).to_numpy() for name in ("key", "v0", "v1")]
        if (np.diff(made[0]) < 0).any():  # several sorted files
            order = np.argsort(made[0])
            made = [array[order] for array in made]
        return made

    def values(self, asked: np.ndarray) -> np.ndarray:
        """(2, n): log2 probabilities of keys under the model of either half."""
        asked = asked.view(np.int64)
        out = np.full((2, len(asked)), np.log2(NO_MODEL), np.float32)
        number = asked % self.parts
        order = np.lexsort((asked, number))
        ends = np.searchsorted(number[order], np.arange(self.parts + 1))
        for part in range(self.parts):
            places = order[ends[part] : ends[part + 1]]
            if len(places):
                own, *values = self._part(part)
                if len(own):
                    at = np.minimum(np.searchsorted(own, asked[places]), len(own) - 1)
                    found = own[at] == asked[places]
                    out[:, places[found]] = [v[at[found]] for v in values]
        return out


class Scorer:
    """Takes texts, keeps the numbers of their n-grams, and gives all their figures after one pass over the model."""

    def __init__(self, reader: Reader):
        self.reader, self.size, self.taken = reader, 0, []

    def add(self, docs: list[tuple[str | None, str]]) -> None:
        """(text, lang) of further documents."""
        own = sorted((k for k, (text, _) in enumerate(docs) if text), key=lambda k: half(docs[k][0]))
        if not own:
            self.taken.append((len(docs), own, None, None, None, 0))
            return
        places = Places([docs[k][0] for k in own], [docs[k][1] for k in own])
        numbers, found = numbered(places.keys)
        split = int(sum(len(docs[k][0]) for k in own if not half(docs[k][0])))
        self.taken.append((len(docs), own, places.ends, numbers.astype(np.int32), found, split))
        self.size += len(numbers)

    def bits(self) -> list[float]:
        """Mean bits per code point of each whole text, in the order of the documents; 0 for an empty text."""
        keys = [found for *_, found, _ in self.taken if found is not None]
        every = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        values = self.reader.values(every)
        out: list[float] = []
        for count, own, ends, numbers, found, split in self.taken:
            figures = [0.0] * count
            if own:
                v0, v1 = values[:, np.searchsorted(every, found)]
                logs = np.concatenate([v1[numbers[:split]], v0[numbers[split:]]]).astype(np.float64)
                starts = np.concatenate([[0], ends[:-1]])
                for k, mean in zip(own, (-np.add.reduceat(logs, starts) / (ends - starts)).tolist(), strict=True):
                    figures[k] = mean
            out += figures
        self.taken, self.size = [], 0
        return out
