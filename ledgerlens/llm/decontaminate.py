"""Benchmark decontamination by SimHash windows of an item's size.

A window of as many words as an item has gets a 64-bit SimHash of its weighted five-word shingles (weight: how often the
shingle occurs in the window). Item fingerprints are kept in a multi-index: BLOCKS blocks of bits, each a table from a block
value to the items within RADIUS // BLOCKS bits of it. Two fingerprints within RADIUS differ by at most that in some block,
so every item within RADIUS is a candidate. Candidates are decided by the exact weighted Jaccard similarity of the shingles.

The item side (benchmark) is broadcast after a check of its size in bytes; a larger one is dealt into slices by a hash, each with
its own pass over the documents. Documents are streamed, never shuffled.
Fingerprints are computed where a window can reach the threshold at all: around places that share a shingle with some item.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import free_name, texts

SHINGLE = 5
THRESHOLD = 0.8
BITS, BLOCKS, RADIUS = 64, 4, 23
#: Most bytes of items that are broadcast together, on average of a slice (some 20 times as much in a task); more items are taken in
#: slices, each with a pass over the documents of its own.
SLICE_BYTES = 8_000_000
WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mix(values: np.ndarray) -> np.ndarray:
    """splitmix64's finisher, wrapping."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(ids: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash for every run of size ids; of a shorter sequence, one for the whole (none if empty)."""
    if not len(ids):
        return np.zeros(0, np.uint64)
    size = min(size, len(ids))
    out = np.full(len(ids) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out * _ODD + ids[k : len(ids) - size + 1 + k].astype(np.uint64))
    return out


def weighted_similarity(left: Counter, right: Counter) -> float:
    """Weighted Jaccard: sum of minima by sum of maxima."""
    shared = sum(min(n, right[k]) for k, n in left.items() if k in right)
    total = left.total() + right.total() - shared
    return shared / total if total else 0.0


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 per bit."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int16) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def simhash(hashes: np.ndarray) -> int:
    return int(_pack(_signs(hashes).sum(axis=0, dtype=np.int64)[None, :])[0])


def dense(hits: np.ndarray, need: int, reach: int) -> bool:
    """Whether some need hits lie within reach places."""
    return len(hits) >= need and bool((hits[need - 1 :] - hits[: len(hits) - need + 1] < reach).any())


def _near(width: int, radius: int) -> np.ndarray:
    """All values of a block with at most radius bits set."""
    values = np.arange(1 << width, dtype=np.uint32)
    return values[np.bitwise_count(values) <= radius]


class MultiIndex:
    """All stored fingerprints within a radius of a query, by blocks."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        self.width = BITS // BLOCKS
        self.masks = _near(self.width, radius // BLOCKS)
        self.tables = []  # per block: items by block value, distinct values, where the items of each start
        for block in range(BLOCKS):
            values = self._block(prints, block)
            order = np.argsort(values, kind="stable")
            keys, starts = np.unique(values[order], return_index=True)
            self.tables.append((order, keys, np.append(starts, len(order))))

    def _block(self, prints: np.ndarray, block: int) -> np.ndarray:
        return ((prints >> np.uint64(block * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.uint32)

    def pairs(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query numbers, item numbers) of all pairs within the radius, each once.

        Per block, query values meet the item values near them: by comparison where those are few, else by probing the
        neighbourhood of each query value.
        """
        codes = []
        for block, (order, keys, starts) in enumerate(self.tables):
            values = self._block(queries, block)
            if len(keys) <= len(self.masks):
                query, key = np.nonzero(np.bitwise_count(values[:, None] ^ keys[None, :]) <= self.radius // BLOCKS)
            else:
                probes = values[:, None] ^ self.masks[None, :]
                place = np.minimum(np.searchsorted(keys, probes), len(keys) - 1)
                query, mask = np.nonzero(keys[place] == probes)
                key = place[query, mask]
            n = starts[key + 1] - starts[key]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            codes.append(np.repeat(query, n) * len(self.prints) + order[np.repeat(starts[key], n) + within])
        both = np.unique(np.concatenate(codes))
        query, item = both // len(self.prints), both % len(self.prints)
        near = np.bitwise_count(queries[query] ^ self.prints[item]) <= self.radius
        return query[near], item[near]


class ItemIndex:
    """What a task needs of the items; rows are (item_id, text), those without words are left out."""

    def __init__(self, rows: list[tuple[int | None, str | None]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.vocabulary: dict[str, int] = {}
        self.items = []
        for item_id, text in rows:
            words = words_of(text)
            if words:
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
                hashes = shingle_hashes(ids)
                self.items.append((item_id, len(words), Counter(hashes.tolist()), simhash(hashes)))
        every = [list(counts) for _, _, counts, _ in self.items]
        self.shingles = np.unique(np.array([h for hashes in every for h in hashes], dtype=np.uint64))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.shingles & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.by_size: dict[int, tuple[np.ndarray, MultiIndex]] = {}
        for size in sorted({n for _, n, _, _ in self.items}):
            numbers = np.array([k for k, item in enumerate(self.items) if item[1] == size])
            self.by_size[size] = numbers, MultiIndex(np.array([self.items[k][3] for k in numbers], dtype=np.uint64))
        #: Items of fewer words than a shingle are one shingle each; their windows have another shingle size.
        self.short = sorted({n for n in self.by_size if n < SHINGLE})

    def shared(self, hashes: np.ndarray) -> np.ndarray:
        """Places whose shingle some item has."""
        hits = np.flatnonzero(self.filter[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.shingles, hashes[hits]), len(self.shingles) - 1)
        return hits[self.shingles[place] == hashes[hits]]

    def matches(self, words: list[str]) -> dict[int, tuple[float, int, int]]:
        """Item number to (best similarity, first word of that window, words in it)."""
        if not words or not self.items:
            return {}
        known = np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), np.int64, len(words))
        best: dict[int, tuple[float, int, int]] = {}
        for shingle in sorted({min(SHINGLE, size, len(words)) for size in [*self.short, SHINGLE]}):
            hashes = shingle_hashes(known, shingle)
            hits = self.shared(hashes)
            sizes = [min(size, len(words)) - shingle + 1 for size in self.by_size if min(SHINGLE, size, len(words)) == shingle]
            if not sizes or not dense(hits, self.needed(min(sizes)), max(sizes)):
                continue
            ids = known.copy()
            others: dict[str, int] = {}
            for at in np.flatnonzero(known == 0).tolist() if len(words) < 20_000 else self._around(hits, known):
                ids[at] = -1 - others.setdefault(words[at], len(others))
            hashes = shingle_hashes(ids.astype(np.uint64), shingle)
            for size, (numbers, index) in self.by_size.items():
                if min(SHINGLE, size, len(words)) != shingle:
                    continue
                self._windows(hashes, hits, min(size, len(words)), shingle, numbers, index, best)
        return best

    def needed(self, count: int) -> int:
        """So many of a window's shingles are shared at least when the similarity reaches the threshold: an exact bound."""
        return max(1, int(np.ceil(2 * self.threshold / (1 + self.threshold) * count - 1e-9)))

    def _around(self, hits: np.ndarray, known: np.ndarray) -> list[int]:
        reach = max(self.by_size)
        near = np.zeros(len(known) + 1, np.int64)
        np.add.at(near, np.maximum(hits - reach, 0), 1)
        np.add.at(near, np.minimum(hits + reach + SHINGLE, len(known)), -1)
        return np.flatnonzero((np.cumsum(near[:-1]) > 0) & (known == 0)).tolist()

    def _windows(self, hashes, hits, size, shingle, numbers, index, best) -> None:
        """Fingerprints all windows of so many words that hold a shared shingle, and verifies what the index returns."""
        count = size - shingle + 1  # shingles in a window
        last = len(hashes) - count
        need = self.needed(count)
        if not dense(hits, need, count):
            return
        starts = np.zeros(last + 2, np.int64)
        low, high = np.maximum(hits - count + 1, 0), np.minimum(hits, last) + 1
        keep = low < high
        np.add.at(starts, low[keep], 1)
        np.add.at(starts, high[keep], -1)
        places = np.flatnonzero(np.cumsum(starts[:-1]) >= need)
        for at in range(0, len(places), 256):
            part = places[at : at + 256]
            # Runs of successive places share their prefix sums.
            cuts = np.flatnonzero(np.diff(part) > 1) + 1
            for run in np.split(part, cuts):
                signs = _signs(hashes[run[0] : run[-1] + count])
                sums = np.zeros((len(signs) + 1, BITS), np.int32)
                np.cumsum(signs, axis=0, out=sums[1:])
                prints = _pack(sums[count : count + len(run)] - sums[: len(run)])
                query, item = index.pairs(prints)
                for q, k in zip(query.tolist(), item.tolist(), strict=True):
                    number = int(numbers[k])
                    start = int(run[q])
                    counts = self.items[number][2]
                    value = weighted_similarity(Counter(hashes[start : start + count].tolist()), counts)
                    if value >= self.threshold and value > best.get(number, (0.0,))[0]:
                        best[number] = value, start, size


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, similarity, window_start, window_words for every document and item with a window that is similar enough.

    Words are runs of word characters in lower case. A window has the item's number of words (a shorter document is one window).
    Of a pair's windows, the most similar and then first is given. Null or empty texts and items match nothing; repeated rows
    each give their own rows; columns other than doc_id, text, item_id are left out.
    """
    items = benchmark.select("item_id", "text").filter(F.octet_length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    slices = max(1, -(-size // SLICE_BYTES))
    found = None
    for number in range(slices):
        own = items if slices == 1 else items.filter(F.expr(f"pmod(xxhash64(item_id, text), {slices}L) = {number}"))
        part = _scan(docs, own.collect(), threshold)
        found = part if found is None else found.unionByName(part)
    return found


def _scan(docs: DataFrame, rows: list, threshold: float) -> DataFrame:
    """contaminated() for the items of one slice."""
    items = docs.sparkSession.sparkContext.broadcast([(row["item_id"], row["text"]) for row in rows])

    def scan(batches):
        import pyarrow as pa

        index = ItemIndex(items.value, threshold)
        for batch in batches:
            rows = []
            for doc_id, text in texts([batch], ["doc_id", "text"], 200):
                for number, (value, start, words) in sorted(index.matches(words_of(text)).items()):
                    rows.append({"doc_id": doc_id, "item_id": index.items[number][0], "similarity": value, "window_start": start, "window_words": words})
            yield pa.RecordBatch.from_pylist(rows, schema=OUT)

    import pyarrow as pa

    OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("window_start", pa.int64()), ("window_words", pa.int64())])
    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, item_id long, similarity double, window_start long, window_words long")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows of contaminated documents, all columns kept.

    Rows are told apart by a hash of the text, so rows that share a doc_id or have none are judged by their own text. Columns of any
    other name come through.
    """
    key = free_name(docs, "__text")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    bad = contaminated(docs.withColumn("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))), benchmark, threshold)
    bad = bad.select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(bad, key, "left_anti").drop(key)
