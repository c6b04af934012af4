"""Source divergence audit: how far the word use of the groups (lang, source) lies apart.

Spark counts the terms of every group; terms in enough documents of a language are kept and numbered. A group's counts
become sorted (term id, count) arrays, one per slice of term ids, so that no array grows with the vocabulary. Groups stand
in tiles; a task gets the arrays of two tiles in a slice and merges every unordered pair of groups once: the shorter array
gallops through the longer one, overlaps, terms of one side and terms of neither are priced, and sums over the slices hold for
both directions.

All arithmetic is on integers. With count occurrences of a term in a group of N over the V kept terms of the language, its price is
p = 1 + floor(10^9 * (count + 2) / (N + 2 V)); two prices are floor((p - q)^2 / (p + q)) apart.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize

UNIT = 1_000_000_000
MIN_DOCUMENTS = 10
TOP_TERMS = 10
#: Term ids per slice and groups per tile: bounds of what a pair task holds.
SLICE, TILE = 1 << 16, 8
#: Entries of counts a counting task holds before it hands them on.
HELD_TERMS = 500_000
#: Letters of ASCII (lower-cased before) and everything beyond ASCII, in UTF-8.
TERM = re.compile(rb"[a-z\x80-\xff]+")


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents); a row with a null term and zeros for every group.

    Combined in the tasks, then by sums. Null text, lang and source count as ''.
    """

    def count(batches):
        import pyarrow as pa

        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size = 0

        def handed_on():
            columns: tuple[list, ...] = ([], [], [], [], [])
            for (lang, source), terms in held.items():
                for part, values in zip(columns, ([lang], [source], [None], [0], [0]), strict=True):
                    part.extend(values)
                columns[0].extend([lang] * len(terms))
                columns[1].extend([source] * len(terms))
                columns[2].extend(terms)
                columns[3].extend(n for n, _ in terms.values())
                columns[4].extend(df for _, df in terms.values())
            held.clear()
            # UTF-8 is never cut: all its bytes beyond ASCII belong to the class.
            arrays = [pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)]
            arrays[2] = arrays[2].cast(pa.string())
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "df"])

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True)
                for lang, source, text in rows:
                    terms = held.setdefault((lang, source), {})
                    before = len(terms)
                    for term, n in Counter(TERM.findall(text.lower())).items():
                        entry = terms.get(term)
                        if entry is None:
                            terms[term] = [n, 1]
                        else:
                            entry[0] += n
                            entry[1] += 1
                    size += len(terms) - before
                if size >= HELD_TERMS:
                    yield handed_on()
                    size = 0
        if held:
            yield handed_on()

    plain = docs.select(*(F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in ("lang", "source", "text")))
    parts = plain.mapInArrow(count, "lang string, source string, term string, n long, df long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _numbered(terms: DataFrame) -> DataFrame:
    """terms with a dense id from 0: the place in its partition plus the rows of the partitions before."""
    place = F.monotonically_increasing_id()
    placed = materialize(terms.withColumns({"__part": F.shiftright(place, 33).cast("int"), "__at": place.bitwiseAND((1 << 33) - 1)}), "terms")
    # One row per partition.
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").withColumn("id", F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def price(count, total, kept):
    """The price of a term as an exact SQL expression over long columns."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (F.col(count) + 2).cast("decimal(19,0)")
    below = (F.col(total) + 2 * F.col(kept)).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def apart(p, q):
    """floor((p - q)^2 / (p + q)); prices are at most 10^9 + 1, so the square fits into 64 bits."""
    return F.call_function("div", (F.col(p) - F.col(q)) * (F.col(p) - F.col(q)), F.col(p) + F.col(q))


def _prices(counts, total: int, kept: int) -> np.ndarray:
    below = total + 2 * kept
    if below > 8_000_000_000:  # 10^9 times a count no longer fits into 64 bits
        return np.array([1 + UNIT * (int(c) + 2) // below for c in counts], np.int64)
    return 1 + UNIT * (np.asarray(counts, np.int64) + 2) // below


def _apart(p, q):
    return (p - q) ** 2 // (p + q)


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both sorted arrays of the values they share. All values of the shorter one step through the longer one at
    once: the step doubles until the value is passed, then the last stretch is halved."""
    if not len(short) or not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # The values ascend, so the place of every 64th one is where its stretch begins.
    start = np.repeat(np.searchsorted(long, short[::64]), 64)[: len(short)]
    step = np.ones(len(short), np.int64)
    ahead = np.flatnonzero(long[np.minimum(start + step, len(long) - 1)] < short)
    while len(ahead):
        step[ahead] *= 2
        ahead = ahead[(start[ahead] + step[ahead] < len(long)) & (long[np.minimum(start[ahead] + step[ahead], len(long) - 1)] < short[ahead])]
    low, high = start, np.minimum(start + step, len(long))
    while np.any(low < high):
        middle = (low + high) // 2
        below = long[np.minimum(middle, len(long) - 1)] < short
        open_ = low < high
        low = np.where(open_ & below, middle + 1, low)
        high = np.where(open_ & ~below, middle, high)
    found = np.flatnonzero((low < len(long)) & (long[np.minimum(low, len(long) - 1)] == short))
    return found, low[found]


def merge(a: tuple, b: tuple, terms: int) -> int:
    """What a slice of so many terms adds to a pair. a, b: (sorted ids, their prices, price of an absent term)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    in_a, in_b = gallop(a[0], b[0])
    total = int(_apart(a[1][in_a], b[1][in_b]).sum())
    for (_, prices, _), shared, other in ((a, in_a, b[2]), (b, in_b, a[2])):
        alone = np.ones(len(prices), bool)
        alone[shared] = False
        total += int(_apart(prices[alone], other).sum())
    absent = terms - len(a[0]) - len(b[0]) + len(in_a)
    return total + absent * int(_apart(a[2], b[2]))


def _pair_task(rows):
    """rows of (tile, source, total, kept, terms, ids, counts) of two tiles in one slice: (a, b, value) for every pair a < b
    between them; within the tile where both are the same."""
    groups = []
    for tile, source, total, kept, terms, ids, counts in rows:
        none = int(_prices([0], total, kept)[0]) if kept else 1
        groups.append((tile, source, (ids, _prices(counts, total, kept), none), terms))
    groups.sort(key=lambda g: (g[0], g[1].encode()))
    tiles = {g[0] for g in groups}
    for k, (tile, source, arrays, terms) in enumerate(groups):
        for other_tile, other, other_arrays, _ in groups[k + 1 :]:
            if len(tiles) == 1 or tile != other_tile:
                yield source, other, merge(arrays, other_arrays, terms)


def divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank.

    part pair: item is every other source of the language, value the sum of distances over all kept terms. part term: the
    top_terms kept terms that the group uses more than its language does. Ranks: value descending, then item by its UTF-8 bytes.
    Null lang, source and text count as '' (so a null and an empty source are one group); a group without terms is priced like
    any other; a language without kept terms has pairs of value 0 and no terms. Repeated rows count as documents each; other
    columns of docs are ignored; an empty table gives an empty table.
    """
    counts = materialize(term_counts(docs), "term-counts")
    words = counts.filter(F.col("term").isNotNull())
    by_lang = words.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("df").alias("df")).filter(F.col("df") >= min_documents)
    kept = materialize(_numbered(by_lang.select("lang", "term", "n_lang")), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_lang").alias("total_lang"))
    entries = words.join(kept, ["lang", "term"]).select("lang", "source", "term", "id", "n", "n_lang")
    entries = materialize(entries, "kept-counts")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter(F.col("term").isNull()).select("lang", "source")
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "total_lang"])
    in_lang = Window.partitionBy("lang").orderBy("source")
    groups = materialize(groups.withColumn("tile", ((F.row_number().over(in_lang) - 1) / TILE).cast("int")), "groups")
    pairs = _pairs(groups, kept, entries)
    terms = entries.join(groups.select("lang", "source", "total", "kept", "total_lang"), ["lang", "source"])
    terms = terms.withColumns({"p": price("n", "total", "kept"), "q": price("n_lang", "total_lang", "kept")}).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart("p", "q").alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(best)


def _pairs(groups: DataFrame, kept: DataFrame, entries: DataFrame) -> DataFrame:
    """lang, source, part, item, value of all pairs of groups of a language, both ways."""
    cut = F.expr(f"id div {SLICE}").cast("int").alias("slice")
    slices = kept.groupBy("lang", cut).agg(F.count("*").alias("terms"))
    arrays = entries.groupBy("lang", "source", cut).agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("e"))  # SLICE entries at most
    arrays = arrays.select("lang", "source", "slice", F.col("e.id").alias("ids"), F.col("e.n").alias("counts"))
    # Every group has a row in every slice of its language; a language without kept terms has the slice -1.
    rows = groups.join(slices, "lang", "left").na.fill({"slice": -1, "terms": 0}).join(arrays, ["lang", "source", "slice"], "left")
    none = F.array().cast("array<long>")
    rows = rows.withColumns({"ids": F.coalesce("ids", none), "counts": F.coalesce("counts", none)})
    last = groups.groupBy("lang").agg(F.max("tile").alias("last"))
    rows = rows.join(last, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    rows = rows.withColumns({"t1": F.least("tile", "other"), "t2": F.greatest("tile", "other")})

    def priced(key, table):
        import pyarrow as pa

        plain = [table.column(n).to_pylist() for n in ("tile", "source", "total", "kept", "terms")]
        arrays = [[scalar.values.to_numpy() for scalar in table.column(n)] for n in ("ids", "counts")]
        found = list(_pair_task(zip(*plain, *arrays, strict=True)))
        lang = key[0].as_py()
        columns = list(zip(*((lang, *row) for row in found), strict=True)) or [[]] * 4
        types = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["lang", "a", "b", "value"])

    fields = ["lang", "slice", "t1", "t2", "tile", "source", "total", "kept", "terms", "ids", "counts"]
    parts = rows.select(*fields).groupBy("lang", "slice", "t1", "t2").applyInArrow(priced, "lang string, a string, b string, value long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    both = sums.select("lang", "value", F.explode(ways).alias("way"))
    return both.select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
