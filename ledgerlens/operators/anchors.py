"""Which anchors of a taxonomy a text holds: one pass over its bytes, whatever the number of terms.

A term is looked up by its first 32, 16, 8, 4, 2 or 1 bytes, whichever still fit, as one 64-bit number. The numbers at all places
of a batch of texts are made by a few array operations and thinned by a bit table of the terms' numbers. A text keeps its distinct
numbers that the table knows; the exact join and the test for the whole term follow, so equal numbers of different
bytes cost a candidate and never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LENGTHS = (1, 2, 4, 8, 16, 32)
#: Bits of a table per term, and the bits of the smallest and the largest table (as powers of two), one table per length. More terms
#: than the largest is made for make it less selective, never wrong.
BITS_PER_TERM = 64
LEAST_BITS, MOST_BITS = 16, 23
#: Bytes of a batch looked at together, which bounds what a task holds beside the batch; the numbers of a window fit a core's cache.
WINDOW = 1 << 17

MIX, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def table_bits(terms: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (BITS_PER_TERM * terms).bit_length()))


def _slots(numbers: np.ndarray, bits: int) -> np.ndarray:
    return (numbers * SPREAD) >> np.uint64(64 - bits)


def _place_numbers(data: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, the numbers of all its places) in ascending order of the lengths: a number is made of two of the length before."""
    numbers, length = data.astype(np.uint64), 1
    while True:
        yield length, numbers
        if length == longest or len(numbers) <= length:
            return
        left, right = numbers[:-length], numbers[length:]
        numbers = left | (right << np.uint64(8 * length)) if length < 8 else left * MIX + right
        length *= 2


def term_numbers(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(length, number) of the anchor of every term; terms are not empty."""
    sizes = np.array([len(term) for term in terms], np.int64)
    lengths = np.array(LENGTHS)[np.searchsorted(LENGTHS, sizes, side="right") - 1]
    heads = np.frombuffer(b"".join([term[:32].ljust(32, b"\0") for term in terms]), "<u8").reshape(-1, 4)
    one, two, three, four = heads.astype(np.uint64).T
    pair = one * MIX + two
    made = [one & np.uint64((1 << 8 * n) - 1) for n in (1, 2, 4)] + [one, pair, pair * MIX + (three * MIX + four)]
    return lengths, np.select([lengths == n for n in LENGTHS], made)


def _known(data: np.ndarray, ends: np.ndarray, tables: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(text, number) of every number in the tables that a text holds, distinct and in order; texts end at ends and follow each other."""
    longest = max(tables, default=0)
    rows, found = [], []
    for begin in range(0, len(data) if longest else 0, WINDOW):
        for length, numbers in _place_numbers(data[begin : begin + WINDOW + longest - 1], longest):
            if length not in tables:
                continue
            numbers = numbers[:WINDOW]
            table = tables[length]
            at = np.flatnonzero(table[_slots(numbers, len(table).bit_length() - 1)])
            row = np.searchsorted(ends, at + begin, side="right")
            inside = at + (begin + length) <= ends[row]
            rows.append(row[inside])
            found.append(numbers[at[inside]])
            # A window's repeats go at once.
            rows[-1], found[-1] = _distinct(rows[-1], found[-1])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return _distinct(np.concatenate(rows), np.concatenate(found))


def _distinct(rows: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((numbers, rows))
    rows, numbers = rows[order], numbers[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (numbers[1:] != numbers[:-1])
    return rows[first], numbers[first]


def anchor_tables(terms: DataFrame, count: int) -> dict[int, bytes]:
    """The bit table of every length that an anchor of `terms` (one column, about `count` rows) has, packed. Bounded, whatever the terms."""
    bits = table_bits(count)

    def words(batches):
        import pyarrow as pa

        for batch in batches:
            some = [term.encode() for term in batch.column(0).to_pylist() if term]
            if not some:
                continue
            lengths, numbers = term_numbers(some)
            slots = _slots(numbers, bits).astype(np.int64)
            set_bits = np.left_shift(np.uint64(1), (slots & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lengths.astype(np.int32)), pa.array(slots >> 6), pa.array(set_bits)], ["length", "word", "bits"])

    made = terms.mapInArrow(words, "length int, word long, bits long").groupBy("length", "word").agg(F.bit_or("bits").alias("bits"))
    tables: dict[int, np.ndarray] = {}
    for row in made.collect():
        tables.setdefault(row["length"], np.zeros(1 << bits - 6, "<i8"))[row["word"]] = row["bits"]
    return {length: table.tobytes() for length, table in tables.items()}


def with_anchor(terms: DataFrame, term: str) -> DataFrame:
    """Adds `_anchor` to rows whose `term` is not empty."""
    place = terms.columns.index(term)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                _, numbers = term_numbers([value.encode() for value in batch.column(place).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers.view(np.int64))], [*terms_names, "_anchor"])

    terms_names = terms.columns
    return terms.mapInArrow(run, T.StructType([*terms.schema.fields, T.StructField("_anchor", T.LongType())]))


def with_text_anchors(texts: DataFrame, text: str, tables: dict[int, bytes]) -> DataFrame:
    """Adds `_anchors`, the distinct numbers of the text's places that the tables know. Rows stay where they are."""
    names, place = texts.columns, texts.columns.index(text)

    def run(batches):
        import pyarrow as pa

        bits = {n: np.unpackbits(np.frombuffer(table, np.uint8), bitorder="little").view(bool) for n, table in tables.items()}
        for batch in batches:
            column = batch.column(place).cast(pa.large_string())
            _, offsets, values = column.buffers()
            ends = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
            data = np.frombuffer(values, np.uint8)[ends[0] : ends[-1]] if values is not None and ends[-1] > ends[0] else np.empty(0, np.uint8)
            rows, numbers = _known(data, ends[1:] - ends[0], bits)
            starts = np.searchsorted(rows, np.arange(len(column) + 1))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(numbers.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*names, "_anchors"])

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField("_anchors", T.ArrayType(T.LongType()))]))
