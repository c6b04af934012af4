"""Harmonic packing of documents into sequences, padded to capacity unless their length is a power of two.

An item of length L belongs to class k = floor(capacity / L): its length lies in (capacity / (k + 1), capacity / k]. A bin of
class k takes k items, which always fit, and one more, which always reaches the end: that one is cut there, and its rest is an
item of its own class. So every class fills its bins with a fixed number of items, knows nothing of other classes or workers, and
a full bin has no padding and one cut at most. Lengths beyond the last class share one, which is filled until a bin is full.

Every worker fills its own classes while it tokenizes. What is left in open bins, at most capacity tokens a class and worker,
is dealt to fewer workers and filled once more; the rest of these is laid end to end, and the last sequence of a worker is cut
into powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, texts
from ledgerlens.llm.tokens import word_encoder

CAPACITY = 4096
#: Classes of a worker; each holds less than two bins.
CLASSES = 64
#: Tokens left in open bins that one worker of the second round takes.
ROUND_TOKENS = 8_000_000

Item = tuple[int | None, int, bytes, int]  # document, start, ids (4 bytes each), tokens of the document
Placed = tuple[int | None, int, int, int, int, int, int]  # document, start, length, crc32, tokens of the document, sequence, offset


class HarmonicBins:
    """Open bins of a worker, one per class. add() gives the pieces of the sequences it fills; ids of sequences count from first."""

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES, first: int = 0):
        self.capacity, self.classes, self.next = capacity, classes, first
        self.open: list[list[Item]] = [[] for _ in range(classes + 1)]
        self.fill = [0] * (classes + 1)

    def class_of(self, length: int) -> int:
        return min(self.capacity // length, self.classes)

    def add(self, item: Item) -> Iterator[Placed]:
        waiting = [item]
        while waiting:
            doc, start, ids, tokens = waiting.pop()
            length = len(ids) // 4
            if not length:
                continue
            if length >= self.capacity:
                yield from self._sequence([(doc, start, ids[: 4 * self.capacity], tokens)])
                waiting.append((doc, start + self.capacity, ids[4 * self.capacity :], tokens))
                continue
            k = self.class_of(length)
            missing = self.capacity - self.fill[k]
            if length < missing:
                self.open[k].append((doc, start, ids, tokens))
                self.fill[k] += length
                continue
            yield from self._sequence([*self.open[k], (doc, start, ids[: 4 * missing], tokens)])
            self.open[k], self.fill[k] = [], 0
            waiting.append((doc, start + missing, ids[4 * missing :], tokens))

    def _sequence(self, items: list[Item]) -> Iterator[Placed]:
        offset = 0
        for doc, start, ids, tokens in items:
            length = len(ids) // 4
            yield doc, start, length, zlib.crc32(ids), tokens, self.next, offset
            offset += length
        self.next += 1

    def left(self) -> Iterator[Item]:
        for items in self.open:
            yield from items

    def close(self) -> Iterator[Placed]:
        """The open bins laid end to end: full sequences, then powers of two that add up to the rest."""
        rest, items = sum(self.fill), list(self.left())
        room, own = 0, []
        for doc, start, ids, tokens in items:
            while ids:
                if not room:
                    room = min(self.capacity, 1 << rest.bit_length() - 1)
                    rest -= room
                part, ids = ids[: 4 * room], ids[4 * room :]
                own.append((doc, start, part, tokens))
                start += len(part) // 4
                room -= len(part) // 4
                if not room:
                    yield from self._sequence(own)
                    own = []
        self.open, self.fill = [[] for _ in self.open], [0] * len(self.fill)


FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _arrow(rows: list[tuple], with_ids: bool):
    import pyarrow as pa

    names = [field.split()[0] for field in FIELDS.split(", ")] + ["ids"] * with_ids
    types = [pa.int64()] * 7 + [pa.binary()] * with_ids
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)


def _first_sequence(round_number: int) -> int:
    """Sequence ids of a task: its round and number above, a counter below."""
    from pyspark import TaskContext

    return (round_number << 62) | (TaskContext.get().partitionId() << 36)


def fill_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, classes: int) -> DataFrame:
    """Pieces with their places; items of open bins have no sequence yet and carry their ids."""

    def run(batches):
        encoder = word_encoder(tokenizer)
        end = end_id.to_bytes(4, "little")
        bins = HarmonicBins(capacity, classes, _first_sequence(0))
        rows = []
        for doc, text in texts(batches, ["doc_id", "text"], 200):
            ids = encoder.encode(text or "") + end
            rows.extend((*placed, None) for placed in bins.add((doc, 0, ids, len(ids) // 4)))
            if len(rows) >= 10_000:
                yield _arrow(rows, True)
                rows = []
        rows.extend((doc, start, len(ids) // 4, None, tokens, None, None, ids) for doc, start, ids, tokens in bins.left())
        yield _arrow(rows, True)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"{FIELDS}, ids binary")


def fill_left(items: DataFrame, capacity: int, classes: int) -> DataFrame:
    """The items of open bins packed whole: nothing is left open."""

    def run(batches):
        bins = HarmonicBins(capacity, classes, _first_sequence(1))
        rows = []
        for item in texts(batches, ["doc_id", "start", "ids", "doc_tokens"], 2000):
            rows.extend(bins.add(item))
            if len(rows) >= 10_000:
                yield _arrow(rows, False)
                rows = []
        yield _arrow([*rows, *bins.close()], False)

    return items.select("doc_id", "start", "ids", "doc_tokens").mapInArrow(run, FIELDS)


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    A document is its ids and the end id; a null or empty text is the end id alone. Every row of docs is a document of its own,
    also with a null or repeated doc_id; its pieces follow each other by start. Documents may be cut anywhere; every id lies in
    one piece. Other columns are ignored, an empty table gives an empty table. capacity is a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    first = materialize(fill_documents(docs, tokenizer, end_id, capacity, classes), "harmonic")
    left = first.filter("sequence_id IS NULL")
    tokens = left.agg(F.sum("length")).first()[0]
    full = first.filter("sequence_id IS NOT NULL").drop("ids")
    if not tokens:
        return full
    dealt = left.repartition(-(-tokens // ROUND_TOKENS), F.xxhash64("doc_id", "start", "ids_crc32", "length"))
    return full.unionByName(materialize(fill_left(dealt, capacity, classes), "harmonic-left"))
