"""Hierarchical residual packing of pieces into sequences of bounded length.

Every partition packs its own pieces best-fit decreasing. Bins that are nearly full leave; the others become items of the
next round, in which a fraction of the groups remains, until one group is left or nothing more can be merged. Only underfull
bins are shuffled, and what a task holds is bounded by group_items.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, texts
from ledgerlens.llm.tokens import word_encoder

MEMBERS = "doc_ids array<long>, pieces array<int>, starts array<long>, lengths array<long>, crcs array<long>, offsets array<long>"
FIELDS = ("doc_ids", "pieces", "starts", "lengths", "crcs", "offsets")


def tokenized_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece.

    A document is its ids and the end id (null or empty text: the end id alone); only a longer one than capacity is cut.
    """

    def cut(batches):
        import pyarrow as pa

        encoder = word_encoder(tokenizer)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, text in texts([batch], ["doc_id", "text"], 200):
                ids = encoder.encode(text or "") + end
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, number, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, OUT.types, strict=True)], schema=OUT)

    import pyarrow as pa

    OUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: lists of item numbers per bin. Equal sizes keep their order.

    Free spaces are a bit set, so the smallest space that holds an item is the lowest set bit at or above its size.
    """
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        if not 0 < size <= capacity:
            raise ValueError(f"size {size} does not fit into {capacity}")
        fitting = spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            number = by_space[space].pop()
            if not by_space[space]:
                spaces ^= 1 << space
        else:
            space, number = capacity, len(bins)
            bins.append([])
        bins[number].append(item)
        if space > size:
            by_space[space - size].append(number)
            spaces |= 1 << (space - size)
    return bins


def _merge(items: list[tuple], capacity: int) -> list[tuple]:
    """Packs items (fill, members) into bins of the same form; the members' offsets move with their item."""
    out = []
    for numbers in best_fit([fill for fill, _ in items], capacity):
        fill, members = 0, tuple([] for _ in FIELDS)
        for number in numbers:
            size, own = items[number]
            for target, values in zip(members[:-1], own[:-1], strict=True):
                target.extend(values)
            members[-1].extend(offset + fill for offset in own[-1])
            fill += size
        out.append((fill, members))
    return out


def _bins(batches, capacity: int, near_full: int, group_items: int, first: bool):
    """Packs what a task reads, group_items at a time."""
    import pyarrow as pa

    LIST = pa.list_(pa.int64())
    schema = pa.schema([("fill", pa.int64()), ("done", pa.bool_()), *((f, pa.list_(pa.int32()) if f == "pieces" else LIST) for f in FIELDS)])

    def packed(items):
        bins = _merge(items, capacity)
        columns = [[fill for fill, _ in bins], [fill >= near_full for fill, _ in bins]]
        columns += [[members[k] for _, members in bins] for k in range(len(FIELDS))]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    items = []
    names = ["length", "doc_id", "piece", "start", "length", "ids_crc32"] if first else ["fill", *FIELDS]
    for size, *rest in texts(batches, names, 5000):
        items.append((size, ([rest[0]], [rest[1]], [rest[2]], [rest[3]], [rest[4]], [0]) if first else tuple(rest)))
        if len(items) == group_items:
            yield packed(items)
            items = []
    if items:
        yield packed(items)


def pack(pieces: DataFrame, capacity: int = 4096, near_full: int | None = None, fan_in: int = 8, group_items: int = 200_000) -> DataFrame:
    """Adds sequence_id and offset to doc_id, piece, start, length, ids_crc32. Every piece gets a place; none is split.

    near_full: a bin of so many tokens leaves (default: at most 8 free places). fan_in: how many groups merge into one per
    round. group_items: most items packed together; while the underfull bins are more, several groups remain, and the tree
    ends when a round no longer takes one bin in a hundred away. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    near_full = capacity - 8 if near_full is None else near_full
    schema = f"fill long, done boolean, {MEMBERS}"

    def round_of(frame: DataFrame, first: bool, number: int) -> DataFrame:
        packed = frame.mapInArrow(lambda batches: _bins(batches, capacity, near_full, group_items, first), schema)
        return materialize(packed, f"packed-{number}")

    bins = round_of(pieces, True, 0)
    finished = [bins.filter("done")]
    open_bins = bins.filter("NOT done")
    left, groups, number = open_bins.count(), None, 0
    while left > 1:
        at_least = -(-left // group_items)
        groups = max(at_least, 1 if groups is None and left <= group_items // 8 else -(-(groups or bins.rdd.getNumPartitions()) // fan_in))
        number += 1
        # Dealt by a hash of the bin, so groups are even whatever the documents are.
        dealt = open_bins.repartition(groups, F.xxhash64("doc_ids", "pieces"))
        bins = round_of(dealt, False, number)
        finished.append(bins.filter("done"))
        open_bins, before = bins.filter("NOT done"), left
        total = bins.count()
        left = open_bins.count()
        if groups == 1 or total > 0.99 * before and groups == at_least:
            break
    finished.append(open_bins)
    whole = finished[0]
    for frame in finished[1:]:
        whole = whole.unionByName(frame)
    # Numbered in a table of its own, so that the numbers do not change when a task runs again.
    numbered = materialize(whole.drop("fill", "done").withColumn("sequence_id", F.monotonically_increasing_id()), "sequences")
    members = F.arrays_zip(*(F.col(f) for f in FIELDS))
    out = numbered.select("sequence_id", F.explode(members).alias("m"))
    return out.select(
        F.col("m.doc_ids").alias("doc_id"),
        F.col("m.pieces").alias("piece"),
        F.col("m.starts").alias("start"),
        F.col("m.lengths").alias("length"),
        F.col("m.crcs").alias("ids_crc32"),
        "sequence_id",
        F.col("m.offsets").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = 4096) -> DataFrame:
    """Tokenizes once, then packs."""
    return pack(materialize(tokenized_pieces(docs, capacity=capacity), "pieces"), capacity)
