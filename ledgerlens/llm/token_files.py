"""Token-id files: a concatenated id array and Elias-Fano coded document boundaries.

A shard file is

    magic | ids, 2 or 4 bytes each, little-endian | boundaries | document ids | footer (JSON) | footer length | magic

Boundaries (0, end of the 1st document, end of the 2nd, ...) and document ids are non-decreasing, so both are Elias-Fano
coded: the low bits of a value are packed as they are, the high bits are written in unary into a bit vector. A select
structure (the place of every 64th one) finds the i-th value by counting ones in a few bytes. That is about
2.5 + log2(range / count) bits a document instead of 64.

Null document ids are counted in the footer and come first. A null text is an empty text: it has the end id alone.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import filesystem, materialize, new_folder, texts, write_target
from ledgerlens.llm.tokens import word_encoder

MAGIC = b"LLTOK01\n"
SAMPLE = 64
#: Documents whose offsets and names are decoded together.
READ = 1024
ONES = np.array([bin(byte).count("1") for byte in range(256)], dtype=np.int64)


class EliasFano:
    """Non-decreasing unsigned integers with random access."""

    def __init__(self, count: int, width: int, low: bytes, high: bytes, samples: bytes):
        self.count, self.width = count, width
        self.low = np.frombuffer(low, dtype=np.uint8)
        self.high = np.frombuffer(high, dtype=np.uint8)
        self.samples = np.frombuffer(samples, dtype="<u4")

    @classmethod
    def encode(cls, values) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        count = len(values)
        if not count:
            return cls(0, 0, b"", b"", b"")
        if np.any(values[1:] < values[:-1]):
            raise ValueError("values must not decrease")
        width = max(0, ((int(values[-1]) + 1) // count).bit_length() - 1)
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(count)
        high = np.zeros(int(ones[-1]) // 8 * 8 + 8, dtype=np.uint8)
        high[ones] = 1
        return cls(count, width, low, np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, index: int) -> int:
        """Place of the one with this index in the high bits."""
        place = int(self.samples[index // SAMPLE])
        left = index % SAMPLE
        byte = place // 8
        left += int(ONES[int(self.high[byte]) & ((1 << place % 8) - 1)])
        while left >= (ones := int(ONES[self.high[byte]])):
            left -= ones
            byte += 1
        rest = int(self.high[byte])
        for _ in range(left):
            rest &= rest - 1
        return byte * 8 + (rest & -rest).bit_length() - 1

    def __getitem__(self, index: int) -> int:
        if not 0 <= index < self.count:
            raise IndexError(index)
        at = index * self.width
        cut = int.from_bytes(self.low[at // 8 : (at + self.width + 7) // 8].tobytes(), "little") >> at % 8
        return ((self.select(index) - index) << self.width) | (cut & ((1 << self.width) - 1))

    def between(self, first: int, end: int) -> np.ndarray:
        """The values of a range of indices; the select structure says which bytes of the high bits hold them."""
        known, after = first // SAMPLE, -(-end // SAMPLE)
        byte = int(self.samples[known]) // 8
        stop = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[byte:stop], bitorder="little")) + byte * 8
        skipped = int(np.searchsorted(ones, self.samples[known])) + first - known * SAMPLE
        out = (ones[skipped : skipped + end - first] - np.arange(first, end)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            at = first * self.width
            bits = np.unpackbits(self.low[at // 8 : (end * self.width + 7) // 8], bitorder="little")[at % 8 :][: (end - first) * self.width]
            out |= (bits.reshape(-1, self.width).astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        out = (ones - np.arange(self.count)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bits = np.unpackbits(self.low, bitorder="little")[: self.count * self.width].reshape(self.count, self.width)
            out |= (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def parts(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]


class TokenFile:
    """Random access to one shard file: len(), document_id(i), start(i), ids(i)."""

    def __init__(self, uri: str):
        system, path = filesystem(uri)
        size = system.get_file_info(path).size
        self.file = system.open_input_file(path)
        tail = self._read(size - 12, 12)
        if tail[4:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        (length,) = struct.unpack("<I", tail[:4])
        self.footer = json.loads(self._read(size - 12 - length, length))
        self.dtype = np.dtype(self.footer["dtype"])
        at = 8 + self.footer["n_ids"] * self.dtype.itemsize
        coded = []
        for part in self.footer["coded"]:
            blobs = []
            for n in part["lengths"]:
                blobs.append(self._read(at, n))
                at += n
            coded.append(EliasFano(part["count"], part["width"], *blobs))
        self.boundaries, self.document_ids = coded

    def _read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def __len__(self) -> int:
        return self.boundaries.count - 1

    def document_id(self, index: int) -> int | None:
        nulls = self.footer["nulls"]
        return None if index < nulls else self.document_ids[index - nulls] + self.footer["least"]

    def start(self, index: int) -> int:
        return self.boundaries[index]

    def ids(self, index: int) -> np.ndarray:
        start, end = self.boundaries[index], self.boundaries[index + 1]
        size = self.dtype.itemsize
        return np.frombuffer(self._read(8 + start * size, (end - start) * size), dtype=self.dtype)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, start, ids) of all documents in file order, one in memory at a time; offsets and names come from select, a range at a time."""
        self.file.seek(8)
        nulls = self.footer["nulls"]
        for at in range(0, len(self), READ):
            stop = min(at + READ, len(self))
            bounds = self.boundaries.between(at, stop + 1).tolist()
            names: list[int | None] = [None] * (min(nulls, stop) - min(nulls, at))
            if stop > nulls:
                names += [n + self.footer["least"] for n in self.document_ids.between(max(at - nulls, 0), stop - nulls).tolist()]
            for name, start, end in zip(names, bounds, bounds[1:], strict=False):
                yield name, start, np.frombuffer(self.file.read((end - start) * self.dtype.itemsize), dtype=self.dtype)


def _write_shard(rows, folder: str, tokenizer: str, end_id: int):
    """Streams one sorted partition into one file; (uri, documents, ids, first document id) or None for an empty partition."""
    first = next(rows, None)
    if first is None:
        return None
    encoder = word_encoder(tokenizer)
    dtype = np.dtype("<u2" if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else "<u4")
    end = struct.pack("<I", end_id)
    total, bounds, names, nulls = 0, [0], [], 0
    out, uri = write_target(folder, ".tok")
    with out:
        out.write(MAGIC)
        row = first
        while row is not None:
            name, text = row
            ids = np.frombuffer(encoder.encode(text or "") + end, dtype="<u4")
            out.write(ids.astype(dtype).tobytes())
            total += len(ids)
            bounds.append(total)
            if name is None:
                nulls += 1
            else:
                names.append(name)
            row = next(rows, None)
        least = names[0] if names else 0
        coded = [EliasFano.encode(bounds), EliasFano.encode([n - least for n in names])]
        described = []
        for part in coded:
            blobs = part.parts()
            described.append({"count": part.count, "width": part.width, "lengths": [len(b) for b in blobs]})
            for blob in blobs:
                out.write(blob)
        footer = json.dumps({"n_ids": total, "dtype": dtype.str, "nulls": nulls, "least": least, "coded": described}).encode()
        out.write(footer + struct.pack("<I", len(footer)) + MAGIC)
    return uri, len(bounds) - 1, total, first[0]


def write_token_files(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes doc_id, text as shard files in ascending doc_id order and returns their manifest.

    Documents are range partitioned by doc_id, so shards follow each other; ties are ordered by text. The manifest (uri,
    n_docs, n_ids, base: ids in all earlier shards) has a row per shard and is itself a table in the shared folder, so the
    files are written once. A lost task writes a new file; only files of the manifest count.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")

    def shard(batches):
        import pyarrow as pa

        made = _write_shard(texts(batches, ["doc_id", "text"]), folder, tokenizer, end_id)
        if made:
            yield pa.RecordBatch.from_pylist([dict(zip(("uri", "n_docs", "n_ids", "first_id"), made, strict=True))], schema=SHARD)

    import pyarrow as pa

    SHARD = pa.schema([("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64())])
    sorted_docs = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # One narrow row per shard, all in one file: on a local file system every file that a task writes starts processes beside the executor.
    shards = sorted_docs.mapInArrow(shard, "uri string, n_docs long, n_ids long, first_id long").repartition(1)
    manifest = materialize(shards, "token-manifest")
    before = Window.orderBy(F.asc_nulls_first("first_id")).rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document of the shard files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches):
        import pyarrow as pa

        for uri, base in texts(batches, ["uri", "base"]):
            rows = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
            for name, start, ids in TokenFile(uri).documents():
                rows["doc_id"].append(name)
                rows["start"].append(base + start)
                rows["n_tokens"].append(len(ids))
                rows["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                if len(rows["doc_id"]) == 10_000:
                    yield pa.RecordBatch.from_pydict(rows, schema=OUT)
                    rows = {k: [] for k in rows}
            yield pa.RecordBatch.from_pydict(rows, schema=OUT)

    import pyarrow as pa

    OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])
    shards = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("uri", "base").repartition(shards, "uri").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
