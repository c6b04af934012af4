"""WARC archives: a writer with revisit records and a reader that splits gzip archives at any byte.

Archives are sequences of gzip members, one per record. A reading task gets a byte range. It looks for the gzip magic in
its range, takes a place for a member when the bytes there inflate to a WARC header, and then owns every record that
starts inside the range, also one that ends beyond it. So each record is read by exactly one task, whatever the split size.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import filesystem, materialize, new_folder, texts, write_target

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def _common(kind: str, page_id: int | None, url: str | None, digest: str, size: int) -> list[tuple[str, str]]:
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    return [*headers, ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]


def response_member(page_id: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [*_common("response", page_id, url, digest, len(payload)), ("Content-Type", "application/http; msgtype=response")]
    return _member(headers, http + payload)


def revisit_member(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int) -> bytes:
    headers = [*_common("revisit", page_id, url, digest, size), ("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return _member(headers, b"")


def write_warc(pages: DataFrame, least_revisit: int = 0, file_bytes: int = 256 << 20, folder: str | None = None) -> DataFrame:
    """Writes page_id, url, html as WARC archives and returns their manifest (uri, size).

    A null html is an empty payload. Of the pages whose payload is equal and has least_revisit bytes or more, the one with
    the smallest page_id is a response and the others are revisits of it; rows that repeat that page_id exactly are
    responses as well, and pages without an id are revisits unless no equal page has one. Only digests are compared between
    pages; what is shuffled are finished gzip members. Archives are rolled at file_bytes.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    firsts = (
        keyed.filter(F.octet_length("payload") >= least_revisit)
        .groupBy("sha1")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter((F.col("n") > 1) & F.col("first_id").isNotNull())
        .drop("n")
    )

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            out = {"sha1": [], "page_id": [], "url": [], "size": [], "member": []}
            for page_id, url, body, sha1 in texts([batch], ["page_id", "url", "payload", "sha1"], 200):
                out["sha1"].append(sha1)
                out["page_id"].append(page_id)
                out["url"].append(url)
                out["size"].append(len(body))
                out["member"].append(response_member(page_id, url, body, base64.b32encode(sha1).decode()))
            yield pa.RecordBatch.from_pydict(out, schema=PACKED)

    def write(batches):
        import pyarrow as pa

        out, uri, size, made = None, "", 0, []
        info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:info>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        for sha1, page_id, url, length, member, first in texts(batches, ["sha1", "page_id", "url", "size", "member", "first_id"], 200):
            if first is not None and page_id != first:
                member = revisit_member(page_id, url, base64.b32encode(sha1).decode(), length, first)
            if out is not None and size + len(member) > file_bytes:
                out.close()
                made.append({"uri": uri, "size": size})
                out = None
            if out is None:
                (out, uri), size = write_target(folder, ".warc.gz"), len(info)
                out.write(info)
            out.write(member)
            size += len(member)
        if out is not None:
            out.close()
            made.append({"uri": uri, "size": size})
        yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("uri", pa.string()), ("size", pa.int64())]))

    import pyarrow as pa

    PACKED = pa.schema([("sha1", pa.binary()), ("page_id", pa.int64()), ("url", pa.string()), ("size", pa.int64()), ("member", pa.binary())])
    packed = keyed.mapInArrow(pack, "sha1 binary, page_id long, url string, size long, member binary")
    # A digest that many pages share is a skewed key of this join; the adaptive planner splits it.
    joined = packed.join(firsts.hint("merge"), "sha1", "left").select("sha1", "page_id", "url", "size", "member", "first_id")
    return materialize(joined.mapInArrow(write, "uri string, size long"), "warc-manifest")


class _Bytes:
    """Forward reading of a file in blocks."""

    def __init__(self, uri: str):
        system, path = filesystem(uri)
        self.file, self.at, self.data = system.open_input_file(path), 0, b""
        self.size = system.get_file_info(path).size

    def block(self, at: int, least: int = 1) -> bytes:
        """Bytes from here on, at least so many unless the file ends."""
        inside = at - self.at
        if 0 <= inside <= len(self.data) and (len(self.data) - inside >= least or self.at + len(self.data) >= self.size):
            return self.data[inside:] if inside else self.data
        self.file.seek(at)
        self.at, self.data = at, self.file.read(max(least, BLOCK))
        return self.data


def _inflate(source: _Bytes, at: int) -> tuple[bytes, int] | None:
    """The record of the member that starts here and the place behind it; None when no WARC header inflates here."""
    unpacker, record, place, seen = zlib.decompressobj(31), [], at, 0
    while not unpacker.eof:
        data = source.block(place)[:65536]
        if not data:
            if seen < 8:
                return None
            raise ValueError(f"archive ends inside the record at byte {at}")
        try:
            got = unpacker.decompress(data)
        except zlib.error as error:
            if seen < 8:
                return None
            raise ValueError(f"damaged record at byte {at}: {error}") from error
        place += len(data) - len(unpacker.unused_data)
        record.append(got)
        if seen < 8:
            head = b"".join(record)[:8]
            if not b"WARC/1.".startswith(head[:7]):
                return None
        seen += len(got)
    whole = b"".join(record)
    return (whole, place) if whole.startswith(b"WARC/1.") else None


def records(uri: str, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, headers in lower case, block) of every record that starts in the byte range."""
    source, at = _Bytes(uri), start
    while at < end:
        data = source.block(at, 3)
        hit = data.find(MAGIC)
        if hit < 0:
            if source.at + len(source.data) >= source.size:
                return
            at += max(1, len(data) - 2)
            continue
        at += hit
        if at >= end:
            return
        found = _inflate(source, at)
        if found is None:
            at += 1
            continue
        head, _, rest = found[0].partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        headers = {name.lower(): value for name, value in headers.items()}
        yield at, headers, rest[: int(headers["content-length"])]
        at = found[1]


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def read_warc(manifest: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """One row per response or revisit: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null in revisits).

    A response whose payload does not have the length and digest of its header is an error.
    """
    spark = manifest.sparkSession

    def read(batches):
        import pyarrow as pa

        for uri, start, end in texts(batches, ["uri", "start", "end"]):
            rows, held = [], 0
            for place, headers, block in records(uri, start, end):
                kind = headers["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                digest, size, payload = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["x-payload-length"]), None
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if (len(payload), digest32(payload)) != (size, digest):
                        raise ValueError(f"payload of {uri} at byte {place} does not match its header")
                rows.append({"page_id": _number(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _number(headers.get("warc-refers-to")), "payload": payload})
                held += len(block)
                if held > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=OUT)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=OUT)

    import pyarrow as pa

    OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    ranges = manifest.select("uri", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(split_bytes))).alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + split_bytes, F.col("size"))).select("uri", "start", "end")
    spread = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "uri", "start")
    return spread.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
