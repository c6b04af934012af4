"""Records of CSV files by byte ranges, numbered as the rows of a sheet.

Spark cuts files into ranges at line ends; whether a range begins inside a quoted cell depends on all quotes before it. A first pass
looks at every range under both states: it counts the records that begin, and keeps what stands before the first record of
a range that begins inside a cell. That is one small row per range; a running sum over these picks the state of every range,
the number of its first record and the rest of a record that is open at its end. The second pass puts lines together and numbers
them. Neither pass moves a line, and empty lines are records like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE = "source_id string, start long, lines long, odd int, begin0 long, begin1 long, head string, closes boolean, first string"


def _lines(spark: SparkSession, paths, encoding: str | None) -> DataFrame:
    lines = spark.read.text(paths)
    value = F.col("value") if encoding is None else F.decode(F.col("value").cast("binary"), F.lit(encoding))
    place = (F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("start"))
    return lines.select(*place, value.alias("value"))


def _runs(batches) -> Iterator[tuple]:
    """(batch, from, to, begins a range?) of stretches of one range. A task reads its ranges one after the other."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        start, source = batch.column("start").to_numpy(), batch.column("source_id").dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((start[1:] != start[:-1]) | (source[1:] != source[:-1])) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            key = batch.column("source_id")[begin].as_py(), int(start[begin])
            yield batch, begin, end, key != last
            last = key


def _odd(values, multi_line: bool) -> np.ndarray:
    """Whether a line has an odd number of quotes."""
    import pyarrow.compute as pc

    if not multi_line:
        return np.zeros(len(values), np.int64)
    return pc.count_substring(values, '"').to_numpy(zero_copy_only=False).astype(np.int64) & 1


def ranges(lines: DataFrame, multi_line: bool) -> DataFrame:
    """A row per range: its lines, whether its quotes are odd, the records that begin in it if it begins outside (0) or inside (1)
    of a cell, the lines up to the first odd one and whether there is one, and the first record of a file."""

    def scan(batches):
        import pyarrow as pa

        row, head = None, []

        def done():
            closes = row["closes"]
            text = "\n".join(head)
            row["head"] = text if closes or multi_line else None
            # A file begins outside of a cell: its first record is its first line, or all up to the second odd one.
            return pa.RecordBatch.from_pylist([row], schema=OUT)

        for batch, begin, end, new in _runs(batches):
            if new:
                if row:
                    yield done()
                row = {"source_id": batch.column("source_id")[begin].as_py(), "start": batch.column("start")[begin].as_py(), "lines": 0, "odd": 0, "begin0": 0, "begin1": 0, "closes": False, "first": None}
                head, first, first_open = [], [], True
            values = batch.column("value").slice(begin, end - begin)
            odd = _odd(values, multi_line)
            before = (row["odd"] + np.cumsum(odd) - odd) & 1
            row["begin0"] += int((before == 0).sum())
            row["begin1"] += int((before == 1).sum())
            if multi_line and not row["closes"]:
                closing = np.flatnonzero(odd)
                upto = int(closing[0]) + 1 if len(closing) else len(odd)
                head += values.slice(0, upto).to_pylist()
                row["closes"] = bool(len(closing))
            if row["start"] == 0 and first_open:
                after = (before + odd) & 1
                closing = np.flatnonzero(after == 0)
                first += values.slice(0, int(closing[0]) + 1 if len(closing) else len(odd)).to_pylist()
                first_open = not len(closing)
                row["first"] = "\n".join(first)
            row["lines"] += len(odd)
            row["odd"] = (row["odd"] + int(odd.sum())) & 1
        if row:
            yield done()

    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    OUT = pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in RANGE.split(", "))])
    return lines.mapInArrow(scan, RANGE)


def placed(found: DataFrame) -> DataFrame:
    """ranges with inside (0 or 1), before (records that begin earlier in the file) and tail (the rest of a record open at the end)."""
    own = Window.partitionBy("source_id").orderBy("start")
    earlier, later = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(1, Window.unboundedFollowing)
    inside = found.withColumn("inside", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).cast("int"))
    begins = F.when(F.col("inside") == 0, F.col("begin0")).otherwise(F.col("begin1"))
    counted = inside.withColumn("before", F.coalesce(F.sum(begins).over(earlier), F.lit(0)))
    # The next range in which the cell ends, and the heads up to it.
    closing = F.min(F.when(F.col("closes"), F.col("start"))).over(later)
    opened = counted.withColumn("open", (F.col("inside") + F.col("odd")) % 2 == 1).withColumn("closing", closing)
    spans = opened.filter("open").select("source_id", F.col("start").alias("at"), F.coalesce("closing", F.lit((1 << 63) - 1)).alias("upto"))
    heads = found.select("source_id", "start", "head")
    parts = spans.join(heads, "source_id").filter("start > at AND start <= upto")
    tails = parts.groupBy("source_id", F.col("at").alias("start")).agg(F.array_sort(F.collect_list(F.struct("start", "head"))).alias("h"))
    tails = tails.select("source_id", "start", F.concat_ws("\n", "h.head").alias("tail"))
    return opened.drop("open", "closing").join(tails, ["source_id", "start"], "left")


def records(spark: SparkSession, paths, multi_line: bool, encoding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(source_id, index, record): every record of every file, index from 0; and (source_id, first): the first record of each file.

    multi_line: a quoted cell may hold line breaks; quotes must then be balanced, as in quoted cells they are. Otherwise every line is
    a record. An open cell at the end of a file ends there. Empty files have no records.
    """
    lines = _lines(spark, paths, encoding)
    found = ranges(lines, multi_line).persist()  # one row per range; computed again if lost
    # One row per range of spark.sql.files.maxPartitionBytes bytes.
    bounds = F.broadcast(placed(found).select("source_id", "start", "lines", "inside", "before", "tail"))

    def assemble(batches):
        import pyarrow as pa

        state = None

        def end_of_range():
            if state is None:
                return
            if state["seen"] != state["lines"]:
                raise ValueError("file ranges changed between two passes over the input")
            if state["open"]:
                text = "\n".join([*state["open"], *([] if state["tail"] is None else [state["tail"]])])
                yield pa.RecordBatch.from_arrays([pa.array([state["source"]]), pa.array([state["index"]], pa.int64()), pa.array([text])], names=NAMES)

        for batch, begin, end, new in _runs(batches):
            if new:
                yield from end_of_range()
                first = {name: batch.column(name)[begin].as_py() for name in ("source_id", "lines", "inside", "before", "tail")}
                if first["inside"] is None:
                    raise ValueError("file ranges changed between two passes over the input")
                # skipped: lines that belong to a record of an earlier range
                state = {"source": first["source_id"], "lines": first["lines"], "tail": first["tail"], "inside": first["inside"], "index": first["before"], "seen": 0, "open": [], "skipped": first["inside"] == 1}
            values = batch.column("value").slice(begin, end - begin)
            odd = _odd(values, multi_line)
            before = (state["inside"] + np.cumsum(odd) - odd) & 1
            state["seen"] += len(odd)
            if not state["inside"] and not odd.any():
                numbers, texts = np.arange(state["index"], state["index"] + len(odd)), values
                state["index"] += len(odd)
            else:
                numbers, texts = [], []
                for line, inside, flips in zip(values.to_pylist(), before.tolist(), odd.tolist(), strict=True):
                    if state["skipped"]:
                        state["skipped"] = not flips
                        continue
                    state["open"].append(line)
                    if not inside ^ flips:
                        numbers.append(state["index"])
                        texts.append("\n".join(state["open"]))
                        state["index"] += 1
                        state["open"] = []
                state["inside"] = int(before[-1] ^ odd[-1])
            yield pa.RecordBatch.from_arrays([pa.array([state["source"]] * len(texts), pa.string()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], names=NAMES)
        yield from end_of_range()

    NAMES = ["source_id", "index", "record"]
    whole = lines.join(bounds, ["source_id", "start"], "left").mapInArrow(assemble, "source_id string, index long, record string")
    firsts = placed(found).filter("start = 0")
    # A first record that does not end in its range goes on in the tail.
    ends = F.when((F.col("begin0") == 1) & (F.col("odd") == 1), F.concat_ws("\n", "first", "tail")).otherwise(F.col("first"))
    return whole, firsts.select("source_id", ends.alias("first"))
