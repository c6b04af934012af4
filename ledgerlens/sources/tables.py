"""Entries and rules from files or DataFrames: header check, cell text, source row numbers, blank rows, fill-down.

Tables come as CSV, Parquet, ORC or JSON files, or as any DataFrame. A path may name many files; each file is a source
of its own (`source_id`) with its own header order and row numbers. An empty line of a CSV file is a blank row: it is
numbered and dropped.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.functions.text import cell_text, split_keywords, strip_text
from ledgerlens.operators.filldown import fill_down
from ledgerlens.sources.records import records

FIRST_ROW = 2


def _missing_message(found: list[str], required: dict[str, str], message: str) -> str | None:
    missing = [header for header in required if header not in found]
    return message + ", ".join(missing) if missing else None


def _project(frame: DataFrame, required: dict[str, str], message: str, keep: list[str]) -> DataFrame:
    """Required columns by stripped header name (first of equal names), as cell text, without all-blank rows."""
    cells = [f for f in frame.schema.fields if f.name not in keep]
    headers = [f.name.strip() for f in cells]
    problem = _missing_message(headers, required, message)
    if problem:
        raise ValueError(problem)
    # Positional renaming, because a DataFrame may hold equal or untrimmed names.
    plain = frame.toDF(*[c if c in keep else f"_cell{i}" for i, c in enumerate(frame.columns)])
    by_cell = [(plain.columns[i], f) for i, f in enumerate(frame.schema.fields) if f.name not in keep]
    text = plain.select(*keep, *[cell_text(F.col(name), f.dataType).alias(name) for name, f in by_cell])
    # An "or" chain stops at the first filled cell, so a usual row costs one look.
    filled = text.filter(reduce(lambda a, b: a | b, [F.col(name) != "" for name, _ in by_cell]))
    return filled.select(
        *keep,
        *[F.col(by_cell[headers.index(header)][0]).alias(name) for header, name in required.items()],
    )


def _with_defaults(frame: DataFrame) -> DataFrame:
    if "row_number" not in frame.columns:
        raise ValueError("a DataFrame source needs a row_number column (first data row = 2)")
    if "source_id" not in frame.columns:
        frame = frame.withColumn("source_id", F.lit(""))
    return frame.withColumn("row_number", F.col("row_number").cast("bigint"))


def entries_from_frame(frame: DataFrame) -> DataFrame:
    """Entries (source_id, row_number, date, name, category, subcategory, company_raw, stage) from worksheet columns."""
    return _project(_with_defaults(frame), K.ENTRY_HEADERS, K.ENTRY_HEADER_ERROR, ["source_id", "row_number"])


def rules_from_frame(frame: DataFrame) -> DataFrame:
    """Rules (source_id, rule_ord, level1, level2, level3, module_name, keywords) from worksheet columns.

    Levels are filled down first and rows without module and keywords dropped after, so that a dropped row still feeds
    the rows below it.
    """
    # Blank rows change nothing: they carry no level and are dropped in the end.
    rows = _project(_with_defaults(frame), K.RULE_HEADERS, K.RULE_HEADER_ERROR, ["source_id", "row_number"])
    return rules_from_cells(rows)


def filled_rows(rows: DataFrame) -> DataFrame:
    """Rule rows with their levels filled down and without the rows that name neither module nor keywords."""
    filled = fill_down(rows, ["level1", "level2", "level3"], order="row_number", source="source_id")
    return filled.filter((F.col("module_name") != "") | (F.col("keyword_text") != ""))


def rules_from_cells(rows: DataFrame) -> DataFrame:
    """Rules from normalised cells (source_id, row_number, level1, level2, level3, module_name, keyword_text)."""
    return filled_rows(rows).select(
        "source_id",
        F.col("row_number").alias("rule_ord"),
        "level1",
        "level2",
        "level3",
        "module_name",
        split_keywords(F.col("keyword_text")).alias("keywords"),
    )


# -- files ----------------------------------------------------------------------------------------------------------


def _splits(rows: DataFrame) -> DataFrame:
    """One small row per file split: how many rows come before it in its file, and where it starts in its task."""
    parts = rows.groupBy("source_id", "_start").agg(
        F.count("*").alias("_rows"),
        F.min("_place").alias("_first"),
    )
    before = Window.partitionBy("source_id").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def _placed(frame: DataFrame) -> DataFrame:
    return frame.select(
        "*",
        F.col("_metadata.file_path").alias("source_id"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_place"),
    )


def _numbered(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows with `_index`, their position in the file from 0, without moving them: rows of a split keep their order
    inside a task, so position = rows before the split + distance from its first row.

    Both passes must cut the files alike. Any shift puts at least one row outside its split's range, and the job then
    stops instead of numbering wrongly.
    """
    bounds = splits.select("source_id", "_start", "_first", "_rows", "_before")
    joined = rows.join(bounds, ["source_id", "_start"], "left")
    inside = "_place - _first >= 0 AND _place - _first < _rows"
    stop = "cast(raise_error('file splits changed between two passes over the input') AS bigint)"
    index = F.expr(f"if({inside}, _before + _place - _first, {stop})")
    return joined.withColumn("_index", index).drop("_start", "_place", "_first", "_rows", "_before")


def _read_typed(spark: SparkSession, paths, fmt: str, required: dict[str, str], message: str) -> DataFrame:
    frame = spark.read.format(fmt).load(paths)
    problem = _missing_message([c.strip() for c in frame.columns], required, message)
    if problem:
        raise ValueError(problem)
    if "row_number" in frame.columns:
        if "source_id" not in frame.columns:
            frame = frame.select("*", F.col("_metadata.file_path").alias("source_id"))
        return frame
    if fmt == "parquet":
        return frame.select(
            "*",
            F.col("_metadata.file_path").alias("source_id"),
            (F.col("_metadata.row_index") + FIRST_ROW).alias("row_number"),
        )
    placed = _placed(frame)
    numbered = _numbered(placed, _splits(placed))
    return numbered.withColumn("row_number", F.col("_index") + FIRST_ROW).drop("_index")


def _read_csv(
    spark: SparkSession, paths, required: dict[str, str], message: str, multi_line: bool, options: dict
) -> DataFrame:
    """Cells of all files under the required names, whatever the header order of each file."""
    options = dict(options)
    encoding = options.pop("encoding", options.pop("charset", None))
    separator = options.get("sep", options.get("delimiter", ","))
    whole, firsts = records(spark, paths, multi_line, encoding)
    mark = F.lit("^\ufeff")
    firsts = firsts.withColumn("first", F.regexp_replace("first", mark, F.lit("")))
    # Separators inside quotes are counted too; at worst some columns stay empty.
    width = firsts.agg(F.max(F.size(F.split("first", F.lit(f"\\Q{separator}\\E"))))).first()[0]
    if width is None:
        raise ValueError(message + ", ".join(required))
    schema = ", ".join(f"_c{i} string" for i in range(width))
    # Spreadsheets double their quotes.
    parsing = {"escape": '"', **options, "mode": "PERMISSIVE", "maxColumns": str(max(width, 20480))}

    def cells(record: Column) -> Column:
        parsed = F.from_csv(record, schema, parsing)
        return F.transform(F.array(*[parsed[f"_c{i}"] for i in range(width)]), lambda c: F.coalesce(strip_text(c), F.lit("")))

    headers = firsts.select("source_id", cells(F.col("first")).alias("_header"))
    missing = F.filter(
        F.array(*[F.lit(h) for h in required]), lambda h: ~F.array_contains(F.col("_header"), h)
    )
    broken = headers.withColumn("_missing", missing).filter(F.size("_missing") > 0).orderBy("source_id").first()
    if broken is not None:
        raise ValueError(message + ", ".join(broken["_missing"]))

    # One header per file: no more rows than files, and no more columns than the widest header.
    body = whole.filter(F.col("index") > 0).join(F.broadcast(headers), "source_id", "left").withColumn("_cells", cells(F.col("record")))
    # Every cell counts, also one beyond the header: it stands in the record as read.
    beyond = F.regexp_replace("record", rf"(?U)[\s\x1c-\x1f\"{re.escape(separator)}]+", "") != ""
    filled = body.filter(F.exists("_cells", lambda c: c != "") | beyond)

    def cell(header: str) -> Column:
        # array_position names the first of equal headers, as wanted.
        return F.element_at("_cells", F.array_position("_header", F.lit(header)).cast("int"))

    return filled.select(
        "source_id",
        (F.col("index") + FIRST_ROW - 1).alias("row_number"),
        *[cell(header).alias(name) for header, name in required.items()],
    )


def read_entries(spark: SparkSession, paths, fmt: str = "csv", multi_line: bool = False, **options) -> DataFrame:
    """Entries from files. `multi_line` allows line breaks inside quoted CSV cells; files are read in ranges either way."""
    if fmt == "csv":
        return _read_csv(spark, paths, K.ENTRY_HEADERS, K.ENTRY_HEADER_ERROR, multi_line, options)
    return entries_from_frame(_read_typed(spark, paths, fmt, K.ENTRY_HEADERS, K.ENTRY_HEADER_ERROR))


def read_rules(spark: SparkSession, paths, fmt: str = "csv", multi_line: bool = True, **options) -> DataFrame:
    """Rules from files; quoted line breaks are allowed by default, they separate keywords."""
    if fmt == "csv":
        return rules_from_cells(_read_csv(spark, paths, K.RULE_HEADERS, K.RULE_HEADER_ERROR, multi_line, options))
    return rules_from_frame(_read_typed(spark, paths, fmt, K.RULE_HEADERS, K.RULE_HEADER_ERROR))
