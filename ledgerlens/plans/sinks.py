"""Output tables and where they go."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens import constants as K


def detail_table(detail: DataFrame, with_source: bool = False, with_file: bool = False) -> DataFrame:
    """Detail under its output headers: 16 columns, 18 with data source and link (and a neutral text header); the
    source file can be added for runs over many files."""
    headers = dict(K.DETAIL_HEADERS)
    if with_source:
        headers["business_scope"] = K.NEUTRAL_SCOPE_HEADER
        headers.update(K.SOURCE_HEADERS)
    shown = detail.withColumn("needs_review", F.when(F.col("needs_review"), K.YES).otherwise(K.NO))
    if with_source:
        if "website_url" not in detail.columns:
            shown = shown.withColumn("website_url", F.lit(""))
        label = F.when(F.col("data_source") == K.WEBSITE_SOURCE, K.WEBSITE_LABEL).otherwise(F.col("data_source"))
        shown = shown.withColumn("data_source", label)
    if with_file:
        headers.update(K.FILE_HEADER)
    return shown.select(*[F.col(name).alias(header) for name, header in headers.items()])


def summary_table(people: DataFrame) -> DataFrame:
    """Summary under its output headers, people in order of first appearance."""
    ordered = people.orderBy("first_source", "first_row")
    return ordered.select(*[F.col(name).alias(header) for name, header in K.SUMMARY_HEADERS.items()])


def new_job_id() -> str:
    return K.JOB_PREFIX + uuid4().hex[:8]


def output_path(output_dir: str, job_id: str, table: str) -> str:
    if not job_id or "/" in job_id or "\\" in job_id or ".." in job_id:
        raise ValueError(K.BAD_JOB_ID)
    return f"{output_dir.rstrip('/')}/{job_id}/{table}"


def write_table(table: DataFrame, path: str, fmt: str) -> None:
    """Never overwrites: a second run under the same job id fails."""
    writer = table.write.mode("errorifexists")
    if fmt == "csv":
        # Quotes are doubled, as spreadsheets expect.
        writer.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    else:
        writer.format(fmt).save(path)


def read_table(spark: SparkSession, path: str, fmt: str, schema: StructType) -> DataFrame:
    """A table written by `write_table`."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        # An empty cell is an empty text here, never a null.
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\x00")
        return reader.csv(path)
    return reader.format(fmt).load(path)
