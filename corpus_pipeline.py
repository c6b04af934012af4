"""The corpus pipeline: documents through toxicity, line dedup, near-duplicates, decontamination and packing.

A stage takes (spark, docs, sf_dir); what it returns is written as Parquet in the shared folder and read again as the next
one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, line_spread, minhash, packing, toxicity
from ledgerlens.llm.common import free_name, materialize, table


def _apart(docs: DataFrame, *own: str) -> DataFrame:
    """The columns a stage works on; all others in one struct, so that no name clashes with an operator's own."""
    others = [F.col(f"`{name}`") for name in docs.columns if name not in own]
    return docs.select(*own, F.struct(*others, F.lit(0).alias(" ")).alias("others"))


def _together(stage: DataFrame, columns: list[str], **own) -> DataFrame:
    """The columns of documents again."""
    return stage.select(*((own[name] if name in own else F.col(f"others.`{name}`")).alias(name) for name in columns))


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the classifier learns from the labels that are not held out. Null and empty texts are scored
    like others; rows with a repeated or null doc_id are judged one by one."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many sites stay at their first place; a document of which nothing is left goes. n_chars follows the text. Null and
    empty texts stay as they are."""
    cleaned = line_spread.dedup_lines(_apart(docs, "doc_id", "text", "source"))
    emptied = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", "\\s+", " ")) == "")
    kept = cleaned.filter(~emptied | F.col("text").isNull())
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("others.n_chars")).cast(docs.schema["n_chars"].dataType)
    return _together(kept, docs.columns, doc_id=F.col("doc_id"), text=F.col("text"), source=F.col("source"), n_chars=n_chars)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id, any id before none.

    A document is a doc_id with a text: rows that repeat a doc_id with another text are judged by their own text, rows that repeat
    both are one document and stay or go together. Null, empty and wordless texts stay.
    """
    own = free_name(docs, "document")
    keyed = docs.withColumn(own, F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))))
    grouped = minhash.near_duplicates(keyed.select(F.col(own).alias("doc_id"), "text")).select(F.col("doc_id").alias("member"), "component_id")
    ids = keyed.groupBy(F.col(own).alias("member")).agg(F.min("doc_id").alias("id"))  # narrow: numbers only
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "member")).alias("first")
    stays = grouped.join(ids, "member").groupBy("component_id").agg(first).select(F.col("first.member").alias(own))
    return keyed.join(stays, own, "left_semi").select(*(F.col(f"`{name}`") for name in docs.columns))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    kept = decontaminate.without_contaminated(_apart(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return _together(kept, docs.columns, doc_id=F.col("doc_id"), text=F.col("text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row per piece of a document with its place."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: A classifier and a tokenizer are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
