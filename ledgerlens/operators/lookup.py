"""Evidence per distinct company: keys, static table, memo of earlier lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.functions.text import clean_company_name

COMPANY_INFO = [
    "query_name",
    "company_name",
    "business_scope",
    "status",
    "source",
    "success",
    "error",
    "raw",
]


def lookup_keys(entries: DataFrame) -> DataFrame:
    """(query_name, entries): one row per distinct cleaned name, '' included."""
    return entries.groupBy(clean_company_name(F.col("company_raw")).alias("query_name")).agg(
        F.count("*").alias("entries")
    )


def static_lookup(keys: DataFrame, table: DataFrame) -> DataFrame:
    """company_info from a static table (query_name, company_name, business_scope, status), unique on query_name.

    A name without a record, or with a record that holds nothing, is a miss.
    """
    record = F.struct("company_name", "business_scope", "status")
    known = table.select("query_name", record.alias("record"))
    if "entries" in keys.columns:
        # Always true. Keeping the count keeps this aggregate equal to the one the skew check needs, and Spark then
        # computes the two once.
        keys = keys.filter("entries > 0")
    found = keys.select("query_name").join(known, "query_name", "left")
    hit = F.coalesce(
        F.col("record.company_name"), F.col("record.business_scope"), F.col("record.status")
    ).isNotNull()

    def field(name: str, default: Column) -> Column:
        return F.when(hit, F.coalesce(F.col(f"record.{name}"), default)).otherwise(default).alias(name)

    return found.select(
        "query_name",
        field("company_name", F.col("query_name")),
        field("business_scope", F.lit("")),
        field("status", F.lit("")),
        F.lit(K.STATIC_SOURCE).alias("source"),
        hit.alias("success"),
        F.when(hit, F.lit("")).otherwise(F.lit(K.STATIC_MISS)).alias("error"),
        F.when(hit, F.to_json("record")).otherwise(F.lit("{}")).alias("raw"),
    )


def pending_keys(keys: DataFrame, known: DataFrame) -> DataFrame:
    """Names that no earlier lookup has answered; a stored row that is null throughout counts as unanswered."""
    answered = known.na.drop(how="all", subset=[c for c in known.columns if c != "query_name"]).select("query_name").distinct()
    return keys.join(answered, "query_name", "left_anti")


def merge_lookups(known: DataFrame, fresh: DataFrame, key: str = "query_name", order: str = "looked_up_at") -> DataFrame:
    """Known and fresh answers as one table, unique on the key: the newest row wins, the fresh one on a tie.

    The maximum is taken before the shuffle as well, so a key stored very often never arrives whole at one task.
    """
    rest = [c for c in known.columns if c != key]
    both = known.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    newest = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, "_fresh")).alias("row"))
    return newest.select(*[F.col(key) if c == key else F.col(f"row.{c}") for c in known.columns])


def one_per_company(company_info: DataFrame, order: str | None = None) -> DataFrame:
    """company_info with one row per query_name: a success before a failure, then the greatest `order` (null: least), then by a
    hash of the row.

    Combined before the shuffle as well, so a company answered very often never arrives whole at one task; texts are carried
    once, they take no part in the comparison. A column named by `order` stays.
    """
    rest = [c for c in company_info.columns if c != "query_name"]
    # A null is told from its neighbour; every column is named once, so nothing costly is computed twice.
    content = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in rest])
    rank = F.struct("success", *([] if order is None else [order]), content)
    best = company_info.groupBy("query_name").agg(F.max_by(F.struct(*rest), rank).alias("row"))
    return best.select(*["query_name" if c == "query_name" else F.col(f"row.{c}") for c in company_info.columns])
