"""The driver tables read as entries, evidence, replies and rules.

Every frame is derived from whole tables and whole texts, so it grows with them. Documents are filed as entries:
`source` is the person, the text's hash is the company (exact copies are filings of the same company), the language
gives the category, and `labels` decide what the registry knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.pages import url_host
from ledgerlens.operators.taxonomy import Taxonomy
from ledgerlens.sources.tables import rules_from_cells

# Taxonomy of the document queries, as worksheet rows from row 2 on (fixed values).
TAXONOMY = [
    ("text", "germanic", "en", "rated", "that、with、thing"),
    ("", "", "", "en", "ther，tion、rated"),
    ("", "", "de", "rated", "keit,lich;heit"),
    ("", "", "", "de", "nung、nicht、rated"),
    ("", "romance", "fr", "rated", "elle、eaux、éell"),
    ("", "", "", "fr", "tion、étre、pour、rated"),
    ("", "", "es", "rated", "ción、ado、los"),
    ("", "", "", "es", "que、para、rated"),
    ("", "", "", "", ""),
]
# People who file everything under the next language, and one who knows no language (fixed values).
MISFILING = ("src3", "src7", "src11")
UNKNOWING = "src13"
PAGE_LANGUAGE = "^https?://[^/]+/([a-z]{2})"
NEXT_LANGUAGE = {"en": "de", "de": "fr", "fr": "es", "es": "en"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels where there are any."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left")


def rating(quality: Column) -> Column:
    return F.when(quality.isNull(), "unknown").when(quality == 1, "rated good").otherwise("rated poor")


def worksheet(spark: SparkSession, sf_dir: str, company: Column | None = None, row: Column | None = None) -> DataFrame:
    """Documents as a worksheet of entries, cells untrimmed; `company` and `row` replace the company cell and the row number."""
    docs = rated_documents(spark, sf_dir)
    shifted = F.create_map(*[F.lit(x) for pair in NEXT_LANGUAGE.items() for x in pair])
    filed = F.when(F.col("source").isin(*MISFILING), shifted[F.col("lang")]).otherwise(F.col("lang"))
    return docs.withColumn("filed", filed).select(
        F.lit("").alias("source_id"),
        (F.col("doc_id") + 2 if row is None else row).alias("row_number"),
        F.when(F.contains("text", F.lit("@")), F.lit(None)).otherwise(F.col("n_chars")).alias("日期"),
        F.concat(F.lit("　"), "source", F.lit(" ")).alias("姓名"),
        F.when(F.col("filed").isin("en", "de"), "germanic").otherwise("romance").alias("一级分类"),
        F.when(F.contains("text", F.lit("|")), F.lit("  "))
        .when(F.col("source") == UNKNOWING, "xx")
        .otherwise(F.col("filed"))
        .alias("细分"),
        (company_text(F.col("text"), F.col("doc_id")) if company is None else company).alias("企业名称&官网"),
        F.concat("source", F.lit("（"), "lang", F.lit("、"), rating(F.col("quality")), F.lit("）")).alias("环节"),
    )


def website_worksheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One worksheet of sites: every stored page is filed on an even row under its host, every document on an odd row under a
    person whose site nobody stored (English) or who has none. Pages with a query in their address are filed under the next language.
    """
    link = F.when(F.col("lang") == "en", " www.d.example.com").otherwise("")
    people = worksheet(
        spark, sf_dir, F.concat(F.lit("Person "), "source", F.lit("-"), "lang", link), F.col("doc_id") * 2 + 3
    )
    stored = table(spark, sf_dir, "pages").select(
        "page_id", "url", url_host(F.col("url")).alias("host"), F.regexp_extract("url", PAGE_LANGUAGE, 1).alias("lang")
    )
    shifted = F.create_map(*[F.lit(x) for pair in NEXT_LANGUAGE.items() for x in pair])
    filed = F.when(F.contains("url", F.lit("?")), shifted[F.col("lang")]).otherwise(F.col("lang"))
    sites = stored.withColumn("filed", filed).select(
        F.lit("").alias("source_id"),
        (F.col("page_id") * 2 + 2).alias("row_number"),
        F.col("page_id").alias("日期"),
        F.regexp_extract("host", "([a-z]+)$", 1).alias("姓名"),
        F.when(F.col("filed").isin("en", "de"), "germanic").otherwise("romance").alias("一级分类"),
        F.col("filed").alias("细分"),
        # No dots in the name itself: "www." inside it would count as a link of its own.
        F.concat(F.lit("Host "), F.replace("host", F.lit("."), F.lit("-")), F.lit(" "), "url").alias("企业名称&官网"),
        F.concat("host", F.lit("（"), "lang", F.lit("、rated good）")).alias("环节"),
    )
    return people.unionByName(sites)


def company_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry replies under the companies of the worksheet: copies of a text are replies for one company."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("replied_at"), company_key(F.col("text")).alias("company")
    )
    answered = replies(spark, sf_dir).drop("company", "query_name")
    return answered.join(docs, "replied_at").withColumnRenamed("company", "query_name")


def company_text(text: Column, doc_id: Column) -> Column:
    return F.concat(F.lit(" Doc "), F.md5(text), F.lit(" Ltd， https://d.example.com/"), doc_id.cast("string"))


def company_key(text: Column) -> Column:
    return F.concat(F.lit("Doc"), F.md5(text), F.lit("Ltd"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static company table: nothing about toxic documents, no scope for poor ones, else the whole text.

    Copies share a company; the newest filing (largest doc_id) is the one on record.
    """
    docs = rated_documents(spark, sf_dir)
    scope = F.when(F.col("quality") == 0, "").otherwise(F.col("text"))
    newest = docs.groupBy(company_key(F.col("text")).alias("query_name")).agg(
        F.max_by(F.struct(scope.alias("business_scope"), "toxic"), "doc_id").alias("row")
    )
    return newest.filter(F.coalesce("row.toxic", F.lit(0)) == 0).select(
        "query_name",
        F.lit(None).cast("string").alias("company_name"),
        F.col("row.business_scope").alias("business_scope"),
        F.lit("存续").alias("status"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry reply per document, its JSON body built from the whole row; shape and fate follow the row."""
    docs = rated_documents(spark, sf_dir)
    good = F.to_json(
        F.struct(
            F.lit("200").alias("Status"),
            F.struct(
                F.when(F.col("lang") == "de", F.col("text")).alias("OperScope"),
                F.when(F.col("lang") != "de", F.col("text")).alias("Scope"),
                F.concat(F.lit("  "), "source", F.lit(" ")).alias("EntName"),
                F.col("n_chars").alias("RegStatus"),
            ).alias("Result"),
        )
    )
    refused = F.to_json(F.struct(F.lit(101).alias("Status"), F.lit("").alias("Message"), F.col("source").alias("msg")))
    in_data = F.to_json(
        F.struct(
            F.lit(200).alias("Status"),
            F.array().cast("array<string>").alias("Result"),
            F.struct(F.lit("  ").alias("Scope"), F.col("text").alias("经营范围")).alias("Data"),
        )
    )
    listed = F.to_json(F.struct(F.lit("200").alias("Status"), F.array("lang").alias("Result")))
    empty = F.to_json(F.struct(F.lit("200").alias("Status"), F.struct(F.col("source").alias("Name")).alias("Result")))
    return docs.select(
        F.col("doc_id").cast("string").alias("query_name"),
        F.when(F.col("source") == "src4", 503).otherwise(200).alias("http_status"),
        F.when(F.col("source") == "src5", F.concat(F.lit("{"), "text"))
        .when(F.col("source") == "src6", F.to_json(F.array("lang")))
        .when(F.col("source") == "src8", listed)
        .when(F.col("source") == "src9", empty)
        .when(F.col("toxic") == 1, refused)
        .when(F.col("quality") == 1, in_data)
        .otherwise(good)
        .alias("body"),
        F.when(F.col("source") == "src2", F.concat(F.lit("timeout "), "lang")).alias("transport_error"),
        F.concat("lang", F.lit("/"), "source").alias("company"),
        F.col("doc_id").alias("replied_at"),
    )


def rule_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as rule rows: labels leave most level cells blank, the whole text is the keyword cell."""
    docs = rated_documents(spark, sf_dir)
    return docs.select(
        F.col("lang").alias("source_id"),
        (F.col("doc_id") + 2).alias("row_number"),
        F.when(F.col("quality") == 0, F.col("source")).otherwise("").alias("level1"),
        F.when(F.col("toxic") == 1, F.concat("lang", F.lit("-"), "source")).otherwise("").alias("level2"),
        F.when(F.contains("text", F.lit("!")), F.col("source")).otherwise("").alias("level3"),
        rating(F.col("quality")).alias("module_name"),
        F.when(F.contains("text", F.lit("|")), "").otherwise(F.col("text")).alias("keyword_text"),
    ).withColumn("module_name", F.when(F.col("module_name") == "unknown", "").otherwise(F.col("module_name")))


def taxonomy(spark: SparkSession) -> Taxonomy:
    """The fixed taxonomy above, through the ordinary rule reader."""
    rows = [("", number, *row) for number, row in enumerate(TAXONOMY, start=2)]
    cells = spark.createDataFrame(
        rows,
        "source_id string, row_number bigint, level1 string, level2 string, level3 string, "
        "module_name string, keyword_text string",
    )
    return Taxonomy(rules_from_cells(cells))


def passage_taxonomy(spark: SparkSession, sf_dir: str, **limits) -> Taxonomy:
    """Taxonomy of the benchmark passages: one group per item, its phrases are the keywords."""
    items = table(spark, sf_dir, "benchmark")
    cells = items.select(
        F.lit("").alias("source_id"),
        (F.col("item_id") + 2).alias("row_number"),
        F.lit("benchmark").alias("level1"),
        F.lit("passage").alias("level2"),
        F.col("item_id").cast("string").alias("level3"),
        F.lit("").alias("module_name"),
        F.replace("text", F.lit("."), F.lit(",")).alias("keyword_text"),
    )
    return Taxonomy(rules_from_cells(cells), **limits)
