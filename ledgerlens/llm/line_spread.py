"""Line dedup by how many sites a line is spread over, with DataFrame functions only.

Per line hash, HyperLogLog sketches of the site are merged by aggregation. Lines whose estimate is near the threshold get an
exact distinct count; the others are decided by the estimate. A line on enough sites is boilerplate and stays at its first place
only (smallest doc_id, then first line), so one copy of everything survives.

Text is moved once at most: lines travel as hashes, and only the numbers of the lines to cut come back to their document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import free_name, materialize

MIN_SITES = 3
MIN_WORDS = 5
LG_K = 10
#: Estimates within this factor of the threshold are counted exactly. A sketch of 2^10 buckets errs by 3 percent.
NEAR = 1.5


def _lines(docs: DataFrame, site: str, min_words: int) -> DataFrame:
    """doc key, line number, two line hashes and the site's hash of every line long enough to judge."""
    lines = docs.select("__doc", "doc_id", F.xxhash64(F.coalesce(F.col(site).cast("string"), F.lit(""))).alias("site"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "raw"))
    lines = lines.withColumn("line", F.btrim("raw", F.lit(" \t\r")))
    spaces = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))
    return lines.filter(spaces >= min_words - 1).select("__doc", "doc_id", "site", "at", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2, first (doc_id null?, doc_id, line) of every line on min_sites sites or more."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")
    sketched = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    # A line on k sites occurs k times at least.
    estimated = sketched.filter(F.col("n") >= min_sites).withColumn("sites", F.hll_sketch_estimate("sketch"))
    possible = materialize(estimated.filter(F.col("sites") >= min_sites / NEAR).select("h1", "h2", "first", "sites"), "line-spread")
    near = possible.filter(F.col("sites") < min_sites * NEAR).select("h1", "h2")
    counted = lines.join(near, ["h1", "h2"]).groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    exact = counted.filter(F.col("sites") >= min_sites).select("h1", "h2")
    sure = possible.filter(F.col("sites") >= min_sites * NEAR)
    return sure.select("h1", "h2", "first").unionByName(possible.join(exact, ["h1", "h2"]).select("h1", "h2", "first"))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with cleaned text and two more columns, n_lines and n_removed.

    A line is what stands between line feeds, without spaces, tabs and carriage returns at its ends; lines of fewer than
    min_words words (parts between spaces) stay. Null texts stay null with no lines, empty ones have one line. Rows with the same doc_id and text are
    treated alike; a null site is a site of its own; null doc_ids come after all others when the first place is sought. Columns n_lines
    and n_removed of docs give way to the new ones; columns of any other name come through.
    """
    docs = docs.drop("n_lines", "n_removed")
    key, of, at_lines = (free_name(docs, name) for name in ("__doc", "__of", "__cut"))
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")))
    lines = materialize(_lines(keyed.withColumn("__doc", F.col(key)) if key != "__doc" else keyed, site, min_words), "lines")  # narrow: hashes, no text
    spread = materialize(spread_lines(lines, min_sites), "spread-lines")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")
    cut = lines.join(spread, ["h1", "h2"]).filter(place != F.col("first"))
    cut = cut.groupBy("__doc").agg(F.collect_set("at").alias(at_lines)).withColumnRenamed("__doc", of)
    joined = keyed.join(cut, F.col(key).eqNullSafe(F.col(of)), "left")
    own = F.split("text", "\n")
    stays = F.filter(own, lambda _, at: ~F.coalesce(F.array_contains(at_lines, at), F.lit(False)))
    text = F.when(F.col(at_lines).isNull(), F.col("text")).otherwise(F.concat_ws("\n", stays))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(own)).cast("long")
    return joined.select(
        *(F.col(f"`{name}`") if name != "text" else text.alias("text") for name in docs.columns),
        n_lines.alias("n_lines"),
        F.coalesce(F.size(at_lines), F.lit(0)).cast("long").alias("n_removed"),
    )
