"""The whole review: entries, rules and evidence in; detail, person summary and progress lines out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.operators.lookup import lookup_keys, one_per_company, static_lookup
from ledgerlens.operators.pages import company_websites, from_websites, host_evidence, page_links, with_website
from ledgerlens.operators.responses import from_responses
from ledgerlens.operators.scoring import score_entries
from ledgerlens.operators.summary import review_steps, person_summary
from ledgerlens.operators.taxonomy import Taxonomy
from ledgerlens.operators.verdict import judge, prepare
from ledgerlens.plans.sinks import (
    detail_table,
    new_job_id,
    output_path,
    read_table,
    summary_table,
    write_table,
)


@dataclass(frozen=True)
class ReviewTables:
    """Lazy results of a review."""

    detail: DataFrame
    people: DataFrame
    steps: DataFrame


def default_companies(spark) -> DataFrame:
    """Seed rows of the static lookup table (fixed values)."""
    return spark.createDataFrame(
        [
            ("金川县雪梨果业开发有限责任公司", None, "梨、水果种植、加工、销售；农产品初加工服务。", "存续"),
            ("黑龙江省佳莲种业有限公司", None, "水稻、玉米、大豆种子繁育、加工、销售。", "存续"),
        ],
        "query_name string, company_name string, business_scope string, status string",
    )


def company_evidence(
    entries: DataFrame,
    source: str = K.STATIC_SOURCE,
    *,
    table: DataFrame | None = None,
    responses: DataFrame | None = None,
    pages: DataFrame | None = None,
    max_chars: int | None = None,
    order: str | None = None,
    **page_limits,
) -> DataFrame:
    """company_info for the entries from the named source: stored registry replies, stored pages, else a static table.

    Of several replies for a company, a good one goes before a failed one, then the greatest `order` column of responses.
    `page_limits` go to host_evidence. Any other DataFrame in company_info form serves `review` just as well.
    """
    source = source.strip().lower()
    if source == K.REGISTRY_SOURCE:
        if responses is None:
            raise ValueError(f"source {source!r} needs responses")
        answers = from_responses(responses, [order] if order else [])
        answers = one_per_company(answers, order)
        return answers.drop(order) if order else answers
    if source == K.WEBSITE_SOURCE:
        if pages is None:
            raise ValueError(f"source {source!r} needs pages")
        evidence = host_evidence(pages, page_links(pages), max_chars=max_chars, **page_limits)
        return from_websites(company_websites(entries), evidence)
    if table is None:
        table = default_companies(entries.sparkSession)
    return static_lookup(lookup_keys(entries), table)


def review_detail(
    entries: DataFrame, rules: DataFrame | Taxonomy, company_info: DataFrame, unique: bool = False, **skew
) -> DataFrame:
    """One verdict per entry, whatever the evidence holds: several rows for a company are reduced to one (one_per_company).

    `unique` says that company_info has one row per query_name already, which saves that step.
    """
    if not unique:
        company_info = one_per_company(company_info)
    taxonomy = rules if isinstance(rules, Taxonomy) else Taxonomy(rules)
    return judge(score_entries(prepare(entries), company_info, taxonomy, **skew))


def review(entries: DataFrame, rules: DataFrame | Taxonomy, company_info: DataFrame, **skew) -> ReviewTables:
    taxonomy = rules if isinstance(rules, Taxonomy) else Taxonomy(rules)
    detail = review_detail(entries, taxonomy, company_info, **skew)
    return ReviewTables(
        detail=detail,
        people=person_summary(detail),
        steps=review_steps(lookup_keys(entries), taxonomy.rules),
    )


def run_review(
    entries: DataFrame,
    rules: DataFrame | Taxonomy,
    company_info: DataFrame,
    output_dir: str,
    job_id: str | None = None,
    fmt: str = "parquet",
    ordered: bool | None = None,
    with_source: bool = False,
    with_file: bool = False,
) -> dict:
    """Review and write `{output_dir}/{job_id}/detail` and `/person_summary`; returns paths and progress lines.

    The detail is computed once: the summary reads three columns of the written table back instead of repeating the
    joins, and a lost executor costs no more than that read. `ordered` writes the detail in input order (default: for
    CSV only; other formats carry the row number and are spared the sort).
    """
    spark = entries.sparkSession
    job_id = job_id or new_job_id()
    detail_path = output_path(output_dir, job_id, "detail")
    summary_path = output_path(output_dir, job_id, "person_summary")

    if with_source and "website_url" not in entries.columns:
        entries = with_website(entries)
    taxonomy = rules if isinstance(rules, Taxonomy) else Taxonomy(rules)
    tables = review(entries, taxonomy, company_info)
    detail = tables.detail
    if fmt == "csv" if ordered is None else ordered:
        detail = detail.orderBy("source_id", "row_number")
    reviewed = Observation("reviewed")
    shown = detail_table(detail.observe(reviewed, F.count("*").alias("n")), with_source, with_file)
    write_table(shown, detail_path, fmt)

    written = read_table(spark, detail_path, fmt, shown.schema)
    back = {header: name for name, header in {**K.DETAIL_HEADERS, **K.FILE_HEADER}.items()}
    written = written.select(*[F.col(c).alias(back.get(c, c)) for c in written.columns])
    if not with_file:
        written = written.withColumn("source_id", F.lit(""))
    people = person_summary(written)
    if not with_file:
        # The written detail does not name its source; who appears first is taken from the entries.
        place = F.min(F.struct("source_id", "row_number")).alias("place")
        first = entries.groupBy(F.coalesce("name", F.lit("")).alias("employee_name")).agg(place)
        first = first.select("employee_name", F.col("place.source_id").alias("first_source"), F.col("place.row_number").alias("first_row"))
        people = people.withColumn("employee_name", F.coalesce("employee_name", F.lit("")))
        people = people.drop("first_source", "first_row").join(first, "employee_name", "left")
    write_table(summary_table(people), summary_path, fmt)

    steps = [row["step"] for row in tables.steps.orderBy("step_ord").collect()]
    if taxonomy is not rules:
        taxonomy.release()
    return {
        "job_id": job_id,
        "detail": detail_path,
        "person_summary": summary_path,
        "reviewed": reviewed.get["n"],
        "steps": steps,
    }
