"""Every operator as a query over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.functions.json_values import pick
from ledgerlens.functions.text import clean_company_name
from ledgerlens.operators import lookup, matching, pages, responses, scoring, summary, taxonomy, verdict
from ledgerlens.plans.review import company_evidence, review, review_detail
from ledgerlens.plans.sinks import detail_table, summary_table
from ledgerlens.queries import adapter
from ledgerlens.sources.tables import entries_from_frame, filled_rows, rules_from_cells

# Ordinary words of the stored pages standing in for module synonyms (fixed values).
PAGE_WORDS = {"业务领域": ("tion", "The"), "公司简介": ("que", "of"), "经典案例": ("und", "la")}


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return entries_from_frame(adapter.worksheet(spark, sf))


def _evidence(spark: SparkSession, sf: str, entries: DataFrame | None = None) -> DataFrame:
    keys = lookup.lookup_keys(entries if entries is not None else _entries(spark, sf))
    return lookup.static_lookup(keys, adapter.registry(spark, sf))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    entries = _entries(spark, sf)
    return scoring.score_entries(
        verdict.prepare(entries), _evidence(spark, sf, entries), adapter.taxonomy(spark)
    )


def entries_normalized(spark, sf):
    return _entries(spark, sf).drop("source_id")


def rules_filled(spark, sf):
    return filled_rows(adapter.rule_cells(spark, sf))


def rules_keywords(spark, sf):
    rules = _document_rules(spark, sf)
    places = rules.select("rule_ord", F.posexplode_outer("keywords").alias("keyword_pos", "keyword"))
    return places.filter("keyword IS NOT NULL")


def _document_rules(spark, sf):
    return rules_from_cells(adapter.rule_cells(spark, sf))


def rule_groups(spark, sf):
    return taxonomy.group_keywords(_document_rules(spark, sf))


def rule_group_modules(spark, sf):
    return taxonomy.group_modules(_document_rules(spark, sf))


def clean_company(spark, sf):
    docs = adapter.table(spark, sf, "documents")
    text = adapter.company_text(F.col("text"), F.col("doc_id"))
    return docs.select(
        "doc_id",
        clean_company_name(text).alias("cleaned"),
        clean_company_name(F.col("text")).alias("cleaned_text"),
    )


def lookup_keys(spark, sf):
    return lookup.lookup_keys(_entries(spark, sf))


def company_lookup(spark, sf):
    return _evidence(spark, sf).drop("raw")


def company_responses(spark, sf):
    return responses.from_responses(adapter.replies(spark, sf)).drop("raw")


def company_replies_latest(spark, sf):
    """Many replies per company: the newest good one, else the newest failed one."""
    replies = adapter.replies(spark, sf).withColumn("query_name", F.col("company"))
    answers = responses.from_responses(replies, ["replied_at"])
    return lookup.one_per_company(answers, "replied_at").drop("raw")


def event_props_pick(spark, sf):
    events = adapter.table(spark, sf, "events")
    return events.select("event_id", pick(F.try_parse_json("props"), ["Scope", "k"]).alias("picked"))


def _known(spark, sf):
    """Lookups answered before: the registry's view of the documents that carry a label."""
    docs = adapter.table(spark, sf, "documents").join(adapter.table(spark, sf, "labels"), "doc_id")
    return docs.select(
        adapter.company_key(F.col("text")).alias("query_name"),
        F.when(F.col("toxic") == 0, F.concat("lang", F.lit("/"), "source")).alias("business_scope"),
        F.col("doc_id").alias("looked_up_at"),
    )


def lookup_pending(spark, sf):
    return lookup.pending_keys(lookup.lookup_keys(_entries(spark, sf)), _known(spark, sf).drop("looked_up_at"))


def lookup_merged(spark, sf):
    docs = adapter.table(spark, sf, "documents")
    fresh = docs.select(
        adapter.company_key(F.col("text")).alias("query_name"),
        F.col("source").alias("business_scope"),
        F.col("doc_id").alias("looked_up_at"),
    )
    return lookup.merge_lookups(_known(spark, sf), fresh)


def missing_fields(spark, sf):
    prepared = verdict.prepare(_entries(spark, sf))
    return prepared.select(
        "row_number",
        F.size("missing").alias("n_missing"),
        F.array_join("missing", K.LIST_SEPARATOR).alias("missing"),
    )


def keyword_hits(spark, sf):
    docs = adapter.table(spark, sf, "documents")
    return matching.keyword_hits(docs, ["doc_id"], "text", adapter.taxonomy(spark))


def keyword_hits_large(spark, sf):
    docs = adapter.table(spark, sf, "documents")
    return matching.keyword_hits(docs, ["doc_id"], "text", adapter.passage_taxonomy(spark, sf))


def keyword_hits_joined(spark, sf):
    """The plan for taxonomies beyond the search limits."""
    docs = adapter.table(spark, sf, "documents")
    return matching.keyword_hits(docs, ["doc_id"], "text", adapter.passage_taxonomy(spark, sf, search_terms=0))


def current_group(spark, sf):
    entries = _entries(spark, sf)
    groups = taxonomy.filed_groups(adapter.taxonomy(spark).rules)
    return (
        entries.join(
            groups,
            (F.col("category") == F.col("level2")) & (F.col("subcategory") == F.col("level3")),
            "left",
        )
        .select("row_number", "category", "subcategory", "level1", "group_ord")
    )


def score_current(spark, sf):
    scored = _scored(spark, sf)
    return scored.filter(F.col("lookup_key").isNotNull()).select(
        "row_number",
        F.col("filed.score").alias("score"),
        F.array_join("filed.evidence", K.EVIDENCE_SEPARATOR).alias("evidence"),
    )


def _best_columns(best: DataFrame) -> DataFrame:
    return best.select(
        "query_name",
        "best.score",
        "best.level2",
        "best.level3",
        F.array_join("best.words", K.LIST_SEPARATOR).alias("words"),
    )


def best_group(spark, sf):
    return _best_columns(scoring.best_groups(_evidence(spark, sf), adapter.taxonomy(spark)))


def best_group_large(spark, sf):
    """The plan for taxonomies beyond the literal limit."""
    passages = adapter.passage_taxonomy(spark, sf, literal_terms=0)
    return _best_columns(scoring.best_groups(_evidence(spark, sf), passages))


def _detail(spark, sf) -> DataFrame:
    entries = _entries(spark, sf)
    return review_detail(entries, adapter.taxonomy(spark), _evidence(spark, sf, entries), unique=True)


def review_detail_query(spark, sf):
    return detail_table(_detail(spark, sf))


def review_detail_large(spark, sf):
    """The plan for taxonomies beyond the literal limit."""
    entries = _entries(spark, sf)
    rules = taxonomy.Taxonomy(adapter.taxonomy(spark).rules, literal_terms=0)
    return detail_table(review_detail(entries, rules, _evidence(spark, sf, entries), unique=True))


def review_detail_joined(spark, sf):
    """The plan for taxonomies beyond the search limits."""
    entries = _entries(spark, sf)
    rules = taxonomy.Taxonomy(adapter.taxonomy(spark).rules, search_terms=0)
    return detail_table(review_detail(entries, rules, _evidence(spark, sf, entries), unique=True))


def person_summary(spark, sf):
    return summary_table(summary.person_summary(_detail(spark, sf)))


def review_steps(spark, sf):
    entries = _entries(spark, sf)
    return review(entries, adapter.taxonomy(spark), _evidence(spark, sf, entries), unique=True).steps


def page_links(spark, sf):
    return pages.followable(pages.page_links(adapter.table(spark, sf, "pages")))


def page_modules_topk(spark, sf):
    links = pages.page_links(adapter.table(spark, sf, "pages"))
    return pages.top_targets(links, modules=PAGE_WORDS)


def page_text(spark, sf):
    stored = adapter.table(spark, sf, "pages")
    return stored.select(
        "page_id", pages.page_title(F.col("html")).alias("title"), pages.clean_markup(F.col("html")).alias("text")
    )


def page_evidence(spark, sf):
    stored = adapter.table(spark, sf, "pages")
    return pages.host_evidence(stored, pages.page_links(stored), modules=PAGE_WORDS)


def _page_entries(spark, sf):
    """One entry per page and per document: the page's host is the company, documents name a site nobody stored."""
    stored = adapter.table(spark, sf, "pages")
    hosted = stored.select(
        F.lit("pages").alias("source_id"),
        (F.col("page_id") + 2).alias("row_number"),
        # No dots in the name itself: "www." inside it would count as a link of its own.
        F.concat(
            F.lit("Host "), F.replace(pages.url_host(F.col("url")), F.lit("."), F.lit("-")), F.lit(" "), F.col("url")
        ).alias("company_raw"),
    )
    docs = adapter.table(spark, sf, "documents").select(
        F.lit("documents").alias("source_id"),
        (F.col("doc_id") + 2).alias("row_number"),
        F.concat(F.lit("Person "), F.col("source"), F.when(F.col("lang") == "en", " www.d.example.com").otherwise("")).alias(
            "company_raw"
        ),
    )
    return pages.with_website(hosted.unionByName(docs))


def website_company_info(spark, sf):
    stored = adapter.table(spark, sf, "pages")
    evidence = pages.host_evidence(stored, pages.page_links(stored), modules=PAGE_WORDS)
    companies = pages.company_websites(_page_entries(spark, sf))
    return pages.from_websites(companies, evidence).drop("raw")


def page_url_latest(spark, sf):
    return pages.page_memo(adapter.table(spark, sf, "pages"), "page_id")


def entry_urls(spark, sf):
    return _page_entries(spark, sf).drop("company_raw")


def review_detail_sources(spark, sf):
    entries = pages.with_website(_entries(spark, sf))
    detail = review_detail(entries, adapter.taxonomy(spark), _evidence(spark, sf, entries), unique=True)
    return detail_table(detail, with_source=True)


def _detail_over_replies(spark, sf) -> DataFrame:
    """Replies are many per company, so the review's own reduction to one answer runs as well."""
    entries = pages.with_website(_entries(spark, sf))
    answers = company_evidence(
        entries, K.REGISTRY_SOURCE, responses=adapter.company_replies(spark, sf), order="replied_at"
    )
    return review_detail(entries, adapter.taxonomy(spark), answers)


def review_replies(spark, sf):
    """The whole review over stored registry replies, every kind of failure among them."""
    return detail_table(_detail_over_replies(spark, sf), with_source=True)


def review_replies_people(spark, sf):
    return summary_table(summary.person_summary(_detail_over_replies(spark, sf)))


def _detail_over_pages(spark, sf) -> DataFrame:
    entries = pages.with_website(entries_from_frame(adapter.website_worksheet(spark, sf)))
    stored = adapter.table(spark, sf, "pages")
    evidence = company_evidence(entries, K.WEBSITE_SOURCE, pages=stored, modules=PAGE_WORDS)
    return review_detail(entries, adapter.taxonomy(spark), evidence)


def review_pages(spark, sf):
    """The whole review over stored pages: sites read, sites nobody stored, companies without a site."""
    return detail_table(_detail_over_pages(spark, sf), with_source=True)


def review_pages_people(spark, sf):
    return summary_table(summary.person_summary(_detail_over_pages(spark, sf)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "entries_normalized": entries_normalized,
    "rules_filled": rules_filled,
    "rules_keywords": rules_keywords,
    "rule_groups": rule_groups,
    "rule_group_modules": rule_group_modules,
    "clean_company": clean_company,
    "lookup_keys": lookup_keys,
    "company_lookup": company_lookup,
    "company_responses": company_responses,
    "company_replies_latest": company_replies_latest,
    "event_props_pick": event_props_pick,
    "lookup_pending": lookup_pending,
    "lookup_merged": lookup_merged,
    "missing_fields": missing_fields,
    "keyword_hits": keyword_hits,
    "keyword_hits_large": keyword_hits_large,
    "keyword_hits_joined": keyword_hits_joined,
    "current_group": current_group,
    "score_current": score_current,
    "best_group": best_group,
    "best_group_large": best_group_large,
    "review_detail": review_detail_query,
    "review_detail_large": review_detail_large,
    "review_detail_joined": review_detail_joined,
    "person_summary": person_summary,
    "review_steps": review_steps,
    "page_links": page_links,
    "page_modules_topk": page_modules_topk,
    "page_text": page_text,
    "page_evidence": page_evidence,
    "website_company_info": website_company_info,
    "page_url_latest": page_url_latest,
    "entry_urls": entry_urls,
    "review_detail_sources": review_detail_sources,
    "review_replies": review_replies,
    "review_replies_people": review_replies_people,
    "review_pages": review_pages,
    "review_pages_people": review_pages_people,
}
