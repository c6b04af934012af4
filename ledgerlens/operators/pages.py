"""Evidence from stored web pages: links, page choice, cleaned text, company_info."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.functions.text import clean_company_name, collapse_whitespace, let, unescape_markup, website_url
from ledgerlens.operators.late import content_hash, possible
from ledgerlens.operators.skew import skew_safe_left_join

LINK_PATTERN = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>(.*?)</a\s*>"""
TITLE_PATTERN = r"(?is)<title[^>]*>(.*?)</title\s*>"
DROPPED_ELEMENTS = ("script", "style", "nav", "footer")
ATTACHMENT_PATTERN = rf"(?i)\.({'|'.join(K.ATTACHMENT_SUFFIXES)})$"


def url_host(url: Column) -> Column:
    """Lower-case host of a link, scheme optional; '' when there is none."""
    return F.lower(F.regexp_extract(url, r"^(?i:https?://)?(?:[^/?#@]*@)?([^/?#:]+)", 1))


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, a scheme for bare hosts, fragment dropped."""

    def lowered(full: Column) -> Column:
        origin = F.regexp_extract(full, r"^([^/]*//[^/?#]*)", 1)
        rest = F.regexp_extract(full, r"(?s)^[^/]*//[^/?#]*(.*)$", 1)
        return F.concat(F.lower(origin), rest)

    def completed(bare: Column) -> Column:
        full = F.when(bare.rlike("^(?i)https?://"), bare).otherwise(F.concat(F.lit("http://"), bare))
        return F.when(bare == "", F.lit("")).otherwise(let(full, lowered))

    return let(F.regexp_replace(url, "(?s)#.*$", ""), completed)


def _without_dots(path: Column) -> Column:
    """Path with its '.' and '..' segments resolved."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(kept, "/")).otherwise(path)


def resolve_link(page: Column, href: Column) -> Column:
    """Absolute form of a link found on a page, fragment dropped; null for mailto:, javascript: and the like."""

    def resolved(link: Column) -> Column:
        page, target = link["page"], link["target"]
        scheme = F.regexp_extract(page, r"^([A-Za-z]+:)//", 1)
        origin = F.regexp_extract(page, r"^([A-Za-z]+://[^/?]*)", 1)
        base = F.regexp_replace(page, r"\?.*$", "")
        folder = F.regexp_extract(base, r"^[A-Za-z]+://[^/]*(/(?:.*/)?)", 1)
        tail = F.regexp_extract(target, r"(\?.*)$", 1)
        path = F.regexp_replace(target, r"\?.*$", "")
        rooted = F.when(path.startswith("/"), path).otherwise(
            F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)
        )
        return (
            F.when(target == "", page)
            .when(target.rlike("^(?i)https?://"), target)
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None).cast("string"))
            .when(target.startswith("//"), F.concat(scheme, target))
            .when(target.startswith("?"), F.concat(base, target))
            .otherwise(F.concat(origin, let(rooted, _without_dots), tail))
        )

    without_fragments = F.struct(
        F.regexp_replace(page, "(?s)#.*$", "").alias("page"), F.regexp_replace(href, "(?s)#.*$", "").alias("target")
    )
    return normalize_url(let(without_fragments, resolved))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, page_url, link_pos, href, anchor, url) for every link of pages (page_id, url, html)."""
    found = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(LINK_PATTERN), 1).alias("href"),
        F.regexp_extract_all("html", F.lit(LINK_PATTERN), 2).alias("anchor"),
    )
    links = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode_outer(found).alias("link_pos", "link"))
    links = links.filter("link IS NOT NULL")
    href = unescape_markup(F.btrim(F.btrim("link.href", F.lit("\"'"))))
    return links.select(
        "page_id",
        "page_url",
        "link_pos",
        href.alias("href"),
        clean_markup(F.col("link.anchor")).alias("anchor"),
    ).withColumn("url", resolve_link(F.col("page_url"), F.col("href")))


def followable(links: DataFrame) -> DataFrame:
    """Links that stay on the page's own host and do not lead to an attachment."""
    path = F.regexp_replace("url", r"\?.*$", "")
    return links.filter(
        F.col("url").isNotNull() & (url_host(F.col("url")) == url_host(F.col("page_url"))) & ~path.rlike(ATTACHMENT_PATTERN)
    )


def module_of(*texts: Column, modules: dict[str, tuple[str, ...]] | None = None) -> Column:
    """First module, in priority order, one of whose words occurs in one of the texts; null when none does."""

    def chosen(texts: Column) -> Column:
        choice = None
        for name, words in (modules or K.PAGE_MODULES).items():
            named = F.exists(texts, lambda text: reduce(lambda a, b: a | b, [text.contains(word) for word in words]))
            choice = F.when(named, name) if choice is None else choice.when(named, name)
        return choice

    return let(F.array_compact(F.array(*texts)), chosen)


def module_rank(module: Column, modules: dict[str, tuple[str, ...]] | None = None) -> Column:
    """1 for the most valuable module; the home page comes after all of them; null for no module."""
    names = [*(modules or K.PAGE_MODULES), K.HOME_MODULE]
    return F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), module), F.lit(0)).cast("int")


def top_targets(links: DataFrame, modules=None, max_pages: int = K.MAX_PAGES) -> DataFrame:
    """(host, url, module, module_rank, place): per host the distinct module links, best first, at most `max_pages`."""
    named = followable(links).select(
        url_host(F.col("page_url")).alias("host"),
        "url",
        module_of(F.col("anchor"), F.col("url"), modules=modules).alias("module"),
    )
    ranked = named.filter(F.col("module").isNotNull()).withColumn(
        "module_rank", module_rank(F.col("module"), modules)
    )
    distinct = ranked.groupBy("host", "url").agg(F.min("module_rank").alias("module_rank"))
    names = F.array(*[F.lit(n) for n in [*(modules or K.PAGE_MODULES), K.HOME_MODULE]])
    return _best_per_host(distinct, max_pages).withColumn("module", F.element_at(names, F.col("module_rank")))


def _best_per_host(candidates: DataFrame, max_pages: int) -> DataFrame:
    """Top rows per host. The rank filter is applied inside every task before the shuffle (window group limit), so a
    host with most of the pages sends no more than `max_pages` rows per task."""
    best_first = Window.partitionBy("host").orderBy("module_rank", "url")
    return candidates.withColumn("place", F.row_number().over(best_first)).filter(F.col("place") <= max_pages)


def clean_markup(html: Column) -> Column:
    """Readable text: no scripts, styles, navigation, footers, comments or tags; white space collapsed."""
    text = html
    for element in DROPPED_ELEMENTS:
        text = F.regexp_replace(text, rf"(?is)<{element}\b[^>]*>.*?</{element}\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    return collapse_whitespace(unescape_markup(text))


def page_title(html: Column) -> Column:
    return clean_markup(F.regexp_extract(html, TITLE_PATTERN, 1))


def classify_pages(pages: DataFrame, links: DataFrame | None = None, modules=None) -> DataFrame:
    """(page_id, host, url, module, module_rank) of the pages worth reading: module pages and home pages.

    A page belongs to a module through its own title or address, or through the text of a link that leads to it. The
    result is narrow: no markup travels with it.
    """
    names = [*(modules or K.PAGE_MODULES), K.HOME_MODULE]
    graded = pages.select(
        "page_id",
        url_host(F.col("url")).alias("host"),
        normalize_url(F.col("url")).alias("url"),
        module_rank(module_of(page_title(F.col("html")), F.col("url"), modules=modules), modules).alias("own_rank"),
    )
    if links is None:
        graded = graded.withColumn("link_rank", F.lit(None).cast("int"))
    else:
        linked = followable(links).select(
            "url", module_rank(module_of(F.col("anchor"), modules=modules), modules).alias("link_rank")
        )
        linked = linked.filter(F.col("link_rank").isNotNull()).groupBy("url").agg(F.min("link_rank").alias("link_rank"))
        # An address may have been stored very often.
        graded = skew_safe_left_join(graded, linked, "url", [F.col("page_id")])
    home = f"if(url rlike '^[a-z]+://[^/?]*/?$', {len(names)}, null)"
    ranked = graded.withColumn("module_rank", F.expr(f"coalesce(least(own_rank, link_rank), {home})"))
    return ranked.filter("module_rank IS NOT NULL").select(
        "page_id",
        "host",
        "url",
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("module_rank")).alias("module"),
        "module_rank",
    )


def host_evidence(
    pages: DataFrame,
    links: DataFrame | None = None,
    modules=None,
    max_pages: int = K.MAX_PAGES,
    max_chars: int | None = None,
) -> DataFrame:
    """(host, stored_pages, used_pages, evidence): one row per host, best pages' text joined by a space.

    An address stored more than once counts once, with its newest page (largest page_id). Pages compete by address
    alone; markup is fetched and cleaned only for those that won a place.
    """
    every = pages.groupBy(url_host(F.col("url")).alias("host")).agg(F.count("*").alias("stored_pages"))
    addresses = classify_pages(pages, links, modules).groupBy("host", "url").agg(
        F.min("module_rank").alias("module_rank"), F.max("page_id").alias("page_id")
    )
    chosen = _best_per_host(addresses, max_pages).select("host", "place", "page_id")
    at = F.xxhash64("page_id")
    markup = possible(pages.select("page_id", "html"), at, chosen, at)
    # Cleaned where it is read: markup never moves.
    texts = markup.select("page_id", clean_markup(F.col("html")).alias("text")).join(chosen, "page_id")
    joined = (
        texts.select("host", "place", "text")
        .groupBy("host")
        # At most max_pages texts per host.
        .agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("texts"))
    )
    evidence = collapse_whitespace(F.array_join(F.transform("texts", lambda t: t["text"]), " "))
    if max_chars is not None:
        evidence = F.substring(evidence, 1, max_chars)
    return every.join(joined, "host", "left").select(
        "host",
        "stored_pages",
        F.coalesce(F.size("texts"), F.lit(0)).cast("bigint").alias("used_pages"),
        F.coalesce(evidence, F.lit("")).alias("evidence"),
    )


def with_website(entries: DataFrame) -> DataFrame:
    """Entries plus `website_url`, the link inside their company text; that text itself stays as it is."""
    return entries.withColumn("website_url", website_url(F.col("company_raw")))


def company_websites(entries: DataFrame) -> DataFrame:
    """(query_name, website_url): per cleaned company the first link entered for it, '' when none was."""
    linked = entries if "website_url" in entries.columns else with_website(entries)
    position = F.struct("source_id", "row_number")
    return linked.groupBy(clean_company_name(F.col("company_raw")).alias("query_name")).agg(
        F.coalesce(
            F.min_by("website_url", F.when(F.col("website_url") != "", position)), F.lit("")
        ).alias("website_url")
    )


def from_websites(companies: DataFrame, evidence: DataFrame, min_chars: int = 1) -> DataFrame:
    """company_info from (query_name, website_url) and host_evidence rows.

    Many companies may name the same host (a marketplace), so the join is the skew-safe one.
    """
    keyed = companies.withColumn("host", F.when(F.col("website_url") != "", url_host(F.col("website_url"))))
    found = skew_safe_left_join(keyed, evidence, "host", [F.col("query_name")])
    text = F.coalesce("evidence", F.lit(""))
    error = (
        F.when(F.col("website_url") == "", K.WEBSITE_NO_URL)
        .when(F.col("stored_pages").isNull(), K.WEBSITE_UNREACHABLE)
        .when(F.length(text) < min_chars, K.WEBSITE_WEAK)
        .otherwise("")
    )
    return found.withColumn("error", error).select(
        "query_name",
        F.col("query_name").alias("company_name"),
        F.when(F.col("error") == "", text).otherwise("").alias("business_scope"),
        F.lit("").alias("status"),
        F.lit(K.WEBSITE_SOURCE).alias("source"),
        (F.col("error") == "").alias("success"),
        "error",
        F.to_json(F.struct("website_url")).alias("raw"),
    )


def page_memo(pages: DataFrame, fetched_at: str, error: Column | None = None) -> DataFrame:
    """(url, fetched_at, text, error): the newest stored fetch of every distinct address, on a tie by a hash of its content.

    Addresses and fetch times compete; markup is cleaned where it is read, for fetches that may have won, and never moves.
    """
    fetches = pages.select(
        normalize_url(F.col("url")).alias("url"),
        F.col(fetched_at).alias("fetched_at"),
        "html",
        (F.lit("") if error is None else error).alias("error"),
    )
    marked = fetches.withColumn("_hash", content_hash(fetches.columns))
    newest = Window.partitionBy("url").orderBy(F.desc_nulls_last("fetched_at"), F.desc("_hash"))
    ranked = marked.select("url", "fetched_at", "_hash").withColumn("_place", F.row_number().over(newest))
    best = ranked.filter("_place = 1").select(F.col("url").alias("_url"), F.col("_hash").alias("_best"))
    near = possible(marked, F.col("_hash"), best, F.col("_best"))
    texts = near.select("url", "fetched_at", clean_markup(F.col("html")).alias("text"), "error", "_hash")
    found = texts.join(best, texts["url"].eqNullSafe(best["_url"]) & (texts["_hash"] == best["_best"]))
    # A fetch stored twice is one.
    once = Window.partitionBy("_url", "_best").orderBy(F.lit(0))
    return found.withColumn("_copy", F.row_number().over(once)).filter("_copy = 1").select("url", "fetched_at", "text", "error")
