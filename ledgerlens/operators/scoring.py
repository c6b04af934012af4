"""How well a group fits an entry, and which group a company's own evidence supports best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.functions.text import let
from ledgerlens.operators.lookup import lookup_keys
from ledgerlens.operators.matching import by_anchors, contained, listed, term_hits, words_in
from ledgerlens.operators.skew import key_counts, skew_safe_left_join
from ledgerlens.operators.taxonomy import Taxonomy, inline_value

ENTRY_ID = ["source_id", "row_number"]


def first_words(words: str) -> str:
    return f"slice({words}, 1, {K.EVIDENCE_KEYWORDS})"


def scope_points(hits: str) -> str:
    return f"least({hits} * {K.SCOPE_POINTS}, {K.SCOPE_CAP})"


def stage_points(hits: str) -> str:
    return f"least({hits} * {K.STAGE_POINTS}, {K.STAGE_CAP})"


def group_score(levels: str, category: str, subcategory: str, modules_hit: str, scope_hits: str, stage_hits: str) -> Column:
    """Points of one group for one entry, 0 to 100. Arguments are SQL: three arrays and three columns."""
    return F.expr(
        f"""least({K.SCORE_CAP},
            if({category} != '' AND array_contains({levels}, {category}), {K.CATEGORY_POINTS}, 0)
            + if({subcategory} != '' AND array_contains({levels}, {subcategory}), {K.SUBCATEGORY_POINTS}, 0)
            + size({modules_hit}) * {K.MODULE_POINTS}
            + {scope_points(scope_hits)} + {stage_points(stage_hits)})"""
    )


def group_evidence(levels: str, category: str, subcategory: str, modules_hit: str, scope: str, stage: str) -> Column:
    """Evidence lines of one group for one entry, in their fixed order; keyword lines name the first few words."""

    def named(prefix: str, value: str) -> str:
        return f"if({value} != '' AND array_contains({levels}, {value}), concat('{prefix}', {value}), null)"

    def listing(prefix: str, words: str) -> str:
        shown = f"array_join({first_words(words)}, '{K.LIST_SEPARATOR}')"
        return f"if(size({words}) > 0, concat('{prefix}', {shown}), null)"

    return F.expr(
        f"""array_compact(concat(
            array({named(K.HIT_CATEGORY, category)}, {named(K.HIT_SUBCATEGORY, subcategory)}),
            transform({modules_hit}, module -> concat('{K.HIT_MODULE}', module)),
            array({listing(K.HIT_SCOPE, scope)}, {listing(K.HIT_STAGE, stage)})))"""
    )


def usable_scope() -> Column:
    return F.expr("if(success, coalesce(business_scope, ''), '')")


# -- words found where the texts are: nothing moves but what the company join moves anyway ----------------------------


def _with_scope_words(company_info: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    return company_info.select("*", words_in(usable_scope(), taxonomy).alias("scope_words"))


def _literal_best(found: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Adds `best` to evidence with `scope_words`: every group is scored inside the row.

    Structs order by score, then by earliest group (`rank`); the words only ride along.
    """
    groups = [
        {"rank": -group.group_ord, "level2": group.level2, "level3": group.level3, "keywords": list(group.keywords)}
        for group in taxonomy.collected_groups
    ]
    constant = inline_value(groups, "array<struct<rank:bigint,level2:string,level3:string,keywords:array<string>>>")
    candidates = F.transform(
        constant,
        lambda group: let(
            F.struct(listed(group["keywords"], F.col("scope_words")).alias("words"), group.alias("of")), _candidate
        ),
    )
    scored = found.select("*", F.when(F.size("scope_words") > 0, F.array_max(candidates)).alias("top"))
    best = """if(top.score > 0, named_struct('group_ord', -top.rank, 'score', top.score,
        'level2', top.level2, 'level3', top.level3, 'words', top.words), null) AS best"""
    return scored.selectExpr("*", best).drop("top")


def _candidate(found: Column) -> Column:
    group, words = found["of"], found["words"]
    return F.struct(
        F.least(F.size(words) * K.SCOPE_POINTS, F.lit(K.SCOPE_CAP)).alias("score"),
        group["rank"].alias("rank"),
        group["level2"].alias("level2"),
        group["level3"].alias("level3"),
        F.slice(words, 1, K.EVIDENCE_KEYWORDS).alias("words"),
    )


def _company_counts(entries: DataFrame) -> DataFrame:
    """Entries per company. The same aggregate as `lookup_keys`, so that a run that has both scans the entries once for
    them; incomplete entries are counted too, which at worst cuts a company into more pieces."""
    return lookup_keys(entries).selectExpr("query_name AS lookup_key", "entries AS n")


_FILED_TYPE = (
    "category string, subcategory string, filed_level1 string, filed_ord bigint, "
    "filed_modules array<string>, filed_keywords array<string>"
)


def _collected_filed_groups(taxonomy: Taxonomy) -> DataFrame:
    """Groups entries can be filed under, as a table bounded by the search limits and therefore broadcast."""
    last = {(g.level2, g.level3): g for g in taxonomy.collected_groups}
    rows = [(*key, g.level1, g.group_ord, list(g.modules), list(g.keywords)) for key, g in last.items()]
    return F.broadcast(taxonomy.rules.sparkSession.createDataFrame(rows, _FILED_TYPE))


def _local_scored(entries: DataFrame, company_info: DataFrame, taxonomy: Taxonomy, **skew) -> DataFrame:
    if taxonomy.literal:
        companies = [_literal_best(_with_scope_words(company_info, taxonomy), taxonomy)]
        scope_hit = F.struct(
            F.size(listed(F.col("filed_keywords"), F.col("scope_words"))).alias("scope_count"),
            listed(F.col("filed_keywords"), F.col("scope_words")).alias("scope_words"),
        )
    else:
        # The narrow table of hits joins the already salted entries; evidence texts are shuffled only once.
        companies = [company_info, _company_hits(_searched_group_hits(company_info, taxonomy), taxonomy)]
        scope_hit = F.try_element_at("hits", F.col("filed_ord"))
    row_id = [F.col(c) for c in ENTRY_ID]
    companies = [company.withColumnRenamed("query_name", "lookup_key") for company in companies]
    joined = skew_safe_left_join(entries, companies, "lookup_key", row_id, _company_counts(entries), **skew)
    placed = joined.join(_collected_filed_groups(taxonomy), ["category", "subcategory"], "left")
    return placed.select(
        "*",
        contained(F.col("filed_modules"), F.col("stage")).alias("filed_hit_modules"),
        scope_hit.alias("filed_hit"),
        contained(F.col("filed_keywords"), F.col("stage")).alias("filed_stage"),
    ).selectExpr(
        "*",
        "filed_hit.scope_words AS filed_scope",
        "coalesce(filed_hit.scope_count, 0) AS filed_scope_count",
        "coalesce(size(filed_stage), 0) AS filed_stage_count",
    )


def _searched_group_hits(company_info: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Like `company_group_hits`, for a `searchable` taxonomy."""
    if by_anchors(taxonomy):
        return company_group_hits(company_info, taxonomy)
    found = _with_scope_words(company_info, taxonomy)
    return _per_group(found.select("query_name", F.explode_outer("scope_words").alias("keyword")), taxonomy)


def _per_group(words: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Company words spread over the groups that have them and counted per (company, group)."""
    places = taxonomy.sized(taxonomy.keyword_places)
    hits = _first_hits("scope_count", "scope_words")
    return words.join(places, "keyword").groupBy("query_name", "group_ord").agg(*hits)


# -- taxonomy of any size: everything is an equi join on long tables --------------------------------------------------


def company_group_hits(company_info: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """(query_name, group_ord, scope_count, scope_words): keyword hits of every company's scope per group.

    What is collected per row is bounded by the words inside one company's text.
    """
    texts = company_info.select("query_name", usable_scope().alias("scope")).filter("scope != ''")
    # A word shared by many groups is looked for once and only then spread over its groups.
    return _per_group(term_hits(texts, ["query_name"], "scope", taxonomy.keywords, "keyword", taxonomy), taxonomy)


def _first_hits(count: str, words: str) -> list[Column]:
    """Number of keyword hits and the first of them in taxonomy order."""
    ordered = "array_sort(collect_list(struct(rule_ord, keyword_pos, keyword)))"
    return [
        F.expr(f"cast(count(*) AS int) AS {count}"),
        F.expr(f"{first_words(f'transform({ordered}, word -> word.keyword)')} AS {words}"),
    ]


def _top_group() -> Column:
    score = scope_points("scope_count")
    return F.expr(
        f"max_by(struct(group_ord, {score} AS score, scope_words AS words), struct({score}, -group_ord)) AS top"
    )


def _named_best(top: DataFrame, taxonomy: Taxonomy, *others: str) -> DataFrame:
    """`best` from the `top` of a company, which knows its group by number only."""
    named = top.select("query_name", *others, "top.*").join(taxonomy.sized(taxonomy.groups), "group_ord")
    return named.selectExpr("query_name", *others, "struct(group_ord, score, level2, level3, words) AS best")


def _best_of(group_hits: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    return _named_best(group_hits.groupBy("query_name").agg(_top_group()), taxonomy)


def _company_hits(group_hits: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """(query_name, hits, best): the hits of every group a company's text has words of, by group, for its entries to look up.

    One reader of `group_hits`, so texts are searched once. What is collected is bounded by the words inside one text.
    """
    posting = F.struct("group_ord", F.struct("scope_count", "scope_words"))
    hits = F.map_from_entries(F.collect_list(posting)).alias("hits")
    return _named_best(group_hits.groupBy("query_name").agg(_top_group(), hits), taxonomy, "hits")


def _long_scored(entries: DataFrame, company_info: DataFrame, taxonomy: Taxonomy, **skew) -> DataFrame:
    row_id = [F.col(c) for c in ENTRY_ID]
    # Read for the filings, the companies, the stages and the result.
    entries = taxonomy.keep(entries)
    group_hits = company_group_hits(company_info, taxonomy)
    filed = taxonomy.filed.selectExpr(
        "level2 AS category", "level3 AS subcategory", "level1 AS filed_level1", "group_ord AS filed_ord"
    )
    placed = entries.join(taxonomy.sized(filed), ["category", "subcategory"], "left")

    scorable = "lookup_key IS NOT NULL AND filed_ord IS NOT NULL"
    staged = placed.filter(scorable).selectExpr(*ENTRY_ID, "stage", "filed_ord AS group_ord")
    stage_hits = (
        term_hits(staged, ENTRY_ID, "stage", taxonomy.keyword_places, "keyword", taxonomy, on=("group_ord",))
        .groupBy(*ENTRY_ID)
        .agg(*_first_hits("filed_stage_count", "filed_stage"))
    )
    ordered = "array_sort(collect_list(struct(rule_ord, module_name)))"
    module_hits = (
        term_hits(staged, ENTRY_ID, "stage", taxonomy.modules, "module_name", taxonomy, on=("group_ord",))
        .groupBy(*ENTRY_ID)
        .agg(F.expr(f"transform({ordered}, m -> m.module_name) AS filed_hit_modules"))
    )
    scope_hits = group_hits.selectExpr(
        "struct(query_name AS company, group_ord) AS _filing",
        "scope_count AS filed_scope_count",
        "scope_words AS filed_scope",
    )
    filing = f"if({scorable}, struct(lookup_key AS company, filed_ord AS group_ord), null) AS _filing"
    with_filing = placed.selectExpr("*", filing)
    joined = skew_safe_left_join(with_filing, scope_hits, "_filing", row_id, **skew).drop("_filing")
    joined = joined.join(stage_hits, ENTRY_ID, "left").join(module_hits, ENTRY_ID, "left")
    companies = [
        company.withColumnRenamed("query_name", "lookup_key") for company in (company_info, _best_of(group_hits, taxonomy))
    ]
    # Counted on the kept entries: another count of the companies would read the table behind them.
    counts = key_counts(entries, "lookup_key")
    scored = skew_safe_left_join(joined, companies, "lookup_key", row_id, counts, **skew)
    return scored.fillna(0, ["filed_scope_count", "filed_stage_count"])


# -- shared ---------------------------------------------------------------------------------------------------------


def score_entries(entries: DataFrame, company_info: DataFrame, taxonomy: Taxonomy, **skew) -> DataFrame:
    """Entries with their evidence, the score of the group they are filed under and the best group of the evidence.

    Needs `lookup_key` on the entries (null where no lookup is wanted) and evidence unique on `query_name`. Adds the
    evidence columns, `filed` (group_ord, score, evidence; null without such a group) and `best` (group_ord, score,
    level2, level3, words; null without any hit).
    """
    plan = _local_scored if taxonomy.searchable else _long_scored
    levels = "array(filed_level1, category, subcategory)"
    modules, scope, stage = (
        f"coalesce({c}, cast(array() AS array<string>))" for c in ("filed_hit_modules", "filed_scope", "filed_stage")
    )
    scored = plan(entries, company_info, taxonomy, **skew).select(
        "*",
        group_score(levels, "category", "subcategory", modules, "filed_scope_count", "filed_stage_count").alias("_score"),
        group_evidence(levels, "category", "subcategory", modules, scope, stage).alias("_lines"),
    )
    return scored.selectExpr(
        *[f"`{c}`" for c in entries.columns],
        "company_name",
        "business_scope",
        "status AS company_status",
        "source",
        "success",
        "error",
        "if(filed_ord IS NULL, null, struct(filed_ord AS group_ord, _score AS score, _lines AS evidence)) AS filed",
        "best",
    )


def best_groups(company_info: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """(query_name, best): per company the group its evidence alone supports best; null without any hit."""
    if taxonomy.searchable:
        if taxonomy.literal:
            return _literal_best(_with_scope_words(company_info, taxonomy), taxonomy).select("query_name", "best")
        group_hits = _searched_group_hits(company_info, taxonomy)
    else:
        group_hits = company_group_hits(company_info, taxonomy)
    return company_info.select("query_name").join(_best_of(group_hits, taxonomy), "query_name", "left")
