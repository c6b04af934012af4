"""From a scored entry to its verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.functions.text import clean_company_name


def missing_fields() -> Column:
    """Headers of the required fields an entry leaves empty, in header order."""
    tests = ", ".join(f"if({name} = '', '{header}', null)" for header, name in K.ENTRY_HEADERS.items())
    return F.expr(f"array_compact(array({tests}))")


def prepare(entries: DataFrame) -> DataFrame:
    """Adds the cleaned company, the missing fields and the lookup key (null: this entry needs no evidence)."""
    named = entries.select(
        "*", clean_company_name(F.col("company_raw")).alias("cleaned_company"), missing_fields().alias("missing")
    )
    return named.select("*", F.expr("if(size(missing) = 0, cleaned_company, null)").alias("lookup_key"))


def _rung(status: str, confidence: str, error_type: str, reason: str, suggestion: str, review: bool) -> str:
    return (
        f"named_struct('status', '{status}', 'confidence', {confidence}, 'error_type', '{error_type}', "
        f"'reason', {reason}, 'suggestion', {suggestion}, 'needs_review', {str(review).lower()})"
    )


def verdict() -> Column:
    """The decision ladder as one struct; the first rung that applies decides."""
    filed = "coalesce(filed.score, 0)"
    incomplete = _rung(
        K.INCOMPLETE,
        "0",
        K.ERROR_INCOMPLETE,
        f"concat('{K.REASON_MISSING}', array_join(missing, '{K.LIST_SEPARATOR}'))",
        "''",
        True,
    )
    not_found = _rung(
        K.UNDECIDED,
        "0",
        K.ERROR_NO_COMPANY,
        f"if(success is null, '{K.REASON_NO_LOOKUP}', coalesce(error, ''))",
        "''",
        True,
    )
    no_scope = _rung(K.UNDECIDED, filed, K.ERROR_NO_SCOPE, f"'{K.REASON_NO_SCOPE}'", "''", True)
    correct = _rung(K.CORRECT, filed, "", f"array_join(filed.evidence, '{K.EVIDENCE_SEPARATOR}')", "''", False)
    wrong = _rung(
        K.WRONG,
        f"greatest(best.score, {K.KEEP_FROM})",
        K.ERROR_SUBCATEGORY,
        f"concat('{K.REASON_BETTER}{K.HIT_SCOPE}', array_join(best.words, '{K.LIST_SEPARATOR}'))",
        "concat(best.level2, ' / ', best.level3)",
        False,
    )
    doubtful = _rung(K.DOUBTFUL, filed, K.ERROR_WEAK_EVIDENCE, f"'{K.REASON_PARTIAL}'", "''", True)
    return F.expr(
        f"""CASE
            WHEN size(missing) > 0 THEN {incomplete}
            WHEN NOT coalesce(success, false) THEN {not_found}
            WHEN coalesce(business_scope, '') = '' THEN {no_scope}
            WHEN {filed} >= {K.CORRECT_FROM} THEN {correct}
            WHEN best.score >= {K.SUGGEST_FROM} AND {filed} < {K.KEEP_FROM} THEN {wrong}
            ELSE {doubtful} END"""
    )


def judge(scored: DataFrame) -> DataFrame:
    """Review result per scored entry; company columns stay '' where the ladder stops before scoring."""

    def company(name: str) -> str:
        return f"if(size(missing) = 0 AND coalesce(success, false), coalesce({name}, ''), '') AS {name}"

    extra = [c for c in ("website_url",) if c in scored.columns]
    return scored.select("*", verdict().alias("verdict")).selectExpr(
        "source_id",
        "row_number",
        "name AS employee_name",
        "category AS original_category",
        "subcategory AS original_subcategory",
        "stage AS original_stage",
        "company_raw AS original_company",
        "cleaned_company",
        "verdict.status",
        "verdict.confidence",
        company("company_name"),
        company("company_status"),
        company("business_scope"),
        "verdict.error_type",
        "verdict.reason",
        "verdict.suggestion",
        "verdict.needs_review",
        "coalesce(source, '') AS data_source",
        *extra,
    )
