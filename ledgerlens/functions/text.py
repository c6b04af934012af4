"""Text columns: everything here is a built-in Spark expression, no UDF."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import constants as K


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, however often the body names it.

    Without it the optimizer copies the expression into every use, and again into every filter it pushes down.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_text(text: Column) -> Column:
    """Strip Unicode white space from both ends (`trim` alone only knows U+0020)."""
    return F.btrim(text, F.lit(K.WHITESPACE))


def collapse_whitespace(text: Column) -> Column:
    return strip_text(F.regexp_replace(text, f"[{K.WHITESPACE_CLASS}]+", " "))


def clean_company_name(text: Column) -> Column:
    """Company text without links, white space and edge punctuation; null becomes ''."""
    without_links = F.regexp_replace(F.coalesce(text, F.lit("")), K.URL_PATTERN, "")
    compact = F.regexp_replace(without_links, f"[{K.WHITESPACE_CLASS}]+", "")
    return F.btrim(compact, F.lit(K.COMPANY_EDGE_MARKS))


def website_url(text: Column) -> Column:
    """First link inside the company text, '' when there is none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), f"({K.URL_PATTERN})", 1)


def split_keywords(text: Column) -> Column:
    """Keyword list of one cell: order and duplicates stay, blanks go."""
    parts = F.transform(F.split(text, K.KEYWORD_SEPARATORS), strip_text)
    return F.filter(parts, lambda part: part != "")


def float_text(value: Column) -> Column:
    """A double as Python's str() writes it: positional from 1e-4 up to 1e16, else like 1e+16."""

    def written(text: Column) -> Column:
        exponent = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
        digits = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), "0+$", "")
        scientific = F.concat(
            F.regexp_replace(text, r"(\.0)?E.*$", ""),
            F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
            F.format_string("%02d", F.abs(exponent)),
        )
        return (
            F.when(text == "NaN", F.lit("nan"))
            .when(text == "Infinity", F.lit("inf"))
            .when(text == "-Infinity", F.lit("-inf"))
            .when(~text.contains("E"), text)
            # A whole number is left with its point only.
            .when(exponent.between(-4, 15), F.regexp_replace(digits, r"\.$", ".0"))
            .otherwise(scientific)
        )

    return let(value.cast("string"), written)


def cell_text(cell: Column, data_type: T.DataType) -> Column:
    """Any cell as stripped text; null becomes ''."""
    if isinstance(data_type, T.BooleanType):
        text = F.initcap(cell.cast("string"))
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        text = float_text(cell.cast("string").cast("double"))
    else:
        text = cell.cast("string")
    return F.coalesce(strip_text(text), F.lit(""))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_non_blank(*texts: Column) -> Column:
    """First candidate that is not blank, stripped; '' when all are."""
    return F.coalesce(*[blank_to_null(strip_text(text)) for text in texts], F.lit(""))


def unescape_markup(text: Column) -> Column:
    """The markup entities that ordinary pages use; &amp; last, so that nothing is decoded twice."""
    named = [
        ("&nbsp;", " "),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&#39;", "'"),
        ("&amp;", "&"),
    ]
    return reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), named, text)
