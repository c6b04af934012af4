"""Reading loosely typed JSON replies: one parse per body, then typed access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import first_non_blank, float_text, let


def member(document: Column, key: str) -> Column:
    """Member of a VARIANT object; null when absent, JSON null or not an object."""
    return F.try_variant_get(document, f"$['{key}']", "variant")


def kind(value: Column) -> Column:
    """Type name of a VARIANT, such as STRING, BIGINT, OBJECT<...>, ARRAY<...>, VOID."""
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("OBJECT"), F.lit(False))


def value_text(value: Column) -> Column:
    """Scalar as Python's str() would write it; objects and arrays keep their JSON text."""

    def written(value: Column) -> Column:
        plain = F.try_variant_get(value, "$", "string")
        return let(
            kind(value),
            lambda type_name: F.when(type_name == "BOOLEAN", F.initcap(plain))
            .when(type_name == "DOUBLE", float_text(F.try_variant_get(value, "$", "double")))
            # The parser drops trailing zeros of a fraction: 200.0 arrives as a whole decimal.
            .when(type_name.rlike(r"^DECIMAL\(([1-9]|1[0-8]),0\)$"), F.concat(plain, F.lit(".0")))
            .when(type_name == "VOID", F.lit(None).cast("string"))
            .otherwise(plain),
        )

    return let(value, written)


def truthy(value: Column) -> Column:
    """Python truth of a JSON value: null, false, 0, '', {} and [] are false."""

    def judged(parts: Column) -> Column:
        type_name, plain = parts["kind"], parts["plain"]
        return (
            F.when(type_name.isNull() | (type_name == "VOID"), F.lit(False))
            .when(type_name == "BOOLEAN", plain == "true")
            .when(type_name == "STRING", plain != "")
            .when(type_name.startswith("OBJECT"), plain != "{}")
            .when(type_name.startswith("ARRAY"), plain != "[]")
            .otherwise(F.coalesce(plain.try_cast("double") != 0, F.lit(True)))
        )

    parts = F.struct(kind(value).alias("kind"), F.try_variant_get(value, "$", "string").alias("plain"))
    return let(parts, judged)


def pick(document: Column, keys: tuple[str, ...] | list[str]) -> Column:
    """First non-blank member among the keys, as stripped text; '' when none."""
    return first_non_blank(*[value_text(member(document, key)) for key in keys])
