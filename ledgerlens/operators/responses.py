"""Batches of raw registry replies turned into company_info."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.functions.json_values import is_object, member, pick, truthy, value_text


def from_responses(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """company_info from (query_name, http_status, body, transport_error); columns named in `keep` stay.

    A null or empty transport_error is none. A body is parsed once. A JSON body that is no object is reported as a format error.
    """
    responses = responses.withColumn("transport_error", F.coalesce("transport_error", F.lit("")))
    parsed = responses.withColumn("doc", F.try_parse_json("body")).select(
        "query_name",
        "http_status",
        "body",
        "transport_error",
        *(keep or []),
        "doc",
        is_object(F.col("doc")).alias("doc_ok"),
        *[member(F.col("doc"), key).alias(key.lower()) for key in ("Status", "Message", "msg", "Result", "Data")],
    )
    result = F.when(truthy(F.col("result")), F.col("result")).when(truthy(F.col("data")), F.col("data"))
    opened = parsed.withColumn("payload", result)
    picked = opened.withColumns(
        {
            "scope": pick(F.col("payload"), K.SCOPE_KEYS),
            "mapped_name": pick(F.col("payload"), K.NAME_KEYS),
            "reg_status": pick(F.col("payload"), K.STATUS_KEYS),
        }
    )
    message = (
        F.when(truthy(F.col("message")), value_text(F.col("message")))
        .when(truthy(F.col("msg")), value_text(F.col("msg")))
        .otherwise(F.col("body"))
    )
    checked = picked.withColumn(
        "error",
        F.when(F.col("transport_error") != "", F.concat(F.lit(K.REGISTRY_TRANSPORT), "transport_error"))
        .when(
            ~F.col("http_status").eqNullSafe(200),
            F.concat(F.lit(K.REGISTRY_HTTP), F.coalesce(F.col("http_status").cast("string"), F.lit(""))),
        )
        .when(F.col("doc").isNull(), F.lit(K.REGISTRY_NOT_JSON))
        .when(~F.col("doc_ok"), F.lit(K.REGISTRY_BAD_RESULT))
        .when(
            ~value_text(F.col("status")).eqNullSafe(F.lit("200")),
            F.concat(F.lit(K.REGISTRY_REFUSED), message),
        )
        .when(F.col("payload").isNotNull() & ~is_object(F.col("payload")), F.lit(K.REGISTRY_BAD_RESULT))
        .when(F.col("scope") == "", F.lit(K.REGISTRY_NO_SCOPE))
        .otherwise(F.lit("")),
    ).withColumn("success", F.col("error") == "")
    has_payload = (F.col("transport_error") == "") & F.col("http_status").eqNullSafe(200) & F.col("doc").isNotNull()

    def when_found(name: str):
        return F.when(F.col("success"), F.col(name)).otherwise(F.lit(""))

    return checked.select(
        "query_name",
        F.when(F.col("success") & (F.col("mapped_name") != ""), F.col("mapped_name"))
        .otherwise(F.col("query_name"))
        .alias("company_name"),
        when_found("scope").alias("business_scope"),
        when_found("reg_status").alias("status"),
        F.lit(K.REGISTRY_SOURCE).alias("source"),
        "success",
        "error",
        F.when(has_payload, F.col("body")).otherwise(F.lit("{}")).alias("raw"),
        *(keep or []),
    )
