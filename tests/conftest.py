from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("ledgerlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


RULE_SCHEMA = "rule_ord bigint, level1 string, level2 string, level3 string, module_name string, keywords array<string>"
ENTRY_SCHEMA = (
    "source_id string, row_number bigint, date string, name string, category string, subcategory string, "
    "company_raw string, stage string"
)
INFO_SCHEMA = (
    "query_name string, company_name string, business_scope string, status string, source string, "
    "success boolean, error string, raw string"
)


def rules_frame(spark, rows):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows, start=2)], RULE_SCHEMA)


def entries_frame(spark, rows):
    """Rows of (date, name, category, subcategory, company, stage)."""
    return spark.createDataFrame([("", i, *row) for i, row in enumerate(rows, start=2)], ENTRY_SCHEMA)


def found(name, scope, status="存续"):
    return (name, name, scope, status, "mock", True, "", "{}")


def missed(name, error="mock 数据中未找到该企业"):
    return (name, name, "", "", "mock", False, error, "{}")
