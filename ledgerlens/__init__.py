"""Review of hand-entered classification records, written as Spark DataFrame jobs."""

from ledgerlens.operators.taxonomy import Taxonomy
from ledgerlens.plans.review import ReviewTables, review, review_detail, run_review
from ledgerlens.sources.tables import (
    entries_from_frame,
    read_entries,
    read_rules,
    rules_from_frame,
)

__all__ = [
    "ReviewTables",
    "Taxonomy",
    "review",
    "review_detail",
    "entries_from_frame",
    "read_entries",
    "read_rules",
    "rules_from_frame",
    "run_review",
]
