"""Which terms occur in which texts: substring matching without comparing every text with every term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.anchors import with_anchor, with_text_anchors
from ledgerlens.operators.taxonomy import Taxonomy, inline_value

# Up to this many words, testing each is faster than the pattern search.
FEW_WORDS = 32
# Beyond this many, looking them up by their anchors is: the patterns' cost grows with the words, the anchors' does not.
MANY_WORDS = 256


def contained(words: Column, text: Column) -> Column:
    """Non-empty words that occur in the text (case-sensitive), in word order."""
    return F.filter(words, lambda word: (word != "") & F.contains(text, word))


def listed(words: Column, allowed: Column) -> Column:
    """Words that are also in `allowed`, in word order."""
    return F.array_intersect(words, allowed)


def words_in(text: Column, taxonomy: Taxonomy) -> Column:
    """Distinct taxonomy keywords inside the text, for a `searchable` taxonomy.

    A few words are looked for one by one; many take one pass over the text per pattern, however many they are, and words that
    fit no pattern are looked for one by one beside them.
    """
    if len(taxonomy.collected_keywords) <= FEW_WORDS:
        return contained(inline_value(taxonomy.collected_keywords, "array<string>"), text)
    patterns, single = taxonomy.patterns
    found = [F.regexp_extract_all(text, F.lit(pattern), 1) for pattern in patterns]
    if single:
        found.append(contained(inline_value(single, "array<string>"), text))
    return F.array_distinct(F.concat(*found))


def by_anchors(taxonomy: Taxonomy) -> bool:
    """Whether keywords are looked up by their anchors: always beyond the search limits, and where patterns would be slower."""
    return not taxonomy.searchable or len(taxonomy.collected_keywords) > MANY_WORDS


def term_hits(
    texts: DataFrame,
    ids: list[str],
    text: str,
    terms: DataFrame,
    term: str,
    taxonomy: Taxonomy,
    on: tuple[str, ...] = (),
) -> DataFrame:
    """(ids, columns of terms) for every row of `terms` whose term is inside a text; `on` columns must agree as well.

    An equi join on each term's anchor finds the few terms that can occur, `contains` confirms them. Texts do not move
    while the measured term table fits a broadcast; beyond that only (id, anchor) pairs are shuffled and the surviving
    candidates are confirmed against the text afterwards.
    """
    keys = [*on, "_anchor"]
    wanted = with_anchor(terms.filter(F.col(term) != ""), term)
    anchored = with_text_anchors(texts.select(*ids, *on, F.col(text).alias("_text")), "_text", taxonomy.anchor_tables)
    exploded = anchored.select(*ids, *on, "_text", F.explode("_anchors").alias("_anchor"))
    if taxonomy.broadcastable:
        found = exploded.join(F.broadcast(wanted), keys).filter(F.contains("_text", term))
    else:
        candidates = exploded.drop("_text").join(wanted, keys)
        confirm = texts.select(*ids, F.col(text).alias("_text"))
        found = candidates.join(confirm, ids).filter(F.contains("_text", term))
    return found.select(*ids, *terms.columns)


def keyword_hits(texts: DataFrame, ids: list[str], text: str, taxonomy: Taxonomy) -> DataFrame:
    """(ids, keyword) for every taxonomy keyword inside every text."""
    if by_anchors(taxonomy):
        return term_hits(texts, ids, text, taxonomy.keywords, "keyword", taxonomy)
    found = texts.select(*ids, F.explode_outer(words_in(F.col(text), taxonomy)).alias("keyword"))
    return found.filter("keyword IS NOT NULL")
