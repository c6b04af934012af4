"""The keyword taxonomy: rule rows, their groups, and how large they are."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ledgerlens.operators.anchors import anchor_tables
from ledgerlens.operators.search import search_patterns

LEVELS = ["level1", "level2", "level3"]

# How far a taxonomy may grow before the next plan takes over (see Taxonomy):
# groups written into the expressions,
LITERAL_TERMS = 512
# words collected for one search pattern,
SEARCH_TERMS = 20_000
SEARCH_CHARS = 400_000
# term tables broadcast; beyond this they are shuffled like any other table.
BROADCAST_TERMS = 2_000_000
BROADCAST_CHARS = 64_000_000

REPEATED_ORDER = "rule_ord must be unique: a review takes one taxonomy in one order"


def rule_groups(rules: DataFrame) -> DataFrame:
    """Groups of equal levels; `group_ord` is the position of a group's first rule, so it orders the groups."""
    return rules.groupBy(*LEVELS).agg(F.min("rule_ord").alias("group_ord"))


def group_keywords(rules: DataFrame) -> DataFrame:
    """(group_ord, levels, keyword, rule_ord, keyword_pos): every distinct keyword of a group at its first place.

    Long form on purpose: a group may hold most of the taxonomy and is never gathered into one row here.
    """
    places = rules.select(*LEVELS, "rule_ord", F.posexplode_outer("keywords").alias("keyword_pos", "keyword"))
    first = (
        places.filter(F.col("keyword") != "")
        # Two fixed-width minima instead of one struct minimum keep this a hash aggregate on both steps.
        .groupBy(*LEVELS, "keyword", "rule_ord")
        .agg(F.min("keyword_pos").alias("keyword_pos"))
        .groupBy(*LEVELS, "keyword")
        .agg(F.min(F.struct("rule_ord", "keyword_pos")).alias("place"))
    )
    return first.join(rule_groups(rules), LEVELS).select("group_ord", *LEVELS, "keyword", "place.*")


def group_modules(rules: DataFrame) -> DataFrame:
    """(group_ord, module_name, rule_ord): named modules, one row per rule, repeats included."""
    named = rules.filter(F.col("module_name") != "").select(*LEVELS, "module_name", "rule_ord")
    return named.join(rule_groups(rules), LEVELS).select("group_ord", "module_name", "rule_ord")


def filed_groups(rules: DataFrame) -> DataFrame:
    """The group an entry is filed under, unique on (level2, level3): the last one when several level1 share it."""
    last = rule_groups(rules).groupBy("level2", "level3").agg(F.max_by("level1", "group_ord"), F.max("group_ord"))
    return last.toDF("level2", "level3", "level1", "group_ord")


@dataclass(frozen=True)
class Size:
    terms: int
    chars: int
    gram_lengths: tuple[int, ...]


@dataclass(frozen=True)
class Group:
    group_ord: int
    level1: str
    level2: str
    level3: str
    modules: tuple[str, ...]
    keywords: tuple[str, ...]


class Taxonomy:
    """Rule rows (rule_ord, level1, level2, level3, module_name, keywords) plus what their measured size allows.

    `literal`: few enough terms to score all groups inside one expression. `searchable`: the keywords fit a search
    pattern, so texts are searched where they are. `broadcastable`: term tables may be broadcast. Each has a plan
    without it.
    """

    def __init__(
        self,
        rules: DataFrame,
        literal_terms: int = LITERAL_TERMS,
        search_terms: int = SEARCH_TERMS,
        broadcast_chars: int = BROADCAST_CHARS,
    ):
        # Read by the size check and by every term table after it; a lost part is computed again from its source.
        self.rules = rules.persist()
        self._literal_terms = literal_terms
        self._search_terms = search_terms
        self._broadcast_chars = broadcast_chars
        self._kept: list[DataFrame] = []

    # Term tables, each described at the function of the same purpose above. They are no larger than the rules, serve
    # several joins each and are therefore kept like them.

    @cached_property
    def groups(self) -> DataFrame:
        return rule_groups(self.rules).persist()

    @cached_property
    def keyword_places(self) -> DataFrame:
        if not self.rules.groupBy("rule_ord").count().filter("count > 1").isEmpty():
            raise ValueError(REPEATED_ORDER)
        places = group_keywords(self.rules).select("group_ord", "keyword", "rule_ord", "keyword_pos")
        if self.size.terms > SEARCH_TERMS or self.size.chars > SEARCH_CHARS:
            return places.persist()
        # A few are values of the plan: adaptive execution shares no step that reads a kept table, and would search texts once
        # per reader of the hits.
        return self.rules.sparkSession.createDataFrame(places.toArrow(), places.schema)

    @property
    def keywords(self) -> DataFrame:
        """(keyword): every distinct keyword once, however many groups share it."""
        return self.keyword_places.select("keyword").distinct()

    @cached_property
    def modules(self) -> DataFrame:
        return group_modules(self.rules).persist()

    @cached_property
    def filed(self) -> DataFrame:
        return filed_groups(self.rules).persist()

    def keep(self, frame: DataFrame) -> DataFrame:
        """Keep a narrow table that the plan without search reads several times, until release()."""
        self._kept.append(frame.persist())
        return frame

    def release(self) -> None:
        """Drop what is kept in executor storage."""
        self.rules.unpersist()
        for frame in self._kept:
            frame.unpersist()
        self._kept.clear()
        for name in ("groups", "keyword_places", "modules", "filed"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()

    @cached_property
    def size(self) -> Size:
        """One-row aggregate over the rules; every decision about collecting and broadcasting rests on it."""
        row = (
            self.rules.selectExpr("explode(concat(array(module_name), keywords)) AS term")
            .selectExpr("length(term) AS n")
            .selectExpr(
                "count(*) AS terms",
                "coalesce(sum(n), 0) AS chars",
                "coalesce(bool_or(n = 1), false) AS g1",
                "coalesce(bool_or(n BETWEEN 2 AND 3), false) AS g2",
                "coalesce(bool_or(n BETWEEN 4 AND 7), false) AS g4",
                "coalesce(bool_or(n >= 8), false) AS g8",
            )
            .first()
        )
        return Size(row["terms"], row["chars"], tuple(n for n in (1, 2, 4, 8) if row[f"g{n}"]))

    @cached_property
    def anchor_tables(self) -> dict[int, bytes]:
        """Bit tables of the anchors of all terms, module names among them: six megabytes at most."""
        terms = self.rules.selectExpr("explode(concat(array(module_name), keywords)) AS term")
        return anchor_tables(terms, self.size.terms)

    @property
    def broadcastable(self) -> bool:
        return self.size.chars <= self._broadcast_chars and self.size.terms <= BROADCAST_TERMS

    def sized(self, terms: DataFrame) -> DataFrame:
        """Broadcast hint for a table derived from the taxonomy, only when its measured size allows it."""
        return F.broadcast(terms) if self.broadcastable else terms

    @cached_property
    def patterns(self) -> tuple[list[str], list[str]] | None:
        """Search patterns of the keywords and the few keywords that fit none; None when either are too many."""
        if self.size.terms > self._search_terms or self.size.chars > SEARCH_CHARS:
            return None
        return search_patterns(set(self.collected_keywords))

    @cached_property
    def collected_keywords(self) -> list[str]:
        return list(dict.fromkeys(word for group in self.collected_groups for word in group.keywords))

    @property
    def searchable(self) -> bool:
        return self.patterns is not None

    @property
    def literal(self) -> bool:
        return self.searchable and self.size.terms <= self._literal_terms

    @cached_property
    def collected_groups(self) -> list[Group]:
        """The groups as values in first-appearance order; the caller has checked `size`, which bounds them."""
        members: dict[tuple[str, str, str], list[Row]] = {}
        rows = self.rules.select("rule_ord", *LEVELS, "module_name", "keywords").collect()
        if len({row["rule_ord"] for row in rows}) < len(rows):
            raise ValueError(REPEATED_ORDER)
        for row in sorted(rows, key=lambda row: row["rule_ord"]):
            members.setdefault(tuple(row[level] for level in LEVELS), []).append(row)
        return [
            Group(
                rows[0]["rule_ord"],
                *levels,
                modules=tuple(row["module_name"] for row in rows if row["module_name"]),
                keywords=tuple(dict.fromkeys(word for row in rows for word in row["keywords"] if word)),
            )
            for levels, rows in members.items()
        ]


def inline_value(value: object, data_type: str) -> Column:
    """A small nested value as one constant; the optimizer folds it into a literal."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), data_type)
