"""The operators over the driver's tables, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import alignment, decontaminate, divergence, harmonic, licenses, line_blocks, line_spread, minhash, packing, perplexity, token_files, toxicity, warc
from ledgerlens.llm.common import table


def op1_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archived = warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages")))
    return archived.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents")))


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.extract_main_text(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"))


def op12_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic.pack_documents(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_perplexity,
        op2_best_fit_packing,
        op3_warc,
        op4_token_files,
        op5_line_spread,
        op6_main_text,
        op7_decontaminate,
        op8_licenses,
        op9_toxicity,
        op10_minhash,
        op11_alignment,
        op12_harmonic_packing,
        op13_source_divergence,
    )
}

#: Payloads are compared as they are; SHA-1 is not in DuckDB's functions everywhere, so op3 has none.
ORACLE = {
    "op5_line_spread": """
        WITH raw_lines AS (
            SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ),
        lines AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM raw_lines),
        spread AS (
            SELECT line, min({'none': doc_id IS NULL, 'id': doc_id, 'pos': pos}) AS place
            FROM lines WHERE length(line) - length(replace(line, ' ', '')) >= 4
            GROUP BY line HAVING count(DISTINCT site) >= 3
        ),
        marked AS (
            SELECT l.*, s.line IS NOT NULL AND {'none': l.doc_id IS NULL, 'id': l.doc_id, 'pos': l.pos} <> s.place AS gone
            FROM lines l LEFT JOIN spread s ON l.line = s.line
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
               coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
        FROM marked GROUP BY doc_id
    """,
    "op13_source_divergence": r"""
        WITH docs AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ),
        words AS (SELECT lang, source, doc, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
        counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        grps AS (SELECT DISTINCT lang, source FROM docs),
        langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
        prices AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                   1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v)::HUGEINT AS p,
                   1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v)::HUGEINT AS q
            FROM grps g JOIN kept k USING (lang) JOIN langs l USING (lang)
            LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
            LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ),
        sums AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
            FROM prices a JOIN prices b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            GROUP BY a.lang, a.source, b.source
        ),
        found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
            FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM prices WHERE n > 0 AND p > q
        ),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
}
