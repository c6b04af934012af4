"""The expected result of every query as ANSI SQL over the driver tables, written apart from the Spark plans."""

from __future__ import annotations

from ledgerlens import constants as K
from ledgerlens.queries import adapter
from ledgerlens.queries.catalog import PAGE_WORDS

# White space as RE2 sees it; \s there is ASCII and lacks the vertical tab.
_WS = r"[\s\x0b\p{Z}\x{85}\x1c-\x1f]"
_NOT_WS = r"[^\s\x0b\p{Z}\x{85}\x1c-\x1f]"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_WS}+|{_WS}+$', '', 'g')"


def _clean(text: str) -> str:
    links = f"regexp_replace({text}, 'https?://{_NOT_WS}+|www\\.{_NOT_WS}+', '', 'g')"
    return f"trim(regexp_replace({links}, '{_WS}+', '', 'g'), '{K.COMPANY_EDGE_MARKS}')"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


RATED = "rated AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"

_SHIFT = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in adapter.NEXT_LANGUAGE.items())
FILED_DOCUMENTS = f"""
filed AS (
  SELECT *, CASE WHEN source IN {adapter.MISFILING} THEN CASE lang {_SHIFT} END ELSE lang END AS filed FROM rated
)"""


def _sheet_rows(row: str, company: str, cleaned: str) -> str:
    return f"""SELECT {row} AS row_number,
         CASE WHEN contains(text, '@') THEN '' ELSE n_chars::VARCHAR END AS date,
         source AS name,
         CASE WHEN filed IN ('en', 'de') THEN 'germanic' ELSE 'romance' END AS category,
         CASE WHEN contains(text, '|') THEN '' WHEN source = '{adapter.UNKNOWING}' THEN 'xx' ELSE filed END AS subcategory,
         {company} AS company_raw,
         source || '（' || lang || '、'
           || CASE WHEN quality IS NULL THEN 'unknown' WHEN quality = 1 THEN 'rated good' ELSE 'rated poor' END
           || '）' AS stage,
         {cleaned} AS cleaned"""


_FILED_SHEET = _sheet_rows(
    "doc_id + 2", "'Doc ' || md5(text) || ' Ltd， https://d.example.com/' || doc_id", "'Doc' || md5(text) || 'Ltd'"
)
ENTRIES = f"""{FILED_DOCUMENTS},
entries AS (
  {_FILED_SHEET}
  FROM filed
)"""

EVIDENCE = f"""
newest AS (
  SELECT 'Doc' || md5(text) || 'Ltd' AS query_name, text, quality, toxic FROM rated
  QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) = 1
),
evidence AS (
  SELECT query_name,
         query_name AS company_name,
         CASE WHEN toxic = 1 OR quality = 0 THEN '' ELSE text END AS business_scope,
         CASE WHEN toxic = 1 THEN '' ELSE '存续' END AS status,
         '{K.STATIC_SOURCE}' AS source,
         coalesce(toxic, 0) = 0 AS success,
         CASE WHEN toxic = 1 THEN '{K.STATIC_MISS}' ELSE '' END AS error
  FROM newest
)"""

_SHEET = ", ".join(str((n, *row)) for n, row in enumerate(adapter.TAXONOMY, start=2))


def _rules(rows: str) -> str:
    """Rule rows (rn, l1, l2, l3, module, kws) down to distinct keywords per group, in first-seen order."""
    return f"""
sheet(rn, l1, l2, l3, module, kws) AS ({rows}),
filled AS (
  SELECT rn, module, kws,
         coalesce(last_value(nullif(l1, '') IGNORE NULLS) OVER w, '') AS l1,
         coalesce(last_value(nullif(l2, '') IGNORE NULLS) OVER w, '') AS l2,
         coalesce(last_value(nullif(l3, '') IGNORE NULLS) OVER w, '') AS l3
  FROM sheet WINDOW w AS (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
rules AS (
  SELECT *, min(rn) OVER (PARTITION BY l1, l2, l3) AS gord FROM filled WHERE module <> '' OR kws <> ''
),
pieces AS (
  SELECT gord, l1, l2, l3, rn, unnest(list) AS kw, generate_subscripts(list, 1) AS pos
  FROM (SELECT *, list_filter(list_transform(
          string_split_regex(kws, '[、，,;；\\n\\r]+'), lambda x: {_strip('x')}), lambda x: x <> '') AS list FROM rules)
),
keywords AS (
  SELECT gord, l1, l2, l3, kw, rn, pos FROM pieces
  QUALIFY row_number() OVER (PARTITION BY gord, kw ORDER BY rn, pos) = 1
)"""


RULES = _rules(f"VALUES {_SHEET}")
PASSAGES = _rules(
    "SELECT item_id + 2, 'benchmark', 'passage', item_id::VARCHAR, '', " + _strip("replace(text, '.', ',')") + " FROM benchmark"
)

FILED = """
filed_group AS (
  SELECT l1, l2, l3, gord FROM rules
  QUALIFY row_number() OVER (PARTITION BY l2, l3 ORDER BY gord DESC, rn) = 1
)"""

BEST = """
scope_hits AS (
  SELECT query_name, gord, l2, l3, count(*) AS n, list(kw ORDER BY rn, pos)[1:6] AS words
  FROM evidence JOIN keywords ON contains(business_scope, kw)
  GROUP BY ALL
),
best AS (
  SELECT query_name, least(12 * n, 45)::INTEGER AS score, l2, l3, array_to_string(words, '、') AS words FROM scope_hits
  QUALIFY row_number() OVER (PARTITION BY query_name ORDER BY least(12 * n, 45) DESC, gord) = 1
)"""

CURRENT = """
placed AS (
  SELECT e.*, f.gord, f.l1 FROM entries e
  LEFT JOIN filed_group f ON e.category = f.l2 AND e.subcategory = f.l3
),
complete AS (
  SELECT * FROM placed
  WHERE date <> '' AND name <> '' AND category <> '' AND subcategory <> '' AND company_raw <> '' AND stage <> ''
),
stage_hits AS (
  SELECT row_number, count(*) AS n, list(kw ORDER BY rn, pos)[1:6] AS words
  FROM complete c JOIN keywords k ON c.gord = k.gord AND contains(c.stage, k.kw) GROUP BY ALL
),
module_hits AS (
  SELECT row_number, count(*) AS n, string_agg('环节模块命中：' || module, '；' ORDER BY rn) AS lines
  FROM complete c JOIN rules r ON c.gord = r.gord AND r.module <> '' AND contains(c.stage, r.module) GROUP BY ALL
),
current AS (
  SELECT c.row_number,
         CASE WHEN c.gord IS NOT NULL THEN least(100, 40 + 5 * coalesce(m.n, 0) + least(12 * coalesce(s.n, 0), 45)
           + least(6 * coalesce(t.n, 0), 20))::INTEGER END AS score,
         CASE WHEN c.gord IS NOT NULL THEN concat_ws('；', '分类命中：' || c.category, '细分命中：' || c.subcategory, m.lines,
           '经营范围关键词：' || array_to_string(s.words, '、'), '录入环节关键词：' || array_to_string(t.words, '、')) END AS evidence
  FROM complete c
  LEFT JOIN scope_hits s ON s.query_name = c.cleaned AND s.gord = c.gord
  LEFT JOIN stage_hits t ON t.row_number = c.row_number
  LEFT JOIN module_hits m ON m.row_number = c.row_number
)"""

_MISSING = """list_filter([CASE WHEN date = '' THEN '日期' END, CASE WHEN name = '' THEN '姓名' END,
  CASE WHEN category = '' THEN '一级分类' END, CASE WHEN subcategory = '' THEN '细分' END,
  CASE WHEN company_raw = '' THEN '企业名称&官网' END, CASE WHEN stage = '' THEN '环节' END], lambda x: x IS NOT NULL)"""

DETAIL = f"""
judged AS (
  SELECT e.*, v.success, v.error, v.company_name, v.status AS registered, v.business_scope, v.source AS found_in,
         coalesce(c.score, 0) AS cur, c.evidence AS lines, b.score AS best_score, b.l2 AS best_l2, b.l3 AS best_l3,
         b.words, array_to_string({_MISSING}, '、') AS missing
  FROM entries e
  LEFT JOIN evidence v ON v.query_name = e.cleaned
  LEFT JOIN current c ON c.row_number = e.row_number
  LEFT JOIN best b ON b.query_name = e.cleaned
),
rung AS (
  SELECT *, CASE WHEN missing <> '' THEN 1 WHEN NOT success THEN 2 WHEN business_scope = '' THEN 3
                 WHEN cur >= 80 THEN 4 WHEN best_score >= 35 AND cur < 60 THEN 5 ELSE 6 END AS r
  FROM judged
),
detail AS (
  SELECT row_number, name, category, subcategory, stage, company_raw, cleaned,
         ['信息缺失', '无法判断', '无法判断', '正确', '错误', '疑似错误'][r] AS status,
         (CASE WHEN r <= 2 THEN 0 WHEN r = 5 THEN 60 ELSE cur END)::INTEGER AS confidence,
         CASE WHEN r > 2 THEN company_name ELSE '' END AS company_name,
         CASE WHEN r > 2 THEN registered ELSE '' END AS registered,
         CASE WHEN r > 2 THEN business_scope ELSE '' END AS business_scope,
         ['信息缺失', '企业信息缺失', '经营范围缺失', '', '细分错误', '证据不足'][r] AS error_type,
         CASE r WHEN 1 THEN '必填字段缺失：' || missing WHEN 2 THEN error
                WHEN 3 THEN '企业经营范围为空，无法进行分类匹配' WHEN 4 THEN lines
                WHEN 5 THEN '经营范围更匹配建议分类：经营范围关键词：' || words
                ELSE '经营范围与当前分类只有部分匹配，建议人工复核' END AS reason,
         CASE WHEN r = 5 THEN best_l2 || ' / ' || best_l3 ELSE '' END AS suggestion,
         CASE WHEN r IN (4, 5) THEN '否' ELSE '是' END AS review,
         CASE WHEN missing = '' THEN found_in ELSE '' END AS found_in
  FROM rung
)"""

_REVIEW = _with(RATED, ENTRIES, EVIDENCE, RULES, FILED, BEST, CURRENT, DETAIL)


def _detail_columns(scope: str = "经营范围") -> str:
    return f"""row_number AS "原始行号", name AS "姓名", category AS "一级分类", subcategory AS "细分", stage AS "环节",
  company_raw AS "企业名称原文", cleaned AS "清洗后企业名称", status AS "审计结果", confidence AS "置信度",
  company_name AS "企查查企业名称", registered AS "经营状态", business_scope AS "{scope}", error_type AS "错误类型",
  reason AS "错误原因", suggestion AS "建议修正", review AS "是否需要人工复核" """


RULE_CELLS = (
    RATED
    + f""",
cells AS (
  SELECT lang AS source_id, doc_id + 2 AS row_number,
         CASE WHEN quality = 0 THEN source ELSE '' END AS c1,
         CASE WHEN toxic = 1 THEN lang || '-' || source ELSE '' END AS c2,
         CASE WHEN contains(text, '!') THEN source ELSE '' END AS c3,
         CASE WHEN quality = 1 THEN 'rated good' WHEN quality = 0 THEN 'rated poor' ELSE '' END AS module_name,
         CASE WHEN contains(text, '|') THEN '' ELSE text END AS keyword_text
  FROM rated
),
doc_rules AS (
  SELECT source_id, row_number,
         coalesce(last_value(nullif(c1, '') IGNORE NULLS) OVER w, '') AS level1,
         coalesce(last_value(nullif(c2, '') IGNORE NULLS) OVER w, '') AS level2,
         coalesce(last_value(nullif(c3, '') IGNORE NULLS) OVER w, '') AS level3,
         module_name, keyword_text
  FROM cells
  WINDOW w AS (PARTITION BY source_id ORDER BY row_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
kept AS (SELECT * FROM doc_rules WHERE module_name <> '' OR keyword_text <> ''),
split_up AS (
  SELECT source_id, row_number, level1, level2, level3, unnest(list) AS keyword,
         (generate_subscripts(list, 1) - 1)::INTEGER AS keyword_pos
  FROM (SELECT *, list_filter(list_transform(string_split_regex(keyword_text, '[、，,;；\\n\\r]+'),
          lambda x: {_strip('x')}), lambda x: x <> '') AS list FROM kept)
),
grouped AS (SELECT level1, level2, level3, min(row_number) AS group_ord FROM kept GROUP BY ALL)"""
)

KNOWN = """
known AS (
  SELECT 'Doc' || md5(d.text) || 'Ltd' AS query_name,
         CASE WHEN l.toxic = 0 THEN d.lang || '/' || d.source END AS business_scope, d.doc_id AS looked_up_at
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id
)"""

_REPLIES = f"""
SELECT query_name,
       CASE WHEN outcome = '' AND quality IS NOT DISTINCT FROM 1 THEN query_name
            WHEN outcome = '' THEN source ELSE query_name END AS company_name,
       CASE WHEN outcome = '' THEN {_strip('text')} ELSE '' END AS business_scope,
       CASE WHEN outcome = '' AND quality IS DISTINCT FROM 1 THEN n_chars::VARCHAR ELSE '' END AS status,
       '{K.REGISTRY_SOURCE}' AS source, outcome = '' AS success, outcome AS error
FROM (SELECT *, doc_id::VARCHAR AS query_name,
             CASE WHEN source = 'src2' THEN '{K.REGISTRY_TRANSPORT}timeout ' || lang
                  WHEN source = 'src4' THEN '{K.REGISTRY_HTTP}503'
                  WHEN source = 'src5' THEN '{K.REGISTRY_NOT_JSON}'
                  WHEN source IN ('src6', 'src8') THEN '{K.REGISTRY_BAD_RESULT}'
                  WHEN source = 'src9' THEN '{K.REGISTRY_NO_SCOPE}'
                  WHEN toxic = 1 THEN '{K.REGISTRY_REFUSED}' || source
                  ELSE '' END AS outcome FROM rated)"""


_REPLIES_BY_COMPANY = _REPLIES.replace("doc_id::VARCHAR AS query_name", "lang || '/' || source AS query_name").replace(
    "SELECT query_name,", "SELECT doc_id AS replied_at, query_name,"
)

# -- pages ----------------------------------------------------------------------------------------------------------


def _text(html: str) -> str:
    for element in ("script", "style", "nav", "footer"):
        html = f"regexp_replace({html}, '(?is)<{element}\\b[^>]*>.*?</{element}\\s*>', ' ', 'g')"
    html = f"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')"
    html = f"regexp_replace({html}, '<[^>]+>', ' ', 'g')"
    return _strip(f"regexp_replace({_entities(html)}, '{_WS}+', ' ', 'g')")


def _entities(text: str) -> str:
    for entity, plain in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")]:
        text = f"replace({text}, '{entity}', '{plain}')"
    return text


def _host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^(?:(?i:https?)://)?([^/?#:]+)', 1))"


def _rank(*texts: str) -> str:
    whens = [
        f"WHEN {' OR '.join(f'contains({text}, {chr(39)}{word}{chr(39)})' for text in texts for word in words)} THEN {rank}"
        for rank, words in enumerate(PAGE_WORDS.values(), start=1)
    ]
    return f"CASE {' '.join(whens)} END"


_NAMES = str([*PAGE_WORDS, K.HOME_MODULE])
_ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)[^>]*>(.*?)</a\s*>"""

LINKS = f"""
raw_links AS (
  SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '{_ANCHOR}', 1)) AS target,
         unnest(regexp_extract_all(html, '{_ANCHOR}', 2)) AS inner_html,
         unnest(range(len(regexp_extract_all(html, '{_ANCHOR}', 1))))::INTEGER AS link_pos
  FROM pages
),
links AS (
  SELECT page_id, page_url, link_pos, href, anchor,
         CASE WHEN bare LIKE 'http%' THEN bare
              WHEN bare = '' THEN regexp_replace(page_url, '#.*', '')
              WHEN bare LIKE '/%' THEN regexp_extract(page_url, '^[a-z]+://[^/?#]*') || bare END AS url
  FROM (SELECT *, regexp_replace(href, '#.*', '') AS bare
        FROM (SELECT page_id, page_url, link_pos, {_entities("trim(target, '\"''')")} AS href, {_text('inner_html')} AS anchor
              FROM raw_links))
),
own_links AS (
  SELECT * FROM links
  WHERE {_host('url')} = {_host('page_url')}
    AND NOT regexp_matches(regexp_replace(url, '\\?.*', ''), '(?i)\\.({'|'.join(K.ATTACHMENT_SUFFIXES)})$')
)"""

PAGE_EVIDENCE = f"""
linked AS (
  SELECT url, min({_rank('anchor')}) AS rank FROM own_links GROUP BY url HAVING min({_rank('anchor')}) IS NOT NULL
),
titled AS (
  SELECT page_id, {_host('url')} AS host, regexp_replace(url, '#.*', '') AS url, html,
         {_text("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)")} AS title
  FROM pages
),
graded AS (
  SELECT t.*, coalesce(least({_rank('title', 't.url')}, l.rank),
                       CASE WHEN regexp_matches(t.url, '^[a-z]+://[^/?]*/?$') THEN {len(PAGE_WORDS) + 1} END) AS rank
  FROM titled t LEFT JOIN linked l ON l.url = t.url
),
addresses AS (
  SELECT host, url, min(rank) AS rank, arg_max(html, page_id) AS html FROM graded WHERE rank IS NOT NULL GROUP BY host, url
),
chosen AS (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY rank, url) AS place FROM addresses QUALIFY place <= {K.MAX_PAGES}
),
host_evidence AS (
  SELECT h.host, h.stored_pages, coalesce(c.used_pages, 0) AS used_pages, coalesce(c.evidence, '') AS evidence
  FROM (SELECT {_host('url')} AS host, count(*) AS stored_pages FROM pages GROUP BY 1) h
  LEFT JOIN (SELECT host, count(*) AS used_pages, trim(string_agg({_text('html')}, ' ' ORDER BY place)) AS evidence
             FROM chosen GROUP BY host) c ON c.host = h.host
)"""

PAGE_ENTRIES = f"""
filings AS (
  SELECT 'pages' AS source_id, page_id + 2 AS row_number, {_host('url')} AS subject, 'Host' || replace({_host('url')}, '.', '-') AS cleaned,
         url AS website_url FROM pages
  UNION ALL
  SELECT 'documents', doc_id + 2, source, 'Person' || source,
         CASE WHEN lang = 'en' THEN 'www.d.example.com' ELSE '' END FROM documents
)"""

_PEOPLE = """SELECT name AS "姓名", count(*) AS "录入数量", count(*) FILTER (status <> '信息缺失') AS "完整数量",
  count(*) FILTER (status = '正确') AS "正确数量", count(*) FILTER (status = '错误') AS "错误数量",
  count(*) FILTER (status = '疑似错误') AS "疑似错误数量", count(*) FILTER (status = '无法判断') AS "无法判断数量",
  CASE WHEN count(*) FILTER (status IN ('正确', '错误')) = 0 THEN '0%'
       ELSE round_even(count(*) FILTER (status = '正确') / count(*) FILTER (status IN ('正确', '错误')) * 100, 0)::INTEGER
            || '%' END AS "正确率"
FROM detail GROUP BY name ORDER BY min(row_number)"""

REPLY_EVIDENCE = f"""
evidence AS (
  SELECT * EXCLUDE (replied_at) FROM ({_REPLIES_BY_COMPANY.replace("lang || '/' || source AS query_name", "'Doc' || md5(text) || 'Ltd' AS query_name")})
  QUALIFY row_number() OVER (PARTITION BY query_name ORDER BY success DESC, replied_at DESC) = 1
)"""


def _website_evidence(filings: str) -> str:
    """company_info of the companies in `filings` (source_id, row_number, cleaned, website_url)."""
    return f"""
evidence AS (
  SELECT query_name, query_name AS company_name, CASE WHEN error = '' THEN evidence ELSE '' END AS business_scope,
         '' AS status, '{K.WEBSITE_SOURCE}' AS source, error = '' AS success, error
  FROM (
    SELECT c.query_name, h.evidence,
           CASE WHEN c.website_url = '' THEN '{K.WEBSITE_NO_URL}' WHEN h.host IS NULL THEN '{K.WEBSITE_UNREACHABLE}'
                WHEN h.evidence = '' THEN '{K.WEBSITE_WEAK}' ELSE '' END AS error
    FROM (SELECT cleaned AS query_name, coalesce(arg_min(website_url, (source_id, row_number)) FILTER (website_url <> ''), '')
            AS website_url FROM {filings} GROUP BY 1) c
    LEFT JOIN host_evidence h ON h.host = {_host('c.website_url')} AND c.website_url <> ''
  )
)"""


_PERSON_SHEET = _sheet_rows(
    "doc_id * 2 + 3",
    "'Person ' || source || '-' || lang || CASE WHEN lang = 'en' THEN ' www.d.example.com' ELSE '' END",
    "'Person' || source || '-' || lang",
)
WEBSITE_ENTRIES = f"""{FILED_DOCUMENTS},
entries AS (
  {_PERSON_SHEET}, CASE WHEN lang = 'en' THEN 'www.d.example.com' ELSE '' END AS website_url, '' AS source_id
  FROM filed
  UNION ALL
  SELECT page_id * 2 + 2, page_id::VARCHAR, regexp_extract(host, '[a-z]+$'),
         CASE WHEN filed IN ('en', 'de') THEN 'germanic' ELSE 'romance' END, coalesce(filed, ''),
         'Host ' || replace(host, '.', '-') || ' ' || url, host || '（' || lang || '、rated good）', 'Host' || replace(host, '.', '-'),
         url, ''
  FROM (SELECT *, CASE WHEN contains(url, '?') THEN CASE lang {_SHIFT} END ELSE lang END AS filed
        FROM (SELECT page_id, url, {_host('url')} AS host, regexp_extract(url, '{adapter.PAGE_LANGUAGE}', 1) AS lang FROM pages))
)"""

_REVIEW_REPLIES = _with(RATED, ENTRIES, REPLY_EVIDENCE, RULES, FILED, BEST, CURRENT, DETAIL)
_REVIEW_PAGES = _with(
    RATED, WEBSITE_ENTRIES, LINKS, PAGE_EVIDENCE, _website_evidence("entries"), RULES, FILED, BEST, CURRENT, DETAIL
)

ORACLE: dict[str, str] = {
    "entries_normalized": _with(RATED, ENTRIES)
    + "SELECT row_number, date, name, category, subcategory, company_raw, stage FROM entries",
    "rules_filled": _with(RULE_CELLS)
    + "SELECT source_id, row_number, level1, level2, level3, module_name, keyword_text FROM kept",
    "rules_keywords": _with(RULE_CELLS) + "SELECT row_number AS rule_ord, keyword_pos, keyword FROM split_up",
    "rule_groups": _with(RULE_CELLS)
    + """SELECT g.group_ord, s.level1, s.level2, s.level3, s.keyword, s.row_number AS rule_ord, s.keyword_pos
FROM (SELECT * FROM split_up QUALIFY row_number() OVER (
        PARTITION BY level1, level2, level3, keyword ORDER BY row_number, keyword_pos) = 1) s
JOIN grouped g ON g.level1 = s.level1 AND g.level2 = s.level2 AND g.level3 = s.level3""",
    "rule_group_modules": _with(RULE_CELLS)
    + """SELECT g.group_ord, k.module_name, k.row_number AS rule_ord FROM kept k
JOIN grouped g ON g.level1 = k.level1 AND g.level2 = k.level2 AND g.level3 = k.level3 WHERE k.module_name <> ''""",
    "clean_company": f"""SELECT doc_id, 'Doc' || md5(text) || 'Ltd' AS cleaned, {_clean('text')} AS cleaned_text
FROM documents""",
    "lookup_keys": _with(RATED, ENTRIES) + "SELECT cleaned AS query_name, count(*) AS entries FROM entries GROUP BY 1",
    "company_lookup": _with(RATED, EVIDENCE) + "SELECT * FROM evidence",
    "company_responses": _with(RATED) + _REPLIES,
    "company_replies_latest": _with(RATED)
    + f"""SELECT * FROM ({_REPLIES_BY_COMPANY})
          QUALIFY row_number() OVER (PARTITION BY query_name ORDER BY success DESC, replied_at DESC) = 1""",
    "event_props_pick": """SELECT event_id, coalesce(nullif(trim(json_extract_string(props, '$.Scope')), ''),
  nullif(trim(json_extract_string(props, '$.k')), ''), '') AS picked FROM events""",
    "lookup_pending": _with(RATED, ENTRIES, KNOWN)
    + """SELECT cleaned AS query_name, count(*) AS entries FROM entries
WHERE cleaned NOT IN (SELECT query_name FROM known WHERE business_scope IS NOT NULL) GROUP BY 1""",
    "lookup_merged": _with(KNOWN)
    + """SELECT query_name, business_scope, looked_up_at FROM (
  SELECT *, 0 AS fresh FROM known UNION ALL
  SELECT 'Doc' || md5(text) || 'Ltd', source, doc_id, 1 FROM documents)
QUALIFY row_number() OVER (PARTITION BY query_name ORDER BY looked_up_at DESC, fresh DESC) = 1""",
    "missing_fields": _with(RATED, ENTRIES)
    + f"""SELECT row_number, len({_MISSING})::INTEGER AS n_missing, array_to_string({_MISSING}, '、') AS missing
FROM entries""",
    "keyword_hits": _with(RULES)
    + """SELECT doc_id, kw AS keyword FROM documents JOIN (SELECT DISTINCT kw FROM keywords) ON contains(text, kw)""",
    "keyword_hits_large": _with(PASSAGES)
    + """SELECT doc_id, kw AS keyword FROM documents JOIN (SELECT DISTINCT kw FROM keywords) ON contains(text, kw)""",
    "keyword_hits_joined": _with(PASSAGES)
    + """SELECT doc_id, kw AS keyword FROM documents JOIN (SELECT DISTINCT kw FROM keywords) ON contains(text, kw)""",
    "current_group": _with(RATED, ENTRIES, RULES, FILED)
    + """SELECT e.row_number, e.category, e.subcategory, f.l1 AS level1, f.gord::BIGINT AS group_ord
FROM entries e LEFT JOIN filed_group f ON e.category = f.l2 AND e.subcategory = f.l3""",
    "score_current": _with(RATED, ENTRIES, EVIDENCE, RULES, FILED, BEST, CURRENT)
    + "SELECT row_number, score, evidence FROM current",
    "best_group": _with(RATED, EVIDENCE, RULES, BEST)
    + """SELECT e.query_name, b.score, b.l2 AS level2, b.l3 AS level3, b.words
FROM evidence e LEFT JOIN best b ON b.query_name = e.query_name""",
    "best_group_large": _with(RATED, EVIDENCE, PASSAGES, BEST)
    + """SELECT e.query_name, b.score, b.l2 AS level2, b.l3 AS level3, b.words
FROM evidence e LEFT JOIN best b ON b.query_name = e.query_name""",
    "review_detail": _REVIEW + f"SELECT {_detail_columns()} FROM detail",
    "review_detail_large": _REVIEW + f"SELECT {_detail_columns()} FROM detail",
    "review_detail_joined": _REVIEW + f"SELECT {_detail_columns()} FROM detail",
    "review_detail_sources": _REVIEW
    + f"""SELECT {_detail_columns(K.NEUTRAL_SCOPE_HEADER)}, found_in AS "数据来源",
  'https://d.example.com/' || (row_number - 2) AS "官网链接" FROM detail""",
    "person_summary": _REVIEW + _PEOPLE,
    "review_steps": _with(RATED, ENTRIES, RULES)
    + """, counts AS (SELECT (SELECT count(*) FROM entries) AS e, (SELECT count(*) FROM rules) AS r,
  (SELECT count(DISTINCT cleaned) FROM entries) AS c)
SELECT 1 AS step_ord, '读取员工记录 ' || e || ' 条' AS step, e AS n FROM counts
UNION ALL SELECT 2, '读取分类规则 ' || r || ' 条', r FROM counts
UNION ALL SELECT 3, '查询企业 ' || c || ' 家', c FROM counts
UNION ALL SELECT 4, '完成审计 ' || e || ' 条', e FROM counts
UNION ALL SELECT 5, '生成质量汇总', NULL
UNION ALL SELECT 6, '导出审计结果 Excel', NULL""",
    "page_links": _with(LINKS) + "SELECT page_id, page_url, link_pos, href, anchor, url FROM own_links",
    "page_modules_topk": _with(LINKS)
    + f""", targets AS (
  SELECT {_host('page_url')} AS host, url, min({_rank('anchor', 'url')}) AS module_rank FROM own_links GROUP BY ALL
)
SELECT host, url, module_rank, row_number() OVER (PARTITION BY host ORDER BY module_rank, url)::INTEGER AS place,
  {_NAMES}[module_rank] AS module FROM targets WHERE module_rank IS NOT NULL QUALIFY place <= {K.MAX_PAGES}""",
    "page_text": f"""SELECT page_id, {_text("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)")} AS title,
  {_text('html')} AS text FROM pages""",
    "page_evidence": _with(LINKS, PAGE_EVIDENCE) + "SELECT host, stored_pages, used_pages, evidence FROM host_evidence",
    "website_company_info": _with(LINKS, PAGE_EVIDENCE, PAGE_ENTRIES, _website_evidence("filings"))
    + "SELECT * FROM evidence",
    "page_url_latest": f"""SELECT url, page_id AS fetched_at, {_text('html')} AS text, '' AS error
FROM (SELECT page_id, regexp_replace(url, '#.*', '') AS url, html FROM pages)
QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1""",
    "entry_urls": _with(PAGE_ENTRIES) + "SELECT source_id, row_number, website_url FROM filings",
    "review_replies": _REVIEW_REPLIES
    + f"""SELECT {_detail_columns(K.NEUTRAL_SCOPE_HEADER)}, found_in AS "数据来源",
  'https://d.example.com/' || (row_number - 2) AS "官网链接" FROM detail""",
    "review_replies_people": _REVIEW_REPLIES + _PEOPLE,
    "review_pages": _REVIEW_PAGES
    + f"""SELECT {_detail_columns(K.NEUTRAL_SCOPE_HEADER)},
  CASE found_in WHEN '{K.WEBSITE_SOURCE}' THEN '{K.WEBSITE_LABEL}' ELSE found_in END AS "数据来源",
  website_url AS "官网链接" FROM detail JOIN (SELECT row_number, website_url FROM entries) USING (row_number)""",
    "review_pages_people": _REVIEW_PAGES + _PEOPLE,
}
