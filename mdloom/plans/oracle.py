"""The same results in DuckDB's SQL, written on their own: regular expressions, lists and windows instead of Spark's forms."""

from __future__ import annotations

from mdloom.functions.text import WS
from mdloom.plans.reports import lines_of_orders, reports_sql, roughened_sql

_WS = "concat(" + ", ".join(f"chr({ord(c)})" for c in WS) + ")"
_CLASS = "".join(f"\\x{{{ord(c):X}}}" for c in WS)
_WORDS = r"'[\s*:|]+'"
_MARKER = r"'^(?:[-+]|\p{Nd}+\.)'"


def strip(x: str) -> str:
    return f"trim({x}, {_WS})"


def bold0(x: str) -> str:
    return strip(f"replace({x}, '**', '')")


def endings(x: str) -> str:
    return f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"


def line_ends(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: rtrim(l, {_WS})), chr(10))"


def whitespace(x: str) -> str:
    return f"regexp_replace({line_ends(x)}, '\\n{{4,}}', repeat(chr(10), 3), 'g')"


def formatted(x: str) -> str:
    return strip(f"regexp_replace({x}, ' {{2,}}', chr(10), 'g')")


def item_list(x: str) -> str:
    parts = f"list_filter(list_transform(string_split({x}, chr(10)), lambda s: {strip('s')}), lambda s: s <> '')"
    return f"array_to_string(list_transform({parts}, lambda s: concat('  ', CASE WHEN regexp_matches(s, {_MARKER}) THEN s ELSE concat('- ', s) END)), chr(10))"


_BASE = f"""
WITH docs AS ({reports_sql(False)}),
lines AS (SELECT doc_id, CAST(i - 1 AS INT) AS line_no, l[i] AS line, starts_with(ltrim(l[i], {_WS}), '|') AS is_table_line
          FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split({endings('content')}, chr(10)) AS l FROM docs))),
marked AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, is_table_line ORDER BY line_no) AS island FROM lines),
md_lines AS (SELECT doc_id, line_no, line, is_table_line, CASE WHEN is_table_line THEN CAST(dense_rank() OVER (PARTITION BY doc_id, is_table_line ORDER BY island) - 1 AS INT) END AS table_no FROM marked),
split AS (SELECT doc_id, table_no, line_no, line, regexp_full_match({strip('line')}, '\\|[{_CLASS}\\-:|]+\\|') AS is_sep,
          CAST(row_number() OVER (PARTITION BY doc_id, table_no ORDER BY line_no) - 1 AS INT) AS row_no, string_split({strip('line')}, '|')[2:] AS rest FROM md_lines WHERE is_table_line),
md_rows AS (SELECT doc_id, table_no, line_no, line, is_sep, row_no,
            CASE WHEN NOT is_sep THEN CAST(row_number() OVER (PARTITION BY doc_id, table_no, is_sep ORDER BY row_no) - 1 AS INT) END AS data_row_no,
            CASE WHEN NOT is_sep THEN list_transform(CASE WHEN {strip('rest[-1]')} = '' THEN rest[:-2] ELSE rest END, lambda c: {strip('c')}) END AS cells FROM split),
md_cells AS (SELECT doc_id, table_no, row_no, is_sep, data_row_no, CAST(i - 1 AS INT) AS col_no, cells[i] AS cell, {bold0('cells[i]')} = '' AS is_blank
             FROM md_rows LEFT JOIN LATERAL (SELECT unnest(range(1, len(cells) + 1)) AS i) ON TRUE),
c AS (SELECT * FROM md_cells WHERE col_no IS NOT NULL),
row_facts AS (SELECT doc_id, table_no, row_no, min(data_row_no) AS data_row_no, count(*) FILTER (cell <> '') AS n_full, count(*) FILTER (cell <> '' AND NOT contains(cell, '**')) AS n_plain, count(*) FILTER (NOT is_blank) AS n_text
              FROM c GROUP BY 1, 2, 3),
all_rows AS (SELECT r.doc_id, r.table_no, r.row_no, r.data_row_no, coalesce(n_full, 0) > 0 AND coalesce(n_plain, 0) = 0 AS bold, coalesce(n_text, 0) AS n_text
             FROM md_rows r LEFT JOIN row_facts f ON r.doc_id = f.doc_id AND r.table_no = f.table_no AND r.row_no = f.row_no WHERE NOT r.is_sep),
subs AS (SELECT a.doc_id, a.table_no, a.row_no, a.data_row_no FROM all_rows a WHERE a.data_row_no BETWEEN 1 AND 3
         AND NOT EXISTS (SELECT 1 FROM all_rows b WHERE b.doc_id = a.doc_id AND b.table_no = a.table_no AND b.data_row_no BETWEEN 1 AND a.data_row_no AND NOT b.bold)),
empty_columns AS (SELECT doc_id, table_no, col_no, count(*) FILTER (NOT is_blank) = 0 AS is_empty FROM c GROUP BY 1, 2, 3),
names AS (SELECT doc_id, table_no, col_no, arg_min({bold0('cell')}, row_no) AS field_name FROM c
          WHERE {bold0('cell')} <> '' AND (data_row_no = 0 OR (doc_id, table_no, row_no) IN (SELECT doc_id, table_no, row_no FROM subs)) GROUP BY 1, 2, 3),
records AS (SELECT doc_id, table_no, row_no, data_row_no FROM all_rows a WHERE data_row_no >= 1 AND n_text > 0
            AND (doc_id, table_no, row_no) NOT IN (SELECT doc_id, table_no, row_no FROM subs)),
fields AS (SELECT c.doc_id, c.table_no, c.data_row_no, c.col_no, field_name, cell AS value, contains({formatted('cell')}, chr(10)) AS is_multiline, {formatted('cell')} AS f
           FROM c SEMI JOIN records r ON c.doc_id = r.doc_id AND c.table_no = r.table_no AND c.row_no = r.row_no
           LEFT JOIN names n ON c.doc_id = n.doc_id AND c.table_no = n.table_no AND c.col_no = n.col_no WHERE NOT is_blank),
texts AS (SELECT *, CASE WHEN field_name IS NOT NULL AND is_multiline THEN concat('**', field_name, ':**', chr(10), {item_list('f')})
          WHEN field_name IS NOT NULL THEN concat('**', field_name, ':** ', f) WHEN is_multiline THEN {item_list('f')} ELSE concat('  - ', f) END AS t FROM fields),
structured AS (SELECT doc_id, table_no, string_agg(t, concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY data_row_no) AS structured
               FROM (SELECT doc_id, table_no, data_row_no, string_agg(t, chr(10) ORDER BY col_no) AS t FROM texts GROUP BY 1, 2, 3) GROUP BY 1, 2),
stats AS (SELECT r.doc_id, r.table_no, min(line_no) + 1 AS first_line, max(line_no) + 1 AS last_line, count(*) AS n_lines, coalesce(max(row_no) FILTER (is_sep), -1) AS last_sep_row,
          coalesce(max(len(cells)), 0) AS n_cols, coalesce(max(list_max(list_transform(cells, lambda x: length(x)))), 0) AS max_cell_len FROM md_rows r GROUP BY 1, 2),
table_stats AS (SELECT s.*, coalesce(e.n, 0) AS n_empty_cols, n_cols > 8 OR max_cell_len > 200 AS is_complex,
                CASE WHEN last_sep_row < 0 THEN 'R1' WHEN (n_cols > 8 OR max_cell_len > 200) AND l.doc_id IS NOT NULL THEN 'R2' WHEN n_cols > 8 OR max_cell_len > 200 THEN 'R3' WHEN coalesce(e.n, 0) > 0 THEN 'R4' ELSE 'R5' END AS route
                FROM stats s LEFT JOIN (SELECT doc_id, table_no, count(*) AS n FROM empty_columns WHERE is_empty GROUP BY 1, 2) e ON s.doc_id = e.doc_id AND s.table_no = e.table_no
                LEFT JOIN structured l ON s.doc_id = l.doc_id AND s.table_no = l.table_no),
kept AS (SELECT doc_id, table_no, row_no, CAST(row_number() OVER (PARTITION BY doc_id, table_no, row_no ORDER BY col_no) - 1 AS INT) AS col_no, cell FROM c
         WHERE (doc_id, table_no, col_no) NOT IN (SELECT doc_id, table_no, col_no FROM empty_columns WHERE is_empty)),
widths AS (SELECT doc_id, table_no, col_no, greatest(3, max(length(cell))) AS width FROM kept GROUP BY 1, 2, 3),
printed AS (SELECT r.doc_id, r.table_no, r.row_no, concat('|', string_agg(CASE WHEN is_sep THEN repeat('-', width + 2) ELSE concat(' ', rpad(coalesce(cell, ''), CAST(width AS INT), ' '), ' ') END, '|' ORDER BY w.col_no), '|') AS line
            FROM md_rows r JOIN widths w ON r.doc_id = w.doc_id AND r.table_no = w.table_no
            LEFT JOIN kept k ON k.doc_id = r.doc_id AND k.table_no = r.table_no AND k.row_no = r.row_no AND k.col_no = w.col_no GROUP BY 1, 2, 3),
rebuilt AS (SELECT t.doc_id, t.table_no, coalesce(string_agg(line, chr(10) ORDER BY row_no), '') AS rebuilt FROM stats t LEFT JOIN printed p ON t.doc_id = p.doc_id AND t.table_no = p.table_no GROUP BY 1, 2),
parts AS (SELECT l.doc_id, l.line_no, CASE route WHEN 'R2' THEN structured WHEN 'R4' THEN rebuilt ELSE line END AS line
          FROM md_lines l LEFT JOIN table_stats t ON l.doc_id = t.doc_id AND l.table_no = t.table_no
          LEFT JOIN structured s ON l.doc_id = s.doc_id AND l.table_no = s.table_no LEFT JOIN rebuilt b ON l.doc_id = b.doc_id AND l.table_no = b.table_no
          WHERE route IS NULL OR route NOT IN ('R2', 'R4') OR l.line_no = first_line - 1),
tables_clean AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS content FROM parts GROUP BY 1),
cleaned AS (SELECT doc_id, {whitespace('content')} AS content_clean FROM tables_clean)
"""


def _html(x: str) -> str:
    """HTML as the pages have it: no tables, no nested lists, every list below no other, addresses in double quotes."""
    steps = [("(?s)<!--.*?-->", "''"), ("(?is)<script\\b.*?</script\\s*>", "''"), ("(?is)<style\\b.*?</style\\s*>", "''"), ("(?is)<head\\b.*?</head\\s*>", "''"), ("[ \\t\\n\\f\\r]+", "' '"), ('(?i)<a href="([^"]*)">([^<]*)</a>', "'[\\2](\\1)'")]
    steps += [(f"(?i)<h{n}\\b[^>]*>", f"concat(chr(10), chr(10), '{'#' * n} ')") for n in range(1, 7)]
    steps += [("(?i)<li\\b[^>]*>", "concat(chr(10), '- ')"), ("(?i)</?(?:p|div|nav|article|footer|ul|h[1-6])\\b[^>]*>", "concat(chr(10), chr(10))"), ("(?i)<br\\b[^>]*>", "chr(10)"), ("<[^>]*>", "''"), (" *\\n *", "chr(10)"), ("\\n{3,}", "concat(chr(10), chr(10))"), ("^\\n+|\\n+$", "''")]
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    for entity, to in (("&quot;", "'\"'"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'")):
        x = f"replace({x}, '{entity}', {to})"
    return x


#: The pages hold no table line, so cleaning them is line ends and white space.
_PAGES = f"WITH p AS (SELECT page_id, {_html('html')} AS raw, html FROM pages), m AS (SELECT page_id, html, {whitespace(endings('raw'))} AS markdown FROM p)"
_FILES = f"""{_PAGES}, f AS (SELECT *, concat('page', page_id, ['.html', '.HTML', '.docx', '.png'][page_id % 4 + 1]) AS original_filename, ['.html', '.html', '.docx', '.png'][page_id % 4 + 1] AS ext FROM m),
j AS (SELECT sha256(concat(original_filename, chr(10), html)) AS job_id, original_filename, ext, html, CASE WHEN ext = '.html' THEN 'done' ELSE 'failed' END AS status,
      CASE WHEN ext <> '.html' THEN 'no converter for .docx' END AS error, CASE WHEN ext = '.html' THEN markdown END AS markdown FROM f WHERE ext <> '.png')"""
#: What the pages of plans.reports.html_pages_sql hold, set as Markdown straight from the rows: the grid with its spans filled.
_HTML_TABLES = f"""WITH x AS ({lines_of_orders()}),
g AS (SELECT k, array_agg(CASE n % 3 WHEN 1 THEN [CAST(p AS VARCHAR), concat(q, '  ', f), CAST(c AS VARCHAR)] WHEN 2 THEN [CAST(before AS VARCHAR), concat(q, ' < &#124;'), concat(f, ', ', t, '; x')] ELSE [CAST(p AS VARCHAR), CAST(s AS VARCHAR), CAST(s AS VARCHAR)] END ORDER BY n) AS body
      FROM (SELECT *, lag(p) OVER (PARTITION BY k ORDER BY n) AS before FROM x) GROUP BY 1),
h AS (SELECT k, list_concat([list_concat(['part', 'amounts', 'amounts'], CASE k % 3 WHEN 1 THEN [''] WHEN 2 THEN list_transform(range(9), lambda i: 'notes') ELSE [] END), ['part', 'qty', 'price']], body) AS grid, [3, 4, 12][k % 3 + 1] AS wide FROM g),
s AS (SELECT *, list_transform(range(1, wide + 1), lambda i: CAST(greatest(3, list_max(list_transform(grid, lambda r: length(coalesce(r[i], ''))))) AS INT)) AS w FROM h),
l AS (SELECT k, list_transform(grid, lambda r: concat('| ', array_to_string(list_transform(range(1, wide + 1), lambda i: rpad(coalesce(r[i], ''), w[i], ' ')), ' | '), ' |')) AS rows,
      concat('|', array_to_string(list_transform(w, lambda n: repeat('-', n + 2)), '|'), '|') AS rule FROM s)
SELECT k AS doc_id, concat('## Order', chr(160), k, NL, NL, 'See [order **', k, '**](/o/', k, '?a=1&b=2) ', chr(8212), ' it''s *here*', NL, NL, '2. one', NL, '3. two', NL, '  - deep', NL, NL, 'Items of ', k, NL, NL,
       rows[1], NL, rule, NL, array_to_string(rows[2:], NL), NL, NL, 'end ![z](/i.png)', NL, NL, '```', NL, ' a', NL, NL, '  b', NL, '```') AS content FROM l""".replace("NL", "chr(10)")
#: The file versions of plans.queries.arrivals with their runs; a page that changed has two.
_ARRIVALS = f"""WITH v AS (SELECT page_id, concat('page', page_id, CASE WHEN page_id % 4 < 2 THEN '.html' ELSE '.docx' END) AS original_filename, CASE WHEN page_id % 4 < 2 THEN '.html' ELSE '.docx' END AS ext, run,
  concat(html, CASE WHEN run = 2 AND page_id % 2 = 0 THEN '<p>changed</p>' ELSE '' END) AS html
  FROM pages, (SELECT unnest([1, 2]) AS run) r WHERE CASE run WHEN 1 THEN page_id % 2 = 0 ELSE page_id % 2 = 1 OR page_id % 10 = 0 END),
m AS (SELECT *, {_html('html')} AS raw FROM v),
j AS (SELECT page_id, sha256(concat(original_filename, chr(10), html)) AS job_id, original_filename, ext, CASE WHEN ext = '.html' THEN 'done' ELSE 'failed' END AS status,
  CASE WHEN ext <> '.html' THEN 'no converter for .docx' END AS error, CASE WHEN ext = '.html' THEN {whitespace(endings('raw'))} END AS markdown, CAST(run AS BIGINT) AS run FROM m)"""
#: Words that must be left, counted, less those that are.
_LOST = f"""must AS (SELECT doc_id, unnest(regexp_split_to_array(line, {_WORDS})) AS word FROM md_lines WHERE table_no IS NULL
  UNION ALL SELECT c.doc_id, unnest(regexp_split_to_array(cell, {_WORDS})) FROM c JOIN table_stats t ON c.doc_id = t.doc_id AND c.table_no = t.table_no WHERE route <> 'R2' AND NOT is_sep
  UNION ALL SELECT doc_id, unnest(list_concat(regexp_split_to_array(coalesce(field_name, ''), {_WORDS}), regexp_split_to_array(value, {_WORDS}))) FROM fields SEMI JOIN (SELECT * FROM table_stats WHERE route = 'R2') t ON fields.doc_id = t.doc_id AND fields.table_no = t.table_no),
left_ AS (SELECT doc_id, unnest(regexp_split_to_array({{after}}, {_WORDS})) AS word FROM cleaned),
lost AS (SELECT doc_id, word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT doc_id, word, 1 AS n FROM must UNION ALL SELECT doc_id, word, -1 FROM left_) WHERE NOT regexp_full_match(word, '-*') GROUP BY 1, 2 HAVING sum(n) > 0)"""
_CUT = "CASE WHEN doc_id % 5 = 0 THEN regexp_replace(content_clean, '\\n[^\\n]*$', '') ELSE content_clean END"
_STAGE = "['uploading', 'extracting', 'generating', 'formatting', 'complete', 'error', 'idle'][event_id % 7 + 1]"
_ROUGH = f"WITH r AS ({roughened_sql()})"


#: Bursts that end before the last event's time less what may come late.
_BURSTS = """WITH e AS (SELECT user_id, ts, CAST(event_id AS VARCHAR) AS c, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, c) AS n FROM e)
    SELECT user_id AS key, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS saved, last(c ORDER BY ts, c) AS content FROM s GROUP BY user_id, n HAVING max(ts) + INTERVAL 7 HOUR <= (SELECT max(ts) FROM events)"""


ORACLES = {
    "scan_documents": f"{_FILES} SELECT original_filename, ext, CAST(strlen(html) AS BIGINT) AS length, sha256(html) AS content_sha FROM j",
    "scan_markdown": "SELECT concat(conv_id, '.md') AS file_name, CAST(length(t) AS INT) AS n_chars, sha256(t) AS content_sha FROM (SELECT conv_id, string_agg(text, concat(chr(10), chr(10)) ORDER BY turn, text) AS t FROM conversations GROUP BY 1)",
    "job_ledger": f"{_FILES} SELECT job_id, original_filename, ext FROM j",
    "convert_documents": f"{_FILES} SELECT job_id, original_filename, ext, status, error, markdown FROM j",
    "incremental_conversion": f"{_ARRIVALS} SELECT * EXCLUDE (page_id) FROM j",
    "current_jobs": f"{_ARRIVALS} SELECT * EXCLUDE (page_id, run) FROM j QUALIFY run = max(run) OVER (PARTITION BY page_id)",
    "stream_conversion": f"{_ARRIVALS} SELECT * EXCLUDE (page_id, run) FROM j WHERE run = 1 OR page_id % 2 = 1",
    "failed_jobs": f"{_FILES} SELECT job_id, original_filename, ext, error FROM j WHERE status = 'failed'",
    "status_by_ext": f"{_FILES} SELECT ext, status, count(*) AS n FROM j GROUP BY 1, 2",
    "result_records": f"{_FILES} SELECT status = 'done' AS success, job_id, original_filename, markdown FROM j",
    "lookup_jobs": f"{_FILES} SELECT w.job_id, j.job_id IS NOT NULL AS found, markdown FROM (SELECT sha256(concat(original_filename, chr(10), html)) AS job_id FROM f UNION ALL SELECT concat('none', page_id) FROM f) w LEFT JOIN j ON w.job_id = j.job_id",
    "pages_to_markdown": f"{_PAGES} SELECT page_id, markdown FROM m",
    "html_tables": f"{_BASE.replace(reports_sql(False), _HTML_TABLES)} SELECT doc_id, content AS markdown, content_clean FROM docs JOIN cleaned USING (doc_id)",
    "write_clean": f"{_BASE} SELECT * FROM cleaned",
    "table_lines": f"{_BASE} SELECT doc_id, line_no, line FROM md_lines WHERE is_table_line",
    "separator_rows": f"{_BASE} SELECT doc_id, table_no, row_no, line FROM md_rows WHERE is_sep",
    "table_stats": f"{_BASE} SELECT * EXCLUDE (is_complex) FROM table_stats",
    "table_stats_exploded": f"{_BASE} SELECT * EXCLUDE (is_complex) FROM table_stats",
    "complex_tables": f"{_BASE} SELECT doc_id, table_no, n_cols, max_cell_len FROM table_stats WHERE is_complex",
    "md_lines": f"{_BASE} SELECT * FROM md_lines",
    "table_blocks": f"{_BASE} SELECT doc_id, table_no, min(line_no) AS first_line_no, count(*) AS n_lines FROM md_lines WHERE is_table_line GROUP BY 1, 2",
    "md_cells": f"{_BASE} SELECT * FROM md_cells",
    "subheader_rows": f"{_BASE} SELECT * FROM subs",
    "empty_columns": f"{_BASE} SELECT * FROM empty_columns",
    "drop_empty_columns": f"{_BASE} SELECT * FROM kept",
    "column_widths": f"{_BASE} SELECT * FROM widths",
    "header_names": f"{_BASE} SELECT * FROM names",
    "table_records": f"{_BASE} SELECT * FROM records",
    "md_fields": f"{_BASE} SELECT * EXCLUDE (f) FROM fields",
    "format_cells": f"{_BASE} SELECT doc_id, table_no, row_no, col_no, {formatted('cell')} AS formatted FROM c",
    "structured_items": f"{_BASE} SELECT doc_id, table_no, data_row_no, col_no, {item_list('f')} AS items FROM fields WHERE is_multiline",
    "structured_lists": f"{_BASE} SELECT * FROM structured",
    "rebuild_tables": f"{_BASE} SELECT * FROM rebuilt",
    "table_to_markdown": """WITH i AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS a, l_partkey AS b, l_suppkey AS c, l_returnflag AS d FROM lineitem),
        w AS (SELECT k, CAST(greatest(12, max(length(CAST(a AS VARCHAR)))) AS INT) AS wa, CAST(greatest(9, max(length(CAST(b AS VARCHAR)))) AS INT) AS wb, CAST(greatest(9, max(length(CAST(c AS VARCHAR)))) AS INT) AS wc, 12 AS wd FROM i GROUP BY 1)
        SELECT k AS l_orderkey, concat('| ', rpad('l_linenumber', max(wa), ' '), ' | ', rpad('l_partkey', max(wb), ' '), ' | ', rpad('l_suppkey', max(wc), ' '), ' | ', rpad('l_returnflag', 12, ' '), ' |', chr(10),
            '|', repeat('-', max(wa) + 2), '|', repeat('-', max(wb) + 2), '|', repeat('-', max(wc) + 2), '|', repeat('-', 14), '|', chr(10),
            string_agg(concat('| ', rpad(CAST(a AS VARCHAR), wa, ' '), ' | ', rpad(CAST(b AS VARCHAR), wb, ' '), ' | ', rpad(CAST(c AS VARCHAR), wc, ' '), ' | ', rpad(d, 12, ' '), ' |'), chr(10) ORDER BY a, b, c, d)) AS markdown
        FROM i JOIN w USING (k) GROUP BY 1""",
    "clean_tables": f"{_BASE} SELECT * FROM tables_clean",
    "clean_tables_exploded": f"{_BASE} SELECT * FROM tables_clean",
    "clean_markdown": f"{_BASE} SELECT * FROM cleaned",
    "clean_documents": f"{_ROUGH} SELECT doc_id, {whitespace(endings('content'))} AS content_clean FROM r",
    "raw_vs_clean": f"{_BASE} SELECT doc_id, content, content_clean FROM docs JOIN cleaned USING (doc_id)",
    "lost_content": f"{_BASE}, {_LOST.format(after='content_clean')} SELECT * FROM lost",
    "planted_losses": f"{_BASE}, {_LOST.format(after=_CUT)} SELECT * FROM lost",
    "line_changes": f"""{_BASE}, t AS (SELECT doc_id, string_split(content, chr(10)) AS a, string_split(content_clean, chr(10)) AS b FROM docs JOIN cleaned USING (doc_id)),
        l AS (SELECT doc_id, a, b, list_reduce(list_concat([list_transform(b, lambda x: 0)], list_transform(range(1, len(a) + 1), lambda i: [i])), lambda old, i:
          list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda m: greatest(old[m], CASE WHEN b[m] = a[i[1]] THEN 1 + CASE WHEN m > 1 THEN old[m - 1] ELSE 0 END ELSE 0 END)))))[-1] AS kept FROM t)
        SELECT doc_id, CAST(kept AS BIGINT) AS n_kept, len(a) - kept AS n_removed, len(b) - kept AS n_added,
          CAST(coalesce(list_min(list_filter(range(least(len(a), len(b))), lambda i: a[i + 1] <> b[i + 1])), least(len(a), len(b))) AS BIGINT) AS same_until FROM l""",
    "clean_with_audit": f"""{_BASE}, a AS (SELECT doc_id, string_agg(concat(first_line, ' ', CASE route WHEN 'R2' THEN 'list' WHEN 'R3' THEN 'fallback' ELSE concat('removed ', n_empty_cols) END), ', ' ORDER BY first_line) AS audit
        FROM table_stats WHERE route IN ('R2', 'R3', 'R4') GROUP BY 1) SELECT doc_id, content_clean, coalesce(audit, '') AS audit FROM cleaned LEFT JOIN a USING (doc_id)""",
    "stored_results": f"{_FILES} SELECT status = 'done' AS success, job_id, original_filename, markdown FROM j WHERE job_id IN ((SELECT min(job_id) FROM j), (SELECT max(job_id) FROM j))",
    "table_audit": f"{_BASE} SELECT doc_id, first_line, CASE route WHEN 'R2' THEN 'list' WHEN 'R3' THEN 'fallback' ELSE concat('removed ', n_empty_cols) END AS action FROM table_stats WHERE route IN ('R2', 'R3', 'R4')",
    "route_counts": f"{_BASE} SELECT route, count(*) AS n FROM table_stats GROUP BY 1",
    "normalize_endings": f"{_ROUGH} SELECT doc_id, {endings('content')} AS content FROM r",
    "strip_line_ends": f"{_ROUGH} SELECT doc_id, {line_ends(endings('content'))} AS content FROM r",
    "cleanup_whitespace": f"{_ROUGH} SELECT doc_id, {whitespace(endings('content'))} AS content FROM r",
    "nonempty_docs": f"{_ROUGH}, l AS (SELECT doc_id, string_split({endings('content')}, chr(10)) AS l FROM r), x AS (SELECT doc_id, CAST(i - 1 AS INT) AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)) SELECT * FROM x WHERE {strip('line')} <> ''",
    "doc_lengths": "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents",
    "output_names": """SELECT doc_id, concat(source, '/doc-', doc_id, ['.md', '.tar.md', '', '.md'][doc_id % 4 + 1]) AS output_name,
        concat(source, '/doc-', doc_id, ['.pdf.md', '.tar.gz.md', '.md', '.md'][doc_id % 4 + 1]) AS with_suffix, ['.pdf', '.gz', '', '.md'][doc_id % 4 + 1] AS ext FROM documents""",
    "progress_percent": "SELECT CAST(floor(l_quantity) AS BIGINT) AS loaded, l_partkey % 60 AS total, CASE WHEN l_partkey % 60 > 0 THEN CAST(floor(floor(l_quantity) * 100 / (l_partkey % 60) + 0.5) AS BIGINT) END AS percent FROM lineitem",
    "stage_index": f"SELECT event_id, {_STAGE} AS stage, CAST([0, 1, 2, 3, 4, -1, -1][event_id % 7 + 1] AS INT) AS stage_no FROM events",
    "stream_clean": f"{_ROUGH} SELECT doc_id, {whitespace(endings('content'))} AS content_clean FROM r",
    "debounced_latest": """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e)
        SELECT user_id AS key, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS saved, last(event_id ORDER BY ts, event_id) AS content FROM s GROUP BY user_id, n""",
    "debounced_append": _BURSTS,
    "debounced_by_timer": _BURSTS,
    "progress_until_done": f"SELECT user_id AS job, last({_STAGE} ORDER BY ts, {_STAGE}) AS stage, max(ts) AS ts FROM events GROUP BY 1",
    "job_progress": f"SELECT user_id AS job, last({_STAGE} ORDER BY ts, {_STAGE}) AS stage, max(ts) AS ts FROM events GROUP BY 1",
    "stage_counts": f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS started, {_STAGE} AS stage, count(*) AS n FROM events GROUP BY 1, 2",
}
