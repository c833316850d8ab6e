"""The queries of queries.py in DuckDB SQL, written apart from the Spark expressions."""

from __future__ import annotations

#: Unicode white space, which RE2's \s is not.
WS = r"[\s\x{000b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def rt(x: str) -> str:
    return rf"regexp_replace({x}, '{WS}+\z', '')"


def tr(x: str) -> str:
    return rf"regexp_replace({rt(x)}, '\A{WS}+', '')"


def lines(x: str) -> str:
    return rf"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '\n\z', ''), chr(10)) END)"


NL = "chr(10)"
_DOC_LINES = f"SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, {lines("coalesce(text, '')")} AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)"


def heading(t: str) -> str:
    """CASE branches of a numbered or named heading of a trimmed line."""
    prefix = rf"regexp_extract({t}, '\A[0-9][0-9.]*')"
    rest = rf"ltrim(substr({t}, length({prefix}) + 1), ' ')"
    depth = f"length({prefix}) - length(replace({prefix}, '.', ''))"
    return (
        f"CASE WHEN strlen({t}) > 120 THEN NULL WHEN contains({prefix}, '.') AND {rest} <> '' AND NOT ends_with({rest}, '.') THEN repeat('#', least({depth}, 3)::INT) || ' ' || {t} "
        f"WHEN (starts_with(lower({t}), 'appendix') OR starts_with(lower({t}), 'scenario')) AND contains({t}, ':') AND strlen({t}) < 100 THEN '## ' || {t} END"
    )


def subheading(t: str) -> str:
    return rf"(strlen({t}) BETWEEN 3 AND 80 AND NOT regexp_matches({t}, '[.,;]\z') AND regexp_matches({t}, '[ \t]') AND regexp_matches({t}, '\A\p{{Lu}}'))"


_PARAS = f"SELECT doc_id, i, {rt('line')} AS p FROM ({_DOC_LINES})"
DOC_PLAIN = f"""SELECT d.doc_id, coalesce(x.t, '') AS plain FROM documents d LEFT JOIN
(SELECT doc_id, string_agg(p, {NL} || {NL} ORDER BY i) || {NL} AS t FROM ({_PARAS}) WHERE p <> '' GROUP BY doc_id) x USING (doc_id)"""
DOC_MARKDOWN = f"""SELECT d.doc_id, coalesce(x.t, '') AS markdown FROM documents d LEFT JOIN
(SELECT doc_id, string_agg(CASE WHEN h IS NOT NULL THEN h WHEN {subheading('t')} THEN '**' || t || '**' ELSE t END || {NL} || {NL}, '' ORDER BY i) AS t
 FROM (SELECT doc_id, i, t, {heading('t')} AS h FROM (SELECT doc_id, i, {tr('p')} AS t FROM ({_PARAS}) WHERE p <> '')) GROUP BY doc_id) x USING (doc_id)"""
DOC_SUB = f"SELECT doc_id, (i - 1)::BIGINT AS line_no, {tr('line')} AS line FROM ({_DOC_LINES}) WHERE {subheading(tr('line'))}"
NEIGHBOURS = f"""SELECT doc_id, count(*) AS n_lines, count(*) FILTER (coalesce(b, '') = '') AS blank_before, count(*) FILTER (coalesce(a, '') = '') AS blank_after
FROM (SELECT doc_id, lag(t) OVER w AS b, lead(t) OVER w AS a FROM (SELECT doc_id, i, {tr('line')} AS t FROM ({_DOC_LINES})) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) GROUP BY doc_id"""
_SECTION = """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_size || '.' || (p_partkey % 7) || ' ' || p_name WHEN 1 THEN 'Appendix ' || p_size || ': ' || p_name
WHEN 2 THEN p_size || '. ' || p_name || '.' ELSE p_size || ' ' || p_name END AS line FROM part"""
SECTION = rf"""SELECT k, line, {heading(tr('line'))} AS heading, CASE WHEN regexp_matches(line, '\A[0-9]+\.') THEN ltrim(substr(line, length(regexp_extract(line, '\A[0-9][0-9.]*')) + 1), ' ') END AS rest FROM ({_SECTION})"""

_CELLS = "SELECT p_partkey, list_transform(range(1, p_size % 14 + 2), lambda i: CASE WHEN i % (p_partkey % 4 + 3) = 0 THEN '' ELSE 'v|' || i END) AS c FROM part"
_EMPTIES = "list_filter(range(0, len(c)), lambda i: c[i + 1] = '')"
_COUNT = f"""SELECT p_partkey, c, len(c) AS n, CASE WHEN len(c) <= 2 THEN 1 WHEN len(c) <= 6 THEN len(c)
WHEN len(e) >= 2 AND e[1] + 1 BETWEEN 2 AND 10 AND len(list_filter(range(2, len(e) + 1), lambda i: e[i] - e[i - 1] <> e[1] + 1)) = 0 THEN e[1] + 1
WHEN len(c) % 3 = 0 AND len(c) / 3 >= 2 THEN 3 WHEN len(c) % 4 = 0 AND len(c) / 4 >= 2 THEN 4 WHEN len(c) % 5 = 0 AND len(c) / 5 >= 2 THEN 5 WHEN len(c) % 2 = 0 THEN 2 ELSE 6 END::BIGINT AS k
FROM (SELECT p_partkey, c, {_EMPTIES} AS e FROM (SELECT p_partkey, c FROM ({_CELLS})))"""
# a line is trimmed before it is split, so empty cells at its end are gone
_CELLS_TRIMMED = f"SELECT p_partkey, string_split(regexp_replace(array_to_string(c, chr(9)), '\\t+\\z', ''), chr(9)) AS c FROM ({_CELLS})"
_TABLES = f"""SELECT p_partkey, k, c, list_filter(list_transform(range(0, len(c), k), lambda i: c[i + 1:i + k]), lambda r: len(list_filter(r, lambda x: x <> '')) > 0) AS rs FROM ({_COUNT.replace(_CELLS, _CELLS_TRIMMED)})"""
TAB_TABLES = f"""SELECT p_partkey, CASE WHEN k <= 1 THEN CASE WHEN trim(array_to_string(c, ' ')) = '' THEN '' ELSE trim(array_to_string(c, ' ')) || {NL} || {NL} END WHEN len(rs) = 0 THEN ''
ELSE array_to_string(list_transform(range(1, len(rs) + 1), lambda j: '|' || array_to_string(list_transform(range(1, k + 1), lambda x: ' ' || replace(coalesce(rs[j][x], ''), '|', '\\|') || ' |'), '') || {NL}
 || CASE WHEN j = 1 THEN '|' || repeat(' --- |', k::INT) || {NL} ELSE '' END), '') || {NL} END AS markdown FROM ({_TABLES})"""

_GAPPY = f"replace(coalesce(text, ''), {NL}, ' ' || repeat({NL}, (doc_id % 5 + 1)::INT))"
_GAPPY_LINES = f"SELECT doc_id, i, {rt('ls[i]')} AS t FROM (SELECT doc_id, {lines(_GAPPY)} AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)"
_ISLANDS = f"SELECT doc_id, i, t, sum(CASE WHEN t <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM ({_GAPPY_LINES})"
_KEPT = f"SELECT doc_id, i, t, t <> '' OR sum(CASE WHEN t = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, island ORDER BY i) <= 2 AS keep FROM ({_ISLANDS})"
BLANK_RUNS = f"SELECT doc_id, count(*) FILTER (keep) AS kept_lines, count(*) AS lines FROM ({_KEPT}) GROUP BY doc_id"
CLEAN = f"""SELECT d.doc_id, CASE WHEN coalesce(p, '') = '' THEN '' ELSE p || {NL} END AS page FROM documents d LEFT JOIN
(SELECT doc_id, trim(string_agg(t, {NL} ORDER BY i), {NL}) AS p FROM ({_KEPT}) WHERE keep GROUP BY doc_id) USING (doc_id)"""


def clean(x: str) -> str:
    """A page's cleaning without islands: by list functions and patterns."""
    joined = f"array_to_string(list_transform({lines(x)}, lambda l: {rt('l')}), {NL})"
    t = rf"trim(regexp_replace({joined}, '\n{{4,}}', {NL} || {NL} || {NL}, 'g'), {NL})"
    return f"(CASE WHEN {t} = '' THEN '' ELSE {t} || {NL} END)"


_PAGES = f"""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, {clean(f"CASE WHEN turn % 3 = 1 THEN ' ' || {NL} ELSE coalesce(text, '') END")} AS p FROM conversations"""
PDF_PLAIN = f"SELECT c.conv_id, x.t AS text FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, string_agg(p, {NL} ORDER BY n) AS t FROM ({_PAGES}) WHERE p <> '' GROUP BY conv_id) x USING (conv_id)"
PDF_HEADINGS = f"""SELECT c.conv_id, x.t AS text FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN
(SELECT conv_id, CASE WHEN count(*) = 1 THEN any_value(p) ELSE string_agg('## Page ' || n || {NL} || {NL} || p, {NL} ORDER BY n) END AS t FROM ({_PAGES}) WHERE p <> '' GROUP BY conv_id) x USING (conv_id)"""

_SUPPLIERS = """SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS r, s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE replace(s_name, '#', '|') END AS nm
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
_SHEETS = "SELECT DISTINCT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS ix, count(*) OVER (PARTITION BY n_regionkey) AS many FROM (SELECT DISTINCT n_regionkey, n_nationkey, n_name FROM ({0}))".format(_SUPPLIERS)
SHEET_TSV = f"""SELECT n_regionkey, string_agg(CASE WHEN many > 1 THEN CASE WHEN ix > 1 THEN {NL} ELSE '' END || '--- ' || n_name || ' ---' || {NL} ELSE '' END || body, '' ORDER BY n_nationkey) AS tsv
FROM ({_SHEETS}) JOIN (SELECT n_nationkey, string_agg(' ' || chr(9) || nm || chr(9) || chr(9) || s_suppkey || {NL}, '' ORDER BY r) AS body FROM ({_SUPPLIERS}) GROUP BY 1) USING (n_nationkey) GROUP BY n_regionkey"""
# the outer blank columns go; a sheet whose names are all blank starts at the key's column
SHEET_MD = f"""SELECT n_regionkey, string_agg(CASE WHEN many > 1 THEN '## ' || n_name || {NL} || {NL} ELSE '' END || body || {NL}, '' ORDER BY n_nationkey) AS markdown FROM ({_SHEETS}) JOIN
(SELECT n_nationkey, string_agg(CASE WHEN named THEN '| ' || replace(nm, '|', '\\|') || ' |  | ' || s_suppkey || ' |' ELSE '| ' || s_suppkey || ' |' END || {NL}
 || CASE WHEN r = 1 THEN '|' || repeat(' --- |', CASE WHEN named THEN 3 ELSE 1 END) || {NL} ELSE '' END, '' ORDER BY r) AS body
 FROM (SELECT *, bool_or(nm <> '') OVER (PARTITION BY n_nationkey) AS named FROM ({_SUPPLIERS})) GROUP BY 1) USING (n_nationkey) GROUP BY n_regionkey"""

_LINE_CELLS = "SELECT l_orderkey, l_linenumber AS row, (l_suppkey % 6)::INT AS col, l_partkey AS seq, CASE WHEN l_returnflag = 'R' THEN l_partkey::VARCHAR ELSE ' ' END AS value FROM lineitem"
SHEET_CROP = f"""SELECT l_orderkey, row, (col - f)::BIGINT AS col, value, seq FROM (SELECT *, max(row) FILTER (trim(value) <> '') OVER w AS lr, min(col) FILTER (trim(value) <> '') OVER w AS f, max(col) FILTER (trim(value) <> '') OVER w AS l
FROM ({_LINE_CELLS}) WINDOW w AS (PARTITION BY l_orderkey)) WHERE row <= lr AND col BETWEEN f AND l"""
SHEET_SKIP = f"SELECT l_orderkey FROM ({_LINE_CELLS}) GROUP BY 1 HAVING bool_or(trim(value) <> '')"
GRID = f"""WITH c AS ({_LINE_CELLS}), b AS (SELECT l_orderkey, max(row) AS h, max(col) AS w FROM c GROUP BY 1), v AS (SELECT l_orderkey, row, col, list(value ORDER BY seq DESC, value DESC)[1] AS value FROM c GROUP BY ALL)
SELECT b.l_orderkey, r.i::BIGINT AS row, k.i::BIGINT AS col, coalesce(v.value, '') AS value FROM b, unnest(range(0, h + 1)) AS r(i), unnest(range(0, w + 1)) AS k(i) LEFT JOIN v ON v.l_orderkey = b.l_orderkey AND v.row = r.i AND v.col = k.i"""
SST = "SELECT l_orderkey, count(p_name) AS n_found, max(coalesce(p_name, '')) AS last_value FROM lineitem LEFT JOIN part ON p_partkey = l_partkey * 2 - l_linenumber GROUP BY 1"
_IDS = "(x BETWEEN 14 AND 22 OR x BETWEEN 27 AND 36 OR x BETWEEN 45 AND 47 OR x BETWEEN 50 AND 58)"
STYLES = f"SELECT style_ix, x AS num_fmt_id, {_IDS} OR (x BETWEEN 150 AND 200 AND x % 3 = 0) AS is_date FROM (SELECT p_partkey AS style_ix, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size + 150 END AS x FROM part)"
LINKS = """SELECT o_orderkey, CASE WHEN v = '' OR u IS NULL THEN v ELSE list_reduce(list_prepend(v, u), lambda a, b: '[' || a || '](' || b || ')') END AS value
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS v FROM orders)
LEFT JOIN (SELECT l_orderkey, list('http://p/' || l_partkey ORDER BY l_linenumber, l_partkey) AS u FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"""

_ANCHORS = """SELECT page_id, i - 1 AS ord, regexp_extract(a[i], 'href="([^"]*)"', 1) AS target, regexp_extract(a[i], '>([^<]*)<', 1) AS t
FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<a href="([^"]*)">([^<]*)</a>', 0) AS a FROM pages), unnest(range(1, len(a) + 1)) AS u(i)"""
_RELS = f"SELECT page_id, ord, 'rId' || (ord % 4) AS rid, target, ord % 3 AS k, ord % 2 = 0 AS ext FROM ({_ANCHORS})"
RELS = f"""SELECT page_id, rid, arg_max(target, ord) FILTER (target <> '' AND (ext OR k = 1)) AS link_url, arg_min(target, ord) FILTER (target <> '' AND k = 0) AS image_target FROM ({_RELS}) GROUP BY 1, 2"""
HYPERLINKS = f"SELECT page_id, string_agg(CASE WHEN {tr('t')} = '' THEN '' ELSE '[' || {tr('t')} || '](' || target || ')' END, ' ' ORDER BY ord) AS markdown FROM ({_ANCHORS}) GROUP BY 1"

_RUNS = """SELECT l_orderkey, l_linenumber AS n, CASE WHEN l_linenumber = 4 THEN ' ' ELSE 'p' || l_partkey END AS t, CASE WHEN l_suppkey % 3 <> 0 THEN 'http://s/' || (l_suppkey % 3) END AS u,
CASE WHEN l_linenumber = 4 THEN '' ELSE repeat('*', (CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::INT) END AS st, l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem"""
_RUN_ISLANDS = f"""SELECT *, sum(CASE WHEN u IS NULL OR pu IS DISTINCT FROM u THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY n, l_partkey, l_suppkey, l_returnflag, l_linestatus ROWS UNBOUNDED PRECEDING) AS g
FROM (SELECT *, lag(u) OVER (PARTITION BY l_orderkey ORDER BY n, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS pu FROM ({_RUNS}))"""
RUNS = f"""SELECT l_orderkey, string_agg(CASE WHEN u IS NULL THEN x WHEN trim(x) = '' THEN '' ELSE '[' || trim(x) || '](' || u || ')' END, '' ORDER BY g) AS markdown, string_agg(p, '' ORDER BY g) AS plain
FROM (SELECT l_orderkey, g, any_value(u) AS u, string_agg(st || t || st, '' ORDER BY n, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS x, string_agg(t, '' ORDER BY n, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS p FROM ({_RUN_ISLANDS}) GROUP BY 1, 2) GROUP BY 1"""
HEADING_LEVELS = """SELECT l_orderkey, CASE WHEN m >= 2800 THEN 1 WHEN m >= 2400 THEN 2 WHEN m >= 2000 THEN 3 ELSE 0 END::INT AS heading
FROM (SELECT l_orderkey, max(CASE WHEN l_linenumber <> 3 THEN p_size * 60 END) AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""
SLIDES_MD = f"""WITH p AS (SELECT l_orderkey, l_linenumber AS n, 't' || l_partkey AS t, l_suppkey % 5 AS k, l_linenumber % 3 AS lv, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <> 5),
q AS (SELECT *, lag(k IN (1, 2)) OVER w AS after_list, lead(n) OVER w IS NULL AS last FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY n, l_partkey, l_suppkey))
SELECT o.l_orderkey, coalesce(string_agg(CASE WHEN k = 0 THEN CASE WHEN after_list THEN {NL} ELSE '' END || repeat('#', CASE WHEN o.l_orderkey % 2 = 0 THEN 4 ELSE 2 END) || ' ' || t || {NL} || {NL}
 WHEN k IN (1, 2) THEN repeat('  ', lv::INT) || CASE WHEN k = 2 THEN '1. ' ELSE '- ' END || t || {NL} || CASE WHEN last THEN {NL} ELSE '' END
 ELSE CASE WHEN after_list THEN {NL} ELSE '' END || t || {NL} || {NL} END, '' ORDER BY n, l_partkey, l_suppkey), '') AS markdown
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN q USING (l_orderkey) GROUP BY 1"""
BULLETS = "SELECT p_partkey, repeat('  ', (p_size % 4)::INT) || CASE WHEN p_partkey % 2 = 0 THEN '1. ' ELSE '- ' END || p_name AS item FROM part"
STYLE_LEVELS = """SELECT p_partkey, st AS style, CASE WHEN k IN (0, 1, 2) THEN p_size % 12 WHEN k = 3 THEN 1 WHEN k = 4 THEN 2 END::INT AS level
FROM (SELECT p_partkey, p_size, p_partkey % 7 AS k, CASE p_partkey % 7 WHEN 0 THEN 'Heading' || (p_size % 12) WHEN 1 THEN 'heading ' || (p_size % 12) WHEN 2 THEN 'heading' || (p_size % 12)
 WHEN 3 THEN 'Title' WHEN 4 THEN 'Subtitle' WHEN 5 THEN 'Heading ' ELSE 'Normal' END AS st FROM part)"""
FIELDS = r"SELECT page_id, CASE WHEN page_id % 4 = 0 THEN nullif(url, '') WHEN page_id % 4 = 1 THEN nullif(regexp_extract(url, '\A[^\s\\]*'), '') END AS url FROM pages"

SERIAL = """SELECT o_orderkey, strftime(o_orderdate::DATE, '%Y-%m-%d') || CASE WHEN o_orderkey % 24 = 0 THEN '' ELSE ' ' || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':00:00' END AS iso FROM orders"""
SERIAL_EDGES = """SELECT id, CASE WHEN v < 0 OR v = 0 OR v > 2958465 THEN v::BIGINT::VARCHAR WHEN v = 60 THEN '1900-02-29' ELSE strftime(DATE '1899-12-31' + (v - CASE WHEN v > 60 THEN 1 ELSE 0 END)::INT, '%Y-%m-%d') END AS iso
FROM (SELECT i AS id, CASE WHEN i < 100 THEN i ELSE i * 30011 END - 1 AS v FROM range(0, 200) t(i))"""
SERIAL_TIME = "SELECT event_id, lpad((s // 3600)::VARCHAR, 2, '0') || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS time FROM (SELECT event_id, event_id % 86400 AS s FROM events)"
DATE_IDS = f"SELECT p_partkey, {_IDS} AS is_date FROM (SELECT p_partkey, p_size AS x FROM part)"
DATE_CODES = """SELECT p_partkey, CASE WHEN p_partkey % 11 = 10 THEN p_size % 3 <> 0 AND regexp_matches(lower(p_type), '[ydhsm]') AND NOT regexp_matches(p_type, '[0#?]')
ELSE p_partkey % 11 IN (0, 5, 7, 9) END AS is_date FROM part"""
FORMAT_NUMBER = r"""SELECT l_orderkey, l_linenumber, l_partkey, regexp_replace(regexp_replace(printf('%.10f', l_quantity), '0+$', ''), '\.$', '') AS quantity,
regexp_replace(regexp_replace(printf('%.10f', round(l_extendedprice * (1 - l_discount), 4)), '0+$', ''), '\.$', '') AS price FROM lineitem"""
RK = """SELECT l_orderkey, l_linenumber, l_partkey, floor(l_quantity) AS whole, (round(l_extendedprice * 100)::BIGINT % 500000000)::DOUBLE / 100.0 AS cents, (1.5625 + l_linenumber / 16.0) * 64 AS double FROM lineitem"""
_REF = """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN lower(l) ELSE l END || CASE WHEN p_size % 10 = 0 THEN '1:B2' ELSE p_size::VARCHAR END AS ref, l, p_size
FROM (SELECT p_partkey, p_size, replace(CASE WHEN p_partkey > 26 THEN chr(((p_partkey - 1) // 26 % 27 + 64)::INT) ELSE '' END || chr(((p_partkey - 1) % 26 + 65)::INT), '@', '') AS l FROM part)"""
COLS = f"SELECT p_partkey, ref, (CASE WHEN l = '' THEN 1 ELSE list_reduce(list_prepend(0, list_transform(string_split(l, ''), lambda c: ascii(c) - 64)), lambda a, b: a * 26 + b) END - 1)::BIGINT AS col FROM ({_REF})"
ROWS = f"SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size - 1 END::BIGINT AS row FROM ({_REF})"
_ZIP = "SELECT page_id, 'ppt/slides/../' || regexp_replace(url, '^[a-z]*:/', '.') || '/../x.png' AS p FROM pages"
ZIP_PATHS = rf"""SELECT page_id, 'ppt/' || CASE WHEN len(seg) > 1 THEN array_to_string(seg[1:len(seg) - 1], '/') || '/' ELSE '' END || 'x.png' AS path,
 regexp_replace(p, '\A(.*)/([^/]*)\z', '\1/_rels/\2.rels', 's') AS rels, CASE WHEN page_id % 2 = 0 THEN p ELSE 'xl/' || p END AS part
FROM (SELECT page_id, p, list_filter(string_split(regexp_extract(p, '\Appt/slides/\.\./(.*)/\.\./x\.png\z', 1, 's'), '/'), lambda s: s NOT IN ('', '.')) AS seg FROM ({_ZIP}))"""
LID = """SELECT i AS lid, CASE WHEN x = 4 THEN 936 WHEN x = 17 THEN 932 WHEN x = 18 THEN 949 WHEN x IN (25, 34, 35) THEN 1251 WHEN x IN (26, 5, 14, 21, 27, 36) THEN 1250 WHEN x IN (37, 38, 39) THEN 1257
WHEN x = 8 THEN 1253 WHEN x = 31 THEN 1254 WHEN x = 13 THEN 1255 WHEN x IN (1, 41) THEN 1256 WHEN x = 42 THEN 1258 WHEN x = 30 THEN 874 ELSE 1252 END::BIGINT AS page FROM (SELECT i, i & 1023 AS x FROM range(0, 4096) t(i))"""
CODEPAGES = """WITH c AS (SELECT [8364, 129, 8218, 402, 8222, 8230, 8224, 8225, 710, 8240, 352, 8249, 338, 141, 381, 143, 144, 8216, 8217, 8220, 8221, 8226, 8211, 8212, 732, 8482, 353, 8250, 339, 157, 382, 376] AS w)
SELECT i AS id, chr((CASE WHEN i BETWEEN 128 AND 159 THEN w[i - 127] ELSE i END)::INT) AS cp1252,
 chr((CASE WHEN i < 161 OR i = 173 THEN i WHEN i = 240 THEN 8470 WHEN i = 253 THEN 167 ELSE i + 864 END)::INT) AS iso5 FROM range(0, 256) t(i), c"""
_HEADS = ["FFD8FFE0", "89504E470D0A1A0A", "474946383961", "52494646000000005745425056", "424D0000", "3C7376672F3E", "3C3F786D6C3E", "0100", "D7CDC69A"]
_DATA = f"from_hex([{', '.join(repr(h) for h in _HEADS)}][(p_partkey % 9 + 1)::INT])"
_MIME_OF = """CASE WHEN strlen(h) < 8 THEN NULL WHEN starts_with(h, 'FFD8FF') THEN 'image/jpeg' WHEN starts_with(h, '89504E47') THEN 'image/png' WHEN starts_with(h, '474946') AND strlen(h) >= 12 THEN 'image/gif'
WHEN starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250' THEN 'image/webp' WHEN starts_with(h, '424D') THEN 'image/bmp' WHEN starts_with(h, '3C') AND contains(h, '3C737667') THEN 'image/svg+xml' END"""
MIME = f"SELECT p_partkey, {_MIME_OF} AS mime FROM (SELECT p_partkey, hex({_DATA}) AS h FROM part)"
IMAGE_REFS = f"""SELECT doc_id, p_partkey, '![][image' || n || ']' AS inline, '[image' || n || ']: <data:' || mime || ';base64,' || to_base64(data) || '>' AS definition
FROM (SELECT *, {_MIME_OF} AS mime FROM (SELECT p_size AS doc_id, p_partkey, {_DATA} AS data, hex({_DATA}) AS h, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM part)) WHERE mime IS NOT NULL"""
DETECT = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ole2' WHEN 1 THEN 'pdf' WHEN 2 THEN 'zip' END AS kind FROM part"

_BY_NATION = "nation JOIN supplier ON s_nationkey = n_nationkey"
_DAY = "strftime(DATE '1899-12-30' + (40000 + s_suppkey)::INT, '%Y-%m-%d')"
XLSX = f"SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS name, s_suppkey::VARCHAR AS suppkey, s_name AS supplier, {_DAY} AS day FROM {_BY_NATION}"
XLS = f"SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS name, s_suppkey::VARCHAR AS suppkey, s_name AS supplier, {_DAY} AS day, CASE WHEN s_suppkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS even FROM {_BY_NATION}"
DOCX = f"""SELECT n_nationkey::BIGINT AS n_nationkey, n_name || {NL} || {NL} || 'item' || {NL} || {NL} || 'all of them' || {NL} || {NL} || 'Key' || chr(9) || 'Name|s' || {NL} || string_agg({NL} || s_suppkey || chr(9) || s_name || {NL}, '' ORDER BY s_suppkey) AS plain,
'## ' || n_name || {NL} || {NL} || '  - item' || {NL} || '[**all** of them](http://s/)' || {NL} || {NL} || '| Key | Name\\|s |' || {NL} || '| --- | --- |' || {NL} || string_agg('| ' || s_suppkey || ' | ' || s_name || ' |' || {NL}, '' ORDER BY s_suppkey) || {NL} AS markdown FROM {_BY_NATION} GROUP BY n_nationkey, n_name"""
_MARK = "repeat('  ', (s_suppkey % 3)::INT) || CASE WHEN s_suppkey % 2 = 1 THEN '1. ' ELSE '- ' END || s_name || chr(10)"
PPTX = f"""SELECT n_nationkey::BIGINT AS n_nationkey, '--- Slide 1 ---' || {NL} || n_name || {NL} || {NL} || '--- Slide 3 ---' || {NL} || string_agg({_MARK}, '' ORDER BY s_suppkey) AS plain,
'## Slide 1' || {NL} || {NL} || '### ' || n_name || {NL} || {NL} || '## Slide 3' || {NL} || {NL} || string_agg({_MARK}, '' ORDER BY s_suppkey) || {NL} AS markdown FROM {_BY_NATION} GROUP BY n_nationkey, n_name"""
_LINK = "s_name || ' is [here](http://s/' || s_suppkey || ').'"
DOC = f"""SELECT n_nationkey::BIGINT AS n_nationkey, n_name || ' Report' || {NL} || {NL} || string_agg({_LINK}, {NL} || {NL} ORDER BY s_suppkey) || {NL} AS plain,
'**' || n_name || ' Report**' || {NL} || {NL} || string_agg({_LINK} || {NL} || {NL}, '' ORDER BY s_suppkey) AS markdown FROM {_BY_NATION} GROUP BY n_nationkey, n_name"""
PDF = f"""SELECT n_nationkey::BIGINT AS n_nationkey, '## Page 1' || {NL} || {NL} || n_name || {NL} || string_agg({NL} || '## Page ' || (r + 2) || {NL} || {NL} || s_name || {NL} || {NL} || '(' || s_suppkey || ')' || {NL}, '' ORDER BY r) AS markdown
FROM (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS r FROM {_BY_NATION}) GROUP BY n_nationkey, n_name"""
ERRORS = f"""SELECT n_nationkey::BIGINT AS n_nationkey, CASE length(n_name) % 7 WHEN 3 THEN 'doc' WHEN 4 THEN 'xls' WHEN 5 THEN 'pdf' WHEN 6 THEN 'docx' END AS format,
CASE WHEN length(n_name) % 7 = 6 THEN n_name || {NL} END AS text, length(n_name) % 7 <> 6 AS failed FROM nation"""
ALL = f"SELECT n_nationkey::BIGINT AS n_nationkey, ['docx', 'xlsx', 'pptx', 'xls', 'doc', 'pdf'][(n_nationkey % 6 + 1)::INT] AS format, n_name || {NL} AS text FROM nation"

ORACLES = {
    "doc_markdown": DOC_MARKDOWN, "doc_plain_paragraphs": DOC_PLAIN, "doc_subheadings": DOC_SUB, "line_neighbours": NEIGHBOURS, "section_headings": SECTION, "tab_columns": f"SELECT p_partkey, k AS n_cols FROM ({_COUNT})",
    "tab_tables": TAB_TABLES, "clean_pages": CLEAN, "blank_runs": BLANK_RUNS, "pdf_pages_plain": PDF_PLAIN, "pdf_page_headings": PDF_HEADINGS, "sheet_tsv": SHEET_TSV, "sheet_markdown": SHEET_MD, "sheet_crop": SHEET_CROP,
    "sheet_skip_empty": SHEET_SKIP, "grid_densify": GRID, "sst_lookup": SST, "style_dates": STYLES, "link_cells": LINKS, "rels_resolve": RELS, "hyperlinks_markdown": HYPERLINKS, "runs_grouped": RUNS,
    "slide_heading_levels": HEADING_LEVELS, "slides_markdown": SLIDES_MD, "bullets": BULLETS, "heading_styles": STYLE_LEVELS, "field_urls": FIELDS, "serial_to_iso": SERIAL, "serial_edges": SERIAL_EDGES, "serial_time": SERIAL_TIME,
    "date_format_ids": DATE_IDS, "date_format_strings": DATE_CODES, "format_number": FORMAT_NUMBER, "rk_decode": RK, "col_refs": COLS, "row_refs": ROWS, "zip_paths": ZIP_PATHS, "lid_codepage": LID, "codepage_decode": CODEPAGES,
    "image_mime": MIME, "image_refs": IMAGE_REFS, "detect_format": DETECT, "xlsx_roundtrip": XLSX, "xls_roundtrip": XLS, "docx_roundtrip": DOCX, "pptx_roundtrip": PPTX, "doc_roundtrip": DOC, "pdf_roundtrip": PDF,
    "parse_errors": ERRORS, "extract_all": ALL, "stream_subheadings": DOC_SUB,
}
