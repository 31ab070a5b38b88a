"""The registered queries in SQL, one statement per query, over the same tables."""

from __future__ import annotations

from .corpus_view import CORPUS_SQL

_SPACE = r"\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def _tokens(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^{_SPACE}]+'))"


def _lines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')) + 1)"


def _name(path: str) -> str:
    return f"regexp_extract({path}, '[^/]*$')"


def _suffix(path: str) -> str:
    return rf"lower(regexp_extract({_name(path)}, '(?s)^.+(\.[^.]+)$', 1))"


def _stem(path: str) -> str:
    return rf"CASE WHEN {_suffix(path)} = '' THEN {_name(path)} ELSE left({_name(path)}, length({_name(path)}) - length({_suffix(path)})) END"


def _base(path: str) -> str:
    return f"regexp_extract({_name(path)}, '(?s)^(.[^.]*)', 1)"


_KIND = r"""CASE WHEN regexp_matches(path, '\.(bin|jpg|pdf)$') THEN 'binary'
  WHEN regexp_matches(path, '\.(txt|py|md|json|csv)$') THEN 'text'
  WHEN text IS NULL OR contains(text, chr(0)) AND strlen(split_part(text, chr(0), 1)) < 1024 THEN 'binary'
  ELSE 'text' END"""
_ANY_SIZE = rf"""(SELECT *, {_KIND} AS kind FROM {CORPUS_SQL}
  WHERE NOT regexp_matches(path, '(^|/)\.')
    AND NOT regexp_matches(path, '(^|/)docs/[^/]+/[^/]*\.md$') AND NOT regexp_matches(path, '[5-7]\.csv$'))"""
_SELECTED = f"(SELECT * FROM {_ANY_SIZE} WHERE length <= 2048)"
# The built-in ignore patterns.
_DEFAULT_RULES = [
    "__pycache__/*", "*.pyc", "*.pyo", "*.pyd", "*.so", "*.dll", "*.dylib", "*.exe", "*.bin", "*.jpg", "*.jpeg",
    "*.pdf", "*.zip", "*.tar.gz", ".git/*", ".svn/*", ".hg/*", "node_modules/*", "venv/*", ".env/*",
]
_IGNORED = "(" + " OR ".join(f"path GLOB '{p}'" for p in [*_DEFAULT_RULES, "docs/*", "*3.json", "src*/fr/*"]) + ")"
_OVERRIDDEN = "(path GLOB 'venv/en/*' OR path GLOB '*7.md')"
_DECISION = f"CASE WHEN kind = 'binary' THEN 'binary' WHEN {_OVERRIDDEN} THEN 'override' WHEN {_IGNORED} THEN 'ignored' ELSE 'kept' END"
_SMALL = f"(SELECT *, {_DECISION} AS decision FROM {_SELECTED})"
_DECIDED = f"(SELECT *, {_DECISION} AS decision FROM {_ANY_SIZE})"
_KEPT = f"(SELECT * FROM {_DECIDED} WHERE decision IN ('kept', 'override'))"
_COUNTERS = f"""count(*) FILTER (WHERE decision IN ('kept', 'override') AND text IS NOT NULL) AS processed_files,
  count(*) FILTER (WHERE decision IN ('kept', 'override') AND text IS NULL) AS skipped_files,
  count(*) FILTER (WHERE decision = 'binary') AS binary_files,
  CAST(0 AS BIGINT) AS error_files,
  CAST(coalesce(sum(length(text)) FILTER (WHERE decision IN ('kept', 'override')), 0) AS BIGINT) AS total_chars,
  CAST(coalesce(sum({_lines('text')}) FILTER (WHERE decision IN ('kept', 'override')), 0) AS BIGINT) AS total_lines,
  CAST(coalesce(sum({_tokens('text')}) FILTER (WHERE decision IN ('kept', 'override')), 0) AS BIGINT) AS total_tokens"""
_INCLUDED = r"regexp_matches(path, '\.md$|(^|/)src/[^/]+/doc[^/]*[0-4]\.txt$|(^|/)docs/[^/]+/[^/]*\.py$|^source.?/[^/]+$|^docs/[^/]+/[^/]*\.csv$|^fr/[^/]*\.txt$')"

_MARKUP = (
    "(?is)<!--.*?(?:-->|$)"
    r"|<script(?:[\s/][^>]*)?>.*?(?:</script[^>]*>|$)|<style(?:[\s/][^>]*)?>.*?(?:</style[^>]*>|$)"
    r"|<template(?:[\s/][^>]*)?>.*?</template\s*>|<rt(?:[\s/][^>]*)?>.*?</rt\s*>|<rp(?:[\s/][^>]*)?>.*?</rp\s*>"
    r"|<[!?][^>]*>"
)
_TAG = r"""(?is)</?[a-zA-Z](?:[^>"'']|"[^"]*"|''[^'']*'')*>"""


def _references(text: str) -> str:
    """The references the pages hold, with or without the final semicolon, ``&amp`` last."""
    pairs = [("&lt", "<"), ("&gt", ">"), ("&quot", '"'), ("&nbsp", "\xa0"), ("&copy", "©"), ("&middot", "·"), ("&amp", "&")]
    for reference, character in pairs:
        text = f"regexp_replace({text}, '{reference};?', '{character}', 'g')"
    return text


_CONTENT = f"regexp_replace(html, '{_MARKUP}', '', 'g')"
_BLOCKS = (
    "address|article|aside|blockquote|body|div|dl|dt|dd|fieldset|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|"
    "html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
)


def _pieces(tags: str, wanted: str, section: int) -> str:
    cut = rf"string_split(regexp_replace(content, '<(/?)({tags})([\s/>])', chr(1) || '\1\2\3', 'gi'), chr(1))"
    return f"""SELECT page_id, {section} AS section, ord, lower(regexp_extract(piece, '^[a-zA-Z0-9]+')) AS kind,
        {_strip(_references(f"regexp_replace('<' || piece, '{_TAG}', '', 'g')"))} AS text
      FROM (SELECT page_id, unnest({cut}[2:]) AS piece, generate_subscripts({cut}[2:], 1) AS ord
            FROM (SELECT page_id, {_CONTENT} AS content FROM pages))
      WHERE regexp_matches(piece, '^({wanted})[\\s/>]', 'i')"""


_ELEMENTS = f"""(SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY section, ord) - 1 AS pos, kind, text
  FROM ({_pieces(_BLOCKS, 'title', 0)} UNION ALL {_pieces(_BLOCKS, 'h[1-6]|p', 1)}
        UNION ALL {_pieces('li|ul|ol', 'li', 2)}))"""

_SLIDE_LINES = f"""(
  SELECT DISTINCT conv_id, turn + 1 AS slide_no, CAST(-1 AS BIGINT) AS line_no, 'Slide ' || (turn + 1) || ':' AS text FROM conversations
  UNION ALL SELECT conv_id, turn + 1, CAST(0 AS BIGINT), {_strip('role')} FROM conversations WHERE {_strip('role')} <> ''
  UNION ALL SELECT conv_id, turn + 1, CAST(1 AS BIGINT), {_strip('text')} FROM conversations WHERE {_strip('text')} <> ''
  UNION ALL SELECT DISTINCT conv_id, turn + 1, CAST(4611686018427387904 AS BIGINT), '' FROM conversations)"""

def _cuts(columns: str, rows: str, part: str, order: str, limit: int) -> str:
    """Add ``cut_no``: how often the bytes of the lines before, each with its line end, pass the limit within a part."""
    return f"""SELECT *, (coalesce(sum(coalesce(strlen(text), 0) + 1) OVER (PARTITION BY {part} ORDER BY {order}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {limit})::BIGINT AS cut_no FROM (SELECT {columns} FROM {rows})"""


_PRICE = "CAST(o_totalprice AS VARCHAR)"
_DAY = "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"
_EVEN = "CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END"
_SHEET_ROW = f"""o_orderkey || ' | ' || o_orderstatus || ' | ' || {_PRICE} || ' | ' || {_DAY}
  || CASE o_orderstatus WHEN 'O' THEN ' | ,' WHEN 'F' THEN ' | ' ELSE '' END || ' | ' || {_EVEN}"""

_PAGE_TEXTS = """(SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
  CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS page_no FROM documents)"""
_SPECS = "['1-3', '5-2', '2', '3,1,3', '', 'x-1', ' 4 - 6 , 2', '900-1000', '1-99999999']"
_REQUESTS = f"(SELECT doc_id, {_SPECS}[doc_id % 9 + 1] AS spec, {_lines('text')} AS n_pages FROM documents)"
_ASKED = """CASE doc_id % 9 WHEN 0 THEN [1, 2, 3] WHEN 1 THEN [2, 3, 4, 5] WHEN 2 THEN [2] WHEN 3 THEN [1, 3]
  WHEN 4 THEN [] WHEN 5 THEN NULL WHEN 6 THEN [2, 4, 5, 6] WHEN 7 THEN range(900, 1001) END"""
_BOUNDS = """CASE doc_id % 9 WHEN 0 THEN [[1, 3]] WHEN 1 THEN [[2, 5]] WHEN 2 THEN [[2, 2]] WHEN 3 THEN [[1, 1], [3, 3]]
  WHEN 4 THEN [] WHEN 5 THEN NULL WHEN 6 THEN [[2, 2], [4, 6]] WHEN 7 THEN [[900, 1000]] ELSE [[1, 99999999]] END"""


def _shown(bounds: str) -> str:
    return f"array_to_string(list_transform({bounds}, lambda b: CASE WHEN b[1] = b[2] THEN b[1]::VARCHAR ELSE b[1] || '-' || b[2] END), ',')"


_CLAMPED = f"""CASE WHEN n_pages IS NULL THEN NULL WHEN doc_id % 9 = 4 THEN CASE WHEN n_pages >= 1 THEN [[1, n_pages]] ELSE [] END
  ELSE list_filter(list_transform({_BOUNDS}, lambda b: [b[1], least(b[2], n_pages)]), lambda b: b[1] <= b[2]) END"""
_CHOSEN = f"CASE WHEN n_pages IS NULL THEN NULL WHEN doc_id % 9 IN (4, 8) THEN range(1, n_pages + 1) ELSE list_filter({_ASKED}, lambda p: p <= n_pages) END"

_NEWEST = """(SELECT user_id, arg_max({'message': event_type || ' ' || props, 'author': 'author' || (event_id % 7),
    'date': strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'}, (ts, CAST(event_id AS VARCHAR))) AS c
  FROM events GROUP BY user_id)"""
_DOC_COMMITS = """(SELECT event_id % (SELECT max(doc_id) + 1 FROM documents) AS doc_id, arg_max({'message': event_type || ' ' || props,
    'author': 'author' || (event_id % 7), 'date': strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'},
    (ts, CAST(event_id AS VARCHAR))) AS c
  FROM events GROUP BY 1)"""

_RULE = "repeat('=', 80)"


def _tree(paths: str) -> str:
    """Entries of ``paths`` (column ``path``) and their folders, with the printing order."""
    return f"""
  WITH files AS (SELECT path FROM {paths}),
  folders AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS entry
    FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS n FROM files)),
  entries AS (SELECT path AS entry, false AS is_dir FROM files
      WHERE NOT starts_with({_name('path')}, '.') AND NOT contains(lower({_name('path')}), 'test')
    UNION ALL SELECT entry, true FROM folders),
  parts AS (SELECT entry, is_dir, string_split(entry, '/') AS p FROM entries)
  SELECT array_to_string(list_transform(range(1, len(p) + 1),
      lambda i: (CASE WHEN i < len(p) OR is_dir THEN '1' ELSE '0' END) || p[i]), chr(0)) AS sort_key,
    CAST(len(p) - 1 AS INTEGER) AS depth,
    repeat('  ', len(p) - 1) || '└── ' || p[-1] || CASE WHEN is_dir THEN '/' ELSE '' END AS line
  FROM parts"""


_FILE_HEAD = "'File: ' || path || chr(10) || repeat('-', 80) || chr(10)"
_SUMMARY = """chr(10) || 'File Statistics:' || chr(10) || '--------------' || chr(10)
  || 'Total files processed: ' || processed_files || chr(10) || 'Binary files skipped: ' || binary_files || chr(10)
  || 'Files with errors: ' || error_files || chr(10) || 'Total characters: ' || format('{:,}', total_chars) || chr(10)
  || 'Total lines: ' || format('{:,}', total_lines) || chr(10) || 'Total tokens: ' || format('{:,}', total_tokens)"""

# Documents filed under part names, and seven patterns for each part.
_NAMED_PATHS = f"""(SELECT doc_id, array_to_string(string_split(path, '/')[1:2], '/') || '/' || p_name || '/' || {_name('path')} AS path
  FROM {CORPUS_SQL} JOIN part ON p_partkey = doc_id % 200 + 1)"""
_PART_RULES = """(SELECT DISTINCT CASE WHEN p_partkey % 7 = 0 THEN 'override' ELSE 'ignore' END AS kind, unnest([
  '*/' || p_name || '/doc' || p_partkey || '.*', 'src' || (p_partkey % 20) || '/*/' || p_name || '/*[0-4].txt', '*' || p_name || '*' || p_partkey || '.md',
  '*/doc?' || p_partkey || '.json', 'docs/*' || lower(p_type) || '*', '?[!s]*' || p_partkey, '*' || p_name || '/doc' || p_partkey || '*[02468].py'])
  AS pattern FROM part)"""

# Every source as a repository: its own rule lines and the defaults, decisions, and what is exported.
_REPOSITORY_RULES = f"""(SELECT DISTINCT source AS repository, CASE WHEN starts_with(line, '!') THEN 'override' ELSE 'ignore' END AS kind,
    CASE WHEN starts_with(line, '!') THEN line[2:] ELSE line END AS pattern
  FROM (SELECT source, trim(unnest(['*' || d || '.txt', 'src/*/doc*' || d || '?.py', 'docs/' || CASE WHEN n % 2 = 0 THEN 'en' ELSE 'fr' END || '/*', ' *.csv ',
      '!*' || d || '.pyc', '!venv/*[!' || d || '].csv', '!' || source || '/en/*'])) AS line
    FROM (SELECT DISTINCT source, TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS n, n % 10 AS d FROM documents)
    WHERE coalesce(n % 5 <> 4, true))
  UNION SELECT source, 'ignore', pattern FROM (SELECT DISTINCT source FROM documents), (SELECT unnest({_DEFAULT_RULES}) AS pattern))"""
_REPOSITORY_FILES = rf"""(SELECT f.source AS repository, f.path, f.text, CASE WHEN f.kind = 'binary' THEN 'binary' WHEN coalesce(r.overridden, false) THEN 'override'
    WHEN coalesce(r.ignored, false) THEN 'ignored' ELSE 'kept' END AS decision
  FROM (SELECT *, {_KIND} AS kind FROM {CORPUS_SQL} WHERE NOT regexp_matches(path, '(^|/)\.')) f
  LEFT JOIN (SELECT c.doc_id, bool_or(r.kind = 'override') AS overridden, bool_or(r.kind = 'ignore') AS ignored FROM {CORPUS_SQL} c
    JOIN {_REPOSITORY_RULES} r ON r.repository = c.source AND c.path GLOB r.pattern GROUP BY c.doc_id) r ON r.doc_id = f.doc_id)"""
_REPOSITORY_KEPT = f"(SELECT * FROM {_REPOSITORY_FILES} WHERE decision IN ('kept', 'override'))"


def _trees(paths: str) -> str:
    """As :func:`_tree`, one for each ``repository`` of ``paths``."""
    return f"""
  WITH files AS (SELECT repository, path FROM {paths}),
  folders AS (SELECT DISTINCT repository, array_to_string(string_split(path, '/')[1:n], '/') AS entry
    FROM (SELECT repository, path, unnest(range(1, len(string_split(path, '/')))) AS n FROM files)),
  entries AS (SELECT repository, path AS entry, false AS is_dir FROM files
      WHERE NOT starts_with({_name('path')}, '.') AND NOT contains(lower({_name('path')}), 'test')
    UNION ALL SELECT repository, entry, true FROM folders),
  parts AS (SELECT repository, is_dir, string_split(entry, '/') AS p FROM entries)
  SELECT repository, array_to_string(list_transform(range(1, len(p) + 1),
      lambda i: (CASE WHEN i < len(p) OR is_dir THEN '1' ELSE '0' END) || p[i]), chr(0)) AS sort_key,
    repeat('  ', len(p) - 1) || '└── ' || p[-1] || CASE WHEN is_dir THEN '/' ELSE '' END AS line FROM parts"""


# crc32 of a source's name by bits: a byte comes in, then eight shifts.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(source, ''),
  lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"""
_UPLOADS = rf"""(SELECT source AS job_id, doc_id AS pos,
  {_name('path')} || CASE WHEN path LIKE '%.md' THEN '.html' ELSE '' END AS filename,
  CASE WHEN regexp_matches(path, '\.(txt|csv)$') OR NOT contains({_name('path')}, '.') THEN 'text/plain'
    WHEN path LIKE '%.pdf' THEN 'application/pdf' WHEN path LIKE '%.md' THEN 'text/html'
    ELSE 'application/octet-stream' END AS content_type,
  length * 5000 AS length FROM {CORPUS_SQL})"""
_REJECTED = rf"""(SELECT *, CASE WHEN length > 52428800 THEN 'File ' || filename || ' exceeds maximum size of 50MB'
    WHEN regexp_matches(filename, '\.(exe|bat|cmd|sh|js|php|py)$') THEN 'File type not allowed: ' || {_suffix('filename')}
    WHEN NOT regexp_matches(filename, '\.(txt|pdf|docx?|xlsx?|pptx?|html?)$')
      THEN 'Unsupported file type: ' || {_suffix('filename')}
    WHEN content_type NOT IN ('text/plain', 'application/pdf', 'text/html') THEN 'Invalid file type detected'
    END AS reject_reason
  FROM {_UPLOADS})"""

_ROUTES = """(SELECT doc_id, lower(ext) AS ext, source || '/report.v' || doc_id || ext AS path,
    unnest(['text', 'csv', 'pdf', 'image', 'docx']) AS format
  FROM (SELECT *, ['.doc', '.docx', '.xls', '.xlsx', '.ppt', '.PPTX', '.mhtml', '.mht', '.html', '.htm', '.py',
    '.pdf', '.zip', ''][doc_id % 14 + 1] AS ext FROM documents))"""
_OUTCOME = """CASE WHEN doc_id % 14 IN (6, 7) THEN 'refused' WHEN doc_id % 14 = 10 THEN 'copy'
    WHEN format = 'text' THEN CASE WHEN doc_id % 14 >= 12 THEN 'copy' ELSE 'ok' END
    WHEN format = 'image' THEN 'no longer supported'
    WHEN format = 'csv' AND doc_id % 14 IN (2, 3) THEN 'ok'
    WHEN format = 'csv' AND doc_id % 14 >= 11 THEN 'error'
    WHEN format = 'pdf' AND doc_id % 14 IN (8, 9) THEN 'render'
    WHEN doc_id % 14 >= 12 THEN 'unsupported input' ELSE 'unsupported' END"""

_RESULTS = """(SELECT CAST(user_id AS VARCHAR) AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos,
    'file' || event_id || '.txt' AS filename, CASE WHEN event_type = 'error' THEN 'bad ' || props END AS error
  FROM events)"""
_ERRORS = f"(SELECT job_id, pos, 'Error converting ' || filename || ': ' || error AS message FROM {_RESULTS} WHERE error IS NOT NULL)"

_REPO_URLS = r"""(SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://github.com/' || rest
    WHEN 1 THEN 'http://github.com/owner/repo' || page_id || '.git'
    WHEN 2 THEN 'https://github.com/owner/repo/tree/dev/' || rest
    WHEN 3 THEN 'https://github.com/owner/repo/issues/' || rest
    WHEN 4 THEN url ELSE 'https://github.com/owner/repo/tree/main/' END AS url
  FROM (SELECT page_id, url, regexp_replace(regexp_replace(url, '^https?://([^/]+)/', '\1/'), '[?#].*$', '') AS rest FROM pages))"""
_REPO = r"nullif(regexp_extract(url, '^(https?://github\.com/[^/]+/[^/]+)', 1), '')"

SQL: dict[str, str] = {
    "corpus_stats": f"SELECT source, {_COUNTERS} FROM {_SMALL} GROUP BY source ORDER BY source",
    "file_selection": f"SELECT doc_id, path, length, kind FROM {_SELECTED}",
    "glob_include": f"SELECT doc_id, path FROM {CORPUS_SQL} WHERE {_INCLUDED}",
    "glob_exclude": f"SELECT doc_id, path FROM {CORPUS_SQL} WHERE NOT {_INCLUDED}",
    "ignore_rules": f"SELECT doc_id, path, {_DECISION} AS decision FROM (SELECT *, {_KIND} AS kind FROM {CORPUS_SQL})",
    "kept_paths": f"SELECT doc_id, path FROM {CORPUS_SQL} WHERE {_OVERRIDDEN} OR NOT {_IGNORED}",
    "dropped_paths": f"SELECT doc_id, path FROM {CORPUS_SQL} WHERE NOT {_OVERRIDDEN} AND {_IGNORED}",
    "rule_source": f"""SELECT DISTINCT kind, pattern FROM (
        SELECT CASE WHEN line LIKE '!%' THEN 'override' ELSE 'ignore' END AS kind,
          CASE WHEN line LIKE '!%' THEN substr(line, 2) ELSE line END AS pattern
        FROM (SELECT {_strip("CASE WHEN (page_no - 1) % 5 = 4 THEN '!' ELSE '' END || text")} AS line FROM {_PAGE_TEXTS})
        WHERE line <> '' AND line NOT LIKE '#%'
        UNION ALL SELECT 'ignore', unnest({_DEFAULT_RULES}))""",
    "type_lookup": f"""SELECT doc_id, {_suffix('path')} AS ext,
        CASE {_suffix('path')} WHEN '.bin' THEN 'binary' WHEN '.jpg' THEN 'binary' WHEN '.pdf' THEN 'binary'
          WHEN '.txt' THEN 'text' WHEN '.py' THEN 'text' WHEN '.md' THEN 'text' WHEN '.json' THEN 'text' END AS ext_kind,
        m.mime, m.mime_kind
      FROM {CORPUS_SQL} LEFT JOIN (VALUES ('.txt', 'text/plain', 'text'), ('.py', 'text/x-python', 'text'),
        ('.md', 'text/markdown', 'text'), ('.json', 'application/json', 'text'), ('.csv', 'text/csv', 'text'),
        ('.pdf', 'application/pdf', 'binary'), ('.bin', 'application/octet-stream', 'binary'),
        ('.jpg', 'image/jpeg', 'binary')) m(ext, mime, mime_kind) ON {_suffix('path')} = m.ext""",
    "nul_sniff": """SELECT doc_id, CASE WHEN t IS NULL OR contains(t, chr(0)) AND strlen(split_part(t, chr(0), 1)) < 1024
          THEN 'binary' ELSE 'text' END AS kind
      FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN substr(text, 1, 900) || chr(0) || text ELSE text || chr(0) END AS t
            FROM documents)""",
    "subdir_scope": f"SELECT doc_id, substr(path, 6) AS path FROM {CORPUS_SQL} WHERE path LIKE 'docs/%'",
    "path_parts": f"""SELECT page_id, {_name('url')} AS name, {_suffix('url')} AS suffix, {_stem('url')} AS stem,
        {_base('url')} AS base, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent,
        CAST(len(string_split(url, '/')) - 1 AS INTEGER) AS depth FROM pages""",
    "decode_fallback": f"""SELECT doc_id, CASE WHEN t IS NULL THEN NULL WHEN doc_id % 3 = 0 THEN 'latin-1' ELSE 'utf-8' END AS encoding,
        CASE WHEN doc_id % 3 > 0 THEN length(t) END AS strict_chars,
        CASE WHEN doc_id % 3 = 0 THEN strlen(t) + 2 ELSE length(t) END AS lenient_chars,
        {_lines('t')} + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS lenient_lines,
        CASE WHEN doc_id % 3 > 0 THEN md5(t) END AS strict_md5
      FROM (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 3 = 1 THEN replace(text, chr(10), chr(13) || chr(10))
          ELSE text END, '\\r\\n?', chr(10), 'g') AS t FROM documents)""",
    "segment_metrics": f"""SELECT doc_id, CASE WHEN valid THEN length(t) END AS chars, CASE WHEN valid THEN {_lines('t')} END AS lines,
        CASE WHEN valid THEN {_tokens('t')} END AS tokens
      FROM (SELECT doc_id, doc_id % 3 > 0 AS valid, regexp_replace(CASE WHEN doc_id % 3 = 1 THEN replace(text, chr(10), chr(13) || chr(10))
          ELSE text END, '\\r\\n?', chr(10), 'g') AS t FROM documents)""",
    "text_metrics": f"""SELECT doc_id, length(text) AS chars, {_lines('text')} AS lines, {_tokens('text')} AS tokens,
        length({_strip('text')}) AS stripped_chars, strlen(text) / 1024.0::DOUBLE AS size_kb,
        format('{{:,}}', length(text)) AS chars_shown FROM documents""",
    "html_text": f"""SELECT page_id, array_to_string(list_filter(list_transform(
        string_split(regexp_replace(regexp_replace(html, '{_MARKUP}', chr(1), 'g'), '{_TAG}', chr(1), 'g'), chr(1)),
        lambda x: {_strip(_references('x'))}), lambda x: x <> ''), chr(10)) AS text FROM pages""",
    "html_elements": f"SELECT page_id, CAST(pos AS INTEGER) AS pos, kind, text FROM {_ELEMENTS}",
    "html_tables": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
      SELECT o_custkey, t AS table_no, u AS outer_table, r AS row_no, c AS col_no, kind, text FROM (
        SELECT o_custkey, 1::BIGINT AS t, 0::BIGINT AS u, n AS r, 1::BIGINT AS c, 'td' AS kind, o_orderkey || ' & ' || o_orderstatus || ' tail' AS text FROM o
        UNION ALL SELECT o_custkey, 1, 0, n, 2, 'td', o_orderstatus FROM o
        UNION ALL SELECT o_custkey, n + 1, 1, 1, 1, 'th', o_orderpriority FROM o
        UNION ALL SELECT o_custkey, n + 1, 1, 1, 2, 'td', o_totalprice::VARCHAR FROM o)""",
    "html_table_rows": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
      SELECT o_custkey, 1::BIGINT AS table_no, n AS row_no, o_orderkey || ' & ' || o_orderstatus || ' tail | ' || o_orderstatus AS text FROM o
      UNION ALL SELECT o_custkey, n + 1, 1, o_orderpriority || ' | ' || o_totalprice FROM o""",
    "html_lists": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
      SELECT o_custkey, l AS list_no, u AS outer_list, d AS depth, i AS item_no, text FROM (
        SELECT o_custkey, 1::BIGINT AS l, 0::BIGINT AS u, 1::BIGINT AS d, n AS i, 'item ' || o_orderkey || ' end' AS text FROM o
        UNION ALL SELECT o_custkey, n + 1, 1, 2, 1, o_orderstatus FROM o UNION ALL SELECT o_custkey, n + 1, 1, 2, 2, '<x>' FROM o)""",
    "html_images": f"""WITH f AS (SELECT doc_id, path FROM {CORPUS_SQL}), p AS (SELECT a.path, b.path AS other FROM f a JOIN f b ON b.doc_id = a.doc_id + 1),
      i AS (SELECT path, other, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS pos FROM p)
      SELECT path, pos::INTEGER AS pos, CASE pos WHEN 0 THEN './' || {_name('path')} || '?size=1#top' WHEN 1 THEN '../../' || other
          WHEN 2 THEN '../x/.././../' || replace(other, '/', '//') WHEN 3 THEN '/' || replace(other, 'o', '%6F') WHEN 4 THEN '../../' || other || '.png'
          WHEN 5 THEN '../../../' || other WHEN 6 THEN 'https://host/' || other ELSE 'data:image/png;base64,AA==' END AS reference,
        pos < 6 AS is_local, CASE WHEN pos = 0 THEN path WHEN pos < 4 THEN other WHEN pos = 4 THEN other || '.png' END AS target, pos < 4 AS found FROM i""",
    "html_outline": f"""SELECT page_id, CASE WHEN html IS NOT NULL THEN coalesce(outline, '') END AS outline
      FROM pages LEFT JOIN (SELECT page_id, string_agg(CASE WHEN kind = 'title' THEN 'Title: ' || text || chr(10)
          WHEN kind LIKE 'h_' THEN chr(10) || text || chr(10) || repeat('=', 40) || chr(10)
          WHEN kind = 'li' THEN '• ' || text ELSE text END, chr(10) ORDER BY pos) AS outline
        FROM {_ELEMENTS} GROUP BY page_id) USING (page_id)""",
    "html_refs": f"""SELECT page_id, CAST(pos AS INTEGER) AS pos, reference,
        NOT regexp_matches(reference, '^(https?://|data:)') AS is_local,
        CASE WHEN reference LIKE '/%' THEN reference ELSE regexp_replace(url, '/[^/]*$', '') || '/' || reference END AS resolved
      FROM (SELECT page_id, url, {_references('ref')} AS reference, pos FROM (
        SELECT page_id, url, unnest(refs) AS ref, generate_subscripts(refs, 1) - 1 AS pos
        FROM (SELECT page_id, url, regexp_extract_all({_CONTENT}, '<a\\s[^>]*href="([^"]+)"', 1) AS refs FROM pages)))""",
    "slide_text": f"""SELECT conv_id, part_no, cut_no, string_agg(text, chr(10) ORDER BY slide_no, line_no, text) AS text
      FROM ({_cuts("*, greatest(slide_no, 0) // 2 AS part_no", _SLIDE_LINES, "conv_id, part_no", "slide_no, line_no, text", 400)}) GROUP BY ALL""",
    "sheet_text": f"""SELECT o_custkey, (left(sheet, 1)::BIGINT << 40) + greatest(ord, 0) // 1024 AS part_no, 0::BIGINT AS cut_no,
        string_agg(line, chr(10) ORDER BY sheet, ord) AS text
      FROM (SELECT o_custkey, o_orderpriority AS sheet, o_orderkey AS ord, {_SHEET_ROW} AS line FROM orders
        UNION ALL SELECT DISTINCT o_custkey, o_orderpriority, -1, 'Sheet: ' || o_orderpriority || chr(10) FROM orders)
      GROUP BY ALL""",
    "sheet_csv": f"""SELECT o_custkey, o_orderkey AS row_no, 'book.' || o_custkey || '_' || replace(o_orderpriority, ' ', '_') || '.csv' AS file,
        o_orderkey || ', ' || o_orderstatus || ',' || {_PRICE} || ',' || {_DAY} || ','
          || CASE o_orderstatus WHEN 'O' THEN '" , "' ELSE '' END || ',' || {_EVEN} AS text FROM orders""",
    "csv_rows": f"""SELECT p_partkey, replace(p_type || ' ' || p_brand, ' ', '_') AS sheet,
        p_partkey || ',' || CASE WHEN contains(shown, ',') THEN '"' || shown || '"' ELSE shown END
          || ',' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END || ',' || CAST(p_retailprice AS VARCHAR) AS line,
        p_partkey || ' | ' || {_strip('shown')} || CASE WHEN p_size % 2 = 0 THEN ' | ' || p_brand ELSE '' END
          || ' | ' || CAST(p_retailprice AS VARCHAR) AS row
      FROM (SELECT *, p_name || CASE WHEN p_size > 25 THEN ', ' || p_type ELSE '' END AS shown FROM part)""",
    "cell_strings": """SELECT c_custkey, CAST(c_acctbal AS VARCHAR) AS balance,
        CAST(floor(c_acctbal) * CASE WHEN c_custkey % 2 = 0 THEN 1e3 ELSE 1e15 END AS VARCHAR) AS rounded,
        true AS round_trips, CASE WHEN c_acctbal < 0 THEN 'True' ELSE 'False' END AS overdrawn FROM customer""",
    "page_text": f"""SELECT doc_id, part_no, cut_no, string_agg(text, chr(10) ORDER BY page_no, text) AS text
      FROM ({_cuts(f"doc_id, page_no, page_no // 16 AS part_no, {_strip('text')} AS text", f"{_PAGE_TEXTS} WHERE {_strip('text')} <> ''", "doc_id, part_no", "page_no, text", 600)})
      GROUP BY ALL""",
    "word_text": f"""SELECT doc_id, (t::BIGINT << 40) + r // 8 AS part_no, 0::BIGINT AS cut_no, string_agg(line, chr(10) ORDER BY t, r) AS text
      FROM (SELECT doc_id, 0 AS t, page_no - 1 AS r, {_strip('text')} AS line FROM {_PAGE_TEXTS} WHERE {_strip('text')} <> ''
        UNION ALL SELECT p_partkey // 10, p_partkey % 2 + 1, p_partkey % 10,
          p_name || ' | ' || p_brand || ' | ' || p_size FROM part)
      GROUP BY ALL""",
    "row_counts": """SELECT o_custkey, CAST(left(o_orderpriority, 1) AS INTEGER) AS sheet_no, count(*) AS n_rows
      FROM orders GROUP BY ALL""",
    "page_selection": f"""SELECT doc_id, spec,
        {_shown(_BOUNDS)} AS parsed, {_shown(_CLAMPED)} AS pages,
        CASE WHEN doc_id % 9 = 5 THEN 'Invalid page number or range: ' || spec
          WHEN spec <> '' AND len({_CHOSEN}) = 0
            THEN 'No valid pages in range: ' || spec || ' (document has ' || n_pages || ' pages)' END AS error
      FROM {_REQUESTS}""",
    "selected_page_text": f"""SELECT doc_id, page_no // 4 AS part_no, 0::BIGINT AS cut_no, string_agg(
          chr(10) || '=== Page ' || page_no || ' ===' || chr(10) || chr(10) || {_strip('text')}, chr(10) ORDER BY page_no) AS text
      FROM {_PAGE_TEXTS} JOIN (SELECT doc_id, {_CHOSEN} AS chosen FROM {_REQUESTS}) USING (doc_id)
      WHERE list_contains(chosen, page_no) AND {_strip('text')} <> '' GROUP BY ALL""",
    "last_commit": f"""SELECT 'user' || c_custkey AS path, c.message AS message, c.author AS author, c.date AS date,
        coalesce('Last Commit: ' || c.message || ' by ' || c.author || ' on ' || left(c.date, 10),
          'Last Commit: No commits found') AS line
      FROM customer LEFT JOIN {_NEWEST} ON c_custkey = user_id""",
    "directory_tree": _tree(
        """(SELECT r_name || '/' || n_name || '/' || c_name AS path FROM customer
          JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
    ),
    "corpus_tree": _tree(_KEPT),
    "sorted_paths": f"SELECT path, length FROM {CORPUS_SQL} ORDER BY path",
    "export_text": f"""SELECT 0 AS section, '' AS sort_key, 'Generated by corpusloom' || chr(10) || {_RULE} || chr(10) || chr(10)
          || 'Repository: documents' || chr(10) || chr(10) || 'Directory Structure:' || chr(10) || '------------------' AS block
      UNION ALL SELECT 1, sort_key, line FROM ({_tree(_KEPT)})
      UNION ALL SELECT 1, chr(65535), chr(10) || {_RULE} || chr(10)
      UNION ALL SELECT 2, path, {_FILE_HEAD} || text || chr(10) || {_RULE} || chr(10) FROM {_KEPT} WHERE text IS NOT NULL
      UNION ALL SELECT 3, '', {_SUMMARY} FROM (SELECT {_COUNTERS} FROM {_DECIDED})""",
    "export_text_commits": f"""SELECT 0 AS section, '' AS sort_key, 'Generated by corpusloom' || chr(10) || {_RULE} || chr(10) || chr(10)
          || 'Repository: documents' || chr(10) || chr(10) || 'Directory Structure:' || chr(10) || '------------------' AS block
      UNION ALL SELECT 1, sort_key, line FROM ({_tree(_KEPT)})
      UNION ALL SELECT 1, chr(65535), chr(10) || {_RULE} || chr(10)
      UNION ALL SELECT 3, '', {_SUMMARY} FROM (SELECT {_COUNTERS} FROM {_DECIDED})
      UNION ALL SELECT 2 AS section, path AS sort_key, {_FILE_HEAD}
          || CASE WHEN c IS NULL THEN 'Last Commit: No commits found' ELSE coalesce(
            'Last Commit: ' || c.message || ' by ' || c.author || ' on ' || left(c.date, 10), 'Last Commit: Unknown') END
          || chr(10) || chr(10) || text || chr(10) || {_RULE} || chr(10) AS block
      FROM {_KEPT} LEFT JOIN {_DOC_COMMITS} USING (doc_id) WHERE text IS NOT NULL""",
    "export_json": f"""SELECT 'documents' AS repository, path, text AS content, c.message AS message, c.author AS author,
        c.date AS date FROM {_KEPT} LEFT JOIN {_DOC_COMMITS} USING (doc_id) WHERE text IS NOT NULL""",
    "json_document": f"""WITH entry AS (SELECT path, row_number() OVER (ORDER BY path) = 1 AS leads, to_json({{'path': path, 'content': text,
          'last_commit': NULL}})::VARCHAR AS body FROM {_KEPT} WHERE text IS NOT NULL)
      SELECT 0 AS section, '' AS sort_key, '{{"repository":"documents", "files": [' AS line
      UNION ALL SELECT CASE WHEN leads THEN 1 ELSE 2 END, path, CASE WHEN leads THEN '' ELSE ',' END || body FROM entry
      UNION ALL SELECT 3, '', ']}}'""",
    "export_summary": f"SELECT *, {_SUMMARY} AS block FROM (SELECT {_COUNTERS} FROM {_DECIDED})",
    "rule_table": f"SELECT DISTINCT path, kind, pattern FROM {_NAMED_PATHS} JOIN {_PART_RULES} ON path GLOB pattern",
    "rule_table_decisions": f"""SELECT doc_id, path, CASE WHEN regexp_matches(path, '\\.(bin|jpg|pdf)$') THEN 'binary' WHEN overridden THEN 'override'
          WHEN ignored THEN 'ignored' ELSE 'kept' END AS decision
      FROM {_NAMED_PATHS} LEFT JOIN (SELECT path, bool_or(kind = 'override') AS overridden, bool_or(kind = 'ignore') AS ignored
        FROM {_NAMED_PATHS} JOIN {_PART_RULES} ON path GLOB pattern GROUP BY path) USING (path)""",
    "export_many": f"""WITH totals AS (SELECT repository, {_COUNTERS} FROM {_REPOSITORY_FILES} GROUP BY repository)
      SELECT repository, 0 AS section, '' AS sort_key, 'Generated by corpusloom' || chr(10) || {_RULE} || chr(10) || chr(10) || 'Repository: '
          || coalesce(repository, '') || chr(10) || chr(10) || 'Directory Structure:' || chr(10) || '------------------' AS block FROM totals
      UNION ALL SELECT repository, 1, sort_key, line FROM ({_trees(_REPOSITORY_KEPT)})
      UNION ALL SELECT repository, 1, chr(65535), chr(10) || {_RULE} || chr(10) FROM totals
      UNION ALL SELECT repository, 2, path, {_FILE_HEAD} || text || chr(10) || {_RULE} || chr(10) FROM {_REPOSITORY_KEPT} WHERE text IS NOT NULL
      UNION ALL SELECT repository, 3, '', {_SUMMARY} FROM totals""",
    "export_many_json": f"SELECT repository, path, text AS content FROM {_REPOSITORY_KEPT} WHERE text IS NOT NULL",
    "next_version_batch": r"""WITH existing AS (SELECT p_name || CASE p_partkey % 3 WHEN 0 THEN '(' || p_size || ')' ELSE '' END AS stem
        FROM part WHERE p_partkey % 3 <> 1),
      highest AS (SELECT split_part(stem, '(', 1) AS base, max(coalesce(TRY_CAST(regexp_extract(stem, '\(([0-9]+)\)$', 1) AS BIGINT), 0)) AS h
        FROM existing GROUP BY ALL),
      wanted AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'hot gear' ELSE 'part ' || (o_custkey % 500) END AS base,
        CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 50 END AS n FROM orders),
      placed AS (SELECT *, row_number() OVER w AS place, first_value(coalesce(n, 0)) OVER w AS own FROM wanted
        WINDOW w AS (PARTITION BY base ORDER BY o_orderkey))
      SELECT o_orderkey, 'out/' || base || CASE WHEN n IS NULL THEN '' ELSE '(' || n || ')' END || '.text' AS path,
        'out/' || base || CASE WHEN h IS NOT NULL THEN '(' || (h + place) || ')' WHEN place > 1 THEN '(' || (own + place - 1) || ')'
          WHEN n IS NULL THEN '' ELSE '(' || n || ')' END || '.text' AS next_path
      FROM placed LEFT JOIN highest USING (base)""",
    "next_version": r"""WITH existing AS (SELECT p_name || CASE p_partkey % 3 WHEN 0 THEN '(' || p_size || ')'
          WHEN 1 THEN '(copy)' ELSE '' END AS stem FROM part),
      wanted AS (SELECT DISTINCT p_name || CASE WHEN p_size > 45 THEN ' ' || p_type ELSE '' END AS stem FROM part),
      highest AS (SELECT split_part(stem, '(', 1) AS base,
          max(coalesce(TRY_CAST(regexp_extract(stem, '^[^(]*\(([0-9]+)\)$', 1) AS BIGINT), 0)) AS n
        FROM existing WHERE NOT contains(stem, '(') OR stem LIKE '%)' GROUP BY ALL),
      placed AS (SELECT stem, split_part(stem, '(', 1) AS base, row_number() OVER w AS place,
          first_value(coalesce(TRY_CAST(regexp_extract(stem, '^[^(]*\(([0-9]+)\)$', 1) AS BIGINT), 0)) OVER w AS own
        FROM wanted WINDOW w AS (PARTITION BY split_part(stem, '(', 1) ORDER BY 'out/' || stem || '.text'))
      SELECT 'out/' || stem || '.text' AS path, 'out/' || CASE WHEN n IS NOT NULL THEN base || '(' || (n + place) || ')'
          WHEN place > 1 THEN base || '(' || (own + place - 1) || ')' ELSE stem END || '.text' AS next_path
      FROM placed LEFT JOIN highest USING (base)""",
    "upload_validation": f"SELECT * FROM {_REJECTED}",
    "upload_verdicts": f"""SELECT job_id, count(*) AS n_files, count(reject_reason) AS n_rejected,
        arg_min(reject_reason, pos) FILTER (WHERE reject_reason IS NOT NULL) AS error FROM {_REJECTED} GROUP BY job_id""",
    "convertible_uploads": f"""SELECT job_id, filename FROM {_UPLOADS}
      WHERE regexp_matches(filename, '\\.(txt|pdf|docx|xlsx|pptx|html|htm)$') AND length <= 10240000
        AND NOT regexp_matches(filename, '^doc.*1\\.txt$')""",
    "conversion_routes": f"""SELECT doc_id, format, {_OUTCOME} AS outcome,
        CASE WHEN format = 'text' AND doc_id % 14 BETWEEN 6 AND 9 THEN 'report.text'
          WHEN format = 'text' AND doc_id % 14 = 11 THEN 'report.v' || doc_id || '.pdf.text'
          ELSE 'report.' || format END AS output,
        {_name('path')} || '.' || format AS upload_output FROM {_ROUTES}""",
    "route_lookup": f"SELECT doc_id, format, {_OUTCOME} AS outcome FROM {_ROUTES}",
    "mhtml_refusals": """SELECT doc_id, CASE WHEN contains(t, 'MIME-Version: 1.0') AND contains(t, 'Content-Type: multipart/related')
        THEN 'MHTML conversion is no longer supported' ELSE 'Invalid MIME structure' END AS reason
      FROM (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'MIME-Version: 1.0' ELSE '' END
          || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Content-Type: multipart/related' ELSE '' END AS t FROM documents)""",
    "row_numbers": """SELECT user_id, event_id * 1000000007 AS event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events""",
    "job_status": f"""WITH counts AS (SELECT job_id, count(*) AS n, count(error) AS bad,
          coalesce(max(pos) FILTER (WHERE error IS NULL), 0) AS last_ok FROM {_RESULTS} GROUP BY job_id),
      known AS (SELECT CAST(c_custkey AS VARCHAR) AS job_id,
          CASE WHEN c_custkey % 11 = 5 THEN 'Invalid command: shred'
            WHEN c_custkey % 7 = 3 THEN 'Invalid format: gif. Valid formats are: text, pdf, html, docx, xlsx, pptx' END AS bad_job
        FROM customer),
      judged AS (SELECT job_id, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, last_ok,
          coalesce(bad_job, CASE WHEN n IS NULL THEN 'No files match the filtering criteria' END) AS why
        FROM known LEFT JOIN counts USING (job_id))
      SELECT job_id, CASE WHEN why IS NOT NULL THEN 'failed' WHEN bad = 0 THEN 'completed' ELSE 'completed_with_errors' END AS status,
        CASE WHEN why IS NOT NULL THEN 0::DOUBLE WHEN bad = 0 THEN 100::DOUBLE ELSE 100::DOUBLE * last_ok / n END AS progress,
        n AS n_files, bad AS n_errors, 'Job failed: ' || why AS failure FROM judged""",
    "job_errors": f"SELECT job_id, pos, message FROM {_ERRORS}",
    "error_details": f"""SELECT job_id, pos // 1024 AS part_no, 0::BIGINT AS cut_no, string_agg(message, chr(10) ORDER BY pos) AS message
      FROM {_ERRORS} GROUP BY ALL""",
    "preview": """SELECT source AS job_id, first.file AS file, first.preview AS preview
      FROM (SELECT source, arg_min({'file': 'doc' || doc_id || '.text', 'preview': substr(text, 1, 1000)}, doc_id) AS first
        FROM documents WHERE doc_id % 4 <> 1 GROUP BY source)""",
    "repo_urls": f"""SELECT page_id, {_REPO} IS NOT NULL AS valid,
        CASE WHEN {_REPO} LIKE '%.git' THEN {_REPO} ELSE {_REPO} || '.git' END AS base,
        CASE WHEN deep THEN below[2] END AS branch, NULL::VARCHAR AS no_subdir,
        CASE WHEN deep AND len(below) > 2 THEN array_to_string(below[3:], '/') END AS subdir,
        replace(regexp_extract(CASE WHEN {_REPO} LIKE '%.git' THEN {_REPO} ELSE {_REPO} || '.git' END, '[^/]*$'), '.git', '') AS name
      FROM (SELECT *, below[2] <> '' AND NOT (len(below) = 3 AND below[3] = '') AS deep FROM (SELECT *,
          parts[nullif(list_position(parts, 'tree'), 0):] AS below
        FROM (SELECT *, string_split(substr(url, length({_REPO}) + 1), '/') AS parts FROM {_REPO_URLS})))""",
    "mask_secret": """SELECT c_custkey, CASE WHEN s = '' THEN '' WHEN length(s) > 6 THEN left(s, 3) || '...' || right(s, 3)
        ELSE 'REDACTED' END AS masked
      FROM (SELECT c_custkey, left(c_name, c_custkey % 12) AS s FROM customer)""",
    "stream_ingest": f"""SELECT path, length, decision, CASE WHEN kept THEN length(text) END AS chars,
        CASE WHEN kept THEN {_lines('text')} END AS lines, CASE WHEN kept THEN {_tokens('text')} END AS tokens
      FROM (SELECT path, length, decision, decision IN ('kept', 'override') AS kept, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text
        FROM (SELECT *, {_DECISION} AS decision FROM (SELECT *, {_KIND} AS kind FROM {CORPUS_SQL}
          WHERE NOT regexp_matches(path, '(^|/)\\.'))))""",
    "stream_current": """WITH j AS (SELECT user_id, count(*) AS n_files, count(error) AS n_errors,
        coalesce(max(event_id) FILTER (WHERE error IS NULL), 0) AS last_ok, max(ts) AS last_ts
        FROM (SELECT *, CASE WHEN event_type = 'error' THEN props END AS error FROM events) GROUP BY user_id)
      SELECT user_id::VARCHAR AS job_id, n_files, n_errors, last_ok, CASE WHEN NOT coalesce(n_files >= c_custkey % 200, false)
          AND last_ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY THEN 'processing' WHEN n_errors = 0 THEN 'completed'
          ELSE 'completed_with_errors' END AS status
      FROM j LEFT JOIN customer ON c_custkey = user_id""",
    "stream_verdicts": f"""SELECT job_id, n_files, n_rejected, CASE WHEN complete THEN error END AS error, complete
      FROM (SELECT job_id, count(*) AS n_files, count(reject_reason) AS n_rejected,
        arg_min(reject_reason, pos) FILTER (WHERE reject_reason IS NOT NULL) AS error FROM {_REJECTED} GROUP BY job_id)
      JOIN (SELECT source AS job_id, {_CRC32} % 3 <> 0 AS complete FROM (SELECT DISTINCT source FROM documents)) USING (job_id)""",
    "stream_status": """SELECT CAST(user_id AS VARCHAR) AS job_id, count(*) AS n_files, count(error) AS n_errors,
        coalesce(max(event_id) FILTER (WHERE error IS NULL), 0) AS last_ok,
        CASE WHEN count(error) = 0 THEN 'completed' ELSE 'completed_with_errors' END AS status
      FROM (SELECT *, CASE WHEN event_type = 'error' THEN props END AS error FROM events) GROUP BY user_id""",
}

_EXT = "['.txt', '.PDF', '.mht', '.zip'][doc_id % 4 + 1]"
_MHTML = """CASE WHEN contains(d.text, 'MIME-Version: 1.0') AND contains(d.text, 'Content-Type: multipart/related')
  THEN 'MHTML conversion is no longer supported' ELSE 'Invalid MIME structure' END"""
_EMPTY = "CASE WHEN coalesce(d.text, '') = '' THEN 'Output file is empty' END"
_NOTHING = "CASE WHEN t.text IS NULL THEN 'No content found in the document' END"
# Whole conversions put 1,024 consecutive pages, slides or rows into a part.
_PAGED = f"""SELECT doc_id, page_no // 1024 AS part_no, string_agg({_strip('text')}, chr(10) ORDER BY page_no) AS text
  FROM {_PAGE_TEXTS} WHERE {_strip('text')} <> '' GROUP BY ALL"""
_DECKS = f"""SELECT conv_id, greatest(slide_no, 0) // 1024 AS part_no, string_agg(text, chr(10) ORDER BY slide_no, line_no, text) AS text
  FROM {_SLIDE_LINES} GROUP BY ALL"""


def _part(text: str, part: str = "0") -> str:
    return f"CASE WHEN {text} IS NOT NULL THEN {part} END::BIGINT AS part_no, {text} AS text"


_READ = "regexp_replace(d.text, '\\r\\n?', chr(10), 'g')"
SQL["convert_text"] = f"""
  SELECT path, output, {_part('text', 'part_no')}, error FROM (SELECT 'd' || doc_id || {_EXT} AS path,
    'd' || doc_id || CASE doc_id % 4 WHEN 1 THEN '.pdf.text' ELSE '.text' END AS output,
    CASE doc_id % 4 WHEN 1 THEN t.part_no ELSE 0 END AS part_no,
    CASE doc_id % 4 WHEN 1 THEN t.text WHEN 2 THEN NULL ELSE nullif({_READ}, '') END AS text,
    CASE doc_id % 4 WHEN 1 THEN {_NOTHING} WHEN 2 THEN {_MHTML} ELSE {_EMPTY} END AS error
  FROM documents d LEFT JOIN (SELECT * FROM ({_PAGED}) WHERE doc_id % 4 = 1) t USING (doc_id))
  UNION ALL SELECT path, output, {_part('text')}, error FROM (SELECT 'p' || page_id || '.html' AS path, 'p' || page_id || '.text' AS output,
    CASE WHEN {_strip('html')} <> '' THEN text END AS text,
    CASE WHEN coalesce({_strip('html')}, '') = '' THEN 'HTML file is empty' END AS error
  FROM pages JOIN ({SQL['html_text']}) USING (page_id))
  UNION ALL SELECT 'c' || conv_id || '.pptx', 'c' || conv_id || '.text', part_no, text, NULL FROM ({_DECKS})
  UNION ALL SELECT 'o' || c_custkey || '.xlsx', 'o' || c_custkey || '.text', part_no, text, {_NOTHING}
  FROM customer LEFT JOIN ({SQL['sheet_text']}) t ON c_custkey = o_custkey"""
SQL["convert_csv"] = f"""
  SELECT path, output, {_part('text')}, error FROM (SELECT 'd' || doc_id || {_EXT} AS path, 'd' || doc_id || '.csv' AS output,
    CASE doc_id % 4 WHEN 0 THEN nullif({_READ}, '') END AS text,
    CASE doc_id % 4 WHEN 0 THEN {_EMPTY} WHEN 2 THEN {_MHTML} ELSE 'No sheet to convert to CSV' END AS error
  FROM documents d)
  UNION ALL SELECT 'p' || page_id || '.html', 'p' || page_id || '.csv', NULL, NULL,
    'Unsupported output format for HTML documents: csv' FROM pages
  UNION ALL SELECT DISTINCT 'c' || conv_id || '.pptx', 'c' || conv_id || '.csv', NULL, NULL,
    'Unsupported output format for PowerPoint documents: csv' FROM conversations
  UNION ALL SELECT 'o' || c_custkey || '.xlsx',
    coalesce('o' || c_custkey || substr(file, length('book.' || c_custkey) + 1), 'o' || c_custkey || '.csv'), part_no, text, {_NOTHING}
  FROM customer LEFT JOIN (SELECT o_custkey, file, row_no // 1024 AS part_no, string_agg(text, chr(10) ORDER BY row_no) AS text
    FROM ({SQL['sheet_csv']}) GROUP BY ALL) t ON c_custkey = o_custkey"""
_HELD = "(n = 4 OR n = 5 OR n = 7 OR n = 8 OR n = 9)"
_OUT = "'No valid pages in range: 4-5, 9, 7-8 (document has ' || last || ' pages)'"
SQL["convert_pages"] = f"""
  WITH page AS (SELECT doc_id, page_no AS n, {_strip('text')} AS text FROM {_PAGE_TEXTS} WHERE doc_id % 4 = 1),
  slide AS (SELECT conv_id, slide_no AS n, line_no, text FROM {_SLIDE_LINES})
  SELECT 'd' || doc_id || '.PDF' AS path, 'd' || doc_id || '.pdf.text' AS output, part_no, t.text,
    CASE WHEN t.text IS NULL THEN CASE WHEN last < 4 THEN {_OUT} ELSE 'No content found in the document' END END AS error
  FROM documents d LEFT JOIN (SELECT doc_id, max(n) AS last FROM page GROUP BY ALL) l USING (doc_id)
    LEFT JOIN (SELECT doc_id, n // 1024 AS part_no,
      string_agg(chr(10) || '=== Page ' || n || ' ===' || chr(10) || chr(10) || text, chr(10) ORDER BY n) AS text
      FROM page WHERE {_HELD} AND text <> '' GROUP BY ALL) t USING (doc_id) WHERE doc_id % 4 = 1
  UNION ALL SELECT 'c' || conv_id || '.pptx', 'c' || conv_id || '.text', part_no, text, CASE WHEN text IS NULL THEN
    CASE WHEN last < 4 THEN {_OUT} ELSE 'No content found in the document' END END
  FROM (SELECT conv_id, max(n) AS last FROM slide GROUP BY ALL) LEFT JOIN (SELECT conv_id, n // 1024 AS part_no,
    string_agg(text, chr(10) ORDER BY n, line_no, text) AS text FROM slide WHERE {_HELD} GROUP BY ALL) USING (conv_id)"""
SQL["sheet_cells_text"] = SQL["sheet_text"]
for _name in ("convert_text", "convert_csv", "convert_pages"):  # no output here is long enough to be cut
    SQL[_name] = f"SELECT *, CASE WHEN text IS NOT NULL THEN 0 END::BIGINT AS cut_no FROM ({SQL[_name]})"
