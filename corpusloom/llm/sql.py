"""The same results in SQL (DuckDB), where SQL can express the operator."""

from __future__ import annotations

from .repetition import BASE_PERCENT, BASE_WINDOW, LINE_LIMIT, MIN_WORDS, WINDOW_LIMITS


def _repetition() -> str:
    covered, joins = [], []
    sizes = list(dict.fromkeys((BASE_WINDOW, *WINDOW_LIMITS)))
    ctes = []
    for n in sizes:
        ctes.append(
            f"""w{n} AS (SELECT row_no, pos, list_aggregate(list_slice(all_words, pos, pos + {n - 1}), 'string_agg', ' ') AS w
  FROM word WHERE pos + {n - 1} <= n_words),
t{n} AS (SELECT row_no, pos FROM (SELECT row_no, pos, count(*) OVER (PARTITION BY row_no, w) AS c FROM w{n}) WHERE c > 1),
c{n} AS (SELECT row_no, count(*) AS covered_words, sum(length(word)) AS covered_chars FROM word
  SEMI JOIN (SELECT DISTINCT row_no, unnest(range(pos, pos + {n})) AS pos FROM t{n}) USING (row_no, pos) GROUP BY row_no)"""
        )
        covered.append(f"coalesce(c{n}.covered_chars, 0) AS k{n}")
        joins.append(f"LEFT JOIN c{n} ON c{n}.row_no = b.row_no")
    over = " OR ".join(f"100 * k{n} > {limit} * word_chars" for n, limit in WINDOW_LIMITS.items())
    return f"""
WITH doc AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT row_no, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS all_words FROM doc),
base AS (SELECT *, len(all_words) AS n_words,
  coalesce(list_sum(list_transform(all_words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM split),
word AS (SELECT row_no, n_words, all_words, unnest(all_words) AS word, unnest(range(1, n_words + 1)) AS pos FROM base),
line AS (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM doc),
full_line AS (SELECT row_no, line, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars FROM line
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
same AS (SELECT row_no, line, any_value(chars) AS chars, count(*) AS c FROM full_line GROUP BY row_no, line),
lines AS (SELECT row_no, sum(c - 1) AS n_dup_lines, sum(c * chars) FILTER (c > 1) AS dup_line_chars FROM same GROUP BY row_no),
{", ".join(ctes)},
joined AS (SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(c{BASE_WINDOW}.covered_words, 0)::BIGINT AS n_repeat_words, coalesce(l.dup_line_chars, 0)::BIGINT AS dup_line_chars,
  {", ".join(covered)}
  FROM base b LEFT JOIN lines l ON l.row_no = b.row_no {" ".join(joins)}),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed,
  100 * dup_line_chars > {LINE_LIMIT} * word_chars OR {over} AS repetitive FROM joined)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars,
  [{", ".join(f"k{n}::BIGINT" for n in WINDOW_LIMITS)}] AS covered_chars, base_failed, NOT base_failed AND NOT repetitive AS kept
FROM judged"""


_ESCAPED = r"regexp_replace({0}, '<(\\*)\|', '<\1\\|', 'g')"

CHAT = rf"""
WITH row_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
named AS (SELECT conv_id, turn, text, CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant'
  WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE role END AS role FROM row_),
shown AS (SELECT *, {_ESCAPED.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")} AS shown_role,
  {_ESCAPED.format("text")} AS shown_text FROM named)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(shown_role) + 1 + length(shown_text) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id"""

NEARDUP = r"""
WITH RECURSIVE doc AS (SELECT row_number() OVER () AS row_no, doc_id, list_filter(regexp_split_to_array(translate(
  coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
made AS (SELECT row_no, doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) END AS shingles FROM doc),
sized AS (SELECT row_no, doc_id, shingles, len(shingles) AS n FROM made),
item AS (SELECT row_no, n, unnest(shingles) AS shingle FROM sized),
pair AS (SELECT x.row_no AS a, y.row_no AS b FROM item x JOIN item y ON x.shingle = y.shingle AND x.row_no < y.row_no
  AND 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n) GROUP BY x.row_no, y.row_no, x.n, y.n
  HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
edge AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT row_no AS a, row_no AS b FROM sized UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
best AS (SELECT r.a AS row_no, min(s.doc_id) AS component_id FROM reach r JOIN sized s ON s.row_no = r.b GROUP BY r.a)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept FROM sized JOIN best USING (row_no)"""

BM25 = r"""
WITH doc AS (SELECT row_number() OVER () AS row_no, doc_id, list_filter(regexp_split_to_array(translate(
  coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
stats AS (SELECT count(*) AS rows_, sum(len(words)) / count(*) AS average FROM doc),
word AS (SELECT row_no, doc_id, len(words) AS length_, unnest(words) AS term FROM doc),
posting AS (SELECT row_no, doc_id, length_, term, count(*) AS tf FROM word GROUP BY ALL),
found AS (SELECT term, count(*) AS df FROM posting GROUP BY term),
weight AS (SELECT p.row_no, p.doc_id, p.term, round(1e6 * ln(1 + (rows_ - df + 0.5) / (df + 0.5)) * (tf * 2.2)
  / (tf + 1.2 * (1 - 0.75 + 0.75 * length_ / average)))::BIGINT AS impact FROM posting p JOIN found USING (term), stats),
query AS (SELECT min(row_no) AS row_no FROM (SELECT row_number() OVER () AS row_no, doc_id, text FROM documents) WHERE doc_id % 100 = 0 GROUP BY doc_id, text),
total AS (SELECT q.row_no AS query, q.doc_id AS query_id, w.row_no, w.doc_id, sum(q.tf * w.impact)::BIGINT AS total
  FROM (SELECT row_no, doc_id, term, tf FROM posting SEMI JOIN query USING (row_no)) q JOIN weight w USING (term)
  GROUP BY q.row_no, q.doc_id, w.row_no, w.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY total DESC, doc_id NULLS FIRST)::INTEGER AS rank FROM total)
SELECT query_id, rank, doc_id, total / 1e6 AS score FROM ranked WHERE rank <= 10"""

DIVERGENCE = r"""
WITH doc AS (SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(
  coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
word AS (SELECT row_no, lang, source, unnest(words) AS term FROM doc),
kept AS (SELECT lang, term FROM word GROUP BY lang, term HAVING count(DISTINCT row_no) >= 10),
size_ AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM doc),
found AS (SELECT lang, source, term, count(*) AS c FROM word SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cell AS (SELECT g.lang, g.source, k.term, coalesce(f.c, 0) AS c FROM grp g JOIN kept k ON k.lang = g.lang
  LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
total AS (SELECT lang, source, sum(c) AS n FROM cell GROUP BY ALL),
own AS (SELECT lang, source, term, c, (1 + (1000000000::HUGEINT * (c + 2)) // (n + 2 * v)::HUGEINT)::BIGINT AS p
  FROM cell JOIN total USING (lang, source) JOIN size_ USING (lang)),
all_ AS (SELECT lang, term, sum(c) AS c FROM cell GROUP BY ALL),
all_total AS (SELECT lang, sum(c) AS n FROM all_ GROUP BY lang),
whole AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (c + 2)::HUGEINT) // (n + 2 * v)::HUGEINT)::BIGINT AS q
  FROM all_ JOIN all_total USING (lang) JOIN size_ USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM grp a JOIN grp b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN own x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN own y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY a.lang, a.source, b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM own JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM ranked
QUALIFY part = 'pair' OR rank <= 10"""


def _climb(tree: str, levels: int) -> str:
    """Levels of a tree of 16 over ``<tree>0 (tree, i, node)``: nodes, then the siblings around each; a lone node goes up unchanged."""
    made = []
    for h in range(levels):
        made.append(
            f"""{tree}n{h} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {tree}{h}),
{tree}s{h} AS (SELECT tree, i, c, coalesce(string_agg(node, '') OVER w1, '') AS before, coalesce(string_agg(node, '') OVER w2, '') AS after FROM {tree}n{h}
  WINDOW w1 AS (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  w2 AS (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
{tree}{h + 1} AS (SELECT tree, i // 16 AS i, CASE WHEN any_value(c) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY i)) END AS node
  FROM {tree}n{h} GROUP BY tree, i // 16)"""
        )
    return ",\n".join(made)


def _manifest(levels: int = 5) -> str:
    """Five levels hold a million rows of a source, and as many sources."""
    shown = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
    fields = [shown.format(x) for x in ("doc_id", "source", "lang", "n_chars")]
    leaf = "sha256(" + " || ".join([*fields, shown.format("{0}")]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 by bits: a byte comes in, then eight shifts
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"
    steps, joins, fold, proof = [], [], "forged", []
    climb = [(f"s{h}", f"ss{h}", f"r.tree = s{h}.tree AND r.i // {16**h} = s{h}.i") for h in range(levels)]
    climb += [(f"t{h}", f"ts{h}", f"r.tree // {16**h} = t{h}.i") for h in range(levels)]
    for number, (name, table, on) in enumerate(climb):
        joins.append(f"JOIN {table} AS {name} ON {on}")
        proof.append(f"{name}.before || {name}.after")
        steps.append(f"CASE WHEN {name}.c = 1 THEN {fold} ELSE sha256({name}.before || {fold} || {name}.after) END AS f{number}")
        fold = f"f{number}"
    return f"""
WITH doc AS (SELECT row_number() OVER () AS row_no, * FROM documents),
leaf AS (SELECT row_no, doc_id, source, {leaf.format("text")} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf.format(lower)} END AS forged FROM doc),
row_ AS (SELECT doc_id, leaf, coalesce(forged, leaf) AS forged, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row_no) - 1 AS i FROM leaf),
s0 AS (SELECT tree, i, leaf AS node FROM row_),
{_climb("s", levels)},
t0 AS (SELECT 0 AS tree, tree AS i, node FROM s{levels}),
{_climb("t", levels)}
SELECT doc_id, leaf, s{levels}.node AS subroot, t{levels}.node AS root, sha256(proof) AS proof_sha256, {fold} AS folded_root,
  {fold} = t{levels}.node AS verified
FROM (SELECT r.tree AS tree_, doc_id, leaf, {" || ".join(proof)} AS proof, forged, {", ".join(steps)} FROM row_ r {" ".join(joins)}) x
JOIN s{levels} ON s{levels}.tree = x.tree_, t{levels}"""


SQL = {
    "op2_repetition": _repetition(),
    "op8_neardup": NEARDUP,
    "op9_chat": CHAT,
    "op10_bm25": BM25,
    "op12_divergence": DIVERGENCE,
    "op13_manifest": _manifest(),
}
