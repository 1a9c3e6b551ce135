"""The registered queries once more, as SQL that an independent engine can run."""

from __future__ import annotations

from quirelake.plans import corpus

NL = "chr(10)"


def values(rows: list, names: str) -> str:
    one = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names}))"


PROSE = "SELECT source || '/doc_' || doc_id || '.md' AS path, text, 'manuscript' AS document_type FROM documents"
TRANSCRIPTS = f"""SELECT 'transcript/conv_' || conv_id || '.md' AS path, '# Conversation ' || conv_id || {NL} || {NL} ||
  string_agg(CASE WHEN turn % 3 = 2 THEN '---' || {NL} || {NL} ELSE '' END || role || ': ' || text, {NL} || {NL} ORDER BY turn) || {NL} AS text, 'note' AS document_type
  FROM conversations GROUP BY conv_id"""
REFERENCES = f"""SELECT 'reference/' || n_name || '.md' AS path, '## ' || n_name || {NL} || {NL} || '- Region: ' || r_name || {NL} || ls || {NL} AS text, 'reference' AS document_type
  FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (SELECT c_nationkey, string_agg('Balance holders - ' || c_mktsegment, {NL} ORDER BY c_mktsegment) AS ls
  FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) GROUP BY c_nationkey) ON c_nationkey = n_nationkey"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def pick(values_: list[str], n: str) -> str:
    return f"[{', '.join(map(quoted, values_))}][{n}]"


_N = f"s_suppkey % {len(corpus.SHAPES)} + 1"
SHAPES = f"""SELECT {pick([d for d, _, _ in corpus.SHAPES], _N)} || s_suppkey || '.md' AS path, replace({pick([chr(10).join(x) + chr(10) for _, _, x in corpus.SHAPES], _N)}, '@', s_name) AS text, {pick([k for _, k, _ in corpus.SHAPES], _N)} AS document_type FROM supplier"""
TYPED = f"SELECT * FROM ({TRANSCRIPTS}) UNION ALL SELECT * FROM ({REFERENCES}) UNION ALL SELECT * FROM ({SHAPES})"
TREE = f"""SELECT '/home/' || source AS root_path, {pick(["chapters/part_", "chapters/old/part_", "lore/a-b_", "lore/a/b_", "notes/n_", "notes/.cache/n_", "_drafts/d_", "top_", "img/p_"], "doc_id % 9 + 1")} || doc_id || {pick([".md", ".MD", ".md", ".markdown", ".txt", ".md", ".mdown", ".txt", ".png"], "doc_id % 9 + 1")} AS path, text FROM documents"""
CONFIG = f"""roots AS (SELECT DISTINCT '/home/' || source AS root_path, CAST(regexp_extract(source, '[0-9]+$') AS INT) AS num FROM documents),
config_drafts AS (SELECT root_path, seq, path, role, enabled FROM roots, {values(corpus.CONFIG, 'seq, path, role, enabled')} WHERE num % 10 <> 7
  UNION ALL SELECT root_path, 9, path, role, TRUE FROM roots JOIN {values(corpus.WRONG, 'n, path, role')} ON num % 10 = n)"""
OPENED = r"""checked AS (SELECT root_path, CASE num % 10 WHEN 4 THEN 'empty_directory_path' WHEN 5 THEN 'duplicate_directory_path' WHEN 6 THEN 'unsafe_directory_path' WHEN 8 THEN 'invalid_primary_manuscript_count' END AS error_code FROM roots WHERE num % 10 <> 7),
saved AS (SELECT root_path, CASE path WHEN './chapters/' THEN 'chapters' ELSE path END AS path, role, enabled, CAST(NULL AS VARCHAR) AS error_code FROM config_drafts JOIN checked c USING (root_path) WHERE c.error_code IS NULL AND role IS NOT NULL
  UNION ALL SELECT '/home/stale', 'old', 'lore_master', TRUE, 'invalid_stored_directory_role'),
told AS (SELECT root_path, CASE WHEN bool_or(s.path IS NULL) THEN 'not_configured' ELSE max(s.error_code) END AS error_code FROM (SELECT root_path FROM roots UNION ALL SELECT '/home/stale' UNION ALL SELECT '/home/none') LEFT JOIN saved s USING (root_path) GROUP BY root_path),
held AS (SELECT t.root_path, t.path, arg_max(role, len(string_split(s.path, '/'))) AS role, bool_or(role <> 'ignore' AND NOT regexp_matches(substr(t.path, length(s.path) + 2), '(^|/)\.[^/]+/')) AS seen
  FROM tree t JOIN saved s ON s.root_path = t.root_path AND enabled AND starts_with(t.path, s.path || '/') GROUP BY t.root_path, t.path),
shown AS (SELECT root_path, path, document_type, CAST(NULL AS VARCHAR) AS error_code FROM (SELECT *, CASE WHEN role = 'primary_manuscript' AND EXT IN ('md', 'markdown', 'mdown') THEN 'manuscript' WHEN role = 'reference' AND EXT IN ('md', 'markdown', 'mdown', 'txt') THEN 'reference'
  WHEN role = 'notes' AND EXT IN ('md', 'markdown', 'mdown', 'txt') THEN 'note' END AS document_type FROM held WHERE seen) WHERE document_type IS NOT NULL UNION ALL SELECT root_path, NULL, NULL, error_code FROM told WHERE error_code IS NOT NULL)"""
LOADED = """asked AS (SELECT root_path, CASE k WHEN 0 THEN '../' || path WHEN 1 THEN path || '/' WHEN 2 THEN 'not/' || path WHEN 3 THEN './' || path WHEN 4 THEN replace(path, '/', '//') WHEN 5 THEN replace(path, '/', '/./') ELSE path END AS path FROM (SELECT *, CAST(regexp_extract(path, '[0-9]+') AS BIGINT) % 8 AS k FROM tree)),
loaded AS (SELECT a.root_path, a.path, o.document_type, CASE WHEN a.path = '' OR starts_with(a.path, '/') OR split_part(a.path, '/', 1) = '.' OR list_contains(string_split(a.path, '/'), '..') THEN 'invalid_document_path' WHEN t.error_code IS NOT NULL THEN t.error_code WHEN o.path IS NULL THEN 'document_not_discovered' END AS error_code, tr.text
  FROM asked a LEFT JOIN told t ON t.root_path = a.root_path AND t.error_code IS NOT NULL LEFT JOIN shown o ON o.root_path = a.root_path AND o.path = a.path LEFT JOIN tree tr ON tr.root_path = a.root_path AND tr.path = a.path)"""


def with_ids(sql: str, *parts: str) -> str:
    """Adds the stable id of some columns to rows: two limbs of 64 bits, a step for each byte."""
    digits = " || '00' || ".join(f"hex(CAST({p} AS VARCHAR))" for p in parts)
    byte = "((instr('0123456789ABCDEF', substr(hx, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hx, 2 * i + 2, 1)) - 1)"
    low = f"(CAST(xor(lo, CAST({byte} AS UBIGINT)) AS HUGEINT) * 1099511628211)"
    top = "CAST(18446744073709551616 AS HUGEINT)"
    return f"""WITH RECURSIVE b AS MATERIALIZED (SELECT row_number() OVER () AS rn, * FROM ({sql})), k AS MATERIALIZED (SELECT rn, {digits} AS hx FROM b),
h AS (SELECT rn, 0 AS i, CAST(0 AS UBIGINT) AS hi, CAST(14695981039346656037 AS UBIGINT) AS lo FROM k
  UNION ALL SELECT rn, i + 1, CAST((CAST(hi AS HUGEINT) * 1099511628211 + {low} // {top}) % {top} AS UBIGINT), CAST({low} % {top} AS UBIGINT) FROM h JOIN k USING (rn) WHERE 2 * i < length(hx)),
ids AS (SELECT rn, lower(lpad(to_hex(arg_max(hi, i)), 16, '0') || lpad(to_hex(arg_max(lo, i)), 16, '0')) AS x FROM h GROUP BY rn)
SELECT b.* EXCLUDE (rn), x[1:8] || '-' || x[9:12] || '-' || x[13:16] || '-' || x[17:20] || '-' || x[21:32] AS id FROM b JOIN ids USING (rn)"""

CLEAN = "trim(regexp_replace({}, '[ \\n]+', ' ', 'g'), ' ')"


def parsed(docs: str, strict: bool = False) -> str:
    """Common table expressions up to marked lines."""
    split = "" if strict else """ OR (NOT coalesce(spaced, FALSE) AND regexp_matches(rtrim(above), '[.!?"'')\\]}”’…]$')
       AND (strlen(ltrim(line)) >= 20 OR len(string_split(trim(regexp_replace(line, ' +', ' ', 'g')), ' ')) >= 4) AND regexp_matches(ltrim(line), '^[\\p{Lu}\\p{N}"''(\\[{“‘—]'))"""
    return f"""corpus AS ({docs}),
split AS (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, string_split(text, {NL}) AS ls FROM corpus)),
raw AS (SELECT path, i - 1 AS line_no, ls[i] AS line FROM split WHERE NOT (i = len(ls) AND ls[i] = '')),
located AS (SELECT *, coalesce(sum(length(line) + 1) OVER b, 0) AS start_char, coalesce(sum(strlen(line) + 1) OVER b, 0) AS start_byte,
  CASE WHEN regexp_matches(trim(line), '^#+ ') THEN 'heading' WHEN regexp_matches(replace(line, ' ', ''), '^(-{{3,}}|\\*{{3,}}|_{{3,}})$') THEN 'scene' WHEN trim(line) = '' THEN 'blank' ELSE 'text' END AS kind
  FROM raw WINDOW b AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
grouped AS (SELECT *, sum(CASE WHEN kind IN ('heading', 'scene') THEN 1 ELSE 0 END) OVER d AS section, sum(CASE WHEN kind = 'scene' THEN 1 ELSE 0 END) OVER d AS scene,
  lag(kind) OVER d AS before, lag(line) OVER d AS above FROM located WINDOW d AS (PARTITION BY path ORDER BY line_no)),
opened AS (SELECT *, max(CASE WHEN kind IN ('heading', 'text') THEN 1 ELSE 0 END) OVER (PARTITION BY path, section ORDER BY line_no) AS open FROM grouped),
flagged AS (SELECT *, max(CASE WHEN kind = 'blank' AND open = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path, section ORDER BY line_no) = 1 AS spaced FROM opened),
marked AS (SELECT *, sum(CASE WHEN kind IN ('heading', 'scene') OR (kind = 'text' AND (before IS DISTINCT FROM 'text'{split})) THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) - 1 AS ordinal FROM flagged),
spans AS (SELECT path, ordinal, CASE WHEN min(kind) = 'text' THEN 'paragraph' ELSE min(kind) END AS span_type,
  CASE WHEN min(kind) = 'scene' THEN trim(min(line)) ELSE string_agg(line, {NL} ORDER BY line_no) END AS text,
  min(line_no) AS start_line, max(line_no) AS end_line, min(start_byte) AS start_byte, max(start_byte + strlen(line)) AS end_byte, min(start_char) AS start_char, max(start_char + length(line)) AS end_char
  FROM marked WHERE kind <> 'blank' GROUP BY path, ordinal)"""


def body(group: str) -> str:
    return f"""framed AS (SELECT *, min(CASE WHEN kind <> 'blank' THEN line_no END) OVER (PARTITION BY path, {group}) AS f, max(CASE WHEN kind <> 'blank' THEN line_no END) OVER (PARTITION BY path, {group}) AS l FROM marked WHERE kind <> 'scene'),
bodies AS (SELECT path, {group}, row_number() OVER (PARTITION BY path ORDER BY {group}) - 1 AS ordinal, string_agg(CASE WHEN kind = 'blank' THEN '' ELSE line END, {NL} ORDER BY line_no) AS text,
  min(CASE WHEN kind <> 'blank' THEN ordinal END) AS start_span_ordinal, max(CASE WHEN kind <> 'blank' THEN ordinal END) AS end_span_ordinal,
  min(line_no) AS start_line, max(line_no) AS end_line, min(start_byte) AS start_byte, max(start_byte + strlen(line)) AS end_byte, min(start_char) AS start_char, max(start_char + length(line)) AS end_char
  FROM framed WHERE line_no BETWEEN f AND l GROUP BY path, {group})"""


EXTENT = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("start_line", "end_line", "start_byte", "end_byte", "start_char", "end_char"))
SPAN_COLUMNS = f"path, CAST(ordinal AS BIGINT) AS ordinal, span_type, text, {CLEAN.format('text')} AS normalized_text, {EXTENT}"
SUMMARY = """list_reduce(list_prepend('', list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x NOT IN ('', '---', '***', '___')),
  lambda x: trim(regexp_replace(regexp_replace(x, '^#+', ''), ' +', ' ', 'g'))), lambda x: x <> '')),
  lambda a, x: CASE WHEN 240 - length(a) - CASE WHEN a = '' THEN 0 ELSE 1 END <= 0 THEN a ELSE a || CASE WHEN a = '' THEN '' ELSE ' ' END || left(x, 240 - length(a) - CASE WHEN a = '' THEN 0 ELSE 1 END) END)"""
EDGE = "[!-/:-@\\[-`{-~“”‘’—–…]+"
PART = "trim(regexp_replace(trim(regexp_replace(trim({}), '^[:—-]+|[:—-]+$', '', 'g')), '\\.+$', ''))"
TOKENS = "string_split(lower(trim(regexp_replace(path, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"


def has(*words: str) -> str:
    return f"list_has_any({TOKENS}, [{', '.join(repr(w) for w in words)}])"


KIND = f"""CASE WHEN document_type = 'note' THEN 'note' WHEN document_type = 'manuscript' THEN NULL WHEN {has('prose')} AND {has('guide', 'guideline')} THEN 'guide/prose' WHEN {has('style')} AND {has('guide', 'sheet')} THEN 'guide/style'
  WHEN {has('critique')} AND {has('guide', 'rubric')} THEN 'guide/critique' WHEN {has('rewrite')} AND {has('guide', 'brief')} THEN 'guide/rewrite' WHEN {has('story')} AND {has('summary', 'synopsis')} THEN 'reference/story_summary'
  WHEN {has('world')} AND {has('summary', 'overview')} THEN 'reference/world_summary' WHEN {has('character', 'characters')} AND {has('bible', 'sheet', 'sheets', 'guide', 'notes')} THEN 'reference/character_bible'
  WHEN {has('timeline', 'chronology')} THEN 'reference/timeline' WHEN {has('terminology', 'glossary', 'lexicon', 'terms')} THEN 'reference/terminology' WHEN {has('research', 'sourcebook')} THEN 'reference/research' END"""
WORDS = "CASE WHEN trim(line) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(line, ' +', ' ', 'g')), ' ')) END"
NUMBERED = "regexp_matches(line, '^([0-9]|(I|II|III|IV|V|VI|VII|VIII|IX|X)\\.)')"
LEFT, RIGHT = "split_part(line, ':', 1)", "substr(line, instr(line, ':') + 1)"
LABEL = f"""(instr(line, ':') > 0 AND len(list_filter(string_split({LEFT}, ' '), lambda x: x <> '')) BETWEEN 1 AND 4 AND regexp_matches({RIGHT}, '[\\p{{L}}\\p{{N}}]') AND NOT starts_with(ltrim({LEFT}), '#') AND length(line) <= 120)"""
DASHED = "(contains(line, ' — ') OR contains(line, ' - '))"
CAPS = "length(regexp_replace(line, '[^\\p{Lu}]', '', 'g'))"
LETTERS = "length(regexp_replace(line, '[^\\p{L}]', '', 'g'))"
HEADING = "lower(trim(regexp_replace(line, '^[#:-]+|[#:-]+$', '', 'g')))"
COUNTS = f"""counts AS (SELECT path, count(*) AS n, count(*) FILTER (regexp_matches(line, '^([-*+] |•)')) AS bullets, count(*) FILTER ({LABEL}) AS labels, count(*) FILTER ({NUMBERED}) AS numbered,
  count(*) FILTER (length(line) <= 72) AS short, count(*) FILTER (length(line) >= 100) AS long,
  count(*) FILTER (starts_with(line, '#') OR {NUMBERED} OR ({LETTERS} > 0 AND {WORDS} <= 12 AND length(line) <= 90 AND {CAPS} * 2 >= {LETTERS})) AS heading_like,
  count(*) FILTER ({DASHED} AND {WORDS} <= 12 AND length(line) <= 100) AS dashed, count(*) FILTER (instr(line, ':') > 0 AND lower(trim({LEFT})) IN ('tone', 'goal', 'purpose', 'result', 'outcome', 'stakes', 'structure', 'scope', 'summary', 'sequence')) AS planning,
  count(*) FILTER (instr(line, ':') > 0 AND regexp_matches(lower({LEFT}), 'role|background|history|trait|relationship|special|identity|profession|rank|dynamic|personality|mission|summary')) AS profile,
  count(*) FILTER ({HEADING} IN ('relationships', 'relationship', 'background', 'history', 'personality', 'professional identity', 'professional summary', 'identity', 'mission', 'dynamics')) AS profile_headings,
  count(*) FILTER ({LABEL} OR ({WORDS} <= 12 AND length(line) <= 120 AND (contains(line, ' = ') OR {DASHED}))) AS definitions
  FROM (SELECT path, trim(line) AS line FROM raw) WHERE line <> '' GROUP BY path),
spanned AS (SELECT path, count(*) FILTER (span_type = 'heading') AS headings, count(*) FILTER (span_type = 'paragraph') AS paragraphs FROM spans GROUP BY path),
feats AS (SELECT c.path, c.document_type, coalesce(n, 0) AS n, coalesce(bullets, 0) AS bullets, coalesce(labels, 0) AS labels, coalesce(numbered, 0) AS numbered, coalesce(short, 0) AS short, coalesce(long, 0) AS long, coalesce(heading_like, 0) AS heading_like,
  coalesce(dashed, 0) AS dashed, coalesce(planning, 0) AS planning, coalesce(profile, 0) AS profile, coalesce(profile_headings, 0) AS profile_headings, coalesce(definitions, 0) AS definitions, coalesce(headings, 0) AS headings, coalesce(paragraphs, 0) AS paragraphs
  FROM corpus c LEFT JOIN counts USING (path) LEFT JOIN spanned USING (path))"""
ARCHETYPE = f"""CASE WHEN document_type = 'manuscript' THEN 'manuscript'
  WHEN 2 * CAST({has('plan', 'planning', 'outline', 'arc', 'arcs', 'beat', 'beats')} AS INT) + 3 * CAST(planning >= 2 AS INT) + CAST(bullets >= 2 AS INT) + CAST(numbered >= 1 AS INT) + CAST(heading_like >= 2 AS INT) + CAST(short * 3 >= n * 2 AS INT) >= 6 THEN 'story_planning'
  WHEN document_type <> 'reference' THEN 'loose_note'
  WHEN profile >= 2 AND (labels >= 3 OR profile_headings >= 2) AND planning = 0 AND (dashed >= 1 OR {has('profile', 'profiles', 'dossier', 'character', 'crew')}) AND short * 2 >= n THEN 'dossier_profile'
  WHEN 2 * CAST({has('glossary', 'terminology', 'taxonomy', 'lexicon')} AS INT) + 2 * CAST(definitions >= 2 AS INT) + 2 * CAST(bullets >= 4 AS INT) + CAST(heading_like >= 2 AS INT) + CAST(long * 4 <= n AS INT) + CAST(short * 3 >= n * 2 AS INT)
    + CAST(profile = 0 AS INT) + CAST(profile_headings = 0 AS INT) + CAST(planning = 0 AS INT) + CAST(paragraphs <= 3 AS INT) >= 6 THEN 'taxonomy_reference'
  WHEN 2 * CAST({has('history', 'politics', 'society', 'culture', 'world')} AS INT) + 2 * CAST(headings >= 2 OR heading_like >= 2 AS INT) + 2 * CAST(paragraphs >= 4 AS INT) + 2 * CAST(long >= 2 AS INT) + 2 * CAST(bullets <= 2 AS INT) + CAST(long > bullets AS INT) + 2 * CAST(paragraphs > bullets AS INT) >= 6 THEN 'expository_world_article'
  ELSE 'loose_note' END"""
EXTENSION = "lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1))"
MENTIONS = f"""tok AS (SELECT path, ordinal, start_char, end_char, ws, unnest(range(1, len(ws) + 1)) AS ti FROM (SELECT *, string_split({CLEAN.format('text')}, ' ') AS ws FROM spans WHERE span_type IN ('heading', 'paragraph'))),
named AS (SELECT path, ordinal, start_char, end_char, ti, regexp_replace(ws[ti], '^{EDGE}|{EDGE}$', '', 'g') AS token FROM tok),
runs AS (SELECT *, regexp_matches(token, '^\\p{{Lu}}') AS is_name, sum(CASE WHEN regexp_matches(token, '^\\p{{Lu}}') THEN 0 ELSE 1 END) OVER (PARTITION BY path, ordinal ORDER BY ti) AS run FROM named),
ment AS (SELECT path, ordinal, min(start_char) AS start_char, min(end_char) AS end_char, min(ti) AS ti, regexp_replace(string_agg(token, ' ' ORDER BY ti), '^((The|A|An) )+([^ ])', '\\3') AS name FROM runs WHERE is_name GROUP BY path, ordinal, run),
cand AS (SELECT path, lower(name) AS k, arg_min(name, ordinal * 1000000 + ti) AS name, count(*) AS mentions, string_agg(DISTINCT CAST(ordinal AS VARCHAR), ',' ORDER BY CAST(ordinal AS VARCHAR)) AS anchors, list_sort(list(DISTINCT ordinal)) AS os,
  arg_min(start_char, ordinal * 1000000 + ti) AS start_char, arg_min(end_char, ordinal * 1000000 + ti) AS end_char, min(ordinal * 1000000 + ti) AS pos FROM ment WHERE name NOT IN ('The', 'A', 'An') GROUP BY path, lower(name)),
entities AS (SELECT path, name, mentions, array_to_string(os, ',') AS anchors, start_char, end_char, row_number() OVER (PARTITION BY path ORDER BY pos) - 1 AS position FROM cand WHERE mentions > 1 OR contains(name, ' '))"""
CLASSIFIED = f"""m AS {values([(p, r, e, k) for k, (p, r, e) in enumerate(corpus.MAPPINGS)], 'dir, role, enabled, seq')},
best AS (SELECT path, arg_max(role, len(string_split(dir, '/')) * 1000 + seq) AS role FROM files JOIN m ON enabled AND (path = dir OR starts_with(path, dir || '/')) GROUP BY path),
classified AS (SELECT path, CASE WHEN role = 'primary_manuscript' AND {EXTENSION} IN ('md', 'markdown', 'mdown') THEN 'manuscript' WHEN role = 'reference' AND {EXTENSION} IN ('md', 'markdown', 'mdown', 'txt') THEN 'reference'
  WHEN role = 'notes' AND {EXTENSION} IN ('md', 'markdown', 'mdown', 'txt') THEN 'note' END AS document_type FROM files LEFT JOIN best USING (path))"""
LOG = """log AS (SELECT event_id AS seq, 'user_' || user_id AS id, 'src' || (user_id % 20) || '/doc_' || user_id || '.md' AS path,
  CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'stale' WHEN 'view' THEN 'pending' ELSE 'upsert' END AS action FROM events)"""
REPLAY = LOG + """,
last AS (SELECT id, max(seq) AS saved, min(seq) AS seq, arg_max(path, seq) AS source_document_path FROM log WHERE action = 'upsert' GROUP BY id),
state AS (SELECT l.id, arg_max(action, l.seq) FILTER (action IN ('approved', 'rejected', 'pending')) AS review, bool_or(action = 'stale') AS stale FROM log l JOIN last USING (id) WHERE l.seq > saved GROUP BY l.id),
records AS (SELECT id, seq, source_document_path, saved, coalesce(review, 'pending') AS review_state, CASE WHEN stale THEN 'stale' ELSE 'current' END AS staleness_state FROM last LEFT JOIN state USING (id))"""
NORMAL = """norm AS (SELECT *, CASE WHEN trim(path) = '' THEN 'empty_directory_path' WHEN starts_with(trim(path), '/') OR list_contains(string_split(trim(path), '/'), '..') THEN 'unsafe_directory_path' END AS error_code,
  coalesce(nullif(array_to_string(list_filter(string_split(trim(path), '/'), lambda x: x NOT IN ('', '.')), '/'), ''), '.') AS clean FROM drafts)"""
DRAFTS = CONFIG + ", drafts AS (SELECT * FROM " + values([(p, k, d, r, e) for k, (p, d, r, e) in enumerate(corpus.DRAFTS)], "project, seq, path, role, enabled") + " UNION ALL SELECT * FROM config_drafts)"
SELECTIONS = "sels AS (SELECT conv_id || '/' || turn AS sel_id, 'transcript/conv_' || conv_id || '.md' AS path, turn * 137 % 900 AS sel_start, turn * 137 % 900 + turn * 53 % 150 - 3 AS sel_end FROM conversations)"
SOURCES_OF = f"base AS (SELECT source || '/' || doc_id || '/' || {pick([p for p, _ in corpus.SOURCES], f'doc_id % {len(corpus.SOURCES)} + 1')} AS path, {pick([t for _, t in corpus.SOURCES], f'doc_id % {len(corpus.SOURCES)} + 1')} AS document_type FROM documents)"
FILES = f"files AS (SELECT * FROM {values([(p,) for p in corpus.FILES], 'path')} UNION ALL SELECT path FROM ({TREE}))"
UPDATES = "upd AS (SELECT 'user_' || (c_custkey % 170) AS id, arg_max(['approved', 'rejected', 'pending'][c_nationkey % 3 + 1], c_custkey) AS st FROM customer GROUP BY 1)"
REQUESTS = "reqs AS (SELECT c_custkey AS request_id, c_custkey % 5 AS project, ['analysis', 'editing', 'ideation'][c_custkey % 3 + 1] AS mode, c_name AS selected_text FROM customer)"
CONTEXT = f"""base AS {values([(p, t, k) for k, (p, t) in enumerate(corpus.SOURCES)], 'path, document_type, n')},
srcs AS (SELECT g AS project, path, {KIND} AS kind, ['pinned', 'retrieved', 'explicit_only'][(n + g) % 3 + 1] AS activation_policy, ['user_authored', 'approved', 'pending_review', 'stale'][(n * 3 + g) % 4 + 1] AS review_state FROM base, (SELECT unnest(range(0, 5)) AS g)),
named AS (SELECT DISTINCT request_id, path FROM reqs, base WHERE (request_id + n) % 7 = 0)"""
ALLOWED = """(starts_with(kind, 'guide/') OR (mode = 'analysis' AND starts_with(kind, 'reference/')) OR kind IN ('reference/story_summary', 'reference/world_summary', 'reference/character_bible')
  OR (mode = 'editing' AND kind IN ('reference/timeline', 'reference/terminology')))"""


def oracle_sql() -> dict[str, str]:
    spans = parsed(TRANSCRIPTS)
    typed = parsed(TYPED)
    out = {
        "flagship_span_counts": f"WITH {parsed(PROSE)} SELECT lang, span_type, count(*) AS n_spans, CAST(sum(end_char - start_char) AS BIGINT) AS n_chars FROM spans JOIN (SELECT source || '/doc_' || doc_id || '.md' AS path, lang FROM documents) USING (path) GROUP BY lang, span_type",
        "line_offsets": f"WITH {parsed(PROSE)} SELECT path, CAST(line_no AS BIGINT) AS line_no, CAST(start_char AS BIGINT) AS start_char, CAST(start_byte AS BIGINT) AS start_byte, line FROM located",
        "parse_spans": f"WITH {spans} SELECT {SPAN_COLUMNS} FROM spans",
        "parse_spans_pieces": f"WITH {parsed(PROSE)} SELECT {SPAN_COLUMNS} FROM spans",
        "parse_spans_prose": f"WITH {parsed(PROSE)} SELECT {SPAN_COLUMNS} FROM spans",
        "parse_spans_strict": f"WITH {parsed(TRANSCRIPTS, True)} SELECT {SPAN_COLUMNS} FROM spans",
        "parse_sections": f"WITH {spans}, {body('section')} SELECT b.path, CAST(b.ordinal AS BIGINT) AS ordinal, b.text, {CLEAN.format('b.text')} AS normalized_text, CASE o.kind WHEN 'scene' THEN 'scene_break' WHEN 'heading' THEN 'heading' ELSE 'file_start' END AS boundary_kind, CASE o.kind WHEN 'scene' THEN trim(o.line) ELSE o.line END AS boundary_text, {EXTENT.replace('CAST(', 'CAST(b.')} FROM bodies b LEFT JOIN marked o ON o.path = b.path AND o.section = b.section AND o.kind IN ('heading', 'scene')",
        "parse_scenes": f"WITH {spans}, {body('scene')} SELECT b.path, CAST(b.ordinal AS BIGINT) AS ordinal, b.text, {CLEAN.format('b.text')} AS normalized_text, trim(o.line) AS separator, CAST(start_span_ordinal AS BIGINT) AS start_span_ordinal, CAST(end_span_ordinal AS BIGINT) AS end_span_ordinal, {EXTENT.replace('CAST(', 'CAST(b.')} FROM bodies b LEFT JOIN marked o ON o.path = b.path AND o.scene = b.scene AND o.kind = 'scene'",
        "entity_candidates": f"WITH {spans}, {MENTIONS} SELECT path, name, mentions, anchors, CAST(start_char AS BIGINT) AS start_char, CAST(end_char AS BIGINT) AS end_char, CAST(position AS BIGINT) AS position, 'pending' AS review_state, 'current' AS staleness_state FROM entities",
        "reviewable_facts": f"""WITH {parsed(TYPED.replace("'note' AS", "'reference' AS"))},
fl AS (SELECT path, ordinal, start_char, end_char, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, string_split(text, {NL}) AS ls FROM spans WHERE span_type = 'paragraph')),
bare AS (SELECT path, ordinal, start_char, end_char, i - 1 AS line_no, trim(regexp_replace(regexp_replace(regexp_replace(trim(ls[i]), '^(- )+', ''), '^(\\* )+', ''), '^(\\+ )+', '')) AS line FROM fl),
cut AS (SELECT *, CASE WHEN instr(line, ':') > 0 THEN ':' WHEN instr(line, ' - ') > 0 THEN ' - ' WHEN instr(line, ' — ') > 0 THEN ' — ' END AS mark FROM bare),
parts AS (SELECT *, {PART.format("left(line, instr(line, mark) - 1)")} AS subject, {PART.format("substr(line, instr(line, mark) + length(mark))")} AS object FROM cut WHERE mark IS NOT NULL)
SELECT path, CAST(ordinal AS BIGINT) AS ordinal, CAST(line_no AS BIGINT) AS line_no, subject, 'is' AS predicate, object, CAST(start_char AS BIGINT) AS start_char, CAST(end_char AS BIGINT) AS end_char, 'pending' AS review_state, 'current' AS staleness_state
FROM parts WHERE regexp_matches(subject, '\\p{{L}}') AND regexp_matches(object, '\\p{{L}}')""",
        "reviewable_summaries": f"""WITH {typed}, {body('section')}, secs AS (SELECT path, ordinal, text, start_char, end_char FROM bodies),
one AS (SELECT path, 'section:' || ordinal AS scope, {SUMMARY} AS s, CAST(ordinal AS VARCHAR) AS anchors, start_char, end_char FROM secs),
many AS (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM one WHERE s <> ''),
whole AS (SELECT path, string_agg(text, {NL} || {NL} ORDER BY ordinal) AS text, string_agg(CAST(ordinal AS VARCHAR), ',' ORDER BY ordinal) AS anchors, min(start_char) AS start_char, max(end_char) AS end_char FROM secs GROUP BY path)
SELECT path, scope, s AS text, anchors, CAST(start_char AS BIGINT) AS start_char, CAST(end_char AS BIGINT) AS end_char, 'pending' AS review_state, 'current' AS staleness_state FROM
(SELECT path, 'document' AS scope, {SUMMARY} AS s, anchors, start_char, end_char FROM whole UNION ALL SELECT path, scope, s, anchors, start_char, end_char FROM many WHERE n > 1) WHERE s <> ''""",
        "line_features": f"WITH {typed}, {COUNTS} SELECT path, document_type, n, bullets, labels, numbered, short, long, heading_like, dashed, planning, profile, profile_headings, definitions, headings, paragraphs FROM feats",
        "archetypes": f"WITH {typed}, {COUNTS} SELECT path, document_type, {ARCHETYPE} AS archetype FROM feats",
        "intended_use": f"""WITH {typed}, {COUNTS}, arch AS (SELECT path, {ARCHETYPE} AS archetype FROM feats), kinds AS (SELECT unnest(['entity_profile', 'relationship', 'timeline_event', 'story_arc', 'world_rule', 'terminology', 'extractive_summary']) AS candidate_kind)
SELECT path, archetype, candidate_kind, CASE WHEN archetype = 'story_planning' THEN 'planning_only' WHEN archetype = 'loose_note' OR (archetype = 'manuscript' AND candidate_kind = 'extractive_summary') OR (archetype = 'dossier_profile' AND candidate_kind = 'story_arc') THEN 'working_context' ELSE 'canon_reference' END AS intended_use FROM arch, kinds""",
        "context_source_kind": f"WITH {SOURCES_OF} SELECT path, document_type, {KIND} AS kind FROM base",
        "project_context_sources": f"WITH {SOURCES_OF} SELECT path, {KIND} AS kind, 'explicit_only' AS activation_policy, 'user_authored' AS review_state FROM base WHERE {KIND} IS NOT NULL",
        "mapping_classify": f"WITH files AS (SELECT DISTINCT path FROM ({PROSE})), {CLASSIFIED} SELECT path, document_type FROM classified",
        "discover_documents": f"WITH files AS (SELECT DISTINCT path FROM ({PROSE})), {CLASSIFIED} SELECT path, document_type FROM classified WHERE document_type IS NOT NULL",
        "file_filters": f"WITH {FILES} SELECT path, {EXTENSION} IN ('md', 'markdown', 'mdown', 'txt') AS supported, {EXTENSION} IN ('md', 'markdown', 'mdown') AS manuscript, regexp_matches(path, '(^|/)\\.[^/]+/') AS hidden FROM files",
        "import_candidates": f"""WITH {FILES}, own AS (SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS dir, {EXTENSION} IN ('md', 'markdown', 'mdown', 'txt') AS t FROM files WHERE NOT regexp_matches(path, '(^|/)\\.[^/]+/')),
g AS (SELECT dir AS path, bool_or(t) AS contains_supported_text_files, CASE dir WHEN 'chapters' THEN 'primary_manuscript' WHEN 'world_context' THEN 'reference' WHEN 'notes' THEN 'notes' END AS suggested_role FROM own GROUP BY dir UNION ALL SELECT 'void', FALSE, NULL)
SELECT path, contains_supported_text_files, suggested_role, array_to_string(list_filter([CASE WHEN suggested_role IS NOT NULL THEN 'directory_named_' || path END, CASE WHEN contains_supported_text_files THEN 'contains_supported_text_files' END], lambda x: x IS NOT NULL), ',') AS suggestion_reasons FROM g WHERE path <> '.' OR contains_supported_text_files""",
        "mapping_normalize": f"WITH {DRAFTS}, {NORMAL} SELECT project, CAST(seq AS BIGINT) AS seq, path, error_code, CASE WHEN error_code IS NULL THEN clean END AS normalized FROM norm",
        "mapping_validate": f"""WITH {DRAFTS}, {NORMAL}, again AS (SELECT *, coalesce(error_code, CASE WHEN row_number() OVER (PARTITION BY project, CASE WHEN error_code IS NULL THEN clean END ORDER BY seq) > 1 THEN 'duplicate_directory_path' END) AS err FROM norm)
SELECT project, coalesce(arg_min(err, seq) FILTER (err IS NOT NULL), CASE WHEN count(*) FILTER (enabled AND role = 'primary_manuscript') <> 1 THEN 'invalid_primary_manuscript_count' END) AS error_code FROM again GROUP BY project""",
        "persisted_mappings": f"WITH {DRAFTS} SELECT path, role, enabled FROM drafts WHERE role IS NOT NULL",
        "memory_upsert": f"WITH {LOG} SELECT id, min(seq) AS seq, arg_max(path, seq) AS source_document_path, arg_max(action, seq) AS last_action FROM log GROUP BY id",
        "memory_replay": f"WITH {REPLAY} SELECT id, seq, source_document_path, saved, review_state, staleness_state, review_state = 'approved' AND staleness_state = 'current' AS reusable FROM records",
        "memory_mark_stale": f"WITH {REPLAY}, gone AS (SELECT DISTINCT source || '/doc_' || doc_id || '.md' AS path FROM documents WHERE lang <> 'en') SELECT id, seq, source_document_path, saved, review_state, CASE WHEN source_document_path IN (SELECT path FROM gone) THEN 'stale' ELSE staleness_state END AS staleness_state FROM records",
        "memory_review": f"WITH {REPLAY}, {UPDATES} SELECT coalesce(r.id, u.id) AS id, CASE WHEN r.id IS NOT NULL THEN coalesce(st, review_state) END AS review_state, staleness_state, CASE WHEN r.id IS NULL THEN 'memory_record_not_found' END AS error_code FROM records r FULL JOIN upd u ON u.id = r.id",
        "selection_overlap": f"""WITH {spans}, {SELECTIONS} SELECT sel_id, s.path, sel_start, sel_end, coalesce(string_agg(CAST(ordinal AS VARCHAR), ',' ORDER BY ordinal), '') AS ordinals, CAST(min(ordinal) AS BIGINT) AS "primary" FROM sels s LEFT JOIN spans p ON p.path = s.path AND sel_end > sel_start AND start_char < sel_end AND end_char > sel_start GROUP BY sel_id, s.path, sel_start, sel_end""",
        "selection_validate": """SELECT p_partkey AS sel_id, CASE WHEN p_partkey % 11 = 0 THEN 'missing_document_path' WHEN p_partkey % 7 = 0 THEN 'empty_selection' WHEN p_partkey % 5 = 0 THEN 'invalid_range' WHEN p_partkey % 3 = 0 THEN 'invalid_span_ordinal' END AS error_code,
  CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 THEN CAST(p_size AS VARCHAR) || ',' || CAST(p_size AS VARCHAR) END AS span_ordinals FROM part""",
        "context_selection": f"""WITH {REQUESTS}, {CONTEXT} SELECT r.request_id, r.mode, s.path, s.kind, CASE WHEN x.path IS NOT NULL THEN review_state IN ('user_authored', 'approved') ELSE activation_policy IN ('pinned', 'retrieved') AND review_state IN ('user_authored', 'approved') AND coalesce({ALLOWED}, FALSE) END AS included
FROM reqs r JOIN srcs s USING (project) LEFT JOIN named x ON x.request_id = r.request_id AND x.path = s.path""",
        "task_results": f"""WITH {REQUESTS} SELECT request_id, mode, CAST(1 AS SMALLINT) AS schema_version, CASE mode WHEN 'analysis' THEN 'analysis_comment' WHEN 'editing' THEN 'draft_change' ELSE 'idea_card' END AS output_type, CASE mode WHEN 'ideation' THEN 'Deterministic idea' END AS title,
  CASE mode WHEN 'analysis' THEN 'Deterministic analysis placeholder for the selected text.' WHEN 'editing' THEN selected_text || ' [deterministic edit]' ELSE 'Placeholder idea tied to the current task target.' END AS output_text FROM reqs""",
        "task_contract": f"""WITH {REQUESTS}, o AS (SELECT o_custkey AS request_id, o_orderkey AS pos, CASE WHEN o_orderkey % 2 = 0 THEN 'draft_change' ELSE 'analysis_comment' END AS output_type, o_orderkey % 97 AS s FROM orders),
e AS (SELECT request_id, pos, CASE WHEN output_type = 'draft_change' AND mode <> 'editing' THEN 'draft_changes_not_allowed' WHEN output_type = 'draft_change' AND NOT (s >= 10 AND s + 5 <= 90) THEN 'draft_change_outside_target' END AS err FROM reqs LEFT JOIN o USING (request_id))
SELECT request_id, arg_min(err, pos) FILTER (err IS NOT NULL) AS error_code FROM e GROUP BY request_id""",
        "latest_pane_selection": "SELECT event_type AS pane_id, max(event_id) AS seq, arg_max(user_id, event_id) AS start_char, CAST(arg_max(user_id, event_id) AS VARCHAR) AS spans FROM events GROUP BY event_type",
    }
    for name, parts in (("entity_candidates", ("path", "name")), ("reviewable_facts", ("path", "ordinal", "subject", "object")), ("reviewable_summaries", ("path", "scope", "text"))):
        if name != "reviewable_facts":
            out[f"{name}_prose"] = with_ids(out[name].replace(spans if name == "entity_candidates" else typed, parsed(PROSE)), *parts)
        out[name] = with_ids(out[name], *parts)
    opened = f"WITH {CONFIG}, tree AS MATERIALIZED ({TREE}), {OPENED.replace('EXT', EXTENSION)}"
    astral = "length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"
    units = "length(left(t, i - 1)) + " + astral.format("left(t, i - 1)")
    return out | {
        "pinned_panes": "WITH l AS (SELECT event_type AS pane_id, max(event_id) AS seq FROM events GROUP BY event_type) SELECT pane_id, CASE WHEN pane_id IN ('view', 'click') THEN seq ELSE seq + 1 END AS seq FROM l",
        "active_target": "SELECT event_type AS pane_id, user_id AS start_char, CAST(user_id AS VARCHAR) AS spans FROM events WHERE event_id = (SELECT max(event_id) FROM events)",
        "selection_offsets": f"SELECT p_partkey, CAST(len(list_filter(range(1, length(t) + 1), lambda i: {units} < n)) AS BIGINT) AS chars FROM (SELECT p_partkey, left(p_name, 7) || '\U0001f600é' || left(p_type, 5) || '\U0001d11e.' AS t, p_size % 20 AS n FROM part)",
        "memory_filters": f"WITH {REPLAY}, {UPDATES}, r AS (SELECT id, seq, coalesce(st, review_state) AS review_state, staleness_state FROM records LEFT JOIN upd USING (id)) SELECT f AS filter, id, seq FROM r, (SELECT unnest(['all', 'pending', 'approved', 'rejected', 'stale', 'reusable']) AS f) WHERE f = 'all' OR f = review_state OR f = 'stale' AND staleness_state = 'stale' OR f = 'reusable' AND review_state = 'approved' AND staleness_state = 'current'",
        "memory_matched": f"WITH {REPLAY} SELECT source_document_path, count(*) AS matched FROM records WHERE source_document_path IN (SELECT 'src' || (user_id % 20) || '/doc_' || user_id || '.md' FROM events WHERE user_id % 3 = 0) GROUP BY 1",
        "memory_stored": f"""WITH odd AS {values([(k, t, h) for k, (t, h) in enumerate(corpus.ANCHOR_TEXTS)], 'k, t, held')},
e AS (SELECT event_id AS id, CASE WHEN event_id % 13 = 0 THEN 'lost' ELSE 'approved' END AS review_state, CASE WHEN event_id % 11 = 0 THEN 'old' ELSE 'current' END AS staleness_state, k, t, held FROM events LEFT JOIN odd ON k = event_id % 61)
SELECT id, review_state, staleness_state, coalesce(t, '[{{"kind":"span","ordinal":' || id % 9 || '}},{{"kind":"scene","ordinal":' || id % 4 || '}}]') AS source_anchors_json,
  CASE WHEN id % 13 = 0 THEN 'invalid_stored_review_state' WHEN id % 11 = 0 THEN 'invalid_stored_staleness_state' WHEN k IS NOT NULL AND held IS NULL THEN 'invalid_stored_anchors' END AS error_code,
  CASE WHEN k IS NULL THEN 'span ' || id % 9 || ',scene ' || id % 4 ELSE held END AS anchors FROM e""",
        "task_requests": "SELECT c_custkey AS n, ['analysis', 'editing', 'ideation', 'other'][c_custkey % 4 + 1] AS mode, CAST(1 AS SMALLINT) AS schema_version, ['analyze_selection', 'rewrite_selection', 'ideate_selection', 'chat'][c_custkey % 4 + 1] AS task_type, CASE WHEN c_custkey % 4 < 3 THEN 'selection' END AS scope, c_name AS context_path, c_custkey AS context_start, TRUE AS has_id FROM customer",
        "chat_threads": "SELECT CAST(conv_id AS VARCHAR) AS thread_id, role AS author, turn * 7 % 5 AS created_at_ms, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations",
        "chat_scopes": "SELECT CAST(conv_id AS VARCHAR) AS thread_id, 'editing' AS mode, coalesce('document ' || max(turn) FILTER (turn % 3 = 1), 'project') AS scope FROM conversations GROUP BY conv_id",
        "rail_paths": """WITH p AS (SELECT p_partkey, [p_brand, p_type, p_brand, p_name] AS req, [p_type, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'none' END, 'x' || p_size] AS av, CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN 'x' || p_size ELSE p_name END AS path FROM part),
a AS (SELECT *, list_filter(req, lambda x, i: list_position(req, x) = i AND list_contains(av, x)) AS act FROM p)
SELECT p_partkey, array_to_string(act, ',') AS active, array_to_string(CASE WHEN list_contains(act, path) THEN list_filter(act, lambda x: x <> path) WHEN list_contains(av, path) THEN list_append(act, path) ELSE act END, ',') AS toggled FROM a""",
        "project_config_errors": opened + " SELECT root_path, error_code FROM checked",
        "project_config": opened + " SELECT root_path, row_number() OVER (PARTITION BY root_path ORDER BY path) - 1 AS seq, path, role, enabled, error_code FROM saved",
        "load_documents": f"{opened}, {LOADED} SELECT root_path, path, document_type, error_code, CASE WHEN error_code IS NULL THEN length(text) END AS n_chars FROM loaded",
        "loaded_spans": f"{opened}, {LOADED}, {parsed("SELECT root_path || '|' || path AS path, text FROM loaded WHERE error_code IS NULL")} SELECT split_part(path, '|', 1) AS root_path, split_part(path, '|', 2) AS path, span_type, count(*) AS n_spans, CAST(sum(end_char - start_char) AS BIGINT) AS n_chars FROM spans GROUP BY ALL",
        "open_projects": opened + " SELECT *, row_number() OVER (PARTITION BY root_path ORDER BY string_split(path, '/')) - 1 AS position FROM shown",
    }
