"""The same results in DuckDB's SQL, from the definitions: what the queries are compared with."""

from __future__ import annotations

from .functions.text import REMOVED

#: White space: of Unicode, of Python's ``str``, of Java's plain ``\\s``; and what ends a line for Java's dot.
US = "[\\t\\n\\x0b\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
PS = US.replace("\\r ", "\\r\\x1c-\\x1f ")
JS = "[\\t\\n\\x0b\\f\\r ]"
ANY = "[^\\n\\r\\x{85}\\x{2028}\\x{2029}]"
#: Regexes of DuckDB have no look-behind; a mark that no text holds takes its place.
MARK = "chr(1)"


def strip(x: str, space: str = US) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{space}+', ''), '{space}+$', '')"


def chain(x: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


def words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{US}+'), lambda w: w <> ''))"


def by_words(x: str) -> str:
    return f"greatest(1, ({words(x)} * 13) // 10)"


def by_length(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN 0 ELSE greatest(1, length({x}) // 4) END)"


def sentences(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?]){US}+', '\\1' || {MARK}, 'g'), {MARK})"


BLANK_LINES = ("\\n{3,}", "\\n\\n")
NORMALISED = strip(chain("text", [("(?s)<!--.*?-->", " "), (f"(?im)^{JS}*(page{JS}*\\d+|\\d{{1,4}}){JS}*$", ""), ("\\.{3,}", " ... "), ("-{3,}", "\\n"), BLANK_LINES])).replace("'\\n'", "chr(10)").replace("'\\n\\n'", "chr(10) || chr(10)")
_RULES = "array_to_string(list_filter(string_split({x}, chr(10)), lambda x: NOT regexp_matches(x, '^[|\\-\\t\\n\\x0b\\f\\r ]+$')), chr(10))"


def _cleaned() -> str:
    x = chain("text", [BLANK_LINES, (f"(?m)^(#{{1,6}}){JS}{{2,}}", "\\1 "), ("(?m)^(#{1,6})([^\\t\\n\\x0b\\f\\r #])", "\\1 \\2")])
    x = _RULES.replace("{x}", x)
    x = chain(x, [(f"(?m)^{JS}*\\d+{JS}*$", ""), (f"(?m)^{JS}*[a-zA-Z]{JS}*$", ""), (f"(https?://){JS}+", "\\1"), (f"(?m)^[*\\-]{JS}+", "- "), (f"(?m)^(\\d+)\\.{JS}{{2,}}", "\\1. ")])
    x = chain(x, [("(?m)[ \\t]+$", ""), (f"{JS}+([.,;:!?])", "\\1"), ("([.,;:!?])([A-Za-z])", "\\1 \\2")])
    return strip(x).replace("'\\n\\n'", "chr(10) || chr(10)")


NORMALIZE_MD = f"SELECT doc_id, {NORMALISED} AS markdown FROM documents"
CLEAN_MD = f"SELECT doc_id, {_cleaned()} AS markdown FROM documents"
SENTENCE_COUNTS = f"SELECT doc_id, len({sentences('text')})::INTEGER AS n_sentences FROM documents"

LINE_NOISE = f"""
WITH l AS (SELECT chunk_id, created_at, content_type, content, list_transform(regexp_split_to_array(content, '\\r\\n|[\\n\\r\\x0B\\f\\x1C\\x1D\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {{'raw': x, 'bare': {strip('x')}}}) AS ls FROM chunks),
k AS (SELECT *, list_filter(ls, lambda x: x.bare = '' OR (NOT regexp_matches(x.bare, '(?i)1\\\\_b|<latexi|&lt;|&gt;|64="') AND (length(x.bare) >= 15 OR (length(x.bare) > 2
    AND (regexp_matches(x.bare, '^(?:[#\\-*>]|1\\.|2\\.)') OR regexp_matches(x.bare, '[.:!?)\\]]$')) AND NOT length(regexp_replace(x.bare, '[\\p{{L}}\\p{{N}}]', '', 'g')) / greatest(length(x.bare), 1) > 0.4)))) AS kept FROM l),
j AS (SELECT *, regexp_replace({strip("array_to_string(list_transform(kept, lambda x: CASE WHEN x.bare = '' THEN '' ELSE x.raw END), chr(10))")}, '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM k),
o AS (SELECT chunk_id, created_at, CASE WHEN coalesce(content_type IN ('code', 'math'), false) THEN content WHEN length(t) < 5 THEN '{REMOVED}' ELSE t END AS content FROM j)
SELECT chunk_id, created_at, content, {by_words('content')}::INTEGER AS estimated_tokens FROM o"""

# --- sections -------------------------------------------------------------------

_LINES = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents WHERE text IS NOT NULL),
    s AS (SELECT *, {strip('line')} AS bare FROM l)"""
_NUM = f"^(\\d+(?:\\.\\d+)*\\.?){JS}+({ANY}+)$"


def _markdown_heads(levels: int) -> str:
    mark = f"^(#{{1,{levels}}}){JS}+({ANY}*)$"
    return f"""(SELECT doc_id, place, length(regexp_extract(bare, '{mark}', 1)) AS lv, regexp_extract(bare, '{mark}', 2) AS header
        FROM (SELECT *, count(*) FILTER (regexp_matches(bare, '^(?:```|~~~)')) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fences FROM s)
        WHERE regexp_matches(bare, '{mark}') AND fences % 2 = 0)"""


_NUMERIC_HEADS = f"""(SELECT doc_id, place, len(parts) AS lv, array_to_string(list_transform(parts, lambda p: regexp_replace(p, '^0+(\\d)', '\\1')), '.') || '. ' || regexp_extract(bare, '{_NUM}', 2) AS header
        FROM (SELECT *, string_split(rtrim(regexp_extract(bare, '{_NUM}', 1), '.'), '.') AS parts FROM s WHERE regexp_matches(bare, '{_NUM}')))"""
STYLE = f"""CASE WHEN text IS NULL THEN NULL WHEN regexp_matches(text, '(?m)^#{{1,4}}{JS}+[^\\n]') THEN 'markdown'
    WHEN len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\d+(\\.\\d+)*\\.?[\\t\\x0b\\f\\r ]+[^\\n]'))) > 0 THEN 'numeric' ELSE 'markdown' END"""


def sections(heads: str, columns: str) -> str:
    return f"""WITH {_LINES}, h AS {heads},
    a AS (SELECT h.doc_id, h.place, arg_max(p.header, p.place) FILTER (p.lv < h.lv) AS up, arg_max(p.lv, p.place) FILTER (p.lv < h.lv) AS up_lv FROM h LEFT JOIN h p ON p.doc_id = h.doc_id AND p.place < h.place GROUP BY ALL),
    t AS (SELECT h.doc_id, h.place, arg_max(p.header, p.place) AS top FROM h JOIN h p ON p.doc_id = h.doc_id AND p.place <= h.place AND p.lv = 1 GROUP BY ALL),
    r AS (SELECT l.doc_id, l.place, l.line, count(h.place) OVER (PARTITION BY l.doc_id ORDER BY l.place) AS sec FROM l LEFT JOIN h ON h.doc_id = l.doc_id AND h.place = l.place),
    g AS (SELECT doc_id, sec, min(place) AS place, string_agg(line, chr(10) ORDER BY place) AS section_content FROM r GROUP BY doc_id, sec),
    n AS (SELECT g.doc_id, g.place, g.section_content, (row_number() OVER (PARTITION BY g.doc_id ORDER BY g.place) - 1)::INTEGER AS section_idx,
        (coalesce(sum(length(section_content)) OVER (PARTITION BY g.doc_id ORDER BY g.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS char_start FROM g),
    o AS (SELECT n.*, h.header AS section_header, h.lv::INTEGER AS section_level, CASE WHEN a.up_lv = h.lv - 1 THEN a.up END AS parent_section, t.top AS top_header, (char_start + length(section_content))::INTEGER AS char_end
        FROM n LEFT JOIN h ON h.doc_id = n.doc_id AND h.place = n.place LEFT JOIN a ON a.doc_id = n.doc_id AND a.place = n.place LEFT JOIN t ON t.doc_id = n.doc_id AND t.place = n.place)
    SELECT doc_id, {columns} FROM o"""


SECTION_COLUMNS = "section_idx, section_header, section_level, parent_section, top_header, section_content, char_start, char_end"
MD_SECTIONS = sections(_markdown_heads(4), SECTION_COLUMNS)
NUM_SECTIONS = sections(_NUMERIC_HEADS, SECTION_COLUMNS)
SECTION_OFFSETS = sections(_markdown_heads(3), "section_idx, char_start, char_end")
STYLED_SECTIONS = sections(
    f"(SELECT * FROM {_markdown_heads(4)} m WHERE doc_id IN (SELECT doc_id FROM documents WHERE {STYLE} = 'markdown') UNION ALL SELECT * FROM {_NUMERIC_HEADS} n WHERE doc_id IN (SELECT doc_id FROM documents WHERE {STYLE} = 'numeric'))",
    "section_idx, section_header, section_level, parent_section, top_header",
)

# --- blocks ---------------------------------------------------------------------

_ENVIRONMENTS = "|".join(f"\\\\begin\\{{{e}[^\\n]*?\\}}\\\\end\\{{{e}\\}}" for e in ("equation", "align", "gather", "multline", "eqnarray"))
TABLE = f"(?m)(?:^\\|[^\\n]*\\|{PS}*\\n^\\|[-: ]+\\|{PS}*\\n(?:^\\|[^\\n]*\\|{PS}*\\n)+)"
_FORMS = (("code", "(?s)```.*?```"), ("math", "(?s)\\$\\$.*?\\$\\$"), ("math", "(?s)\\\\\\[.*?\\\\\\]"), ("math", _ENVIRONMENTS), ("table", TABLE))


def _hits(n: int, kind: str, pattern: str) -> str:
    return f"""SELECT doc_id, {n} AS n, '{kind}' AS content_type, m[i] AS content, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start_idx
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM documents WHERE text IS NOT NULL))"""


_ALL_HITS = " UNION ALL ".join(_hits(n, kind, pattern) for n, (kind, pattern) in enumerate(_FORMS))
CONTENT_BLOCKS = f"""WITH h AS (SELECT *, start_idx + length(content) AS end_idx FROM ({_ALL_HITS})),
    w AS (SELECT *, coalesce(lag(end_idx) OVER (PARTITION BY doc_id ORDER BY start_idx, n), 0) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY start_idx, n) AS k FROM h),
    last AS (SELECT doc_id, arg_max(end_idx, k) AS stop, max(k) AS k FROM w GROUP BY doc_id),
    b AS (SELECT doc_id, k * 2 AS k, content, content_type, start_idx, end_idx FROM w
        UNION ALL SELECT w.doc_id, w.k * 2 - 1, {strip('substr(d.text, w.before + 1, w.start_idx - w.before)', PS)}, 'prose', w.before, w.start_idx FROM w JOIN documents d USING (doc_id) WHERE w.start_idx > w.before
        UNION ALL SELECT d.doc_id, coalesce(last.k, 0) * 2 + 1, {strip('substr(d.text, coalesce(last.stop, 0) + 1)', PS)}, 'prose', coalesce(last.stop, 0), length(d.text) FROM documents d LEFT JOIN last USING (doc_id) WHERE d.text IS NOT NULL AND length(d.text) > coalesce(last.stop, 0)),
    f AS (SELECT * FROM b WHERE content_type <> 'prose' OR content <> ''),
    e AS (SELECT * FROM f UNION ALL SELECT doc_id, 0, text, 'prose', 0, length(text) FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM f))
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS block_idx, content, content_type, start_idx::INTEGER AS start_idx, end_idx::INTEGER AS end_idx FROM e"""


def _numbered(source: str, key: str, pieces: str, index: str, value: str) -> str:
    return f"SELECT {key}, (i - 1)::INTEGER AS {index}, pieces[i] AS {value} FROM (SELECT {key}, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM (SELECT {key}, {pieces} AS pieces FROM {source}))"


_EMPTY = "{'done': []::VARCHAR[], 'now': NULL::VARCHAR, 'n': 0::BIGINT}"


def _ended(fold: str) -> str:
    """The pieces of a fold, with the one at hand if there is any."""
    return f"list_transform([{fold}], lambda f: CASE WHEN f.now IS NULL THEN f.done ELSE list_append(f.done, f.now) END)[1]"


def packed(parts: str, glue: str, over: str) -> str:
    """Parts put together while ``over`` (a condition on ``whole``) is false."""
    whole = f"(acc.now || {glue} || x)"
    step = f"""CASE WHEN acc.now IS NULL THEN {{'done': acc.done, 'now': x, 'n': 0::BIGINT}} WHEN {over.replace('whole', whole)} THEN {{'done': list_append(acc.done, acc.now), 'now': x, 'n': 0::BIGINT}}
        ELSE {{'done': acc.done, 'now': {whole}, 'n': 0::BIGINT}} END"""
    return _ended(f"list_reduce({parts}, lambda acc, x: {step}, {_EMPTY})")


def sum_pieces(x: str, most: int) -> str:
    """Sentences put together while the sum of their own counts is within the budget."""
    return _ended(f"""list_reduce({sentences(x)}, lambda acc, x: CASE WHEN acc.now IS NULL THEN {{'done': acc.done, 'now': x, 'n': (length(x) // 4)::BIGINT}}
        WHEN acc.n + length(x) // 4 > {most} THEN {{'done': list_append(acc.done, acc.now), 'now': x, 'n': (length(x) // 4)::BIGINT}} ELSE {{'done': acc.done, 'now': acc.now || ' ' || x, 'n': (acc.n + length(x) // 4)::BIGINT}} END, {_EMPTY})""")


def hard_pieces(source: str, key: str, x: str, most: int) -> str:
    """CTEs f, h, p, b and c, of which c holds the pieces of text ``x`` of each row of ``source``, cut at sentences and, where too long, by length."""
    token = "'@@CODE' || (i - 1) || '@@'"
    cut = f"list_transform(range((length(p) - 1) // {4 * most} + 1), lambda k: substr(p, k * {4 * most} + 1, {4 * most}))"
    return f"""f AS (SELECT {key}, {x} AS body, regexp_extract_all({x}, '(?s)```.*?```') AS fences FROM {source}),
    h AS (SELECT *, list_reduce(range(1, len(fences) + 1), lambda acc, i: replace(acc, fences[i], {token}), body) AS hidden FROM f),
    p AS (SELECT *, {packed(f"list_filter({sentences('hidden')}, lambda s: s <> '')", "' '", f"length(whole) // 4 > {most}")} AS packed FROM h),
    b AS (SELECT *, list_transform(packed, lambda p: list_reduce(range(1, len(fences) + 1), lambda acc, i: replace(acc, {token}, fences[i]), {strip('p')})) AS shown FROM p),
    c AS (SELECT {key}, body, CASE WHEN body = '' THEN [] ELSE flatten(list_transform(shown, lambda p: CASE WHEN length(p) // 4 > {most} THEN {cut} ELSE [p] END)) END AS pieces FROM b)"""


SENTENCES_SUM = _numbered("documents WHERE text IS NOT NULL", "doc_id", sum_pieces("text", 300), "piece_idx", "content")
SENTENCES_HARD = f"""WITH {hard_pieces('documents WHERE text IS NOT NULL', 'doc_id', 'text', 300)}
    {_numbered('c', 'doc_id', 'pieces', 'piece_idx', 'content')}"""
TABLE_PIECES = f"""WITH r AS (SELECT DISTINCT chunk_id, content AS t, string_split({strip('content')}, chr(10)) AS rows FROM chunks WHERE regexp_matches(content, '(?m)^\\|[-:| ]+\\|[ \\t]*$')),
    p AS (SELECT chunk_id, CASE WHEN {by_words('t')} <= 60 OR len(rows) < 3 THEN [t] ELSE list_transform({packed("rows[3:]", "chr(10)", by_words("(rows[1] || chr(10) || rows[2] || chr(10) || whole)") + " > 60")}, lambda b: rows[1] || chr(10) || rows[2] || chr(10) || b) END AS pieces FROM r)
    {_numbered('p', 'chunk_id', 'pieces', 'piece_idx', 'content')}"""

# --- fingerprints ---------------------------------------------------------------

_BITS = ", ".join(f"sum(CASE WHEN (('0x' || substr(h, {k // 4 + 1}, 1))::INTEGER >> {3 - k % 4}) & 1 = 1 THEN n ELSE 0 END) AS b{k}" for k in range(64))
_DIGITS = " || ".join("substr('0123456789abcdef', (" + " + ".join(f"CASE WHEN 2 * b{k + j} > total THEN {8 >> j} ELSE 0 END" for j in range(4)) + ") + 1, 1)" for k in range(0, 64, 4))
#: Lower case of the dotted capital I is two characters, as Unicode has it.
LOWER = "lower(replace({}, 'İ', 'i̇'))"
_FLAT = f"regexp_replace({LOWER.format('text')}, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"
HASHED = f"""f AS (SELECT doc_id, {_FLAT} AS flat FROM documents WHERE regexp_replace(text, '{US}+', '', 'g') <> ''),
    g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(length(flat) - 2, 1) + 1), lambda i: substr(flat, i, 3))) AS gram FROM f),
    c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL), u AS (SELECT gram, substr(md5(gram), 17) AS h FROM (SELECT DISTINCT gram FROM c)),
    v AS (SELECT doc_id, sum(n) AS total, {_BITS} FROM c JOIN u USING (gram) GROUP BY doc_id),
    fps AS (SELECT d.doc_id, d.text, coalesce({_DIGITS}, repeat('0', 16)) AS simhash FROM documents d LEFT JOIN v USING (doc_id))"""
_WORDS = f"""g AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array({LOWER.format('text')}, '{PS}+'), lambda w: w <> '')) AS gram FROM documents),
    c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL), u AS (SELECT gram, substr(md5(gram), 17) AS h FROM (SELECT DISTINCT gram FROM c)),
    v AS (SELECT doc_id, sum(n) AS total, {_BITS} FROM c JOIN u USING (gram) GROUP BY doc_id)"""
SIMHASH_WORDS = f"WITH {_WORDS} SELECT d.doc_id, coalesce({_DIGITS}, repeat('0', 16)) AS simhash FROM documents d LEFT JOIN v USING (doc_id)"
SIMHASH = f"WITH {HASHED} SELECT doc_id, simhash FROM fps"
NGRAM_COUNTS = f"SELECT doc_id, greatest(length({_FLAT}) - 2, 1)::BIGINT + CASE WHEN text IS NULL THEN NULL ELSE 0 END AS n_grams FROM documents"


def greedy(rows: str) -> str:
    """Ids kept of ``rows`` (id, v), taken in order of ``o``; ``known`` (v) holds what is accepted beforehand."""
    return f"""k AS (SELECT list_reduce(list({{'id': id, 'v': v}} ORDER BY o), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: bit_count(xor(y.v, x.v)) <= 3)) > 0 THEN acc ELSE list_append(acc, x) END,
        (SELECT coalesce(list({{'id': NULL::{{kind}}, 'v': v}}), []) FROM known)) AS kept FROM {rows})"""


DEDUP_GREEDY = f"""WITH {HASHED}, known AS (SELECT 0::UBIGINT AS v WHERE false), r AS (SELECT doc_id AS id, doc_id AS o, ('0x' || simhash)::UBIGINT AS v FROM fps),
    {greedy('r').replace('{kind}', 'BIGINT')}, i AS (SELECT unnest(list_transform(kept, lambda x: x.id)) AS doc_id FROM k)
    SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM i) THEN 'kept' ELSE 'duplicate' END AS status FROM fps"""
PIPELINE_STATUS = f"""WITH {HASHED}, known AS (SELECT 0::UBIGINT AS v WHERE false), r AS (SELECT doc_id AS id, doc_id AS o, ('0x' || simhash)::UBIGINT AS v FROM fps WHERE text IS NOT NULL),
    {greedy('r').replace('{kind}', 'BIGINT')}, i AS (SELECT unnest(list_transform(kept, lambda x: x.id)) AS id FROM k), a AS (SELECT r.* FROM r JOIN i USING (id)),
    n AS (SELECT r.id, count(*) AS n FROM r JOIN a ON a.o < r.o AND bit_count(xor(a.v, r.v)) <= 3 GROUP BY r.id)
    SELECT printf('doc-%012d', d.doc_id) AS path, CASE WHEN d.text IS NULL THEN 'failed' WHEN n.n > 0 THEN 'skipped' ELSE 'ok' END AS status,
        CASE WHEN d.text IS NULL THEN 'no text' WHEN n.n > 0 THEN 'duplicate' END AS reason, coalesce(n.n, 0)::INTEGER AS n_matches FROM documents d LEFT JOIN n ON n.id = d.doc_id"""
DEDUP_STATUS = f"SELECT status, count(*) AS n FROM ({DEDUP_GREEDY}) GROUP BY status"

# --- merging --------------------------------------------------------------------

FRONT = "upper({}) IN ('', 'ARTICLE HISTORY', 'ABSTRACT', 'KEYWORDS', 'AUTHOR INFORMATION')"
_EARLIEST = """e AS (SELECT chunk_id, arg_min({'file_id': file_id, 'place': chunk_index, 'content': content, 'section_header': section_header, 'content_type': content_type}, created_at) AS r FROM chunks GROUP BY chunk_id),
    q AS (SELECT r.file_id AS file_id, {'place': r.place, 'chunk_id': chunk_id, 'content': coalesce(r.content, ''), 'section_header': r.section_header, 'content_type': r.content_type, 'n': %s::BIGINT} AS x FROM e)"""


def _folded(tokens: str, step: str) -> str:
    start = "{'done': [rows[1]][1:0], 'now': rows[1]}"
    return f"""WITH {_EARLIEST % tokens.replace('$', "coalesce(r.content, '')")},
    g AS (SELECT file_id, list(x ORDER BY x.place, x.chunk_id) AS rows FROM q GROUP BY file_id),
    f AS (SELECT file_id, list_reduce(rows[2:], lambda acc, x: {step}, {start}) AS f FROM g),
    a AS (SELECT file_id, list_append(f.done, f.now) AS rows FROM f)
    SELECT file_id, (i - 1)::INTEGER AS chunk_index, rows[i].place AS place, rows[i].chunk_id AS chunk_id, rows[i].content AS content, rows[i].section_header AS section_header, rows[i].content_type AS content_type,
        rows[i].n::INTEGER AS estimated_tokens FROM (SELECT file_id, rows, unnest(range(1, len(rows) + 1)) AS i FROM a)"""


def _row(base: str, whole: str, tokens: str) -> str:
    return f"{{'place': {base}.place, 'chunk_id': {base}.chunk_id, 'content': {whole}, 'section_header': {base}.section_header, 'content_type': {base}.content_type, 'n': {tokens.replace('$', whole)}::BIGINT}}"


_WHOLE = "(acc.now.content || chr(10) || chr(10) || x.content)"
_FITS = f"""coalesce(acc.now.n < 50 AND ((acc.now.section_header IS NOT DISTINCT FROM x.section_header AND acc.now.content_type IS NOT DISTINCT FROM x.content_type)
    OR coalesce({FRONT.format(strip("coalesce(acc.now.section_header, '')"))} AND {FRONT.format(strip("coalesce(x.section_header, '')"))} AND acc.now.content_type = 'prose' AND x.content_type = 'prose', false)) AND acc.now.n + x.n <= 500, false)"""
_KEEP = "{'done': list_append(acc.done, acc.now), 'now': x}"
MERGE_SHORT = _folded(by_words("$"), f"CASE WHEN {_FITS} THEN {{'done': acc.done, 'now': {_row('acc.now', _WHOLE, by_words('$'))}}} ELSE {_KEEP} END")
_TEXT = strip("acc.now.content")
_ONLY = f"""(coalesce(acc.now.section_header, '') <> '' AND length({_TEXT}) < greatest(50, length(coalesce(acc.now.section_header, '')) * 2) AND contains(lower({_TEXT}), lower({strip("coalesce(acc.now.section_header, '')")})))"""
_JOINED = strip(f"({_TEXT} || chr(10) || chr(10) || {strip('x.content')})")
JOIN_SHORT = _folded(by_length("$"), f"CASE WHEN {_ONLY} OR acc.now.n < 50 THEN {{'done': acc.done, 'now': {_row('x', _JOINED, by_length('$'))}}} ELSE {_KEEP} END")

_COLUMNS = ("section_header", "section_level", "parent_section")


def _pipeline(clean: str, parts: str, tokens: str, last: str) -> str:
    """Cleaned texts, sections of three levels, pieces of those over the budget, short ones joined to the next: CTE ``o`` and what follows it."""
    found = sections(_markdown_heads(3), f"section_idx, section_content, {', '.join(_COLUMNS)}").replace("FROM documents", "FROM src")
    row = lambda base, whole: "{" + ", ".join(f"'{c}': {base}.{c}" for c in _COLUMNS) + f", 'content': {whole}, 'n': {tokens.replace('$', whole)}::BIGINT}}"
    step = f"CASE WHEN {_ONLY} OR acc.now.n < 50 THEN {{'done': acc.done, 'now': {row('x', _JOINED)}}} ELSE {_KEEP} END"
    fields = ", ".join(f"rows[i].{c} AS {c}" for c in _COLUMNS)
    return f"""WITH src AS (SELECT doc_id, {clean} AS text FROM documents), sec AS ({found}), {parts},
    e AS (SELECT doc_id, section_idx, {', '.join(_COLUMNS)}, unnest(pieces) AS content, unnest(range(len(pieces))) AS piece FROM c JOIN sec USING (doc_id, section_idx)),
    q AS (SELECT doc_id, section_idx, piece, {row('e', 'e.content')} AS x FROM e), g AS (SELECT doc_id, list(x ORDER BY section_idx, piece) AS rows FROM q GROUP BY doc_id),
    z AS (SELECT doc_id, list_reduce(rows[2:], lambda acc, x: {step}, {{'done': [rows[1]][1:0], 'now': rows[1]}}) AS f FROM g),
    y AS (SELECT doc_id, list_append(f.done, f.now) AS rows FROM z),
    o AS (SELECT printf('doc-%012d', doc_id) AS file_id, (i - 1)::INTEGER AS chunk_index, {fields}, rows[i].content AS content, rows[i].n::INTEGER AS estimated_tokens FROM (SELECT doc_id, rows, unnest(range(1, len(rows) + 1)) AS i FROM y))
    {last}"""


_QUARTER = "(length($) // 4)"
PAGE_CHUNKS = _pipeline(
    _cleaned(), f"c AS (SELECT doc_id, section_idx, CASE WHEN length(section_content) // 4 <= 512 THEN [section_content] ELSE {sum_pieces('section_content', 512)} END AS pieces FROM sec)", _QUARTER,
    "SELECT *, (chunk_index + 1)::VARCHAR AS chunk_id, lag((chunk_index + 1)::VARCHAR) OVER w AS prev_chunk_id, lead((chunk_index + 1)::VARCHAR) OVER w AS next_chunk_id FROM o WINDOW w AS (PARTITION BY file_id ORDER BY chunk_index)",
)
_LONG = f"""{hard_pieces('sec', 'doc_id, section_idx', 'section_content', 1024).replace('c AS (SELECT doc_id, section_idx, body, CASE WHEN', f"c AS (SELECT doc_id, section_idx, body, CASE WHEN {by_length('body')} <= 1024 THEN [body] WHEN")}"""
LAYOUT_CHUNKS = _pipeline(
    NORMALISED, _LONG, by_length("$"),
    "SELECT *, file_id || '-' || (chunk_index + 1) AS chunk_id, CASE WHEN chunk_index > 0 THEN file_id || '-' || chunk_index END AS prev_chunk_id, CASE WHEN lead(1) OVER w = 1 THEN file_id || '-' || (chunk_index + 2) END AS next_chunk_id FROM o WINDOW w AS (PARTITION BY file_id ORDER BY chunk_index)",
)

# --- contents -------------------------------------------------------------------

#: Tables of contents as text, from the entries of each file: numbered lines, else list marks by level; leaders and page at the end.
RENDERED = """d AS (SELECT file_id, '# Volume' || chr(10) || chr(10) || '## Table of Contents' || chr(10) || string_agg(CASE WHEN numeric_id IS NOT NULL THEN numeric_id || ' ' ELSE repeat('- ', coalesce(level, 0) + 1) END
    || coalesce(title, '') || CASE WHEN page IS NOT NULL THEN ' ..... ' || page ELSE '' END, chr(10) ORDER BY entry_no) || chr(10) || chr(10) || '## Opening' || chr(10) || 'The text begins here.' AS text FROM toc_entries GROUP BY file_id)"""
_TITLE = "(?is)^(.*?)((?:##[\\t\\n\\x0b\\f\\r ]*Table of Contents|TABLE OF CONTENTS).*)$"
_MASKED = "regexp_replace(tail, '(?i)\\n##Table of Contents', chr(10) || '@@Table of Contents', 'g')"
_FOUND = f"""{RENDERED}, t AS (SELECT file_id, text, regexp_extract(text, '{_TITLE}', 1) AS head, regexp_extract(text, '{_TITLE}', 2) AS tail FROM d),
    p AS (SELECT *, CASE WHEN tail = '' THEN NULL WHEN strpos({_MASKED}, chr(10) || '##') = 0 THEN tail ELSE substr(tail, 1, strpos({_MASKED}, chr(10) || '##') - 1) END AS toc FROM t)"""
TOC_REMOVED = f"WITH {_FOUND} SELECT file_id, CASE WHEN toc IS NULL THEN text ELSE {strip('(head || substr(tail, length(toc) + 1))')} END AS markdown FROM p"
_PAGE = f"(?:{JS}*\\.{{2,}}{JS}*(\\d+))?$"
_NUMERIC = f"^(\\d+(?:\\.\\d+)*\\.?){JS}+({ANY}+?){_PAGE}"
_CHAPTER = f"(?i)^(CHAPTER{JS}+(\\d+)|ABSTRACT|INTRODUCTION|CONCLUSION|REFERENCES|APPENDIX){_PAGE}"
_SIMPLE = f"^({ANY}+?){_PAGE}"
_READY = f"regexp_replace(regexp_replace(replace(replace(replace(toc, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '[ \\t]+', ' ', 'g'), '{JS}*\\.{JS}*\\.', '..', 'g')"
TOC_LINES = f"""WITH RECURSIVE {_FOUND},
    l AS (SELECT file_id, unnest(list_transform(string_split({_READY}, chr(10)), lambda x: {strip('x')})) AS x, unnest(range(len(string_split({_READY}, chr(10))))) AS i FROM p WHERE toc IS NOT NULL),
    k AS (SELECT file_id, i, regexp_replace(x, '^(?:[-*+]{JS}*)+', '') AS x, greatest(length(regexp_replace(regexp_extract(x, '^((?:[-*+]{JS}*)*)', 1), '{JS}', '', 'g')) - 1, 0)::INTEGER AS depth
        FROM l WHERE x <> '' AND NOT starts_with(x, '#') AND NOT contains(upper(x), 'TABLE OF CONTENTS')),
    e AS (SELECT file_id, i, CASE WHEN regexp_matches(x, '{_NUMERIC}') THEN {{'title': {strip(f"regexp_extract(x, '{_NUMERIC}', 2)")}, 'page': try_cast(nullif(regexp_extract(x, '{_NUMERIC}', 3), '') AS INTEGER),
            'numeric_id': rtrim(regexp_extract(x, '{_NUMERIC}', 1), '.'), 'level': len(string_split(rtrim(regexp_extract(x, '{_NUMERIC}', 1), '.'), '.'))::INTEGER}}
        WHEN regexp_matches(x, '{_CHAPTER}') THEN {{'title': {strip(f"regexp_extract(x, '{_CHAPTER}', 1)")}, 'page': try_cast(nullif(regexp_extract(x, '{_CHAPTER}', 3), '') AS INTEGER), 'numeric_id': nullif(regexp_extract(x, '{_CHAPTER}', 2), ''), 'level': 0}}
        WHEN regexp_matches(x, '{_SIMPLE}') THEN {{'title': {strip(f"regexp_extract(x, '{_SIMPLE}', 1)")}, 'page': try_cast(nullif(regexp_extract(x, '{_SIMPLE}', 2), '') AS INTEGER), 'numeric_id': NULL::VARCHAR, 'level': depth}} END AS e, regexp_matches(x, '{_NUMERIC}') AS dotted FROM k),
    n AS (SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY i) - 1)::INTEGER AS entry_no, e.title AS title, e.page AS page, e.level AS level, e.numeric_id AS numeric_id,
        CASE WHEN dotted AND e.level > 1 THEN regexp_replace(e.numeric_id, '\\.\\d+$', '') END AS parent_id, bool_or(e.numeric_id IS NOT NULL) OVER (PARTITION BY file_id) AS numbered FROM e WHERE e IS NOT NULL),
    u AS (SELECT n.file_id, n.entry_no, max(o.entry_no) AS parent_idx FROM n JOIN n o ON o.file_id = n.file_id AND CASE WHEN n.numbered THEN o.numeric_id = n.parent_id ELSE o.entry_no < n.entry_no AND o.level < n.level END GROUP BY ALL),
    c AS (SELECT n.*, u.parent_idx FROM n LEFT JOIN u USING (file_id, entry_no)),
    w AS (SELECT file_id, entry_no, title AS full_path FROM c WHERE parent_idx IS NULL UNION ALL SELECT c.file_id, c.entry_no, w.full_path || ' > ' || c.title FROM c JOIN w ON c.file_id = w.file_id AND c.parent_idx = w.entry_no)
    SELECT c.file_id, c.entry_no, c.title, c.page, c.level, c.numeric_id, c.parent_id, c.parent_idx::INTEGER AS parent_idx, w.full_path FROM c LEFT JOIN w USING (file_id, entry_no)"""

#: Parents of stored entries: by number in a file where any entry has one, else the nearest earlier entry of a smaller level.
TOC_PARENTS = """WITH f AS (SELECT *, bool_or(numeric_id IS NOT NULL) OVER (PARTITION BY file_id) AS numbered FROM toc_entries),
    u AS (SELECT e.file_id, e.entry_no, max(p.entry_no) AS parent_no FROM f e JOIN f p ON p.file_id = e.file_id AND CASE WHEN e.numbered THEN p.numeric_id = e.parent_id ELSE p.entry_no < e.entry_no AND p.level < e.level END GROUP BY ALL)
    SELECT f.file_id, f.entry_no, u.parent_no::INTEGER AS parent_no FROM f LEFT JOIN u USING (file_id, entry_no)"""
