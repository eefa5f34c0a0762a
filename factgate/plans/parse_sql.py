"""The parsers' registered queries as DuckDB SQL."""

from __future__ import annotations

import json

from ..functions import text as T
from ..sources import parse
from .sql_text import q as _q


def _strip(c: str) -> str:
    return f"regexp_replace({c}, {_q(f'^{T.SPACE}+|{T.SPACE}+$')}, '', 'g')"


def _single(c: str) -> str:
    return f"trim(regexp_replace({c}, {_q(T.SPACE + '+')}, ' ', 'g'))"


def _inline(c: str) -> str:
    for pattern, by in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"\*\*|__|`", "")):
        c = f"regexp_replace({c}, {_q(pattern)}, {_q(by)}, 'g')"
    return c


def _cells(c: str) -> str:
    bare = f"regexp_replace({_strip(c)}, '^\\|+|\\|+$', '', 'g')"
    return f"list_transform(string_split({bare}, '|'), lambda c: {_strip('c')})"


def _lines(body: str) -> str:
    cut = f"regexp_split_to_array({body}, {_q(parse.LINE_END)})"
    return f"unnest({cut}) AS line, generate_subscripts({cut}, 1) AS pos"


def _joined(rows: str) -> str:
    """rows (key, pos, kind, said, more…) with neighbouring lines of kind text joined, breaks dropped."""
    return f"""SELECT key, min(pos) AS pos, any_value(kind) AS kind, any_value(level) AS level, any_value(section) AS section, string_agg(said, ' ' ORDER BY pos) AS text FROM (
      SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY pos) AS block FROM (
        SELECT *, (NOT (kind = 'text' AND lag(kind, 1, 'break') OVER (PARTITION BY key ORDER BY pos) = 'text'))::INT AS opens FROM {rows}
      )) WHERE kind <> 'break' GROUP BY key, block"""


def _located(blocks: str, more: str = "") -> str:
    """blocks (key, pos, level, text, more) with the heading path folded over all headings so far."""
    return f"""SELECT key, (row_number() OVER (PARTITION BY key ORDER BY pos) - 1)::INT AS block_pos, level, text, path {more}, CASE WHEN level > 0 THEN path ELSE
        path || CASE WHEN path = '' THEN '' ELSE ' ' END || '¶' || (count(*) FILTER (level = 0) OVER (PARTITION BY key, path ORDER BY pos))::VARCHAR END AS loc
      FROM (SELECT *, CASE WHEN len(heads) = 0 THEN '' ELSE array_to_string(list_reduce(heads, lambda a, h: {{'level': h.level, 'path': list_concat(a.path[1:h.level - 1], h.path)}}).path, ' > ') END AS path
        FROM (SELECT *, list_filter(list(CASE WHEN level > 0 THEN {{'level': level, 'path': [text]}} END) OVER (PARTITION BY key ORDER BY pos), lambda h: h IS NOT NULL) AS heads FROM {blocks}))"""


RENDERED = (
    "SELECT doc_id AS key, '---' || chr(10) || 'title: ' || source || chr(10) || '---' || chr(10) || '# ' || source || chr(10) || chr(10) || '### ' || lang || chr(10) || chr(10) "
    "|| replace(replace(text, chr(10), chr(10) || '- '), ', ', ',' || chr(10)) || chr(10) || '## `end`' || chr(10) || '| ' || lang || ' | **x** |' || chr(10) || '|---|:-:|' AS body FROM documents"
)
MARKDOWN = rf"""WITH r AS ({RENDERED}), l AS (SELECT key, {_lines(f"regexp_replace(body, {_q(parse.FRONT)}, '')")} FROM r),
f AS (SELECT *, starts_with({_strip('line')}, '```') AS fence, sum(starts_with({_strip('line')}, '```')::INT) OVER (PARTITION BY key ORDER BY pos) AS fences FROM l),
h AS (SELECT *, CASE WHEN fence THEN 0 ELSE length(regexp_extract(line, {_q(parse.HEADING)}, 1)) END AS level, {_strip(f"regexp_replace(regexp_extract(line, {_q(parse.HEADING)}, 2), '[*_`]', '', 'g')")} AS title FROM f WHERE fence OR fences % 2 = 0),
k AS (SELECT *, '' AS section, CASE WHEN fence OR {_strip('line')} = '' THEN 'break' WHEN level > 0 THEN CASE WHEN title = '' THEN 'break' ELSE 'heading' END
        WHEN regexp_matches(line, {_q(parse.ITEM)}) THEN 'item' WHEN starts_with({_strip('line')}, '|') THEN CASE WHEN len(list_filter({_cells('line')}, lambda c: NOT regexp_full_match(c, '[-: ]*'))) = 0 THEN 'break' ELSE 'row' END ELSE 'text' END AS kind FROM h),
s AS (SELECT *, CASE kind WHEN 'heading' THEN title WHEN 'item' THEN {_inline(f"regexp_extract(line, {_q(parse.ITEM)}, 1)")} WHEN 'row' THEN array_to_string(list_transform({_cells('line')}, lambda x: {_inline('x')}), ' | ') ELSE {_inline(_strip('line'))} END AS said FROM k),
p AS ({_joined('s')}), b AS (SELECT key, pos, level, CASE kind WHEN 'heading' THEN text ELSE {_single('text')} END AS text FROM p), e AS (SELECT * FROM b WHERE text <> '')
SELECT key AS source_id, block_pos, level, loc, text FROM ({_located('e')})"""


def draft_units(sentences: str, strip_tags: str) -> str:
    """sentences: the list of sentences of `text`; strip_tags: `said` without tags."""
    return rf"""WITH r AS ({RENDERED}), l AS (SELECT key, {_lines(f"regexp_replace(body, {_q(parse.COMMENT)}, '', 'g')")} FROM r),
k AS (SELECT *, 0 AS level, CASE WHEN {_strip('line')} = '' THEN 'break' WHEN regexp_matches(line, {_q(parse.HEADING)}) THEN 'heading' WHEN regexp_matches(line, {_q(parse.ITEM)}) THEN 'list-item'
        WHEN starts_with({_strip('line')}, '|') OR starts_with({_strip('line')}, '---') OR starts_with({_strip('line')}, '```') THEN 'table-cell' ELSE 'text' END AS kind FROM l),
t AS (SELECT *, CASE kind WHEN 'heading' THEN {_strip(f"regexp_extract(line, {_q(parse.HEADING)}, 2)")} WHEN 'list-item' THEN regexp_extract(line, {_q(parse.ITEM)}, 1) ELSE {_strip('line')} END AS said FROM k),
s AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'heading' THEN {_strip(strip_tags)} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY pos), '') AS section FROM t),
p AS ({_joined('s')}),
u AS (SELECT key, pos, section, kind, CASE kind WHEN 'heading' THEN [text] WHEN 'table-cell' THEN list_filter({_cells('text')}, lambda c: NOT regexp_full_match(c, '[-:]*')) ELSE {sentences} END AS parts FROM p),
x AS (SELECT key, pos, section, CASE kind WHEN 'text' THEN 'sentence' ELSE kind END AS kind, unnest(parts) AS text, generate_subscripts(parts, 1) AS part FROM u)
SELECT key AS item_id, (row_number() OVER (PARTITION BY key ORDER BY pos, part) - 1)::INT AS index, section, kind, text FROM x"""


_NAMES = ", ".join(map(_q, (*parse.HEADS, *parse.BLOCKS)))
_SKIPS = ", ".join(map(_q, parse.SKIPPED))
#: All entities that the operator decodes; names end with their semicolon if they have one.
_ENTITIES = "(VALUES " + ", ".join(f"({_q('&' + name)}, {_q(chars)})" for name, chars in json.loads(parse._ENTITIES).items()) + ") AS entities(name, chars)"
_DIGITS = "ltrim(regexp_replace(e, '[&#xX;]', '', 'g'), '0')"
_CODE = f"CASE WHEN length({_DIGITS}) BETWEEN 1 AND 7 THEN CASE WHEN regexp_matches(e, '^&#[xX]') THEN ('0x' || {_DIGITS})::BIGINT ELSE {_DIGITS}::BIGINT END ELSE 0 END"
_CHAR = "CASE WHEN code <= 0 OR code > 1114111 OR code BETWEEN 55296 AND 57343 THEN chr(65533) ELSE chr(code::INT) END"
HTML = rf"""WITH m AS (SELECT page_id AS key, regexp_extract_all(html, {_q(parse.MARKUP)}) AS m FROM pages), t AS (SELECT key, unnest(m) AS token, generate_subscripts(m, 1) AS pos FROM m),
n AS (SELECT *, starts_with(token, '</') AS closes, regexp_matches(token, '(?is)^<(script|style)\b.*</|/>$') AS whole,
        CASE WHEN starts_with(token, '<') AND length(token) > 1 THEN lower(regexp_extract(token, '^</?([A-Za-z][^\s/>]*)', 1)) END AS name FROM t),
f AS (SELECT *, coalesce(name IN ({_NAMES}) OR (name = 'br' AND NOT closes), false) AS flush FROM n),
e AS (SELECT *, sum(flush::INT) OVER w AS run, CASE WHEN flush THEN CASE WHEN regexp_full_match(name, 'h[1-6]') AND NOT closes AND NOT whole THEN substring(name, 2, 1)::INT ELSE 0 END END AS opened,
        sum(CASE WHEN name IN ({_SKIPS}) AND NOT whole THEN CASE WHEN closes THEN -1 ELSE 1 END ELSE 0 END) OVER w AS depth,
        coalesce(last_value(CASE WHEN name = 'title' AND NOT whole THEN NOT closes END IGNORE NULLS) OVER w, false) AS in_title FROM f WINDOW w AS (PARTITION BY key ORDER BY pos)),
k AS (SELECT *, depth > least(0, min(depth) OVER (PARTITION BY key ORDER BY pos)) AS skipped FROM e),
r AS (SELECT key, min(pos) AS pos, coalesce(max(opened), 0) AS level, coalesce(string_agg(token, '' ORDER BY pos) FILTER (name IS NULL AND NOT in_title AND NOT skipped), '') AS raw FROM k GROUP BY key, run),
g AS (SELECT key, coalesce(string_agg(token, '' ORDER BY pos) FILTER (name IS NULL AND in_title), '') AS title FROM k GROUP BY key),
d AS (SELECT key, pos, unnest(regexp_extract_all(raw, {_q(parse.ENTITY)})) AS e, generate_subscripts(regexp_extract_all(raw, {_q(parse.ENTITY)}), 1) AS i FROM (SELECT key, pos, raw FROM r UNION ALL SELECT key, -1, title FROM g)),
c AS (SELECT *, CASE WHEN starts_with(e, '&#') AND length(e) > 2 THEN {_CODE} END AS code FROM d),
u AS (SELECT key, pos, string_agg(CASE WHEN code IS NOT NULL THEN {_CHAR} ELSE coalesce(chars, e) END, '' ORDER BY i) AS said FROM c LEFT JOIN {_ENTITIES} ON e = name GROUP BY key, pos),
b AS (SELECT key, r.pos, level, {_single("coalesce(u.said, '')")} AS text, {_strip("coalesce(h.said, '')")} AS title FROM r LEFT JOIN u USING (key, pos) LEFT JOIN (SELECT key, said FROM u WHERE pos = -1) h USING (key)), x AS (SELECT * FROM b WHERE text <> '')
SELECT key AS page_id, block_pos, level, title, path, text FROM ({_located('x', ', title')})"""
