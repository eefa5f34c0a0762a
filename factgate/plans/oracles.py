"""The registered queries as DuckDB SQL."""

from __future__ import annotations

from ..functions import lexicon as L
from ..sources.driver_tables import CLAIMS_SQL, SOURCES_SQL, UNITS_SQL
from . import gate_sql, parse_sql, report_sql
from .sql_text import listed as _list
from .sql_text import normal as _normal
from .sql_text import q as _q
from .sql_text import stem as _stem
from .sql_text import stripped_tags as _strip_tags
from .sql_text import tokens as _tokens


CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), {_q(p)}) THEN '{c}'" for c, p in L.CATEGORIES) + f" ELSE '{L.DEFAULT_CATEGORY}' END"
CONFIDENCE = f"CASE WHEN regexp_matches(text, {_q(L.ROADMAP)}) THEN 'low' WHEN regexp_matches(text, {_q(L.HEDGE)}) THEN 'medium' ELSE 'high' END"
RATED = f"{CLAIMS_SQL}, rated AS (SELECT *, {CATEGORY} AS category, {CONFIDENCE} AS confidence FROM claims)"
HIGH = ", ".join(map(_q, L.HIGH_RISK))
VERDICTS = f"""{RATED}, {UNITS_SQL}, v AS (
  SELECT u.*, CASE WHEN c.id IS NULL THEN 'missing-claim' WHEN status = 'deprecated' THEN 'deprecated' WHEN status <> 'verified' THEN 'needs-review'
              WHEN confidence = 'low' AND category IN ({HIGH}) THEN 'high-risk-low-confidence' WHEN confidence = 'low' THEN 'low-confidence' END AS reason
  FROM units u LEFT JOIN rated c ON c.id = u.cited_id
), verdicts AS (SELECT *, CASE WHEN reason IS NULL THEN 'pass' WHEN reason = 'low-confidence' THEN 'flag' ELSE 'block' END AS verdict FROM v)"""
REPORTS = f"""{VERDICTS}, counted AS (
  SELECT item_id, count(*) AS n_units, count(*) FILTER (verdict = 'block') AS blocks, count(*) FILTER (verdict = 'flag') AS flags,
         count(*) FILTER (reason = 'missing-claim') AS missing, count(*) FILTER (reason = 'deprecated') AS deprecated, count(*) FILTER (reason = 'needs-review') AS unreviewed
  FROM verdicts GROUP BY item_id
), reports AS (SELECT *, CASE WHEN blocks > 0 THEN 'blocked' ELSE 'approved' END AS status FROM counted)"""

_ABBREV = "|".join(a.replace(".", r"\.") for a in L.ABBREVIATIONS)


def _split(passes: int) -> str:
    """The sentences of `text`.  An abbreviation takes the space that the next one begins at, so neighbours need a second pass."""
    t = _normal("coalesce(text, '')")
    for _ in range(passes):
        t = f"regexp_replace({t}, '(?i)(^|[^A-Za-z.])({_ABBREV})\\.(\\s)', '\\1\\2' || chr(2) || '\\3', 'g')"
    for _ in range(2):
        t = f"regexp_replace({t}, '(\\d)\\.( ?\\d)', '\\1' || chr(2) || '\\2', 'g')"
    t = f"regexp_replace({t}, '([.!?](?:\\s*\\[\\[[A-Z0-9\\-]+\\]\\])*)\\s+([\"''(\\[]?[A-Z0-9])', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({t}, chr(1)), lambda s: trim(replace(s, chr(2), '.'))), lambda s: s <> '')"


_SPLIT, _SPLIT_ALL = _split(1), _split(2)
SENTENCES, SENTENCES_ALL = (f"sentences AS (SELECT doc_id, source, {x} AS s FROM documents)" for x in (_SPLIT, _SPLIT_ALL))
MEASURED = rf"""{SENTENCES_ALL}, one AS (SELECT source, unnest(s) AS t FROM sentences), w AS (
  SELECT source, len(regexp_extract_all(t, {_q(L.WORD)}))::BIGINT AS w, ends_with(t, '?') AS q, ends_with(t, '!') AS x, regexp_matches(t, '(?i)\b(you|your|yours)\b') AS y FROM one
), measured AS (
  SELECT source, count(*) AS sentences, sum(w)::BIGINT AS words, sum(w)::DOUBLE / count(*) AS mean_words,
         list_sort(list(w))[floor(0.1 * (count(*) - 1))::BIGINT + 1]::INTEGER AS p10, list_sort(list(w))[floor(0.9 * (count(*) - 1))::BIGINT + 1]::INTEGER AS p90,
         count(*) FILTER (q) / count(*)::DOUBLE AS question_rate, count(*) FILTER (x) / count(*)::DOUBLE AS exclaim_rate, count(*) FILTER (y) / count(*)::DOUBLE AS second_person_rate
  FROM w GROUP BY source
)"""

STEMS = f"""list_distinct(list_transform(list_filter({_tokens('text')}, lambda w: length(w) > 2 AND NOT list_contains({_list(L.GENERIC)}, w) AND NOT regexp_full_match(w, '\\d+(\\.\\d+)?')), lambda w: {_stem('w')}))"""
_STATUS = "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '\\b{w}\\b') THEN '{s}' END" for w, s in L.STATUS_WORDS) + "], lambda x: x IS NOT NULL)))"
_WORDS = "regexp_extract_all(text, '[A-Za-z]+|\\d+(?:\\.\\d+)?')"
_NUMERIC = "regexp_full_match({}, '\\d+(\\.\\d+)?')"
_NN = (
    f"list_distinct(flatten(list_transform(list_filter(range(1, len({_WORDS}) + 1), lambda i: {_NUMERIC.format(_WORDS + '[i]')}), lambda i: list_transform(list_filter(({_WORDS})[i + 1 : i + 3], "
    f"lambda x: NOT {_NUMERIC.format('x')} AND NOT list_contains({_list(L.STOPWORDS)}, lower(x))), lambda x: {{'number': ({_WORDS})[i], 'noun': {_stem('lower(x)')}}}))))"
)
_HEAD = f"CASE WHEN regexp_extract(text, {_q('(?s)^(.+?)' + L.SUBJECT_END.replace('(?i)', '(?i:', 1) + ')')}, 1) <> '' THEN regexp_extract(text, {_q('(?s)^(.+?)' + L.SUBJECT_END.replace('(?i)', '(?i:', 1) + ')')}, 1) ELSE array_to_string((string_split(trim(text), ' '))[1:3], ' ') END"
_SUBJECT = f"list_distinct(list_transform(list_filter({_tokens(_HEAD)}, lambda w: length(w) > 1), lambda w: {_stem('w')}))"
_EMPTY = "[]::VARCHAR[]"
_TOKENS = _list(L.STATUS_TOKENS)
CONFLICTS = f"""{RATED}, {SOURCES_SQL}, active AS (SELECT * FROM rated WHERE status <> 'deprecated' AND category <> 'market-evidence'),
st AS (SELECT product_id, id, unnest({STEMS}) AS stem FROM active),
size AS (SELECT product_id, count(*) AS n FROM active GROUP BY product_id),
common AS (SELECT st.product_id, stem FROM st JOIN size USING (product_id) GROUP BY st.product_id, stem, n HAVING count(*) > greatest(4, n // 5)),
sal AS (SELECT product_id, id, list(stem) AS salient FROM st ANTI JOIN common USING (product_id, stem) GROUP BY product_id, id),
cs AS (SELECT product_id, list(stem) AS common FROM common GROUP BY product_id),
f AS (
  SELECT a.product_id, a.id, text, src.kind AS src, src.updated AS age, salient, coalesce(cs.common, {_EMPTY}) AS common, {_STATUS} AS rel, {_NN} AS nn, {_SUBJECT} AS subj,
         list_sort(list_distinct(list_transform(regexp_extract_all(text, {_q(L.QUALIFIER)}, 1), lambda x: lower(x)))) AS scope,
         regexp_matches(text, {_q(L.ABSOLUTE)}) AS abs_, regexp_matches(text, {_q(L.EXCEPTION)}) AS exc, regexp_matches(text, {_q(L.REGISTRY_NEGATION)}) AS neg,
         list_filter(salient, lambda x: NOT list_contains({_TOKENS}, x)) AS plain
  FROM active a JOIN sal USING (product_id, id) LEFT JOIN cs ON cs.product_id = a.product_id LEFT JOIN sources src ON src.source_id = a.source_id
), p AS (
  SELECT a.product_id, a.id AS a, b.id AS b, a.src AS asrc, b.src AS bsrc, a.age AS aage, b.age AS bage, a.rel AS arel, b.rel AS brel, a.scope AS ascope, b.scope AS bscope, a.abs_ AS aabs, b.abs_ AS babs, a.exc AS aexc, b.exc AS bexc, a.neg AS aneg, b.neg AS bneg, a.nn AS ann, b.nn AS bnn,
         len(list_intersect(a.salient, b.salient)) AS both_, len(list_intersect(a.plain, b.plain)) AS plain_, len(a.plain) + len(b.plain) AS plains,
         len(a.salient) + len(b.salient) AS sizes, len(a.subj) AS asub, len(b.subj) AS bsub, len(list_intersect(a.subj, b.subj)) AS sub,
         list_filter(list_intersect(list_transform(a.nn, lambda x: x.noun), list_transform(b.nn, lambda x: x.noun)), lambda x: NOT list_contains(a.common, x)) AS nouns
  FROM f a JOIN f b ON a.product_id = b.product_id AND a.id < b.id AND a.text <> b.text WHERE len(list_intersect(a.salient, b.salient)) > 0
), r AS (
  SELECT *, asub > 0 AND bsub > 0 AND sub / greatest(1, asub + bsub - sub) >= 0.75 AS same, both_ / greatest(1, sizes - both_) AS j,
         list_transform(list_filter(ann, lambda v: list_contains(nouns, v.noun)), lambda v: v.number) AS va, list_transform(list_filter(bnn, lambda v: list_contains(nouns, v.noun)), lambda v: v.number) AS vb FROM p
), ruled AS (
  SELECT product_id, a, b, asrc, bsrc, aage, bage, CASE
    WHEN len(arel) > 0 AND len(brel) > 0 AND arel <> brel AND plain_ >= 1 AND plain_ / greatest(1, plains - plain_) >= 0.25 THEN 'status'
    WHEN len(nouns) > 0 AND both_ >= 2 AND same AND j >= 0.4 AND NOT (len(ascope) > 0 AND len(bscope) > 0 AND ascope <> bscope) AND len(list_intersect(va, vb)) = 0 THEN 'number'
    WHEN both_ >= 3 AND ((aabs AND bexc AND NOT babs) OR (babs AND aexc AND NOT aabs)) THEN 'absolute'
    WHEN j >= 0.6 AND same AND aneg <> bneg THEN 'negation' END AS rule FROM r
), conflicts AS (
  SELECT product_id, a, b, rule, CASE WHEN rule = 'absolute' THEN 'absolute-vs-exception' WHEN rule = 'status' AND list_sort([asrc, bsrc]) = ['changelog', 'living'] THEN 'living-vs-changelog' ELSE 'contradiction' END AS kind,
         CASE WHEN rule = 'absolute' THEN NULL WHEN asrc = 'living' AND bsrc <> 'living' THEN a WHEN bsrc = 'living' AND asrc <> 'living' THEN b WHEN bage > aage THEN b ELSE a END AS interim_default
  FROM ruled WHERE rule IS NOT NULL
)"""
SIMILAR = f"""q AS (SELECT item_id AS query_id, list_distinct({_tokens('text')}) AS t FROM benchmark), d AS (SELECT doc_id AS target_id, list_distinct({_tokens('text')}) AS t FROM documents),
pairs AS (
  SELECT query_id, target_id, count(*) AS shared, count(*) / (sqrt(qn) * sqrt(dn)) AS score, count(*) / qn AS overlap
  FROM (SELECT query_id, len(t) AS qn, unnest(t) AS token FROM q) JOIN (SELECT target_id, len(t) AS dn, unnest(t) AS token FROM d) USING (token) GROUP BY query_id, target_id, qn, dn
)"""
#: `best`: the three best documents of each passage, with the share of its stems that each has.
BEST = f"""{SIMILAR}, best AS (
  SELECT query_id, target_id, r, len(list_intersect(qs, ds)) / greatest(1, len(qs)) AS covered
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target_id) AS r FROM pairs) JOIN (SELECT item_id AS query_id, {gate_sql.stems('text')} AS qs FROM benchmark) USING (query_id) JOIN (SELECT doc_id AS target_id, {gate_sql.stems('text')} AS ds FROM documents) USING (target_id) WHERE r <= 3
)"""
ROUNDS = "rounds AS (SELECT o_custkey AS item_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::INTEGER AS round, CASE o_orderstatus WHEN 'F' THEN 'approved' ELSE 'blocked' END AS status, o_orderdate AS created_at FROM orders)"
VERSIONS = """a AS (SELECT doc_id, source AS source_id, text || CASE WHEN doc_id % 3 = 0 THEN ' before' ELSE '' END AS was, text || CASE WHEN doc_id % 5 = 0 THEN ' after' ELSE '' END AS now_ FROM documents),
old AS (SELECT 'DOC-' || lpad(doc_id::VARCHAR, 8, '0') AS id, source_id, md5(lower(was)) AS quote_hash, md5(was) AS text FROM a),
new AS (SELECT doc_id AS pos, CASE WHEN doc_id % 7 = 0 THEN 'elsewhere' ELSE source_id END AS source_id, md5(lower(now_)) AS quote_hash, md5(now_) AS text FROM a),
n1 AS (SELECT *, row_number() OVER (PARTITION BY source_id, quote_hash, text ORDER BY pos) AS k FROM new), o1 AS (SELECT *, row_number() OVER (PARTITION BY source_id, quote_hash, text ORDER BY id) AS k FROM old),
exact AS (SELECT pos, n1.source_id, quote_hash, text, id FROM n1 LEFT JOIN o1 USING (source_id, quote_hash, text, k)),
free AS (SELECT id, quote_hash, text, row_number() OVER (PARTITION BY quote_hash, text ORDER BY id) AS k FROM old WHERE id NOT IN (SELECT id FROM exact WHERE id IS NOT NULL)),
rest AS (SELECT pos, quote_hash, text, row_number() OVER (PARTITION BY quote_hash, text ORDER BY source_id, pos) AS k FROM exact WHERE id IS NULL),
matched AS (
  SELECT pos, id, 'exact' AS how FROM exact WHERE id IS NOT NULL
  UNION ALL SELECT pos, free.id, CASE WHEN free.id IS NULL THEN 'new' ELSE 'moved' END FROM rest LEFT JOIN free USING (quote_hash, text, k)
)"""
SAMPLES = "s AS (SELECT lang, (length(text) % 997) / 997 AS score, quality AS label FROM documents JOIN labels USING (doc_id))"
TOPICS = "(SELECT unnest(" + _list((*(c for c, _ in L.CATEGORIES), L.DEFAULT_CATEGORY)) + ") AS category)"

ORACLES: dict[str, str] = {
    "gate_citations": f"WITH {REPORTS} SELECT * FROM reports",
    "category_mix": f"WITH {RATED} SELECT category, confidence, CASE WHEN category IN ({HIGH}, 'market-evidence') OR confidence = 'low' THEN 'needs-review' ELSE 'verified' END AS base_status, count(*) AS n FROM rated GROUP BY ALL",
    "word_counts": f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), {_q(L.WORD)}))::BIGINT AS n_words FROM documents",
    "sentence_split": f"WITH {SENTENCES_ALL} SELECT doc_id, len(s)::BIGINT AS n_sentences, md5(array_to_string(s, chr(10))) AS digest FROM sentences",
    "tags": f"WITH {UNITS_SQL} SELECT item_id, count(DISTINCT cited_id) AS n_cited, 'It supports this. ' AS plain FROM units GROUP BY item_id",
    "text_measure": f"WITH {MEASURED} SELECT * FROM measured",
    "style_scores": report_sql.STYLE.replace("{sentences}", _SPLIT),
    "claim_extract": f"""WITH {SENTENCES}, one AS (SELECT doc_id, unnest(s) AS text FROM sentences), k AS (
          SELECT doc_id, CASE WHEN len(string_split(text, ' ')) > 59 THEN array_to_string((string_split(text, ' '))[1:59], ' ') ELSE text END AS quote, text FROM one
          WHERE len(regexp_extract_all(text, {_q(L.WORD)})) >= 5 AND NOT ends_with(text, '?') AND NOT regexp_matches(text, {_q(L.SKIPPED_OPENING)}) AND regexp_matches(text, '[a-z]')
        ), d AS (SELECT doc_id, quote, min({CONFIDENCE}) AS confidence FROM k GROUP BY doc_id, quote)
        SELECT doc_id AS source_id, count(*) AS n_claims, count(*) FILTER (confidence = 'high') AS n_high FROM d GROUP BY doc_id""",
    "registry_build": f"WITH {VERSIONS} SELECT * FROM matched",
    "registry_absent": f"WITH {VERSIONS} SELECT id, 'deprecated' AS status, 'absent' AS status_reason FROM old WHERE id NOT IN (SELECT id FROM matched WHERE id IS NOT NULL)",
    "id_allocation": """WITH top AS (SELECT lang, max(doc_id) AS top FROM documents WHERE doc_id < 100 GROUP BY lang),
        n AS (SELECT doc_id, coalesce(top, 0) + row_number() OVER (PARTITION BY d.lang ORDER BY source, doc_id) AS num FROM documents d LEFT JOIN top USING (lang) WHERE doc_id >= 100)
        SELECT doc_id, 'DOC-' || CASE WHEN num < 1000 THEN lpad(num::VARCHAR, 3, '0') ELSE num::VARCHAR END AS id FROM n""",
    "ruling_fold": f"""WITH {CLAIMS_SQL}, r AS (
          SELECT 'PT-' || lpad(o_custkey::VARCHAR, 8, '0') AS id, count(*) AS n_rulings, bool_or(o_orderstatus NOT IN ('F', 'P')) AS low,
                 last(CASE o_orderstatus WHEN 'P' THEN 'deprecated' ELSE CASE WHEN o_orderkey % 2 = 1 THEN 'needs-review' ELSE 'verified' END END ORDER BY o_orderdate, o_orderkey) FILTER (o_orderstatus IN ('F', 'P')) AS s
          FROM orders GROUP BY o_custkey)
        SELECT c.id, coalesce(s, c.status) AS status, coalesce(low, false) AS deprioritized, coalesce(n_rulings, 0) AS n_rulings FROM claims c LEFT JOIN r ON r.id = c.id""",
    "conflict_pairs": f"WITH {CONFLICTS} SELECT product_id, a, b, kind, rule, interim_default FROM conflicts",
    "page_tension": f"""WITH {CONFLICTS}, {UNITS_SQL}, m AS (SELECT a || '~' || b AS conflict_id, kind, unnest([a, b]) AS cited_id FROM conflicts),
        t AS (SELECT item_id, conflict_id, m.kind, min(index) AS first_index, count(DISTINCT index) AS n_sentences, bool_or(regexp_matches(text, {_q(L.SUPERLATIVE)})) AS bold FROM units JOIN m USING (cited_id) JOIN claims ON id = cited_id GROUP BY item_id, conflict_id, m.kind)
        SELECT item_id, conflict_id, first_index, n_sentences, CASE kind WHEN 'absolute-vs-exception' THEN 'colliding-absolutes' ELSE 'tension' END AS kind,
               CASE WHEN kind = 'absolute-vs-exception' AND bold THEN 'block' ELSE 'flag' END AS verdict, CASE WHEN kind = 'absolute-vs-exception' AND bold THEN 'overstated' ELSE 'tension' END AS reason FROM t""",
    "doc_freq": f"WITH {CLAIMS_SQL} SELECT product_id, stem, count(*) AS n FROM (SELECT product_id, id, unnest({STEMS}) AS stem FROM claims) GROUP BY product_id, stem",
    "topk_claims": f"WITH {SIMILAR} SELECT * FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target_id))::INTEGER AS rank, target_id, shared, round(score, 3) AS score FROM pairs) WHERE rank <= 3",
    "unanswered": f"WITH {BEST} SELECT item_id AS query_id FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM best WHERE r = 1 AND covered >= 0.5)",
    "staleness": f"""WITH {SENTENCES}, t AS (SELECT doc_id, s[ceil(len(s) * (doc_id % 4 + 1) / 4)::INT] AS quote, CASE WHEN doc_id % 2 = 1 THEN left(text, floor(length(text) * 3 / 4)::INT) ELSE replace(text, ' ', '  ') END AS body
          FROM sentences JOIN documents USING (doc_id) WHERE len(s) > 0)
        SELECT doc_id, contains(lower({_normal('body')}), lower({_normal('quote')})) AS verbatim FROM t""",
    "stale_sources": """WITH s AS (SELECT doc_id AS source_id, sha256(text) AS sha, doc_id % 11 <> 0 AS active FROM documents),
        b AS (SELECT source_id, CASE WHEN source_id % 9 = 0 THEN sha256(sha) ELSE sha END AS built FROM s WHERE source_id % 4 <> 1)
        SELECT source_id, CASE WHEN sha IS NULL THEN 'removed' WHEN built IS NULL THEN 'added' ELSE 'changed' END AS change FROM (SELECT * FROM s WHERE active) FULL JOIN b USING (source_id) WHERE sha IS DISTINCT FROM built""",
    "change_detection": "SELECT doc_id AS source_id, doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0 AS changed FROM documents",
    "latest_per_key": "SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "reflag": f"WITH {CLAIMS_SQL}, {UNITS_SQL} SELECT item_id, string_agg(DISTINCT cited_id, ',' ORDER BY cited_id) AS claim_ids FROM units WHERE cited_id NOT IN (SELECT id FROM claims WHERE status = 'verified') GROUP BY item_id",
    "rollback_live": f"WITH {ROUNDS} SELECT item_id, round, max(CASE WHEN status = 'approved' THEN round END) OVER (PARTITION BY item_id ORDER BY round) AS live_round FROM rounds",
    "adjacent_units": f"""WITH {CLAIMS_SQL}, {UNITS_SQL}, u AS (SELECT item_id, index, cited_id, product_id, lag(cited_id) OVER w AS before, lag(product_id) OVER w AS pb FROM units LEFT JOIN claims ON id = cited_id WINDOW w AS (PARTITION BY item_id ORDER BY index, cited_id))
        SELECT item_id, index, cited_id, before FROM u WHERE product_id = pb AND cited_id <> before""",
    "round_compare": """WITH b AS (SELECT DISTINCT conv_id, md5(text) AS t, true AS was FROM conversations WHERE turn % 4 < 2), a AS (SELECT DISTINCT conv_id, md5(text) AS t, true AS now_ FROM conversations WHERE turn % 4 >= 2)
        SELECT conv_id AS item_id, CASE WHEN was IS NULL THEN 'new' WHEN now_ IS NULL THEN 'fixed' ELSE 'still' END AS change, count(*) AS n FROM a FULL JOIN b USING (conv_id, t) GROUP BY ALL""",
    "auc": f"""WITH {SAMPLES} SELECT lang, (SELECT sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*) FROM s p, s n WHERE p.label = 1 AND n.label = 0 AND p.lang = s.lang AND n.lang = s.lang) AS auc,
        sum(label)::BIGINT AS n_pos, sum(1 - label)::BIGINT AS n_neg FROM s GROUP BY lang""",
    "youden": f"""WITH {SAMPLES}, c AS (SELECT lang, score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY ALL),
        j AS (SELECT lang, score, round(sum(p) OVER up / greatest(1, sum(p) OVER every_) - sum(n) OVER up / greatest(1, sum(n) OVER every_), 12) AS j, lag(score) OVER (PARTITION BY lang ORDER BY score) AS lower_
              FROM c WINDOW up AS (PARTITION BY lang ORDER BY score ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), every_ AS (PARTITION BY lang))
        SELECT lang, j, (score + coalesce(lower_, score)) / 2 AS threshold FROM j QUALIFY row_number() OVER (PARTITION BY lang ORDER BY j DESC, score) = 1""",
    "gate_eval_score": f"""WITH {VERDICTS}, o AS (SELECT (['true', 'false', 'untagged', 'overstated', 'partial'])[index % 5 + 1] AS label, (verdict = 'block')::INTEGER AS b FROM verdicts)
        SELECT avg(b) FILTER (label IN ('false', 'overstated', 'partial')) AS catch_rate, avg(b) FILTER (label = 'true') AS false_block_rate, avg(b) FILTER (label = 'untagged') AS untagged_rate, count(*) AS n FROM o""",
    "gate_report": gate_sql.report(RATED, HIGH),
    "registry_overlap": f"WITH {gate_sql.overlap(gate_sql.seeds(CLAIMS_SQL))} SELECT item_id, index, best_id, reg_n, round(reg_ratio, 6) AS reg_ratio FROM near",
    "verify_sentences": f"""WITH {gate_sql.verified(gate_sql.seeds(CLAIMS_SQL))} SELECT label, claim_status, classification, verdict, reason, count(*) AS n, count(*) FILTER (reason = 'untagged' AND best_id = item_id) AS n_suggested, sum(reg_n)::BIGINT AS reg_n FROM verdicts GROUP BY ALL""",
    "gate_eval_run": f"""WITH {gate_sql.verified(gate_sql.seeds(CLAIMS_SQL))}, o AS (SELECT label, (verdict = 'block')::INTEGER AS b FROM verdicts WHERE claim_status = 'verified')
        SELECT avg(b) FILTER (label IN ('false', 'overstated', 'partial')) AS catch_rate, avg(b) FILTER (label = 'true') AS false_block_rate, avg(b) FILTER (label = 'untagged') AS untagged_rate, count(*) AS n FROM o""",
    "gate_eval_pages": gate_sql.eval_pages(f"{RATED}, conflicts AS (WITH {CONFLICTS} SELECT * FROM conflicts)", HIGH),
    "gate_labels": f"WITH {gate_sql.verified(gate_sql.seeds(CLAIMS_SQL))} SELECT label, count(*) AS n, count(*) FILTER (verdict = 'block') AS blocked, count(*) FILTER ((label = 'true') = (verdict = 'block')) AS misses FROM verdicts GROUP BY label",
    "gate_targets": f"""WITH {gate_sql.verified(gate_sql.seeds(CLAIMS_SQL))}, o AS (SELECT label, (verdict = 'block')::INTEGER AS b FROM verdicts WHERE claim_status = 'verified')
        SELECT 'catch_rate' AS metric, avg(b) AS value, 0.95::DOUBLE AS target, avg(b) >= 0.95::DOUBLE AS passed FROM o WHERE label IN ('false', 'overstated', 'partial')
        UNION ALL SELECT 'false_block_rate', avg(b), 0.1::DOUBLE, avg(b) <= 0.1::DOUBLE FROM o WHERE label = 'true' UNION ALL SELECT 'untagged_rate', avg(b), 0.95::DOUBLE, avg(b) >= 0.95::DOUBLE FROM o WHERE label = 'untagged'""",
    "discovered": r"""WITH p AS (SELECT regexp_extract(url, '^(\w+://[^/]+)', 1) || '/' AS url, html FROM pages), l AS (SELECT url, unnest(list_distinct(list_transform(regexp_extract_all(html, 'href="([^"#]+)"', 1), lambda u: CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN u WHEN starts_with(u, '/') THEN rtrim(url, '/') || u ELSE url || u END))) AS link FROM p)
        SELECT url, link, count(*) AS n FROM (SELECT * FROM l WHERE starts_with(link, url) AND link <> url UNION ALL SELECT url, url FROM p) GROUP BY url, link""",
    "repairs": gate_sql.repairs(CLAIMS_SQL),
    "affected": f"""WITH {CONFLICTS}, {UNITS_SQL}, stale AS (SELECT id AS claim_id FROM claims WHERE status <> 'verified'),
        t AS (SELECT 'content' AS kind, item_id::VARCHAR AS id, cited_id AS claim_id FROM units UNION ALL SELECT 'conflict', a || '~' || b, unnest([a, b]) FROM conflicts)
        SELECT kind, id, string_agg(DISTINCT claim_id, ',' ORDER BY claim_id) AS claim_ids FROM t JOIN stale USING (claim_id) GROUP BY kind, id""",
    "value_counts": """SELECT event_type, props, n, rank FROM (SELECT event_type, props, count(*) AS n, (row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, min(event_id), props))::INTEGER AS rank
        FROM events GROUP BY event_type, props HAVING count(*) >= 3) WHERE rank <= 5""",
    "phrases": """WITH w AS (SELECT role, conv_id * 1000 + turn AS at_, string_split(lower(text), ' ') AS w FROM conversations),
        g AS (SELECT role, at_, unnest(list_concat(list_transform(range(1, len(w) - 1), lambda i: w[i : i + 2]), list_transform(range(1, len(w) - 2), lambda i: w[i : i + 3]))) AS g FROM w),
        c AS (SELECT role, array_to_string(g, ' ') AS phrase, count(*) AS n, min(at_) AS first_ FROM g WHERE g[1] NOT IN ('the', 'a', 'and', 'to', 'of') AND g[-1] NOT IN ('the', 'a', 'and', 'to', 'of') GROUP BY ALL HAVING count(*) >= 3)
        SELECT role, phrase, n, rank FROM (SELECT *, (row_number() OVER (PARTITION BY role ORDER BY n DESC, first_, phrase))::INTEGER AS rank FROM c) WHERE rank <= 15""",
    "links": "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"#]+)\"', 1)) AS link FROM pages",
    "cost_dash": "SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18, 2))::DOUBLE AS cost, count(*) AS n, grouping(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "coverage": f"WITH {RATED} SELECT t.category, count(rated.id) AS n FROM {TOPICS} t LEFT JOIN rated ON rated.category = t.category AND status <> 'deprecated' GROUP BY t.category",
    "dq_rules": f"""WITH {RATED}, {UNITS_SQL}, b AS (
          SELECT 'high-risk-verified' AS rule FROM rated WHERE category IN ({HIGH}) AND status = 'verified' UNION ALL SELECT 'low-confidence-verified' FROM rated WHERE confidence = 'low' AND status = 'verified'
          UNION ALL SELECT 'dangling-citation' FROM units WHERE cited_id NOT IN (SELECT id FROM claims) UNION ALL SELECT 'repeated-conversation-id' FROM conversations GROUP BY conv_id HAVING count(*) > 1)
        SELECT rule, count(*) AS n FROM b GROUP BY rule""",
    "log_rollup": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL",
    "audit_rollup_stream": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL",
    "markdown_blocks": parse_sql.MARKDOWN,
    "draft_units": parse_sql.draft_units(_SPLIT_ALL, _strip_tags("said")),
    "html_blocks": parse_sql.HTML,
    "rebuild_text": "SELECT doc_id AS source_id, md5(text) AS digest FROM documents",
    "vocabulary": f"""WITH w AS (SELECT source, doc_id, unnest({_tokens('text')}) AS word FROM documents), c AS (
          SELECT source, word, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id), word) AS r FROM w WHERE length(word) > 3 AND NOT regexp_full_match(word, '\\d+') GROUP BY source, word)
        SELECT * FROM (SELECT source, word, n, (row_number() OVER (PARTITION BY source ORDER BY r))::INTEGER AS rank FROM c WHERE r <= 60 AND n >= 3) WHERE rank <= 20""",
    "seed_set": f"""WITH {RATED}, s AS (SELECT product_id, unnest(CASE WHEN status <> 'verified' THEN ['not-citable'] WHEN regexp_matches(text, '\\b\\d+\\b') THEN ['true', 'untagged', 'false', 'overstated', 'partial'] ELSE ['true', 'untagged', 'overstated', 'partial'] END) AS label FROM rated),
        n AS (SELECT product_id, label, CASE label WHEN 'partial' THEN least(24, count(*)) // 2 ELSE least(12, count(*)) END AS n FROM s GROUP BY product_id, label)
        SELECT product_id, label, n, CASE label WHEN 'untagged' THEN 0 ELSE n END AS n_tagged FROM n WHERE n > 0 UNION ALL SELECT DISTINCT product_id, 'positioning', 6, 0 FROM claims""",
    "greedy_chunks": f"""WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM l),
        w AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), {_q(L.WORD)}))::INTEGER AS w FROM p), f(doc_id, i, chunk, acc) AS (
          SELECT doc_id, i, 0, w FROM w WHERE i = 1
          UNION ALL SELECT w.doc_id, w.i, CASE WHEN acc >= 180 THEN chunk + 1 ELSE chunk END, CASE WHEN acc >= 180 THEN w ELSE acc + w END FROM f JOIN w ON w.doc_id = f.doc_id AND w.i = f.i + 1
        ), c AS (SELECT doc_id, chunk, max(acc) AS words, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY i) FILTER (text <> ''), '') AS text FROM f JOIN w USING (doc_id, i) GROUP BY doc_id, chunk)
        SELECT * FROM c WHERE words >= 90 OR (chunk = 0 AND words > 0)""",
    "conflict_delta": f"WITH {CONFLICTS} SELECT product_id, a, b, kind, rule, interim_default FROM conflicts",
    "changes_stream": "SELECT user_id, event_type, event_id FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)",
    "compacted_orders": "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "page_claims": f"""WITH {gate_sql.overlap(gate_sql.seeds(CLAIMS_SQL))}, near3 AS (SELECT product_id, plain, p.id FROM pairs p JOIN claims c USING (product_id, id) WHERE c.status = 'verified' QUALIFY row_number() OVER (PARTITION BY product_id, plain ORDER BY score DESC, p.id) <= 3),
        u AS (SELECT item_id, near3.id FROM seeds JOIN near3 USING (product_id, plain) UNION SELECT item_id, item_id FROM seeds WHERE tagged) SELECT item_id, string_agg(id, ',' ORDER BY id) AS claim_ids FROM u GROUP BY item_id""",
    "positioning_packs": """SELECT p_brand AS source_id, 'First words' AS positioning_statement, 'theme' AS kind, p_type AS name, count(*)::INTEGER AS n, md5('Packed as it ships|' || string_agg(p_name, '|' ORDER BY p_partkey)) AS digest FROM part GROUP BY ALL
        UNION ALL SELECT p_brand, 'First words', 'persona', 'Buyer ' || p_size, 2, md5('buyer; ' || min(p_name) || '|cost|' || max(p_type) || '|' || CASE WHEN p_size % 2 = 0 THEN 'unaware' ELSE 'problem-aware' END) FROM part GROUP BY p_brand, p_size""",
    "off_brand": r"""WITH d AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '(?i)\byour\b', 'the user''s', 'g'), '(?i)\byou\b', 'the user', 'g') AS third FROM documents),
        v AS (SELECT doc_id, 'hype' AS variant, 'A revolutionary, game-changing way! ' || replace(text, '.', '!') AS t FROM d UNION ALL SELECT doc_id, 'third-person', regexp_replace(third, '\.\s+', ', and ', 'g') FROM d
              UNION ALL SELECT doc_id, 'wrong-name', 'Productify: ' || text FROM d UNION ALL SELECT doc_id, 'banned', text || ' seamless leverage.' FROM d)
        SELECT doc_id, variant, md5(t) AS digest FROM v""",
    "allowed_claims": f"WITH {CLAIMS_SQL} SELECT id, product_id FROM claims WHERE NOT regexp_matches(lower(text), CASE WHEN length(product_id) % 2 = 0 THEN '\\bplanned\\b' ELSE '\\bencrypts\\b' END)",
    "citations_view": f"""WITH {CLAIMS_SQL}, {UNITS_SQL} SELECT item_id, md5(string_agg(index::VARCHAR || ' | ' || cited_id || ' | ' || coalesce(text, '-') || ' | ' || coalesce(source_id::VARCHAR, '-'), chr(10) ORDER BY index, cited_id)) AS digest
        FROM units LEFT JOIN claims ON id = cited_id GROUP BY item_id""",
    "proof_links": f"WITH {BEST} SELECT query_id, min_by(target_id, r) AS target_id FROM best WHERE covered >= 0.6 GROUP BY query_id",
    "search_blocks": f"WITH {SIMILAR} SELECT query_id, target_id, shared, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, target_id))::INTEGER AS rank FROM pairs) WHERE rank <= 10",
    "budget_state": "SELECT user_id, count(*) AS runs, sum(value::DECIMAL(18, 2))::DOUBLE AS spent, sum(value::DECIMAL(18, 2)) >= 500 AS over_budget FROM events GROUP BY user_id",
    "correction_notes": f"WITH {CLAIMS_SQL} SELECT o_orderkey AS ruling_id, id AS claim_id, text, source_id FROM orders JOIN claims ON id = 'PT-' || lpad(o_custkey::VARCHAR, 8, '0') WHERE o_orderstatus = 'P'",
    "browse": f"WITH {RATED} SELECT id, text, category FROM rated WHERE status = 'needs-review' AND contains(text, 'units') ORDER BY num LIMIT 50",
    "seed_batches": f"WITH {CLAIMS_SQL}, b AS (SELECT product_id, id, (row_number() OVER (PARTITION BY product_id ORDER BY num) - 1) // 40 AS batch FROM claims) SELECT product_id, batch, count(*) AS n, min(id) AS first_id FROM b GROUP BY ALL",
    "leaked_names": "SELECT DISTINCT doc_id FROM documents WHERE regexp_matches(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+')",
}
ORACLES |= report_sql.queries(RATED, VERDICTS, ROUNDS, CONFLICTS, TOPICS, BEST, CATEGORY, ("hero", "benefits", "proof", "cta"))
