"""Reports, planning and data-quality queries as DuckDB SQL."""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import planning, reports
from ..operators.style import HYPE
from ..sources.driver_tables import CLAIMS_SQL, PRODUCT_SOURCES_SQL, SOURCES_SQL
from .sql_text import listed, normal, q, stem, stripped_tags, tokens

HIGH = ", ".join(map(q, L.HIGH_RISK))
PRODUCTS = "products AS (SELECT DISTINCT p_brand AS product_id, regexp_extract(p_brand, '(\\d+)$', 1)::INT AS num FROM part)"
CID = "'PT-' || lpad({}::VARCHAR, 8, '0')"


def _stems(c: str) -> str:
    return f"list_distinct(list_transform(list_filter({tokens(stripped_tags(c))}, lambda w: length(w) > 1), lambda w: {stem('w', L.GATE_SUFFIXES)}))"


KB = f"""{CLAIMS_SQL}, {PRODUCTS}, {PRODUCT_SOURCES_SQL}, kb0 AS (
  SELECT p.product_id, p.num, coalesce(s.truth, 0) AS truth, coalesce(s.style, 0) AS style, coalesce(s.positioning, 0) AS positioning, coalesce(s.evidence, 0) AS evidence, coalesce(c.verified, 0) AS verified, coalesce(c.needs_review, 0) AS needs_review, coalesce(o.n, 0) AS n_stale,
         CASE num % 3 WHEN 1 THEN 'draft' WHEN 2 THEN 'active' END AS profile, CASE WHEN num % 3 > 0 AND num % 2 = 1 THEN 0.7::DOUBLE END AS threshold, num % 4 > 0 AS pack
  FROM products p
  LEFT JOIN (SELECT product_id, count(*) FILTER (type = 'truth' AND status = 'active') AS truth, count(*) FILTER (type = 'style' AND status = 'active') AS style, count(*) FILTER (type = 'positioning' AND status = 'active') AS positioning, count(*) FILTER (type = 'evidence' AND status = 'active') AS evidence FROM psources GROUP BY product_id) s USING (product_id)
  LEFT JOIN (SELECT product_id, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'needs-review') AS needs_review FROM claims GROUP BY product_id) c USING (product_id)
  LEFT JOIN (SELECT product_id, count(*) AS n FROM psources WHERE source_id % 11 = 0 AND product_id < 'Brand#2' GROUP BY product_id) o USING (product_id)
), kb AS (
  SELECT product_id, num, truth, style, positioning, evidence, verified, needs_review, n_stale, threshold, CASE WHEN truth = 0 THEN 'no-truth-sources' WHEN verified = 0 THEN 'no-verified-claims' ELSE '' END AS blockers,
         concat_ws(',', CASE WHEN style = 0 THEN 'no-style-sources' WHEN profile IS NULL THEN 'profile-not-built' WHEN profile <> 'active' THEN 'profile-is-a-draft' WHEN threshold IS NULL THEN 'threshold-not-accepted' END,
                   CASE WHEN positioning = 0 THEN 'no-positioning-sources' WHEN NOT pack THEN 'pack-not-built' END, CASE WHEN n_stale > 0 THEN 'stale' END) AS warnings FROM kb0
)"""
LIVE = """live AS (SELECT item_id, round, status, created_at, max(CASE WHEN status = 'approved' THEN round END) OVER (PARTITION BY item_id ORDER BY round) AS live_round FROM rounds)"""
PROOFS = f"proofs AS (SELECT p_brand AS product_id, p_partkey AS pos, unnest([p_partkey, p_partkey - 1]) AS k, unnest([0, 1]) AS i FROM part), linked AS (SELECT product_id, pos, string_agg(id, ',' ORDER BY i) FILTER (status = 'verified') AS ids FROM proofs LEFT JOIN (SELECT id, status FROM claims) ON id = {CID.format('k')} GROUP BY product_id, pos)"
NEAR = f"""ct AS (SELECT product_id, id, text, list_distinct({tokens('text')}) AS t FROM claims WHERE status = 'verified')"""
ASKS = f"""{CLAIMS_SQL}, {NEAR}, notes AS (
  SELECT p_partkey AS brief_id, p_brand AS product_id, string_split(replace(replace('Say first that ' || p_brand || ' ' || p_type || ' supports up to ' || p_size || ' units. Mention the customer award for ledgers; Keep it short.', '. ', '.~'), '; ', ';~'), '~') AS n FROM part
), asks AS (SELECT brief_id, product_id, (generate_subscripts(n, 1) - 1)::INT AS pos, unnest(n) AS need FROM notes),
a AS (SELECT *, list_distinct({tokens('need')}) AS t FROM asks WHERE regexp_matches(need, {q(planning.ASKS)})),
best AS (SELECT brief_id, pos, ct.text FROM a JOIN ct ON a.product_id = ct.product_id AND list_has_any(a.t, ct.t)
         QUALIFY row_number() OVER (PARTITION BY brief_id, pos ORDER BY len(list_intersect(a.t, ct.t)) / (sqrt(len(a.t)) * sqrt(len(ct.t))) DESC, id) = 1),
asked AS (SELECT a.brief_id, a.pos, need FROM a LEFT JOIN best USING (brief_id, pos) WHERE text IS NULL OR len(list_intersect({_stems('need')}, {_stems('text')})) / greatest(1, len({_stems('need')})) < 0.5)"""
FACTS = f"""{CLAIMS_SQL}, {NEAR}, said AS (
  SELECT p_partkey AS aid_id, p_brand AS product_id, [replace(p_brand, '#', ' ') || ' ' || p_type || ' does not support up to ' || p_size || ' units.', 'It keeps brand ledgers for seven years now.', 'Short one.'] AS n FROM part
), s AS (SELECT aid_id, product_id, (generate_subscripts(n, 1) - 1)::INT AS pos, CASE WHEN generate_subscripts(n, 1) = 1 THEN 'Notes ' || unnest(n) ELSE unnest(n) END AS sentence FROM said),
t AS (SELECT *, list_distinct({tokens('sentence')}) AS t FROM s WHERE len(string_split(sentence, ' ')) >= 5 AND (contains(lower(sentence), 'brand'))),
best AS (SELECT aid_id, pos, id, len(list_intersect(t.t, ct.t)) / len(t.t) AS overlap, text FROM t JOIN ct ON t.product_id = ct.product_id AND list_has_any(t.t, ct.t) QUALIFY row_number() OVER (PARTITION BY aid_id, pos ORDER BY len(list_intersect(t.t, ct.t)) DESC, id) = 1),
j AS (SELECT aid_id, pos, CASE WHEN coalesce(overlap, 0) < 0.6 THEN 'not-in-registry' WHEN regexp_matches(sentence, {q(L.REGISTRY_NEGATION)}) <> regexp_matches(text, {q(L.REGISTRY_NEGATION)}) THEN 'contradicts' END AS issue, id FROM t LEFT JOIN best USING (aid_id, pos))"""
PERSONAS = f"""{PRODUCTS}, seg AS (SELECT DISTINCT c_mktsegment AS s FROM customer), b AS (SELECT c_custkey AS brief_id, 'Brand#' || (c_custkey % 25 + 1)::VARCHAR AS product_id, lower(c_mktsegment) AS audience, lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN ' for the buyer' ELSE '' END AS said FROM customer),
p AS (SELECT product_id, s, length(s) AS pos, 'Head of ' || s AS name, list_distinct({tokens("'Head of ' || s || ' buyer of units'")}) AS t FROM seg, products WHERE num % 6 > 0),
r AS (SELECT brief_id, name FROM b JOIN p USING (product_id) QUALIFY row_number() OVER (PARTITION BY brief_id ORDER BY len(list_intersect(list_distinct({tokens('said')}), t)) DESC, pos) = 1)"""
STYLE = rf"""WITH pieces AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN '# The Whole Story About Things' ELSE '# one more story' END || chr(10) AS head, text FROM documents),
one AS (SELECT doc_id, source, list_filter({{sentences}}, lambda s: true) AS s FROM pieces),
whole AS (SELECT doc_id, source, {{sentences}} AS s FROM (SELECT doc_id, source, head || text AS text FROM pieces)),
w AS (SELECT source, unnest(s) AS t FROM whole), cad AS (SELECT source, avg(len(regexp_extract_all(t, {q(L.WORD)}))) AS a, avg(regexp_matches(t, '(?i)\b(you|your|yours)\b')::INT) AS y, sum(len(regexp_extract_all(t, {q(L.WORD)}))) AS words FROM w GROUP BY source),
n AS (SELECT source, count(*) AS pieces, count(*) FILTER (doc_id % 2 = 0) / count(*) AS titled FROM pieces GROUP BY source),
v AS (SELECT source, doc_id, unnest({tokens('head || text')}) AS word FROM pieces), vc AS (SELECT source, word, count(*) AS c, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id), word) AS r FROM v WHERE length(word) > 3 AND NOT regexp_full_match(word, '\d+') GROUP BY source, word),
pref AS (SELECT source, list(word) AS preferred FROM (SELECT * FROM vc WHERE r <= 60 AND c >= 3 QUALIFY row_number() OVER (PARTITION BY source ORDER BY r) <= 20) GROUP BY source),
prof AS (SELECT source, a, y, CASE WHEN titled > 0.6 THEN 'title' WHEN titled < 0.25 THEN 'sentence' ELSE 'mixed' END AS hc, coalesce(preferred, []) AS preferred FROM cad JOIN n USING (source) LEFT JOIN pref USING (source) WHERE pieces >= 3 AND words >= 1500),
hy AS (SELECT source, list_filter({{hype}}, lambda h: NOT list_contains(used, h)) AS avoid FROM (SELECT source, coalesce(list(DISTINCT h) FILTER (h IS NOT NULL), []) AS used FROM (SELECT source, unnest(CASE WHEN len(x) = 0 THEN [NULL] ELSE x END) AS h FROM (SELECT source, list_filter({{hype}}, lambda h: regexp_matches(lower(head || text), '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(h) || '([^\p{{L}}\p{{N}}_]|$)')) AS x FROM pieces)) GROUP BY source)),
d AS (SELECT doc_id AS item_id, p.source, head || text AS t, len(s) AS n, list_sum(list_transform(s, lambda x: len(regexp_extract_all(x, {q(L.WORD)})))) AS words, len(list_filter(s, lambda x: regexp_matches(x, '(?i)\b(you|your|yours)\b'))) AS you, len(list_filter(s, lambda x: ends_with(x, '!'))) AS ex FROM one JOIN pieces p USING (doc_id)),
j AS (SELECT d.*, prof.* EXCLUDE (source), avoid, CASE WHEN item_id % 2 = 0 THEN 'title' ELSE 'sentence' END AS own, greatest(1, n) AS m FROM d JOIN prof USING (source) JOIN hy USING (source)),
k AS (SELECT item_id, t, greatest(0, 1 - abs(coalesce(words, 0) / m - a) / greatest(1, a)) AS cadence, greatest(0, 1 - abs(you / m - y) * 1.5::DOUBLE - ex / m * 3) AS voice,
  greatest(0, least(1, len(list_filter(preferred, lambda w: regexp_matches(lower(t), '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(w) || '([^\p{{L}}\p{{N}}_]|$)'))) / greatest(1, least(6, len(preferred)))) - 0.2::DOUBLE * len(list_filter(avoid, lambda w: regexp_matches(lower(t), '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(w) || '([^\p{{L}}\p{{N}}_]|$)')))) AS vocabulary,
  CASE WHEN regexp_matches(t, '(^|[^\w-])Productify([^\w-]|$)') THEN 0.0 WHEN contains(lower(t), lower(source)) THEN 1.0 ELSE 0.6 END::DOUBLE AS naming, CASE WHEN own = hc THEN 1.0 ELSE 0.5 END::DOUBLE AS formatting, regexp_matches(lower(t), '\bthe end\b') AS banned FROM j),
f AS (SELECT *, 0.25::DOUBLE * voice + 0.25::DOUBLE * cadence + 0.2::DOUBLE * vocabulary + 0.2::DOUBLE * naming + 0.1::DOUBLE * formatting AS total FROM k)
SELECT item_id, round(CASE WHEN banned THEN least(total, 0.4::DOUBLE) ELSE total END, 3) AS score, round(voice, 3) AS voice, round(cadence, 3) AS cadence, round(vocabulary, 3) AS vocabulary, round(naming, 3) AS naming, round(formatting, 3) AS formatting FROM f""".replace("{hype}", listed(HYPE))
_SAID = f"md5(lower({normal('text')}))"


def sections(names: tuple[str, ...]) -> str:
    """The greedy allocation, one section after the other."""
    at = {s: i for i, s in enumerate(names)}
    out = [f"""WITH {CLAIMS_SQL}, rated AS (SELECT id, product_id, num, status, {_SAID} AS said, text, {{category}} AS category FROM claims), briefs AS (SELECT c_custkey AS brief_id, 'Brand#' || (c_custkey % 25 + 1)::VARCHAR AS product_id, c_custkey % 101 AS qu FROM customer),
    pool AS (SELECT * FROM rated WHERE status = 'verified' AND NOT regexp_matches(lower(text), CASE WHEN length(product_id) % 2 = 0 THEN '\\bconnectors\\b' ELSE '\\bencrypts\\b' END)),
    sec AS (SELECT unnest({listed(names)}) AS section, unnest({list(at.values())}) AS at_),
    found AS (SELECT product_id, qu, section, id, row_number() OVER (PARTITION BY product_id, qu, section ORDER BY (num * (at_ + 3) + qu) % 101 DESC, id) AS rank FROM (SELECT DISTINCT product_id, qu FROM briefs) JOIN rated USING (product_id), sec WHERE status = 'verified'),
    cand AS (SELECT brief_id, section, id, false AS is_proof, rank FROM briefs JOIN found USING (product_id, qu) WHERE rank <= 25 UNION ALL SELECT brief_id, section, id, true, num FROM briefs JOIN claims USING (product_id), sec WHERE num % 50 = 7),
    c AS (SELECT cand.*, said, category FROM cand JOIN pool USING (id))"""]
    taken: list[str] = []
    for s in names:
        want = planning.WANTS.get(s, planning.WANTS_ELSE)
        if not want:
            continue
        where = f"section = '{s}'" + ("" if s in planning.PROOF_SECTIONS else " AND NOT is_proof") + (f" AND category IN ({', '.join(map(q, planning.PROOF_CATEGORIES))})" if s == "proof" else "")
        anti = f" ANTI JOIN ({' UNION ALL '.join(f'SELECT brief_id, said FROM t{t}' for t in taken)}) USING (brief_id, said)" if taken else ""
        one = f"SELECT * FROM (SELECT * FROM c WHERE {where}) x{anti} QUALIFY row_number() OVER (PARTITION BY brief_id, said ORDER BY is_proof DESC, rank, id) = 1"
        out.append(f"t{at[s]} AS (SELECT brief_id, section, id, said, (row_number() OVER (PARTITION BY brief_id ORDER BY is_proof DESC, rank, id))::INT AS pick FROM ({one}) QUALIFY pick <= {want})")
        taken.append(str(at[s]))
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT brief_id, section, id, pick FROM t{t}" for t in taken)


def queries(rated: str, verdicts: str, rounds: str, conflicts: str, topics: str, best: str, category: str, names: tuple[str, ...]) -> dict[str, str]:
    """rated, verdicts, rounds, conflicts, best: CTEs of other queries; topics: the dimension of categories; category: that of `text`."""
    review = f"{rated}, queue AS (SELECT product_id, category, coalesce(nullif(trim(string_split(string_split(location, '>')[1], '¶')[1]), ''), 'General') AS theme, count(*) AS n, string_agg(id, ',' ORDER BY num) AS ids FROM rated WHERE status = 'needs-review' GROUP BY ALL)"
    return {
        "registry_stats": f"WITH {CLAIMS_SQL} SELECT product_id, count(*) AS total, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'needs-review') AS needs_review, count(*) FILTER (status = 'deprecated') AS deprecated FROM claims GROUP BY product_id",
        "kb_status": f"WITH {KB} SELECT * EXCLUDE (num), CASE WHEN blockers <> '' THEN 'blocked' WHEN n_stale > 0 THEN 'stale' ELSE 'ready' END AS state FROM kb",
        "onboarding": f"""WITH {KB} SELECT product_id, unnest(['truth sources', 'style examples', 'positioning material', 'knowledge base', 'claims reviewed', 'style threshold']) AS step,
            unnest([truth > 0, style > 0, positioning > 0, num % 5 > 0, verified > 0 AND needs_review = 0, threshold IS NOT NULL]) AS done FROM kb""",
        "quality_dash": f"""WITH {rounds}, {LIVE}, i AS (SELECT item_id, count(*) AS n, max(live_round) AS live_round FROM live GROUP BY item_id), x AS (SELECT i.*, c_mktsegment, CASE WHEN live_round IS NULL THEN NULL WHEN item_id % 10 = 0 THEN 'approved-override' ELSE 'approved' END AS s FROM i JOIN customer ON c_custkey = item_id)
            SELECT c_mktsegment, count(*) AS items, count(s) AS approved, CASE WHEN count(s) > 0 THEN round((count(*) FILTER (s = 'approved-override') / count(s))::DECIMAL(18, 9), 3)::DOUBLE END AS override_rate, round(avg(n)::DECIMAL(18, 9), 2)::DOUBLE AS avg_rounds, count(*) FILTER (live_round <= {1 + reports.AUTO_ROUNDS} AND s = 'approved') AS approved_within_cap FROM x GROUP BY c_mktsegment""",
        "blocks_by_reason": f"WITH {verdicts} SELECT coalesce(reason, 'page') AS reason, count(*) AS n FROM verdicts WHERE verdict = 'block' GROUP BY ALL",
        "newest_drafts": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 300",
        "auto_rounds": f"SELECT o_custkey AS item_id, count(*) FILTER (o_orderpriority < '3') AS auto_rounds, count(*) FILTER (o_orderpriority < '3') >= {reports.AUTO_ROUNDS} AS exhausted FROM orders GROUP BY o_custkey",
        "export_live": f"WITH {rounds}, {LIVE}, i AS (SELECT item_id, max(live_round) AS live_round FROM live GROUP BY item_id) SELECT item_id, round, concat_ws('/', item_id, round, status) AS final_text FROM rounds JOIN i USING (item_id) WHERE round = live_round AND item_id % 9 <> 0",
        "pending_extraction": "SELECT doc_id AS source_id FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 9 = 0",
        "claims_with_sources": f"WITH {CLAIMS_SQL}, {SOURCES_SQL} SELECT id, CASE WHEN c.source_id = 2 THEN '2' ELSE 'Source ' || c.source_id END AS source_title, 'https://example.org/' || c.source_id AS url, kind AS source_kind, updated FROM claims c LEFT JOIN sources USING (source_id)",
        "unsupported_asks": f"WITH {ASKS} SELECT * FROM asked",
        "relink_proofs": f"WITH {CLAIMS_SQL}, {PROOFS} SELECT product_id, pos, coalesce(ids, '') AS claim_ids, CASE WHEN ids IS NULL THEN 'needs-claim' ELSE 'has-claim' END AS status FROM linked",
        "fact_check": f"WITH {FACTS} SELECT aid_id, pos, issue, CASE WHEN issue = 'contradicts' THEN id END AS claim_id FROM j WHERE issue IS NOT NULL",
        "pick_persona": f"WITH {PERSONAS} SELECT brief_id, coalesce(name, audience) AS persona FROM b LEFT JOIN r USING (brief_id)",
        "golden_matches": f"""WITH {CLAIMS_SQL}, g AS (SELECT product_id, num, lower({normal("CASE num % 3 WHEN 0 THEN upper(text) WHEN 1 THEN text || ' It is  so.' ELSE regexp_replace(text, '^\\S+ \\S+ ', '') END")}) AS g FROM claims),
            c AS (SELECT product_id, num AS pos, id, status, lower({normal('text')}) AS c FROM claims),
            m AS (SELECT g.num, id FROM g JOIN c USING (product_id) WHERE contains(c, g) OR (contains(g, c) AND length(c) > 0.6 * length(g)) QUALIFY row_number() OVER (PARTITION BY g.num ORDER BY status <> 'verified', pos) = 1)
            SELECT g.num, id AS claim_id FROM g LEFT JOIN m USING (num)""",
        "reproducible": "SELECT event_type AS source_id, 'user = U ' || user_id AS query, count(*) AS count FROM events WHERE user_id % 5 <> 0 GROUP BY event_type, user_id",
        "dq_sweep": f"""WITH {rated}, {PRODUCTS}, v AS (
            SELECT unnest(list_filter([CASE WHEN status = 'verified' AND (category IN ({HIGH}) OR confidence = 'low') AND num % 4 <> 0 THEN 'needs-confirmation' END, CASE WHEN num % 10 = 3 THEN 'quote-not-verbatim' END, CASE WHEN status <> 'verified' THEN 'plan-on-unverified-claim' END,
                                    CASE WHEN category = 'market-evidence' THEN 'evidence-without-count' END, CASE WHEN len(regexp_extract_all(text, {q(L.WORD)})) >= 60 THEN 'quote-too-long' END], lambda x: x IS NOT NULL)) AS rule FROM rated
            UNION ALL SELECT unnest(list_filter([CASE WHEN num % 5 = 0 THEN 'name-forbidden' END, CASE WHEN num % 2 = 0 THEN 'variant-allowed-and-forbidden' END, CASE WHEN num % 3 = 0 THEN 'word-preferred-and-banned' END, CASE WHEN num % 2 = 0 AND num % 7 = 0 THEN 'inconsistent-but-active' END,
                                    CASE WHEN num % 4 = 0 THEN 'weights-do-not-sum-to-one' END, CASE WHEN num % 6 = 0 THEN 'unknown-decision' END], lambda x: x IS NOT NULL)) FROM products
            UNION ALL SELECT unnest(list_filter([CASE WHEN p_partkey % 3 > 0 AND p_partkey % 5 = 0 THEN 'has-claim-without-ids' END, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 > 0 THEN 'needs-claim-with-ids' END], lambda x: x IS NOT NULL)) FROM part
            UNION ALL SELECT unnest(list_filter([CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 1 THEN 'override-missing' END, CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 3 > 0 THEN 'approved-with-blocks' END, CASE WHEN o_orderkey % 4 = 0 THEN 'override-without-reason' END,
                                    CASE WHEN o_orderkey % 12 > 10 THEN 'count-exceeds-total' END], lambda x: x IS NOT NULL)) FROM orders)
            SELECT rule, count(*) AS n FROM v GROUP BY rule""",
        "column_constraints": """WITH v AS (SELECT unnest(list_filter([CASE WHEN l_orderkey IS NULL THEN 'l_orderkey: required' END, CASE WHEN l_shipdate IS NULL THEN 'l_shipdate: required' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'l_returnflag: enum' END,
            CASE WHEN l_linestatus NOT IN ('O', 'F') THEN 'l_linestatus: pattern' END, CASE WHEN l_quantity NOT BETWEEN 1 AND 45 THEN 'l_quantity: range' END, CASE WHEN l_discount > 0.09::DOUBLE THEN 'l_discount: range' END, CASE WHEN length(l_returnflag) <> 1 THEN 'l_returnflag: length' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem)
            SELECT rule, count(*) AS n FROM v GROUP BY rule""",
        "section_alloc": sections(names).replace("{category}", category),
        "token_estimate": f"""WITH {CLAIMS_SQL}, {PRODUCT_SOURCES_SQL}, c AS (SELECT product_id, count(*) FILTER (status = 'verified') AS v FROM claims GROUP BY product_id), w AS (SELECT product_id, sum(words)::BIGINT AS w FROM psources WHERE status = 'active' GROUP BY product_id),
            x AS (SELECT product_id, least(coalesce(v, 0), {reports.SLICE}) * {reports.PER_CLAIM} AS s, coalesce(w, 0) AS w FROM c FULL JOIN w USING (product_id))
            SELECT product_id, unnest(['eval', 'quick-check', 'ingest', 'content']) AS kind, unnest([49600, 15000 + s, floor(w * 1.4::DOUBLE * 3)::BIGINT, s * 2 + 40000 + (4 * (s + 6000) + 30000) * {1 + reports.AUTO_ROUNDS}]) AS tokens FROM x""",
        "retention": f"""WITH {rounds}, r AS (SELECT *, max(CASE WHEN status = 'approved' THEN round END) OVER (PARTITION BY item_id) AS live FROM rounds)
            SELECT 'round' AS kind, item_id, round FROM r WHERE created_at < TIMESTAMP '2000-01-01' - INTERVAL 365 DAY AND round IS DISTINCT FROM live AND round % 4 <> 0
            UNION ALL SELECT 'run', event_id, NULL FROM events WHERE ts - INTERVAL 25 YEAR < TIMESTAMP '2000-01-01' - INTERVAL 365 DAY""",
        "review_queue": f"WITH {review} SELECT *, category NOT IN ({HIGH}) AS bulk_allowed FROM queue",
        "gaps": f"""WITH {conflicts}, {PROOFS}, {best} SELECT 'zero-coverage' AS gap_type, t.category AS key, '0' AS detail FROM {topics} t WHERE t.category NOT IN (SELECT category FROM rated WHERE status <> 'deprecated')
            UNION ALL SELECT 'review-backlog', product_id || '/' || category || '/' || trim(string_split(location, '>')[1]), count(*)::VARCHAR FROM rated WHERE status = 'needs-review' GROUP BY ALL
            UNION ALL SELECT 'open-conflict', product_id, count(*)::VARCHAR FROM conflicts GROUP BY product_id
            UNION ALL SELECT 'proof-without-claim', product_id, count(*)::VARCHAR FROM linked WHERE ids IS NULL GROUP BY product_id
            UNION ALL SELECT 'doc-correction', id, o_orderkey::VARCHAR FROM orders JOIN claims ON id = {CID.format('o_custkey')} WHERE o_orderstatus = 'P'
            UNION ALL SELECT 'unanswered-objection', item_id::VARCHAR, '' FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM best WHERE r = 1 AND covered >= 0.5)""",
    }
