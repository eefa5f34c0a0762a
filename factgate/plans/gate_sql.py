"""The gate's registered queries as DuckDB SQL."""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions import text as T
from .sql_text import listed, q, stem, stripped_tags, tokens


def said(c: str) -> str:
    return f"lower(trim(regexp_replace({stripped_tags(c)}, {q(T.SPACE + '+')}, ' ', 'g')))"


def _found(c: str, pattern: str) -> str:
    return f"regexp_extract_all({c}, {q(pattern)})"


def stems(c: str) -> str:
    return f"list_distinct(list_transform(list_filter({tokens(stripped_tags(c))}, lambda w: length(w) > 1), lambda w: {stem('w', L.GATE_SUFFIXES)}))"


def _numbers(c: str) -> str:
    """Digits behind a letter do not begin a number: the first of them is masked."""
    masked = f"regexp_replace({stripped_tags(c)}, '([A-Za-z])\\d', '\\1#', 'g')"
    return f"list_distinct(list_transform({_found(masked, L.NUMBER_WITH_UNIT)}, lambda n: regexp_replace(lower(regexp_replace(n, '\\s', '', 'g')), '[.,]+$', '')))"


def _word_in(hay: str, word: str, end: str) -> str:
    return f"regexp_matches({hay}, '\\b' || regexp_escape({word}) || '{end}')"


_EMPTY = "[]::VARCHAR[]"


def report(verdicts: str, high: str) -> str:
    """verdicts: CTEs up to `rated`, the claims with category and confidence; high: high-risk categories."""
    return f"""WITH {verdicts}, li AS (
      SELECT *, l_orderkey AS item_id, 'PT-' || lpad(l_partkey::VARCHAR, 8, '0') AS cid,
             'It leaves with ' || l_quantity::INT || ' others from ' || l_suppkey || CASE WHEN l_tax = 0 THEN '' ELSE ' [[PT-' || lpad(l_partkey::VARCHAR, 8, '0') || ']]' END || '.' AS text, (l_suppkey + index) % 9 AS way
      FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS index FROM lineitem)
    ), fits AS (
      SELECT o_orderkey AS item_id, o_orderstatus <> 'P' AND o_orderkey % 13 <> 0 AS ok, o_totalprice, o_orderpriority, o_custkey FROM orders
    ), rev AS (
      SELECT item_id, index + CASE WHEN item_id % 3 = 0 THEN 1 ELSE 0 END AS index, {said('text')} AS said, CASE WHEN way < 2 THEN 'block' ELSE 'pass' END AS verdict, CASE way WHEN 0 THEN 'partial' WHEN 1 THEN 'untagged' END AS reason
      FROM li JOIN fits USING (item_id) WHERE ok AND way <> 8
    ), by_text AS (SELECT item_id, said, arg_max(verdict, index) AS verdict, arg_max(coalesce(reason, ''), index) AS reason FROM rev GROUP BY item_id, said
    ), u AS (
      SELECT li.item_id, li.index, li.l_suppkey, li.l_tax, CASE WHEN i.said = {said('li.text')} THEN i.verdict ELSE t.verdict END AS rv, CASE WHEN i.said = {said('li.text')} THEN i.reason ELSE nullif(t.reason, '') END AS rr,
             CASE WHEN li.l_tax = 0 THEN NULL WHEN c.id IS NULL THEN 'missing-claim' WHEN c.status = 'deprecated' THEN 'deprecated' WHEN c.status <> 'verified' THEN 'needs-review'
                  WHEN c.confidence = 'low' AND c.category IN ({high}) THEN 'high-risk-low-confidence' WHEN c.confidence = 'low' THEN 'low-confidence' END AS mr
      FROM li LEFT JOIN rated c ON c.id = li.cid LEFT JOIN rev i ON i.item_id = li.item_id AND i.index = li.index LEFT JOIN by_text t ON t.item_id = li.item_id AND t.said = {said('li.text')}
    ), v AS (
      SELECT item_id, CASE WHEN mr IS NOT NULL AND mr <> 'low-confidence' THEN 'block' WHEN mr = 'low-confidence' AND rv = 'pass' THEN 'flag'
                           WHEN ok AND l_suppkey % 2 = 0 AND l_tax = 0 AND coalesce(rv, 'block') = 'block' AND (rv IS NULL OR rr = 'untagged') THEN 'pass' ELSE coalesce(rv, 'block') END AS verdict FROM u JOIN fits USING (item_id)
    ), checkers AS (
      SELECT item_id, checker, (item_id + length(checker)) % 6 AS told FROM (
        SELECT item_id, unnest(list_filter(['style-checker', CASE WHEN o_orderpriority < '3' THEN 'best-practice-auditor' END, CASE WHEN o_custkey % 2 = 0 THEN 'synthetic-buyer' END], lambda x: x IS NOT NULL)) AS checker FROM fits)
    ), flags AS (
      SELECT item_id, CASE verdict WHEN 'block' THEN 'block' ELSE 'low' END AS severity, NULL AS missing FROM v WHERE verdict <> 'pass'
      UNION ALL SELECT item_id, 'block', NULL FROM fits WHERE NOT ok
      UNION ALL SELECT item_id, CASE WHEN l_quantity > 47 THEN 'block' ELSE 'low' END, NULL FROM li JOIN fits USING (item_id) WHERE ok AND index = 3 AND l_quantity > 40
      UNION ALL SELECT item_id, CASE WHEN checker = 'synthetic-buyer' THEN CASE WHEN told >= 4 THEN 'low' END WHEN told < 2 THEN 'high' END, CASE WHEN told = 0 OR (told = 1 AND checker <> 'synthetic-buyer') THEN checker END FROM checkers
      UNION ALL SELECT item_id, CASE WHEN l_discount >= 0.1 THEN 'high' ELSE 'low' END, NULL FROM li JOIN checkers USING (item_id) WHERE checker = 'style-checker' AND told >= 2 AND l_discount >= 0.08
    ), n AS (
      SELECT item_id, count(*) FILTER (severity = 'block') AS block_count, count(*) FILTER (severity = 'high') AS high_count, count(*) FILTER (severity = 'low') AS low_count, coalesce(string_agg(DISTINCT missing, ',' ORDER BY missing), '') AS missing
      FROM fits LEFT JOIN flags USING (item_id) GROUP BY item_id)
    SELECT n.*, CASE WHEN block_count + high_count > 0 AND o_totalprice > 300000 THEN 'approved-override' WHEN block_count > 0 THEN 'blocked' WHEN high_count > 0 THEN 'flagged' ELSE 'approved' END AS status FROM n JOIN fits USING (item_id)"""


def seeds(claims: str) -> str:
    """CTEs up to `seeds`: the labelled sentences of every claim."""
    return f"""{claims}, kinds AS (
      SELECT id AS item_id, product_id, status AS claim_status, text AS claim, unnest([
        {{'index': 0, 'label': 'true', 'text': text || ' [[' || id || ']]'}}, {{'index': 1, 'label': 'false', 'text': regexp_replace(text, '(\\d+) (units|per|connectors)', '9\\1 \\2', 'g') || ' [[' || id || ']]'}},
        {{'index': 2, 'label': 'overstated', 'text': 'Always ' || text || ' [[' || id || ']]'}}, {{'index': 3, 'label': 'untagged', 'text': text}},
        {{'index': 4, 'label': 'partial', 'text': regexp_replace(text, '\\.$', '') || ' and reconciles quarterly ledgers across warehouses. [[' || id || ']]'}}]) AS s FROM claims
    ), seeds AS (SELECT item_id, product_id, claim_status, claim, s.index AS index, s.label AS label, s.label <> 'untagged' AS tagged, s.text AS text, {stripped_tags('s.text')} AS plain FROM kinds)"""


def overlap(made: str) -> str:
    """CTEs up to `near`, from those up to `seeds`: seeds with best_id, reg_n, reg_ratio."""
    return f"""{made}, ct AS (SELECT product_id, id, text AS ctext, list_distinct({tokens('text')}) AS t FROM claims),
    qt AS (SELECT DISTINCT product_id, plain, list_distinct({tokens('plain')}) AS t FROM seeds),
    pairs AS (SELECT qt.product_id, plain, id, len(list_intersect(qt.t, ct.t)) / (sqrt(len(qt.t)) * sqrt(len(ct.t))) AS score FROM qt JOIN ct ON qt.product_id = ct.product_id AND list_has_any(qt.t, ct.t)),
    best AS (SELECT product_id, plain, id AS best_id FROM pairs QUALIFY row_number() OVER (PARTITION BY product_id, plain ORDER BY score DESC, id) = 1),
    st AS (SELECT DISTINCT plain, list_filter({stems('plain')}, lambda w: NOT list_contains({listed(L.GENERIC_STEMS)}, w)) AS own FROM seeds),
    cst AS (SELECT id, {stems('text')} AS cs FROM claims),
    near AS (SELECT s.*, best_id, own, coalesce(len(list_intersect(own, cs)), 0) AS reg_n, CASE WHEN len(own) > 0 THEN coalesce(len(list_intersect(own, cs)) / len(own), 0) ELSE 0 END AS reg_ratio
             FROM seeds s JOIN st USING (plain) LEFT JOIN best USING (product_id, plain) LEFT JOIN cst ON cst.id = best_id)"""


def verified(made: str) -> str:
    """CTEs up to `verdicts`, from those up to `seeds`: near with classification, verdict, reason; each seed cites its own claim or nothing."""
    matches = lambda p, c="t": f"regexp_matches({c}, {q(p)})"
    keys = f"list_filter({tokens('cond')}, lambda w: length(w) > 2)"
    return f"""{overlap(made)}, vocab AS (
      SELECT product_id, list(stem) AS vocabulary FROM (SELECT product_id, stem, count(*) AS n FROM (SELECT product_id, id, unnest({stems('text')}) AS stem FROM claims) GROUP BY ALL) JOIN (SELECT product_id, count(*) AS size FROM claims GROUP BY ALL) USING (product_id)
      WHERE n >= 2 AND n < greatest(5, size * 0.2::DOUBLE) GROUP BY product_id
    ), f AS (
      SELECT *, trim(plain) AS t, {_numbers('plain')} AS sn, {_numbers('claim')} AS cn, {stems('plain')} AS sst, {stems('claim')} AS cst2,
             {matches(L.SUPERLATIVE, 'trim(plain)')} AS absolute, {matches(L.FACT_VERB, 'trim(plain)')} AS verb, {matches(L.NORMATIVE, 'trim(plain)')} AS normative FROM near LEFT JOIN vocab USING (product_id)
    ), c AS (
      SELECT *, CASE WHEN t = '' OR ends_with(t, '?') OR ({matches(L.CALL_TO_ACTION)} AND len(sn) = 0) THEN 'positioning'
          WHEN reg_n >= 3 AND reg_ratio >= 0.6 AND NOT normative THEN 'factual'
          WHEN len(regexp_split_to_array(t, '\\s+')) <= 7 AND (len(sn) > 0 OR (absolute AND verb) OR {matches(L.QUANTIFIER)}) THEN 'positioning-hiding-fact'
          WHEN len(regexp_split_to_array(t, '\\s+')) <= 7 THEN CASE WHEN tagged THEN 'factual' ELSE 'positioning' END
          WHEN len(sn) > 0 OR tagged THEN 'factual'
          WHEN ({matches('(?i)^(if|imagine|what if|picture|when)' + chr(92) + 'b')} AND NOT absolute AND reg_ratio < 0.6) OR normative THEN 'positioning'
          WHEN reg_n >= 3 AND reg_ratio >= 0.5 THEN 'factual' WHEN reg_n <= 1 AND NOT absolute THEN 'positioning' WHEN verb THEN 'factual' ELSE 'positioning' END AS classification,
        list_filter(own, lambda w: NOT list_contains(cst2, w) AND NOT regexp_full_match(w, '\\d+')) AS extra, {_found('t', L.SUPERLATIVE)} AS bold, {_found('claim', L.CONDITION)} AS conds FROM f
    ), r AS (
      SELECT *, CASE WHEN classification = 'positioning' THEN NULL WHEN NOT tagged THEN 'untagged' WHEN claim_status = 'deprecated' THEN 'deprecated' WHEN claim_status <> 'verified' THEN 'needs-review'
          WHEN len(list_filter(bold, lambda w: NOT {_word_in('lower(claim)', 'lower(w)', chr(92) + 'b')})) > 0 THEN 'overstated'
          WHEN len(list_filter(sn, lambda x: NOT list_contains(cn, x))) > 0 THEN CASE WHEN len(cn) > 0 THEN 'contradicted' ELSE 'partial' END
          WHEN {matches(L.GATE_NEGATION)} <> {matches(L.GATE_NEGATION, 'claim')} AND len(list_intersect(sst, cst2)) / greatest(1, len(sst) + len(cst2) - len(list_intersect(sst, cst2))) >= 0.6 THEN 'contradicted'
          WHEN len(list_filter(conds, lambda cond: len(list_filter(CASE WHEN len({keys}) > 0 THEN {keys} ELSE [trim(lower(cond))] END, lambda w: NOT {_word_in('lower(t)', 'w', '')})) > 0)) > 0 THEN 'overstated'
          WHEN len(own) > 0 AND ((len(extra) >= 2 AND (len(extra) / len(own) > 0.34 OR list_has_any(extra, coalesce(vocabulary, {_EMPTY})))) OR len(extra) >= 4) THEN 'partial' END AS reason FROM c
    ), verdicts AS (SELECT *, CASE WHEN reason IS NULL THEN 'pass' ELSE 'block' END AS verdict FROM r)"""


def repairs(claims: str) -> str:
    return f"""WITH {verified(seeds(claims))}, w AS (
      SELECT label, v.item_id, reason, CASE WHEN reason IN ('overstated', 'partial', 'contradicted', 'combined-conclusion') AND tagged THEN v.item_id WHEN reason = 'untagged' THEN best_id END AS want, tagged, sst, reason AS why FROM verdicts v WHERE verdict = 'block'
    ), x AS (SELECT w.*, c.id AS got, tagged AND why <> 'untagged' OR len(list_intersect(sst, {stems('c.text')})) / greatest(1, len(sst)) >= 0.8 AS good FROM w LEFT JOIN claims c ON c.id = want AND c.status = 'verified')
    SELECT label, reason, count(*) AS n, count(got) FILTER (good) AS n_repaired, count(*) FILTER (good AND got = item_id) AS n_own FROM x GROUP BY label, reason"""


def sampled(claims: str) -> str:
    """CTEs up to `seeds`, from those up to `rated`: at most 12 labelled sentences a product and label, and their place on a page of 40."""
    whole, bare = f"md5(concat_ws('/', id, label, '7'))", "regexp_replace({}, '\\.+$', '')"
    condition = f"regexp_extract(text, {q(L.SAMPLE_CONDITION)}, 1)"
    verb, head = f"regexp_extract(text, {q(L.SAMPLE_VERB)}, 2)", f"regexp_extract(text, {q(L.SAMPLE_VERB)}, 1)"
    bold = f"({listed(L.OVERSTATING)})[(rn - 1) % {len(L.OVERSTATING)} + 1]"
    return f"""{claims}, drawn AS (
      SELECT *, row_number() OVER w AS rn, lead(text) OVER w AS next FROM (
        SELECT product_id, id, text, status, unnest(CASE WHEN status <> 'verified' THEN ['not-citable'] WHEN category = 'market-evidence' THEN []::VARCHAR[] WHEN regexp_matches(text, '\\b\\d+\\b') THEN ['true', 'untagged', 'false', 'overstated', 'partial'] ELSE ['true', 'untagged', 'overstated', 'partial'] END) AS label FROM rated)
      WINDOW w AS (PARTITION BY product_id, label ORDER BY {whole}, id)
    ), worded AS (
      SELECT *, CASE label WHEN 'false' THEN regexp_replace(text, '\\b\\d+', (CASE WHEN n < 1000 THEN 2 * n + 1 ELSE n // 2 END)::VARCHAR)
          WHEN 'overstated' THEN CASE WHEN {condition} <> '' AND rn % 2 = 1 THEN replace(replace(text, {condition}, ''), ' .', '.')
            WHEN {verb} = '' THEN 'Only ' || lower(text[1]) || text[2:] WHEN {verb} IN ('is', 'are') THEN concat_ws(' ', {head}, {verb}, {bold}) || regexp_replace(text, {q(L.SAMPLE_VERB)}, '')
            ELSE concat_ws(' ', {head}, regexp_replace({bold}, '^the ', ''), {verb}) || regexp_replace(text, {q(L.SAMPLE_VERB)}, '') END
          WHEN 'partial' THEN {bare.format('text')} || ', and it also ' || regexp_replace({bare.format('next')}, {q(L.GRAFTED_VERB)}, '\\1') ELSE text END AS said
      FROM (SELECT *, nullif(regexp_extract(text, '\\b(\\d+)(\\.\\d+)?\\b', 1), '')::BIGINT AS n FROM drawn)
      WHERE CASE WHEN label = 'partial' THEN rn % 2 = 1 AND rn < 24 AND next IS NOT NULL ELSE rn <= 12 END
    ), labelled AS (
      SELECT product_id, id, id AS item_id, label, status AS claim_status, text AS claim, label <> 'untagged' AS tagged, said || CASE WHEN label = 'untagged' THEN '' WHEN regexp_matches(said, '[.!?]$') THEN ' [[' || id || ']]' ELSE '. [[' || id || ']]' END AS text FROM worded
      UNION ALL SELECT product_id, 'pos-' || i, NULL, 'positioning', NULL, NULL, false, ({listed(L.POSITIONING_SAMPLES)})[i + 1] FROM (SELECT DISTINCT product_id FROM claims), (SELECT unnest(range({len(L.POSITIONING_SAMPLES)})) AS i)
    ), seeds AS (
      SELECT *, (row_number() OVER (PARTITION BY product_id ORDER BY md5(concat_ws('/', id, label)), id, label) - 1) // 40 AS page, {stripped_tags('text')} AS plain FROM labelled
    )"""


def eval_pages(claims: str, high: str) -> str:
    """claims: CTEs up to `rated` and `conflicts`.  Each seed is one sentence here, so a unit of its page."""
    return f"""WITH {verified(sampled(claims))}, units AS (
      SELECT v.product_id, page, v.label, v.item_id, {said('v.plain')} AS words, v.verdict = 'block' OR (tagged AND r.confidence = 'low' AND r.category IN ({high})) AS blocks, r.id AS cited
      FROM verdicts v LEFT JOIN rated r ON tagged AND r.id = v.item_id
    ), here AS (
      SELECT product_id, page, a, b, bool_or(kind = 'absolute-vs-exception' AND regexp_matches(claims.text, {q(L.SUPERLATIVE)})) AS bad
      FROM units u JOIN conflicts x USING (product_id) JOIN claims ON claims.id = u.cited WHERE cited IN (a, b) GROUP BY ALL
    ), judged AS (
      SELECT u.*, blocks OR EXISTS (SELECT 1 FROM here h WHERE h.bad AND h.product_id = u.product_id AND h.page = u.page AND u.cited IN (h.a, h.b)) AS blocked FROM units u
    ), told AS (SELECT *, bool_or(blocked) OVER (PARTITION BY product_id, page, words) AS stopped FROM judged)
    SELECT label, count(*) AS n, count(*) FILTER (stopped) AS blocked, count(*) FILTER (stopped = (label IN ('true', 'positioning'))) AS misses FROM told GROUP BY label"""
