"""The driver's queries over the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_knn, toxicity_ssk
from .byte_bpe import decode_ids, encode_texts
from .chat_format import format_chats, read_back, turns_to_events
from .common import crc_mod, table
from .exact_dedup import exact_dedup
from .filter_audit import audit, failures, text_filters
from .lm_logbilinear import score_texts
from .merkle_manifest import FIELDS, fold, leaf_of, manifest, proof_digest
from .ngram_join import ngram_join
from .source_mix import mix_sources
from .substring_dedup import drop_passages
from .token_counts import count_tokens
from .topk_pivot import top_k


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    awkward = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", awkward), (-7, 1, "assistant", awkward)], "conv_id long, turn long, role string, text string")
    read = read_back(format_chats(turns_to_events(rows.unionByName(more), revised=True)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|start|><|message|><|end|>') + 2 * length(role || text) - length(translate(role || text, '<[\', '')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS uid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (SELECT uid, len(w) AS words, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w), g AS (
  SELECT uid, words, i, hash(concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o)) AS sh FROM t WINDOW o AS (PARTITION BY uid ORDER BY i)
), d AS (SELECT DISTINCT uid, sh FROM g WHERE i <= greatest(1, words - 4)), s AS (
  SELECT w.doc_id, w.uid, count(d.sh) AS n FROM w LEFT JOIN d USING (uid) GROUP BY w.doc_id, w.uid
), x AS (SELECT uid, n, sh FROM d JOIN s USING (uid)), e AS (
  SELECT a.uid AS a, b.uid AS b FROM x a JOIN x b USING (sh) WHERE a.uid <> b.uid AND a.n * 100 >= 80 * b.n AND b.n * 100 >= 80 * a.n
  GROUP BY a.uid, b.uid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(uid, r) AS (SELECT uid, uid FROM s UNION SELECT reach.uid, e.b FROM reach JOIN e ON e.a = reach.r),
least AS (SELECT reach.uid, min(s.doc_id) AS component_id FROM reach JOIN s ON s.uid = reach.r GROUP BY reach.uid)
SELECT doc_id, n AS n_shingles, component_id FROM s JOIN least USING (uid)
"""


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 0
    voters = quality_knn.train(docs, table(spark, sf_dir, "labels"), "quality", ~held_out)
    scored = quality_knn.score_quality(docs, voters)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_mod("doc_id", 3) == 1
    machine = toxicity_ssk.train(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out)
    scored = toxicity_ssk.score_toxicity(docs, machine)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = decode_ids(encode_texts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) != 0)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p
)
SELECT * FROM r WHERE rank <= 5
"""


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws(' ', doc_id::VARCHAR, coalesce(text, ''))) AS key, row_number() OVER () AS uid
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no,
         ([3, 1, 2])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source
), level(step, l) AS (  -- share out by weight, cap, share the rest again until no source is above its cap
  SELECT 0, (SELECT 1.5::DOUBLE * sum(source_size) / sum(weight) FROM s)
  UNION ALL
  SELECT step + 1, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - (SELECT coalesce(sum(2.0::DOUBLE * source_size), 0) FROM s WHERE 2.0::DOUBLE * source_size <= l * weight))
                   / (SELECT sum(weight) FROM s WHERE 2.0::DOUBLE * source_size > l * weight)
  FROM level WHERE step < (SELECT count(*) FROM s)
), goal AS (
  SELECT s.*, least(2.0::DOUBLE * source_size, coalesce((SELECT max(l) FROM level), 0) * weight) AS target FROM s
), c AS (
  SELECT sum(size) AS words, greatest(1, least(1024, (1.5::DOUBLE * sum(size))::BIGINT // 65536)) AS block FROM d
), span AS (
  SELECT no, floor((sum(target) OVER (ORDER BY no) - target) / sum(target) OVER () * 2147483648) AS lo,
         floor(sum(target) OVER (ORDER BY no) / sum(target) OVER () * 2147483648) AS hi FROM goal
), slot AS (
  SELECT i, (i % 2147483648) * 1327217885 % 2147483648 AS point
  FROM (SELECT unnest(range(ceil(1.05::DOUBLE * 1.5::DOUBLE * words / block)::BIGINT)) AS i FROM c)
), served AS (
  SELECT no, row_number() OVER (PARTITION BY no ORDER BY i) - 1 AS rank FROM slot JOIN span ON point >= lo AND point < hi
), placed AS (
  SELECT d.doc_id, d.uid, d.size, source_size, no, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, uid) - size AS pos
  FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source
), run AS (
  SELECT uid, no, pos + k * source_size AS lo, least(pos + k * source_size + size, floor(target)::BIGINT) AS hi FROM placed, (VALUES (0), (1)) r(k)
), piece AS (
  SELECT uid, no, lo, hi, unnest(range((lo // block)::BIGINT, ((hi - 1) // block + 1)::BIGINT)) AS rank, block FROM run, c WHERE hi > lo
), got AS (
  SELECT uid, sum(least(hi, (rank + 1) * block) - greatest(lo, rank * block))::BIGINT AS taken FROM piece JOIN served USING (no, rank) GROUP BY uid
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN got USING (uid)
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) == 0), leaf_of([tampered if f == "text" else F.col(f) for f in FIELDS]))
    rows = manifest(table(spark, sf_dir, "documents"), also={"changed": changed})
    folded = rows.withColumn("folded_root", fold(F.coalesce("changed", "digest"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, n_chars, lang,
         list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda acc, b:
           list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))) AS crc
  FROM documents
), f AS (
  SELECT *, CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS later,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM d
), leaf AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(later) || ':' || later, '-')) AS now FROM f
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaf
), node(level, source, pos, n, digest) AS (
  SELECT 0, source, pos, n, leaf FROM numbered
  UNION ALL
  SELECT level + 1, source, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY level, source, pos // 16, n
), subroot AS (
  SELECT source, digest, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1
), upper(level, pos, n, digest) AS (
  SELECT 0, pos, n, digest FROM subroot
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 16, n
), root AS (SELECT digest AS root FROM upper WHERE n = 1), row AS (
  SELECT row_number() OVER () AS uid, l.doc_id, l.leaf, l.now, l.source, l.pos, s.digest AS subroot, s.pos AS place, s.height FROM numbered l JOIN subroot s ON l.source IS NOT DISTINCT FROM s.source
), step AS (
  SELECT uid, level, coalesce(string_agg(digest, '' ORDER BY x.pos) FILTER (x.pos < (r.pos >> (4 * level))), '') AS before, coalesce(string_agg(digest, '' ORDER BY x.pos) FILTER (x.pos > (r.pos >> (4 * level))), '') AS after
  FROM row r JOIN node x ON r.source IS NOT DISTINCT FROM x.source AND x.n > 1 AND (x.pos >> 4) = (r.pos >> (4 * level + 4)) GROUP BY uid, level
  UNION ALL
  SELECT uid, height + level, coalesce(string_agg(digest, '' ORDER BY x.pos) FILTER (x.pos < (place >> (4 * level))), ''), coalesce(string_agg(digest, '' ORDER BY x.pos) FILTER (x.pos > (place >> (4 * level))), '')
  FROM row r JOIN upper x ON x.n > 1 AND (x.pos >> 4) = (place >> (4 * level + 4)) GROUP BY uid, height, level
), folded(uid, level, digest) AS (
  SELECT uid, 0, now FROM row
  UNION ALL
  SELECT f.uid, f.level + 1, sha256(before || digest || after) FROM folded f JOIN step s ON s.uid = f.uid AND s.level = f.level
), proof AS (
  SELECT r.uid, sha256(coalesce(string_agg(before || after, '' ORDER BY level), '')) AS proof_sha256 FROM row r LEFT JOIN step USING (uid) GROUP BY r.uid
), last AS (SELECT uid, max_by(digest, level) AS folded_root FROM folded GROUP BY uid)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM row JOIN proof USING (uid) JOIN last USING (uid), root
"""


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (SELECT uid, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d), later AS (
  SELECT uid, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id NULLS LAST, i) > 1 AS later FROM x
), t AS (SELECT uid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d), c AS (
  SELECT uid, i, word, coalesce(bool_or(later) OVER (PARTITION BY uid ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM t LEFT JOIN later USING (uid, i)
)
SELECT doc_id, count(i) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN c USING (uid) GROUP BY uid, doc_id
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), text_filters())
    return audit(counts, "ABCDE")


OP13_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), d AS (
  SELECT row_number() OVER () AS uid, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t),
         regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY part, fails
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT part, filter_order, n, good, toxic, fails, len(list_filter(fails, lambda f: f)) AS n_fails, unnest(range(1, 6)) AS step FROM c, o
), f AS (
  SELECT *, fails[ascii(filter_order[step]) - 64] AS own, len(list_filter(range(1, step), lambda i: fails[ascii(filter_order[i]) - 64])) > 0 AS gone FROM s
), g AS (
  SELECT part, filter_order, step::INTEGER AS step, sum(n) FILTER (NOT own AND NOT gone) AS kept, sum(n) FILTER (own AND NOT gone) AS removed, sum(n) FILTER (own AND gone) AS redundant,
         sum(n) FILTER (own AND n_fails = 1) AS unique_fails, sum(good) FILTER (own AND NOT gone) AS good_lost, sum(toxic) FILTER (own AND NOT gone) AS toxic_lost
  FROM f GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, filter_order[step]), 0)::BIGINT AS shapley
FROM g
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_chat_formatting": op2_chat_formatting,
        "op3_ngram_join": op3_ngram_join,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_toxicity": op5_toxicity,
        "op6_token_counts": op6_token_counts,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_exact_topk": op9_exact_topk,
        "op10_source_mixing": op10_source_mixing,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_substring_dedup": op12_substring_dedup,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_chat_formatting": OP2_SQL, "op3_ngram_join": OP3_SQL, "op9_exact_topk": OP9_SQL, "op10_source_mixing": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_filter_audit": OP13_SQL}
