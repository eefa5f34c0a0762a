import base64
import hashlib
import math
import os
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import oracle
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from factgate.llm import quality_knn, queries
from factgate.llm.common import crc_mod

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    oracle.same(queries.queries()[name](spark, oracle.SF), queries.oracle_sql()[name])


def near_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    group = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and 100 * len(a & b) >= 80 * len(a | b) and group[i] != group[j]:
                lo, hi = sorted((group[i], group[j]))
                group = {k: lo if g == hi else g for k, g in group.items()}
    return group


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "source_mix", "byte_bpe"]

    def step(name, docs):
        out = str(tmp_path / name)
        stages[name](spark, docs, oracle.SF).write.parquet(out)
        return spark.read.parquet(out)

    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    voters = quality_knn.train(docs, spark.read.parquet(f"{oracle.SF}/labels.parquet"), "quality", crc_mod("doc_id", 5) != 0)
    before = texts(docs)
    scores = quality_knn.vote(voters, np.array([quality_knn.term_counts(t) for t in before.values()]))
    good = step("quality_classifier", docs)
    assert good.columns == columns and set(texts(good)) == {i for i, s in zip(before, scores) if s >= 0.3}

    last = {}
    for i, t in sorted(texts(good).items()):
        last[t] = i
    single = step("exact_dedup", good)
    assert single.columns == columns and set(texts(single)) == set(last.values())

    group = near_groups(texts(single))
    distinct = step("ngram_jaccard_join", single)
    assert distinct.columns == columns and set(texts(distinct)) == set(group.values())

    mixed = step("source_mix", distinct)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/ngram_jaccard_join/*.parquet'")
    takes = {i: int(taken / max(size, 1) + 0.5) for i, size, taken in c.sql(f"SELECT doc_id, size, taken FROM ({queries.OP10_SQL})").fetchall()}
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in takes.items() if n})

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded, left = step("byte_bpe", mixed).collect(), texts(mixed)
    assert len(encoded) == mixed.count()
    for r in encoded:
        assert r.ids == enc.encode_ordinary(left[r.doc_id]) and r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(left[r.doc_id].encode()).hexdigest()


def test_stages_take_clashing_columns_nulls_and_empty_tables(spark):
    rows = [(1, "Some plain words of text here.", "en", "a", 1, 2, "x"), (2, None, None, None, 1, 2, "x"), (None, "", "en", "a", 1, 2, "x"), (3, "Some plain words of text here.", "en", "b", 1, 2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, ids int, __take string")
    for table in (docs, docs.limit(0)):
        kept = table.count()
        for name, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, oracle.SF)
            if name != "byte_bpe":
                assert table.columns == docs.columns, name
        got = table.collect()
        assert table.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"] and (len(got) > 0) == (kept > 0)
        # Equal texts of 1 and 3 are one document, the mix takes none more than twice.
        assert {r.doc_id for r in got} <= {None, 1, 2, 3} and len({1, 3} & {r.doc_id for r in got}) <= 1 and all(sum(x == r for x in got) <= 2 for r in got)


def registered(spark, name):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").collect()}
    got = queries.queries()[name](spark, oracle.SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    return docs, {r.doc_id: r for r in got}


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op4_and_op5_splits_thresholds_and_labels(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{oracle.SF}/labels.parquet").collect()}
    for name, n, at, cut, label in (("op4_quality_classifier", 5, 0, 0.3, "quality"), ("op5_toxicity", 3, 1, 0.7, "toxic")):
        _, got = registered(spark, name)
        for i, r in got.items():
            assert r.held_out == (remainder(i, n) == at) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        judged = [(labels[i][label], r.predicted) for i, r in got.items() if i in labels and r.held_out]
        assert judged and sum(a == b for a, b in judged) >= 0.85 * len(judged)


def test_op4_against_the_whole_vote(spark):
    """Every score from all labelled training documents, neighbour by neighbour."""
    docs, got = registered(spark, "op4_quality_classifier")
    labels = [(r.doc_id, int(r.quality == 1)) for r in spark.read.parquet(f"{oracle.SF}/labels.parquet").collect() if r.quality is not None and remainder(r.doc_id, 5)]
    rows = sorted({(x, quality_knn.term_counts(docs[i]).tobytes()) for i, x in labels if i in docs})
    voters = quality_knn.fit(np.array([np.frombuffer(c, np.float32) for _, c in rows]), np.array([x for x, _ in rows]))
    for i, text in docs.items():
        near = np.round(np.maximum(0, quality_knn.project(quality_knn.term_counts(text)[None], voters.idf, voters.axes) @ voters.vectors.T)[0], 5)
        first = sorted(range(len(near)), key=lambda j: (-near[j], j))[: quality_knn.NEIGHBOURS]
        weight = near[first].astype(float) ** quality_knn.POWER
        want = (weight * voters.labels[first]).sum() / weight.sum() if weight.sum() > 0 else 0.5
        assert abs(got[i].score - want) < 2e-3, i


def test_op6_and_op7_against_the_libraries(spark):
    docs, got = registered(spark, "op6_token_counts")
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, r in got.items():
        n = len(pieces.encode(docs[i]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[i].encode()), n, n > 4096)
    _, got = registered(spark, "op7_byte_bpe")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in got.items():
        ids, sha = enc.encode_ordinary(docs[i]), lambda b: hashlib.sha256(b).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(docs[i].encode()))


def test_op8_base_columns_and_normalised_scores(spark):
    docs, got = registered(spark, "op8_lm_scoring")
    words = lambda t: [w.decode() for w in t.encode().lower().split()] + [None]
    c = Counter(w for i, t in docs.items() if remainder(i, 10) for w in words(t))
    n, v = sum(c.values()), len(c)
    for i, r in got.items():
        w = words(docs[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(i, 10) == 0, len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-6 * len(w) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
