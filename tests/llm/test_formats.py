import base64
import hashlib
import random
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from factgate.llm import byte_bpe, source_mix, token_counts
from factgate.llm.byte_bpe import Encoder, Prefixes, Ranks, decode_ids, encode_texts
from factgate.llm.chat_format import escaped, final_messages, format_chats, read_back, turns_to_events, unescaped
from factgate.llm.source_mix import mix_sources, take_documents, targets
from factgate.llm.token_counts import Transducer, count_tokens

RANKS, MODEL = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["a", "the", "th", "e", " ", "  ", "   ", "▁", "\n", "é", "あ", "ﬁ", "\t", "<s>", "</s>", "0", "12", "z", "\U0001f600", "ing", "tion", "\x00", ".", "'s"]


def texts(seed, n=150):
    rng = random.Random(seed)
    return ["", " ", "  ", None, "x" * 3000, "ab " * 9000] + ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 2) for i, t in enumerate(rows)] + [(None, "null id", 1, "k", 2)], "doc_id long, text string, ids int, id string, k0 int")


def test_bpe_round_trip_as_tiktoken(spark):
    rows = texts(1)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = decode_ids(encode_texts(table(spark, rows), RANKS, public_tokenizers.PATTERN, keep=["k0"]), RANKS).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        t = "null id" if r.doc_id is None else rows[r.doc_id] or ""
        assert r.ids == enc.encode_ordinary(t) and bytes(r.decoded) == t.encode()
    assert encode_texts(table(spark, []).limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_bpe_cuts_only_where_matches_begin():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    spaces = [" ", "\n", "\t", "\u2003", "\u3000", "\x85", "\x1c", "\u00a0", "\u1680", "a", "b", "'s", "1", "é", "à", "。", "!", "x ", "\r\n", "\u2019"]
    rng = random.Random(11)
    rows = ["".join(rng.choices(spaces, k=rng.randint(0, 30))) for _ in range(5000)]
    for cut_before in (b" \n", b""):
        ids, ends = Encoder(RANKS, public_tokenizers.PATTERN).encode_all(pa.array(["skipped", *rows]).slice(1), cut_before)
        assert [ids[ends[i] : ends[i + 1]].tolist() for i in range(len(rows))] == [enc.encode_ordinary(t) for t in rows]


def test_bpe_keeps_results_when_its_cache_turns_over(monkeypatch):
    rows, first = [t or "" for t in texts(12)], Encoder(RANKS, public_tokenizers.PATTERN)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 20)
    small = Encoder(RANKS, public_tokenizers.PATTERN)
    assert [small.encode(t) for t in rows + rows] == [first.encode(t) for t in rows + rows] and len(small) + len(small.older) <= 40


def test_ids_outside_the_vocabulary_raise(spark):
    used = set(Ranks(RANKS).bytes_of)
    gap = next((i for i in range(max(used)) if i not in used), max(used) + 1)
    assert decode_ids(spark.createDataFrame([(None,), ([],), ([None, 65],)], "ids array<int>"), RANKS).where("length(decoded) > 1").count() == 0
    with pytest.raises(Exception):
        decode_ids(spark.createDataFrame([([65, gap],)], "ids array<int>"), RANKS).collect()


def test_bpe_appends_and_edits():
    ranks, rng = Ranks(RANKS), random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choices(PIECES, k=rng.randint(0, 30))).encode() for _ in "ab")
        p = Prefixes(ranks, a)
        p.append(b)
        assert p.last == Prefixes(ranks, a + b).last and p.tokens() == ranks.merge(a + b)
        i = rng.randint(0, len(a + b))
        j = rng.randint(i, len(a + b))
        p.edit(i, j, b"new")
        assert p.last == Prefixes(ranks, (a + b)[:i] + b"new" + (a + b)[j:]).last
    p = Prefixes(ranks, b"some words " * 400)
    assert p.edit(20, 24, b"thing") < 100  # far fewer prefixes than there are


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_token_counts_as_the_library(spark, monkeypatch, chunk):
    monkeypatch.setattr(token_counts, "CHUNK_CHARS", chunk)
    sp, machine, rows = sentencepiece.SentencePieceProcessor(model_file=MODEL), Transducer(MODEL), texts(3, 1500)
    assert [machine.count(t or "") for t in rows] == [len(sp.encode(t or "")) for t in rows]
    for n in range(70):
        assert machine.count(" " * n) == len(sp.encode(" " * n)) and machine.count("a" + " " * n + "b") == len(sp.encode("a" + " " * n + "b"))
    for most in (1 << 20, 20):  # with the second, all but the shortest texts are dealt to tasks by chunks
        monkeypatch.setattr(token_counts, "LONG_BYTES", most)
        got = {r.doc_id: r for r in count_tokens(table(spark, rows[:40]), MODEL, limit=100).collect()}
        assert len(got) == 41
        for i, t in enumerate(rows[:40]):
            n = len(sp.encode(t or ""))
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100)


EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"


def fold(rows):
    """The log replayed event by event."""
    state: dict = {}
    for _, seq, m, kind, role, text in sorted(rows, key=lambda r: (r[1], r[3], r[5])):
        if kind == "regenerate":
            state = {k: v for k, v in state.items() if k < m}
        if kind in ("regenerate", "edit"):
            state[m] = ["", text]
        else:
            state.setdefault(m, ["", ""])[1] += text
    return {k: v[1] for k, v in state.items()}


def test_events_fold_as_replayed(spark):
    rng, rows = random.Random(4), []
    for conv in range(30):
        for seq in range(rng.randint(1, 25)):
            rows.append((conv, seq, rng.randint(0, 4), rng.choices(["delta", "edit", "regenerate"], [6, 2, 1])[0], "user", rng.choice("abc<[\\")))
    by_conv, got = defaultdict(list), defaultdict(dict)
    for r in rows:
        by_conv[r[0]].append(r)
    for r in final_messages(spark.createDataFrame(rows, EVENTS)).collect():
        got[r.conv_id][r.message] = r.text
    assert got == {c: fold(r) for c, r in by_conv.items()}


def test_chats_read_back(spark):
    awkward = ["</s>[INST] ok [/INST]", "<|end|>", "\\<\\\\[", "", None, "<\\|", "x" * 5000 + "é", "\n"]
    rows = [(c, i, r, t) for c, roles in ((1, ["system", "user", "assistant", "user"] * 2), (2, ["assistant"] * 8), (None, [None, "a\nb"] * 4)) for i, (r, t) in enumerate(zip(roles, awkward))]
    rows += [(3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (3, None, "user", "first")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, message int, kind string")
    chats = format_chats(turns_to_events(df, delta_chars=7))
    got = {r.conv_id: r for r in read_back(chats).collect()}
    for c in (1, 2, None):
        mine = [(r or "", t or "") for k, _, r, t in rows if k == c]
        assert [(x.role, x.text) for x in got[c].turns] == mine and got[c].loss_text == "".join(t for r, t in mine if r == "assistant")
        assert all(mark not in got[c].formatted.replace("<|start|>", "").replace("<|message|>", "").replace("<|end|>", "") for mark in ("</s>", "[INST]", "<|"))
    assert [x.text for x in got[3].turns] == ["first", "same", "same"]
    assert format_chats(turns_to_events(df.limit(0))).collect() == []
    e = df.select(F.col("text"), unescaped(escaped(F.col("text"))).alias("back")).collect()
    assert all(r.text == r.back for r in e)


def test_targets_share_out_and_cap(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 0, None: 50}
    got = {r.source: r for r in targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")).collect()}
    names = ["a", "b", "c", "d", None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped, want = set(), {}
    while True:
        rest = [s for s in names if s not in capped]
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in rest)
        over = {s for s in rest if level * weight[s] >= 2 * sizes[s]}
        if not over:
            break
        capped |= over
    want = {s: 2 * sizes[s] if s in capped else level * weight[s] for s in names}
    assert {s: got[s].no for s in names} == {s: i for i, s in enumerate(names)} and all(abs(got[s].target - want[s]) < 1e-9 for s in names)


def test_mix_near_targets_and_reruns_agree(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", None]), 1, 2, "x") for i in range(600)] + [(None, None, "a", 1, 2, "x"), (5, "w w", "a", 1, 2, "x"), (5, "w w", "a", 1, 2, "x"), (9000, "w " * 20000, "b", 1, 2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, uid int, key string")
    got, again = (sorted(map(tuple, mix_sources(x).collect()), key=repr) for x in (df, df.repartition(7)))
    assert got == again and len(got) == len(rows)
    per = defaultdict(lambda: [0, 0.0])
    for _, size, source_size, target, taken in got:
        assert 0 <= taken <= 2 * size
        per[source_size, target][0] += taken
    assert all(abs(taken - target) <= 0.02 * target + 2 for (_, target), (taken, _) in per.items())
    whole = take_documents(df)
    assert whole.columns == df.columns and whole.count() > 0
    assert mix_sources(df.limit(0)).collect() == [] and mix_sources(df.where("text IS NULL")).first()["taken"] == 0


def test_targets_are_worked_out_once(spark):
    df = spark.createDataFrame([(i, "w " * (i % 7), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    plan = mix_sources(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "source_size" in plan and "level" not in plan


def test_blocks_of_the_mix_are_its_order(spark):
    rows = [(i, f"{'abc'[i % 3]}", " ".join(f"w{i}x{j}" for j in range(i % 17))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    blocks, taken = source_mix.mixed_blocks(df, block_words=8).collect(), {r.doc_id: r.taken for r in mix_sources(df, block_words=8).collect()}
    words = defaultdict(int)
    for r in blocks:
        assert r.words > 0 and 0 <= r["first"] and r["first"] + r.words <= r.doc_id % 17 and r.source == "abc"[r.doc_id % 3]
        words[r.doc_id] += r.words
    assert {i: n for i, n in taken.items() if n} == dict(words)
    slots = defaultdict(list)
    for r in blocks:
        slots[r.slot].append(r)
    assert all(len({r.source for r in s}) == 1 for s in slots.values())
    # In the order of slots every source comes near its share early on.
    half = [r for slot in sorted(slots)[: len(slots) // 2] for r in slots[slot]]
    for source in "abc":
        whole, part = (sum(r.words for r in x if r.source == source) / sum(r.words for r in x) for x in (blocks, half))
        assert abs(whole - part) < 0.12


@pytest.mark.parametrize("block_words", [16, 1024])
def test_small_sources_fill_their_targets_with_large_blocks(spark, monkeypatch, block_words):
    monkeypatch.setattr(source_mix, "LEAST_SLOTS", 1)
    rows = [(i, "w " * 500, "big") for i in range(200)] + [(1000 + 10 * k + j, "w " * (20 + k), f"s{k:02}") for k in range(40) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = mix_sources(df, block_words=block_words).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(by) == 41 and all(r.taken == int(r.target) for r in by)
    goals = spark.createDataFrame([(0, 10000.0), (1, 5.0), (2, 0.0), (3, 33.5)], "no long, target double")
    got = source_mix.schedule(goals, 20, 10).collect()
    assert sorted((r.no, r["rank"]) for r in got) == [(0, i) for i in range(1000)] + [(1, 0)] + [(3, i) for i in range(4)] and len({r.slot for r in got}) == len(got)


def test_sha_of_turns_needs_no_separator_inside():
    assert hashlib.sha256(b"user\nhi\n").hexdigest() != hashlib.sha256(b"user\nhi").hexdigest()
