import re

import pytest
from pyspark.sql import functions as F

from factgate.functions import lexicon as L
from factgate.functions import text as T


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [
    ("It works. It ships! Does it? Yes", ["It works.", "It ships!", "Does it?", "Yes"]),
    ("Limits, e.g. Ten of them, hold. Next one.", ["Limits, e.g. Ten of them, hold.", "Next one."]),
    ("It is cited. [[PT-001]] Then more.", ["It is cited. [[PT-001]]", "Then more."]),
    ("Version 3. 4 is out.", ["Version 3. 4 is out."]),
    ("", []), (None, []),
])
def test_split_sentences(spark, text, want):
    assert one(spark, text, T.split_sentences) == want


def test_tags_and_words(spark):
    text = "It  holds [[PT-001]] , and [[PT-002]] [[x]]"
    assert one(spark, text, T.tags_in) == ["PT-001", "PT-002"]
    assert one(spark, text, T.strip_tags) == "It holds, and [[x]]"
    assert one(spark, "don't stop-gap 3.5x", T.word_count) == 3
    assert one(spark, "  “a”  b’s ", T.norm_ws) == "\"a\" b's"


@pytest.mark.parametrize("word, registry, gate", [("installations", "install", "install"), ("applied", "appli", "appl"), ("knowingly", "knowing", "know"), ("sent", "sent", "sent")])
def test_stemmers_differ(spark, word, registry, gate):
    def plain(w, suffixes):
        return next((w[: -len(s)] for s in suffixes if len(w) > len(s) + 3 and w.endswith(s)), w)

    assert one(spark, word, T.stem_registry) == plain(word, L.REGISTRY_SUFFIXES) == registry
    assert one(spark, word, T.stem_gate) == plain(word, L.GATE_SUFFIXES) == gate


def test_numbers_and_nouns(spark):
    assert one(spark, "It takes 30 ms, 1,5 GB and v2 of 99.9%.", T.numbers) == ["30ms", "1,5gb", "99.9%"]
    got = one(spark, "It has 64 wireless sensors", T.num_nouns)
    assert {(r["number"], r["noun"]) for r in got} == {("64", "wireles"), ("64", "sensor")}


def test_rules_of_claims(spark):
    assert one(spark, "Encrypts data with AES", T.category) == "security"
    assert one(spark, "Cheaper than most", T.category) == "competitive"
    assert one(spark, "Blue", T.category) == "capability"
    assert [one(spark, t, T.confidence) for t in ("It is planned", "It may work", "It works")] == ["low", "medium", "high"]
    assert one(spark, "Now in beta, once early access", T.release_status) == ["beta"]


def test_name_pattern(spark):
    hit = lambda t: one(spark, t, lambda c: c.rlike(T.name_pattern("Acme")))
    assert hit("use Acme now") and not hit("use Acme Cloud") and not hit("Acme-like")


def test_fixed_patterns_compile():
    for p in (L.TAG, L.WORD, L.ABSOLUTE, L.EXCEPTION, L.SUPERLATIVE, L.CONDITION, L.FACT_VERB, *(p for _, p in L.CATEGORIES)):
        re.compile(p)


def test_white_space_of_java_patterns_is_the_same(spark):
    odd = [i for i in range(0x11000) if not 0xD800 <= i < 0xE000] + [0x1F600, 0x10FFFF]
    df = spark.createDataFrame([(i, chr(i)) for i in odd], "i int, c string")
    c = F.col("c")
    differ = df.where((c.rlike(f"^{T.SPACE}") != c.rlike(f"^{T.JAVA_SPACE}")) | ((c.rlike(f"^{T.SPACE}") & (c != " ")) != c.rlike(f"^{T.ODD_SPACE}")))
    assert differ.count() == 0
    texts = spark.createDataFrame([(x,) for x in (" a  b\t", "a\u00a0 \u2003b\nc", "\u3000a b\x1c", "é ü\x85", "plain text only", "", None)], "c string")
    assert texts.where(~F.trim(F.regexp_replace(c, f"{T.SPACE}+", " ")).eqNullSafe(T.single_spaced(c)) | ~F.regexp_replace(c, f"^{T.SPACE}+|{T.SPACE}+$", "").eqNullSafe(T.stripped(c))).count() == 0
