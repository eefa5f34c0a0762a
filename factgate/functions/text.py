"""Text functions: every one takes Columns and gives a Column, and runs inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


#: White space as Unicode has it, for patterns of Java and of RE2.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: The same characters, and those but the plain space, for Java alone: as what is outside the common letters first, so that a letter is told in one or two steps.
_RARE = r"[\x00-\x08\x0e-\x1b\x7f-\x{84}\x{86}-\x{9f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}]"
JAVA_SPACE, ODD_SPACE = rf"[^\x21-\x7e\x{{a1}}-\x{{167f}}{_RARE}]", rf"[^\x20-\x7e\x{{a1}}-\x{{167f}}{_RARE}]"


def strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{JAVA_SPACE}+|{JAVA_SPACE}+$", "")


def single_spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{JAVA_SPACE}{{2,}}|{ODD_SPACE}", " "))  # plain single ones stay as they are


def norm_ws(c: Column) -> Column:
    """Straight quotes, single spaces, trimmed; null counts as empty."""
    c = F.coalesce(c, F.lit(""))
    for curly, straight in (("’", "'"), ("“", '"'), ("”", '"')):
        c = F.replace(c, F.lit(curly), F.lit(straight))
    return single_spaced(c)


def quote_hash(c: Column) -> Column:
    return F.sha2(F.lower(norm_ws(c)), 256)


def word_count(c: Column) -> Column:
    return F.size(found(F.coalesce(c, F.lit("")), L.WORD))


def strip_tags(c: Column) -> Column:
    """Without claim tags, spaces before punctuation and double spaces."""
    for pattern, by in ((L.TAG, ""), (r"[ \t]+([.,;:!?])", "$1"), (r"[ \t]{2,}", " ")):
        c = F.regexp_replace(c, pattern, by)
    return c


def tags_in(c: Column) -> Column:
    return found(F.coalesce(c, F.lit("")), L.TAG, 1)


def cited_ids(c: Column) -> Column:
    return F.array_sort(F.array_distinct(tags_in(c)))


def trimmed(w: Column) -> Column:
    return F.regexp_replace(F.lower(w), r"^[.'’-]+|[.'’-]+$", "")


def tokens(c: Column) -> Column:
    """Lower-case words without stop words, in order."""
    # A word up to its last letter or digit, which is what trimmed leaves of it: words begin with one.
    words = F.transform(found(strip_tags(F.coalesce(c, F.lit(""))), rf"[A-Za-z0-9](?:{L.WORD.removeprefix('[A-Za-z0-9]')}[A-Za-z0-9])?"), F.lower)
    return F.filter(words, lambda w: ~w.isin(*L.STOPWORDS))


def split_sentences(c: Column) -> Column:
    """Sentences of normalised text, each with the tags behind it.

    A dot after an abbreviation, or between a digit and a digit, does not end one.
    """
    mark, dot = "\u0001", "\u0002"
    t = norm_ws(c)
    abbreviations = "|".join(a.replace(".", r"\.") for a in L.ABBREVIATIONS)
    t = F.regexp_replace(t, rf"(?i)(^|[^A-Za-z.])({abbreviations})\.(?=\s)", rf"$1$2{dot}")
    t = F.regexp_replace(t, r"(\d)\.(?= ?\d)", rf"$1{dot}")
    t = F.regexp_replace(t, r"([.!?](?:\s*\[\[[A-Z0-9\-]+\]\])*+)\s+(?=[\"'(\[]?[A-Z0-9])", rf"$1{mark}")
    parts = F.transform(F.split(t, mark), lambda s: F.trim(F.replace(s, F.lit(dot), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def _stemmed(w: Column, suffixes: Sequence[str]) -> Column:
    """Without the first suffix it ends in that leaves more than three letters."""
    steps = [(F.length(w) > len(s) + 3) & w.endswith(s) for s in suffixes]
    cut = [F.substring(w, F.lit(1), F.length(w) - len(s)) for s in suffixes]
    return reduce(lambda acc, x: acc.when(*x), list(zip(steps, cut))[1:], F.when(steps[0], cut[0])).otherwise(w)


def stem_registry(w: Column) -> Column:
    return _stemmed(w, L.REGISTRY_SUFFIXES)


def stem_gate(w: Column) -> Column:
    return _stemmed(w, L.GATE_SUFFIXES)


def stems_registry(c: Column) -> Column:
    kept = F.filter(tokens(c), lambda w: (F.length(w) > 2) & ~w.isin(*L.GENERIC) & ~w.rlike(r"^\d+(?:\.\d+)?$"))
    return F.array_distinct(F.transform(kept, stem_registry))


def stems_gate(c: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(tokens(c), lambda w: F.length(w) > 1), stem_gate))


def numbers(c: Column) -> Column:
    """Distinct numbers with their units, without spaces; digits right behind a letter do not count."""
    raw = found(strip_tags(c), r"(?<![A-Za-z])" + L.NUMBER_WITH_UNIT.replace(r"(?:[.,]\d+)*", r"(?:[.,]\d++)*+"))
    return F.array_distinct(F.transform(raw, lambda n: F.regexp_replace(F.lower(F.regexp_replace(n, r"\s", "")), r"[.,]+$", "")))


def num_nouns(c: Column) -> Column:
    """Distinct (number, stem) for the content words among the three words behind each number."""
    words = found(c, r"[A-Za-z]+|\d+(?:\.\d+)?")
    numeric = r"^\d+(?:\.\d+)?$"

    def pairs(w: Column, i: Column) -> Column:
        after = F.filter(F.slice(words, i + 2, F.lit(3)), lambda x: ~x.rlike(numeric) & ~F.lower(x).isin(*L.STOPWORDS))
        return F.when(w.rlike(numeric), F.transform(after, lambda x: F.struct(w.alias("number"), stem_registry(F.lower(x)).alias("noun"))))

    return F.array_distinct(F.flatten(F.filter(F.transform(words, pairs), lambda x: x.isNotNull())))


def subject(c: Column) -> Column:
    """Stems of what stands before the first listed verb, else of the first three words."""
    before = F.regexp_extract(c, r"(?s)^(.+?)" + L.SUBJECT_END.replace("(?i)", "(?i:", 1) + ")", 1)
    first = F.array_join(F.slice(F.split(F.trim(c), r"\s+"), 1, 3), " ")
    return F.array_distinct(F.transform(F.filter(tokens(F.when(before != "", before).otherwise(first)), lambda w: F.length(w) > 1), stem_registry))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def same_subject(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & (jaccard(a, b) >= 0.75)


def release_status(c: Column) -> Column:
    hits = [F.when(F.lower(c).rlike(rf"\b{words}\b"), F.lit(status)) for words, status in L.STATUS_WORDS]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))


def qualifiers(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(found(c, L.QUALIFIER, 1), F.lower)))


def category(c: Column) -> Column:
    low = F.lower(c)
    first, *rest = [(low.rlike(p), F.lit(name)) for name, p in L.CATEGORIES]
    return reduce(lambda acc, x: acc.when(*x), rest, F.when(*first)).otherwise(L.DEFAULT_CATEGORY)


def confidence(c: Column) -> Column:
    return F.when(c.rlike(L.ROADMAP), "low").when(c.rlike(L.HEDGE), "medium").otherwise("high")


def base_status(cat: Column, conf: Column, high_risk: Sequence[str] = L.HIGH_RISK) -> Column:
    return F.when(cat.isin(*high_risk, "market-evidence") | (conf == "low"), "needs-review").otherwise("verified")


def name_pattern(name: str) -> str:
    """A pattern for a product name on its own, not inside a longer capitalised name."""
    return r"(?<![\w-])\Q" + name + r"\E(?![\w-])(?!\s+[A-Z0-9])(?!['’]s\s+[A-Z])"


def tag(text: Column, ids: Column) -> Column:
    """A sentence, closed by a dot where it has no end, with the tags of its claims."""
    bare = F.rtrim(text)
    return F.concat(bare, F.when(bare.rlike("[.!?]$"), "").otherwise("."), F.array_join(F.transform(ids, lambda i: F.concat(F.lit(" [["), i, F.lit("]]"))), ""))
