"""Text functions as DuckDB expressions."""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions.text import SPACE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def stem(w: str, suffixes: tuple[str, ...] = L.REGISTRY_SUFFIXES) -> str:
    return "CASE " + " ".join(f"WHEN length({w}) > {len(s) + 3} AND ends_with({w}, '{s}') THEN left({w}, length({w}) - {len(s)})" for s in suffixes) + f" ELSE {w} END"


def tokens(text: str) -> str:
    words = f"list_transform(regexp_extract_all({text}, {q(L.WORD)}), lambda w: regexp_replace(lower(w), '^[.''’-]+|[.''’-]+$', '', 'g'))"
    return f"list_filter({words}, lambda w: w <> '' AND NOT list_contains({listed(L.STOPWORDS)}, w))"


def normal(c: str) -> str:
    return f"trim(regexp_replace(translate({c}, '’“”', '''\"\"'), '{SPACE}+', ' ', 'g'))"


def stripped_tags(text: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({text}, {q(L.TAG)}, '', 'g'), '[ \\t]+([.,;:!?])', '\\1', 'g'), '[ \\t]{{2,}}', ' ', 'g')"
