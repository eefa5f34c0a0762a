"""Token counts by a compiled transducer, without making the tokens.

A piece vocabulary with merge scores is compiled, state by state as texts need them, into a deterministic transducer
over characters.  A state holds what later input can depend on: the longest suffix that begins some piece, and for each
position in it the last token of the prefix, the number of tokens since, and whether the leading space mark stands
alone.  A transition is annotated with the tokens it adds.  The space mark synchronises: whatever the state before it,
the state behind it is the same.  So the state map of a chunk is an open head, a closed count and an open tail, and
such maps compose associatively; a text's count is the scan of its chunks' maps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import _slices
from .common import hold, prepare, whole

MARK = "▁"
#: Characters of a chunk; words and transducer states a worker remembers before it starts anew.
CHUNK_CHARS, REMEMBERED, STATES = 1 << 16, 300_000, 400_000
#: Texts of more bytes are dealt to several tasks, chunk by chunk.
LONG_BYTES = 1 << 20


class Place(NamedTuple):
    """One position of a state's window: last token up to there (none at a start), tokens so far, space mark alone."""

    last: str | None
    count: int
    alone: bool


class ChunkMap(NamedTuple):
    """head: what stands before the first space (None: no space at all, and tail is all); closed: tokens of the words between; spaces, tail: the open last word and the run of spaces before it."""

    head: str | None
    closed: int
    spaces: int
    tail: str


class Transducer:
    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        score = {sp.id_to_piece(i): sp.get_score(i) for i in usable}
        self.runs = {len(p) for p in score if not p.strip(MARK)} | {1}
        self.score = {p: s for p, s in score.items() if p == MARK or p.strip(MARK)}
        least = min(s for p, s in self.score.items() if len(p) > 1)
        if any(MARK in p[1:] for p in self.score) or any(s >= least for p, s in score.items() if len(p) > 1 and p not in self.score):
            raise ValueError("pieces with inner space marks, or runs of them that merge before words do, are not supported")
        self.begins = {p[:k] for p in self.score for k in range(1, len(p))}
        self.alone: dict[str, bool] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[int, bool]] = {}
        self.reset()

    def reset(self) -> None:
        """State 0: nothing before."""
        self.states: list[tuple[str, tuple[Place, ...]]] = [("", (Place(None, 0, False),))]
        self.numbers = {self.states[0]: 0}
        self.arcs: dict[tuple[int, str], tuple[int, int, bool]] = {}

    def merge(self, text: str) -> list[str]:
        """Plain merging by best score, leftmost first; used on single pieces and pairs of pieces only."""
        parts = list(text)
        while len(parts) > 1:
            best, at = max((self.score.get(parts[i] + parts[i + 1], -float("inf")), -i) for i in range(len(parts) - 1))
            if best == -float("inf"):
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def valid(self, left: str | None, right: str) -> bool:
        memo, key, want = (self.alone, right, [right]) if left is None else (self.fits, (left, right), [left, right])
        if key not in memo:
            memo[key] = self.merge("".join(want)) == want
        return memo[key]

    def arc(self, state: int, char: str) -> tuple[int, int, bool]:
        """(next state, tokens it adds, space mark alone) on reading a character; compiled once."""
        window, places = self.states[state]
        if char not in self.score:  # byte tokens, and a fresh start behind them; nothing merges across
            alone = places[-1].alone
            found = self.number("", (Place(None, 0, alone),)), len(char.encode()), alone
        else:
            window += char
            for k in range(len(window)):
                piece, before = window[k:], places[k]
                if piece in self.score and self.valid(before.last, piece):
                    break
            alone = before.alone if before.last is not None or k or not window.startswith(MARK) else len(piece) == 1
            new = Place(piece, before.count + 1, alone)
            keep = next((i for i in range(len(window)) if window[i:] in self.begins), len(window))
            found = self.number(window[keep:], (*places, new)[keep:]), new.count - places[-1].count, alone
        self.arcs[state, char] = found
        return found

    def number(self, window: str, places: tuple[Place, ...]) -> int:
        """Counts are kept relative to the window's first position."""
        first = places[0].count
        key = window, tuple(p._replace(count=p.count - first) for p in places)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
        return self.numbers[key]

    def word(self, w: str) -> tuple[int, bool]:
        """Tokens of the space mark and the word behind it, and whether the mark stands alone."""
        if (known := self.words.get(w)) is not None:
            return known
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        if len(self.states) >= STATES:
            self.reset()
        state, count, alone = self.arc(0, MARK) if (0, MARK) not in self.arcs else self.arcs[0, MARK]
        for c in w:
            state, more, alone = self.arcs.get((state, c)) or self.arc(state, c)
            count += more
        if len(w) <= 64:
            self.words[w] = count, alone
        return count, alone

    def spaces(self, n: int) -> int:
        """Tokens of n space marks alone: runs grow from the left, one mark or finished run at a time."""
        longest = max(self.runs)
        full, rest = divmod(n, longest)
        if rest == 0 or rest in self.runs:
            return full + (rest > 0)
        return full + 1 + self.spaces(rest - max(r for r in self.runs if r < rest))

    def closed(self, spaces: int, w: str) -> int:
        """Tokens of a run of space marks and the word behind it, if any."""
        if not w:
            return self.spaces(spaces)
        count, alone = self.word(w)
        if spaces == 1:
            return count
        return count - 1 + self.spaces(spaces) if alone else count + self.spaces(spaces - 1)

    def chunk_map(self, chunk: str) -> ChunkMap:
        head, *words = chunk.split(" ")
        if not words:
            return ChunkMap(None, 0, 0, chunk)
        spaces, total = 1, 0
        if "" not in words:
            total = sum(self.word(w)[0] for w in words[:-1])
        else:
            for w in words[:-1]:
                if w:
                    total, spaces = total + self.closed(spaces, w), 1
                else:
                    spaces += 1
        return ChunkMap(head, total, spaces, words[-1])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of a's chunk followed by b's; b's chunk must not begin with a space."""
        if b.head is None:
            return a._replace(tail=a.tail + b.tail)
        if a.head is None:
            return b._replace(head=a.tail + b.head)
        return ChunkMap(a.head, a.closed + self.closed(a.spaces, a.tail + b.head) + b.closed, b.spaces, b.tail)

    def total(self, maps: list[ChunkMap]) -> int:
        """Tokens of a text from its chunks' maps, in order: the scan's last value, by halves."""
        while len(maps) > 1:
            maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        m = maps[0]
        return m.closed + self.closed(m.spaces, m.tail)

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        return self.total([self.chunk_map(c) for c in re.findall(_chunk(), " " + text.replace(MARK, " "))])


def _chunk() -> str:
    """The pattern of chunks: so many characters, and the rest of a run of spaces, which is never cut."""
    return f"(?s).{{1,{CHUNK_CHARS}}} *"


@lru_cache(maxsize=1)
def transducer(model_file: str) -> Transducer:
    """One per Python worker, kept from task to task."""
    return Transducer(model_file)


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row's whole text, without begin, end or special tokens.

    Control strings inside texts are ordinary text.  Null and empty texts have no bytes and no tokens.  Rows are
    independent: repeated and null ids stay as they are, and only the two named columns are read.  model_file (a BPE
    model with identity normalisation and a leading space mark) must be readable on every executor.
    """
    prepare(docs.sparkSession)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("token_counts", transducer.cache_clear)
        machine = transducer(model_file)
        for b in _slices(batches):
            counts = [machine.count(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("token_counts", transducer.cache_clear)
        machine = transducer(model_file)
        for b in _slices(batches):
            maps = [machine.chunk_map(c) for c in b.column(b.num_columns - 1).to_pylist()]
            made = [pa.array([m[i] for m in maps], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], *ChunkMap._fields])

    def scanned(group: pa.Table) -> pa.Table:
        """The maps of one text, composed in order."""
        group = group.sort_by("pos")
        n = transducer(model_file).total([ChunkMap(*x) for x in zip(*(group.column(c).to_pylist() for c in ChunkMap._fields))])
        return pa.table([group.column("id").slice(0, 1), group.column("n_bytes").slice(0, 1), pa.array([n], pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(whole(text_col)).cast("long").alias("n_bytes"), whole(text_col).alias("text"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long"
    long_text = F.col("n_bytes") > LONG_BYTES
    short = rows.where(~long_text).mapInArrow(per_task, f"{kind}, n_tokens long")
    # The chunks of a long text are rows of their own: its state maps are made on many tasks and composed per text.
    text = F.concat(F.lit(" "), F.replace("text", F.lit(MARK), F.lit(" ")))
    chunks = rows.where(long_text).withColumn("uid", F.monotonically_increasing_id()).select("id", "n_bytes", "uid", F.posexplode(F.regexp_extract_all(text, F.lit(_chunk()), 0)).alias("pos", "chunk"))
    maps = chunks.repartition("uid", "pos").mapInArrow(mapped, f"{kind}, uid long, pos int, head string, closed long, spaces long, tail string")
    counted = short.unionByName(maps.groupBy("uid").applyInArrow(scanned, f"{kind}, n_tokens long"))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
