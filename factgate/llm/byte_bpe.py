"""Byte-level BPE encoding and decoding by prefix dynamic programming.

The encoding of every byte prefix ends in exactly one valid last token, so one token id per prefix is the whole state:
the last token at position i is the token ending there whose predecessor, the last token at its start, is compatible
with it.  Appending bytes only adds entries, and after an edit only entries behind it are made again, up to where they
agree with the old ones.  Texts are cut where matches surely begin, and each distinct piece of a batch is encoded once.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, prepare, whole

#: Distinct matches of a generation, of which a Python worker remembers two, and pairs of tokens before it starts anew.
REMEMBERED, PAIRS = 150_000, 400_000
#: Lengths of beginnings whose prefixes are kept for other matches.
STEMS = (9, 7, 5)
#: Texts are handed on in batches of about this many bytes; larger ones repeat more pieces.
BATCH_BYTES, PIECE_BATCH_BYTES = 4 << 20, 8 << 20


class Ranks:
    """A vocabulary of byte strings with merge ranks, read from a .tiktoken file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self._fits: dict[int, bool] = {}
        self._own: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain merging by lowest rank, leftmost first; used on single tokens and pairs of tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ids.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def stands(self, token: int) -> bool:
        """Whether the token's bytes alone are encoded as this token."""
        if (known := self._own.get(token)) is None:
            known = self._own[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together."""
        key = left << 32 | right
        if (known := self._fits.get(key)) is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            known = self._fits[key] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known


class Prefixes:
    """The last tokens of all prefixes of one byte string; known: those of its first prefixes, if made before."""

    def __init__(self, ranks: Ranks, data: bytes = b"", known: tuple[int, ...] = ()):
        self.ranks, self.data, self.last = ranks, data, list(known)
        self._extend(len(data))

    def _extend(self, stop: int) -> None:
        """Last tokens up to prefix length `stop`.  Only one candidate is valid, so their order is free; most are short."""
        data, last, r = self.data, self.last, self.ranks
        get, fits, longest = r.ids.get, r._fits.get, r.longest
        for end in range(len(last) + 1, stop + 1):
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                if (t := get(data[start:end])) is not None:
                    if not start:
                        if r.stands(t):
                            break
                    elif (known := fits(last[start - 1] << 32 | t)) or (known is None and r.follows(last[start - 1], t)):
                        break
            else:
                raise ValueError("a byte is missing from the vocabulary")
            last.append(t)

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend(len(self.data))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace data[start:stop]; the number of prefixes whose last token was made again."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start]
        for end in range(start + 1, len(self.data) + 1):
            # From here on the old entries hold: a token cannot reach back behind as many equal entries as it is long.
            back = end - 1 - self.ranks.longest
            if back >= start + len(new) and self.last[back : end - 1] == old[back - shift : end - 1 - shift]:
                self.last += old[end - 1 - shift :]
                return end - 1 - start
            self._extend(end)
        return len(self.data) - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(t := self.last[end - 1])
            end -= len(self.ranks.bytes_of[t])
        return out[::-1]


class Encoder(dict):
    """Text to ids.  As a dict it holds the ids of matches met lately, as bytes of int32; `older` those of the generation before."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ranks, self.find = Ranks(ranks_path), regex.compile(pattern).findall
        self.stems: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[str, bytes] = {}

    def __missing__(self, match: str) -> bytes:
        ids = self.older.get(match)
        if ids is None:
            data = match.encode()
            whole = self.ranks.ids.get(data)
            ids = array("i", (whole,) if whole is not None and self.ranks.stands(whole) else self._made(data)).tobytes()
        if len(match) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[match] = ids
        return ids

    def _made(self, data: bytes) -> list[int]:
        """From the prefixes of the longest stem already met: matches share their beginnings."""
        known = next((k for n in STEMS if (k := self.stems.get(data[:n])) is not None), ())
        p = Prefixes(self.ranks, data, known)
        if len(self.stems) >= REMEMBERED // 2:
            self.stems.clear()
        for n in STEMS:
            if len(known) < n <= len(data):
                self.stems[data[:n]] = tuple(p.last[:n])
        return p.tokens()

    def encode(self, text: str) -> array:
        return array("i", b"".join(map(self.__getitem__, self.find(text))))

    def encode_all(self, texts: pa.StringArray, cut_before: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's ids begin and the last ones end).

        Every distinct piece of the batch is encoded once; the rest is gathering in numpy.
        """
        offsets, data = _bytes_of(texts)
        cut = np.zeros(len(data) + 1, bool)
        cut[_cuts(data, cut_before)] = True
        cut[offsets] = True
        cuts = np.flatnonzero(cut)
        if len(cuts) < 2:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        find, ids_of = self.find, self.__getitem__
        made = [b"".join(map(ids_of, find(p))) for p in pieces.dictionary.to_pylist()]
        n = np.fromiter(map(len, made), np.int64, len(made)) // 4
        flat, first, which = np.frombuffer(b"".join(made), np.int32), np.cumsum(n) - n, pieces.indices.to_numpy()
        n, first = n[which], first[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        return flat[np.arange(ends[-1]) + np.repeat(first - ends[:-1], n)], ends[np.searchsorted(cuts, offsets)]


@lru_cache(maxsize=1)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One per Python worker, kept from task to task."""
    return Encoder(ranks_path, pattern)


def _bytes_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(where each text begins and the last one ends, UTF-8 of all texts) of an array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def _cuts(data: np.ndarray, cut_before: bytes) -> np.ndarray:
    """Places in front of one of the bytes where neither neighbour is white space, nor may be (beyond ASCII, the bytes decide)."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
    opens = space.copy()
    opens[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # first bytes of white space beyond ASCII
    at = np.flatnonzero(np.isin(data, np.frombuffer(cut_before, np.uint8)))
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[~space[data[at - 1]] & ~opens[data[at + 1]]]
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    return at[~((two == 0xC2) | np.isin(three, [0xE1, 0xE2, 0xE3]) & (data[at - 1] >= 0x80))]


def _slices(batches: Iterator[pa.RecordBatch], size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = max(1, min(b.num_rows, b.num_rows * size // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def encode_texts(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids", keep: Sequence[str] = (), cut_before: bytes = b" \n"
) -> DataFrame:
    """(id, *keep, ids array<int>): the whole text of every row, each match of the pattern encoded on its own, without special tokens.

    Null and empty texts have no tokens.  Rows are independent: repeated and null ids stay as they are, and only the
    named columns are read; keep names further columns to carry along.  Texts of any length are encoded whole.
    ranks_path must be readable on every executor.  cut_before: ASCII white space that, single between other characters,
    always begins a match of the pattern; texts are cut there first.  Empty for patterns of which that holds for none.
    """
    prepare(docs.sparkSession)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("byte_bpe", encoder.cache_clear)
        encode = encoder(ranks_path, pattern).encode_all
        for b in _slices(batches, PIECE_BATCH_BYTES):
            ids, ends = encode(b.column(0), cut_before)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], lists], [*b.schema.names[1:], "ids"])

    carried = [id_col, *keep]
    rows = docs.select(whole(text_col).alias("text"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(carried)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(per_task, f"{kinds}, ids array<int>").select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(carried)), F.col("ids").alias(ids_col))


def decode_ids(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with one more column (or another in its place), binary: the bytes of the ids, which need not be valid UTF-8.

    A null list, an empty one and null ids in it decode to no bytes; an id outside the vocabulary raises.  The
    vocabulary is a constant of the plan, so this runs without Python workers.
    """
    of = Ranks(ranks_path).bytes_of
    table = F.split(F.lit(",".join(of[i].hex() if i in of else "?" for i in range(max(of) + 1))), ",")
    made = F.unhex(F.coalesce(F.array_join(F.transform(ids_col, lambda i: table[i]), ""), F.lit("")))
    return encoded.withColumn(out_col, F.coalesce(made, F.raise_error(F.lit("an id is not in the vocabulary")).cast("binary")))
