"""Removal of passages that occur earlier, by automata of repeated phrases.

Documents are dealt once, by content, into blocks of bounded size, kept as a bucketed table, so that all later steps find a
block's texts in place.

1. Recurring anchors.  A window of 20 words is anchored at the least hash of its phrases of 10 words, so equal windows
   have equal anchors, and about one position in six is one.  Only anchors seen twice can be part of a repeated window.
2. Confirmed windows.  Windows at recurring anchors are told by 96 bits of hash; each block reports its first occurrence of
   each.  What occurs twice, in whatever blocks, is a repeated window, and the smallest (document, place) its first one.
3. Automata.  Runs of repeated windows are passages.  Each block compiles the phrases of its passages into Aho-Corasick
   automata over word codes, in shards of bounded size, and streams all of its documents through them.  A repeated window
   holds at least one whole phrase, so each occurrence is found; which window stands there is looked up by its 20 words.

A block holds the automata of its own passages only, so the work grows with the corpus, not with corpus times passages.  A
passage that all documents hold reaches a task once per block, not once per document.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_root, prepare, whole

#: Words of a window, and of the phrases that automata hold; a run of WINDOW words holds a whole phrase at any offset.
WINDOW, PHRASE = 20, 10

#: Bytes of text of a block, blocks of a bucket, phrases of one automaton (some 100 bytes a word).
BLOCK_BYTES, BLOCKS_A_BUCKET, SHARD_PHRASES = 2 << 20, 4, 20_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LAST = np.iinfo(np.int64).max  # null ids come after all others
#: Of each of two hashes: a random number for each byte, an odd base, and its inverse modulo 2^64.
_BYTES = np.random.default_rng(20).integers(0, 1 << 64, (2, 256), np.uint64)
_POWERS = [(np.uint64(b), np.uint64(pow(b, -1, 1 << 64))) for b in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Words:
    """The words of some texts, as codes of their own vocabulary."""

    def __init__(self, texts: pa.Array) -> None:
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        inside = ~_SPACE[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[at[:-1]] = True
        begins[1:-1] |= ~inside[:-1]
        starts = np.flatnonzero(inside & begins[:-1])
        kept = np.concatenate([[0], np.cumsum(inside)])
        offsets = np.append(kept[starts], kept[-1]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        self.codes: np.ndarray = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.vocabulary: pa.Array = coded.dictionary
        self.lengths = np.bincount(np.searchsorted(at, starts, "right") - 1, minlength=len(texts)).astype(np.int64)
        self.bases = np.concatenate([[0], np.cumsum(self.lengths)])
        windows = np.maximum(self.lengths - WINDOW + 1, 0)
        #: Where windows start, counted over all texts, and the text of each.
        self.text_of = np.repeat(np.arange(len(texts)), windows)
        self.windows = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + self.bases[self.text_of]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each word, from sums over the bytes of the whole vocabulary."""
        v = self.vocabulary
        at = np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1].astype(np.int64)
        data = np.frombuffer(v.buffers()[2] or b"", np.uint8)[: at[-1]]
        out = []
        for numbers, (base, inverse) in zip(_BYTES, _POWERS):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers[data] * _geometric(base, len(data)), dtype=np.uint64)])
            h = (sums[at[1:]] - sums[at[:-1]]) * _geometric(inverse, len(data) + 1)[at[:-1]]
            h ^= h >> np.uint64(32)
            out.append((h * _BASE)[self.codes])
        return out[0], out[1]


def _geometric(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, … modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _rolled(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of the k words from each place on."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= base
        out += h[j : j + n]
    return out


def _over(x: np.ndarray, k: int, of: np.ufunc) -> np.ndarray:
    """The least or largest of k neighbours from each place on."""
    out, span = x, 1
    while span < k:
        step = min(span, k - span)
        out, span = of(out[:-step], out[step:]), span + step
    return out


def _anchors(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and the hash of each place that is one."""
    if not len(words.windows):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    phrases, reach = _rolled(h, PHRASE, _BASE), WINDOW - PHRASE + 1
    least = _over(phrases, reach, np.minimum)
    owned = np.zeros(len(least), np.uint64)
    owned[words.windows] = least[words.windows]
    pad = np.zeros(reach - 1, np.uint64)
    most = _over(np.concatenate([pad, owned, pad]), reach, np.maximum)  # of the windows that hold the phrase at each place
    return least[words.windows], phrases[most == phrases]


def _dealt(shard: np.ndarray, block: int, columns: dict[str, np.ndarray]) -> pa.Table:
    """One row per shard, with the shard's part of each column as bytes."""
    order = np.argsort(shard, kind="stable")
    ids, first = np.unique(shard[order], return_index=True)
    bounds = np.append(first, len(shard))
    out = {"shard": pa.array(ids.astype(np.int64)), "block": pa.array(np.full(len(ids), block, np.int64))}
    for name, x in columns.items():
        x = np.ascontiguousarray(x[order])
        out[name] = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((bounds * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
    return pa.table(out)


def _joined(table: pa.Table, kinds: dict[str, type]) -> dict[str, np.ndarray]:
    """The columns of bytes as arrays, one after another, and the block of each entry."""
    out = {n: np.frombuffer(b"".join(table[n].to_pylist()), kind) for n, kind in kinds.items()}
    first = next(iter(kinds))
    sizes = pc.binary_length(table[first]).to_numpy() // np.dtype(kinds[first]).itemsize
    return out | {"block": np.repeat(table["block"].to_numpy(), sizes)}


def _texts(docs: pa.Table) -> tuple[pa.Table, Words]:
    """The block's documents in order, and their words."""
    docs = docs.sort_by([("ord", "ascending"), ("th", "ascending")]).combine_chunks()
    texts = docs["text"].combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    return docs, Words(texts.cast(pa.binary()))


def _anchor_rows(shards: int):
    def of(docs: pa.Table) -> pa.Table:
        block = docs["block"][0].as_py()
        _, words = _texts(docs)
        _, places = _anchors(words, words.hashes()[0])
        found, n = np.unique(places, return_counts=True)
        found = np.repeat(found, np.minimum(n, 2))
        return _dealt((found % np.uint64(shards)).astype(np.int64), block, {"h": found})

    return of


def _recurring(rows: pa.Table) -> pa.Table:
    x = _joined(rows, {"h": np.uint64})
    order = np.lexsort((x["block"], x["h"]))
    h, block = x["h"][order], x["block"][order]
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[:-1] |= h[1:] == h[:-1]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (block[1:] != block[:-1])
    keep = again & once
    out = _dealt(block[keep], 0, {"h": h[keep]})
    return pa.table({"block": out["shard"], "h": out["h"]})


_WINDOW_KINDS = {"key": np.uint64, "more": np.uint32, "ord": np.int64, "th": np.int32, "text": np.uint32, "start": np.uint32, "several": np.uint8}


def _window_rows(shards: int):
    def of(docs: pa.Table, recurring: pa.Table) -> pa.Table:
        block = docs["block"][0].as_py() if docs.num_rows else 0
        docs, words = _texts(docs)
        h, other = words.hashes()
        anchors, _ = _anchors(words, h)
        hit = np.isin(anchors, np.frombuffer(b"".join(recurring["h"].to_pylist()), np.uint64))
        at, text = words.windows[hit], words.text_of[hit]
        key, first, n = np.unique(_rolled(h, WINDOW, _BASE)[at] if len(at) else np.zeros(0, np.uint64), return_index=True, return_counts=True)
        at, text = at[first], text[first]
        more = (_rolled(other, WINDOW, _OTHER)[at] if len(at) else key).astype(np.uint32)
        return _dealt(
            (key % np.uint64(shards)).astype(np.int64),
            block,
            {"key": key, "more": more, "ord": docs["ord"].to_numpy()[text], "th": docs["th"].to_numpy()[text], "text": text.astype(np.uint32), "start": (at - words.bases[text]).astype(np.uint32), "several": (n > 1).astype(np.uint8)},
        )

    return of


def _confirmed(rows: pa.Table) -> pa.Table:
    """Of each repeated window, the places that blocks have reported; here: the first of all is in this block."""
    x = _joined(rows, _WINDOW_KINDS)
    order = np.lexsort((x["start"], x["th"], x["ord"], x["more"], x["key"]))
    x = {n: v[order] for n, v in x.items()}
    same = (x["key"][1:] == x["key"][:-1]) & (x["more"][1:] == x["more"][:-1])
    here = np.ones(len(order), bool)
    here[1:] = ~same
    keep = x["several"] > 0
    keep[1:] |= same
    keep[:-1] |= same
    out = _dealt(x["block"][keep], 0, {"text": x["text"][keep], "start": x["start"][keep], "here": here[keep].astype(np.uint8)})
    return pa.table({"block": out["shard"], "text": out["text"], "start": out["start"], "here": out["here"]})


def _phrases(starts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The distinct phrases, as rows of codes, of the passages that runs of consecutive windows make."""
    if not len(starts):
        return np.zeros((0, PHRASE), np.int32)
    cut = np.flatnonzero(np.diff(starts) > 1)
    first, last = starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]
    n = (last - first + WINDOW - PHRASE) // PHRASE + 1
    at = np.repeat(first, n) + PHRASE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return np.unique(codes[at[:, None] + np.arange(PHRASE)], axis=0)


def _occurrences(codes: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    """Where phrases stand in a text of codes, by automata of at most SHARD_PHRASES phrases.

    A word is spelled in three letters, each of an alphabet of its own, so that a node has few children and a match begins
    at a word; words of no phrase are all spelled alike.
    """
    if not len(phrases):
        return np.zeros(0, np.int64)
    used = np.unique(phrases)
    number = np.zeros(int(codes.max()) + 1, np.int64)
    number[used] = 1 + np.arange(len(used))
    base = 2
    while base**3 <= len(used):
        base += 1

    def spelled(x: np.ndarray) -> str:
        n = number[x]
        letters = np.stack([n // (base * base), n // base % base + base, n % base + 2 * base], axis=-1) + 0x100
        return letters.astype("<u4").tobytes().decode("utf-32-le")

    text, found = spelled(codes), []
    for s in range(0, len(phrases), SHARD_PHRASES):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        part, size = spelled(phrases[s : s + SHARD_PHRASES].ravel()), 3 * PHRASE
        for i in range(0, len(part), size):
            automaton.add_word(part[i : i + size])
        automaton.make_automaton()
        found.append(np.fromiter((end for end, _ in automaton.iter(text)), np.int64) // 3 - PHRASE + 1)
    return np.concatenate(found)


def _later(words: Words, first: np.ndarray, here: np.ndarray) -> np.ndarray:
    """The windows that stand somewhere earlier.  first: where the block has each repeated window first."""
    order = np.argsort(first)
    first, here = first[order], here[order]
    near = np.zeros(len(words.codes) + 1, np.int64)
    hits = _occurrences(words.codes, _phrases(first, words.codes))
    np.add.at(near, np.maximum(hits - (WINDOW - PHRASE), 0), 1)
    np.add.at(near, hits + 1, -1)
    possible = words.windows[np.cumsum(near)[words.windows] > 0]
    if not len(possible):
        return possible
    key = _rolled(words.hashes()[0], WINDOW, _BASE)
    by_key = np.argsort(key[first])
    at = first[by_key]
    got = np.minimum(np.searchsorted(key[at], key[possible]), len(at) - 1)
    same = np.ones(len(possible), bool)
    for j in range(WINDOW):  # word by word: what hashes alike need not be alike
        same &= words.codes[possible + j] == words.codes[at[got] + j]
    return possible[same & ~((here[by_key][got] > 0) & (at[got] == possible))]  # all but the first of all


_RESULT = "id {0}, n_words long, n_removed long, removed array<struct<start:int,stop:int>>, kept_text string"


def _cleaned(docs: pa.Table, repeated: pa.Table) -> pa.Table:
    docs, words = _texts(docs)
    x = {n: np.frombuffer(b"".join(repeated[n].to_pylist()), kind) for n, kind in (("text", np.uint32), ("start", np.uint32), ("here", np.uint8))}
    later = _later(words, words.bases[x["text"]] + x["start"], x["here"])
    cover = np.zeros(len(words.codes) + 1, np.int64)
    np.add.at(cover, later, 1)
    np.add.at(cover, later + WINDOW, -1)
    gone = np.cumsum(cover)[:-1] > 0
    kept = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(~gone)])[words.bases].astype(np.int32), words.vocabulary.take(pa.array(words.codes[~gone])))
    n_gone = np.concatenate([[0], np.cumsum(gone)])[words.bases]
    text_of = np.repeat(np.arange(len(words.lengths)), words.lengths)
    opens = gone & np.concatenate([[True], ~gone[:-1] | (text_of[1:] != text_of[:-1])])[: len(gone)]
    shuts = gone & np.concatenate([~gone[1:] | (text_of[1:] != text_of[:-1]), [True]])[: len(gone)]
    a, b = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    of = text_of[a]
    spans = pa.StructArray.from_arrays([pa.array((a - words.bases[of]).astype(np.int32)), pa.array((b - words.bases[of]).astype(np.int32))], ["start", "stop"])
    listed = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words.lengths)))]).astype(np.int32), spans)
    text = pc.binary_join(kept, pa.scalar(b" ", pa.binary())).cast(pa.string())
    return pa.table({"id": docs["id"], "n_words": pa.array(words.lengths), "n_removed": pa.array(np.diff(n_gone).astype(np.int64)), "removed": listed, "kept_text": text})


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """The bucketed table of blocks (id, ord, th, text, block), in the shared folder, and the number of blocks."""
    spark = prepare(docs.sparkSession)
    text = whole(text_col)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = int(-(-size // block_bytes)) or 1
    ident, th = F.col(id_col), F.hash(text)
    rows = docs.select(ident.alias("id"), F.coalesce(ident.cast("long"), F.lit(_LAST)).alias("ord"), th.alias("th"), text.alias("text"), F.pmod(F.xxhash64(ident, th), F.lit(n)).alias("block"))
    buckets = -(-n // BLOCKS_A_BUCKET)
    name = f"factgate_blocks_{uuid.uuid4().hex}"
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}"
    rows.repartition(buckets, "block").write.bucketBy(buckets, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name), n


def drop_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, removed (spans of words), kept_text (kept words, joined by one space).

    A word is removed if a window of 20 words covers it whose words also start earlier: in a row with a smaller id, or
    earlier in the same row.  Windows are judged on the input.  Ids are integers; null ids come last, rows that repeat an id
    ascend by a hash of their text, and of rows that repeat both one counts as the first.  Null and empty texts have no
    words and stay as empty; texts under 20 words lose nothing.  Long texts are one block each, whatever their size.  Only
    the two columns are read, so others never clash; an empty table gives no rows.

    The table of blocks stays in the shared folder and in the session's catalog, as checkpoints do.
    """
    blocks, n = _blocks(docs, id_col, text_col, block_bytes)
    by_block = blocks.groupBy("block")
    anchors = by_block.applyInArrow(_anchor_rows(n), "shard long, block long, h binary")
    recurring = anchors.groupBy("shard").applyInArrow(_recurring, "block long, h binary")
    windows = by_block.cogroup(recurring.groupBy("block")).applyInArrow(_window_rows(n), "shard long, block long, " + ", ".join(f"{c} binary" for c in _WINDOW_KINDS))
    repeated = windows.groupBy("shard").applyInArrow(_confirmed, "block long, text binary, start binary, here binary")
    out = by_block.cogroup(repeated.groupBy("block")).applyInArrow(_cleaned, _RESULT.format(blocks.schema["id"].dataType.simpleString()))
    return out.withColumnRenamed("id", id_col)
