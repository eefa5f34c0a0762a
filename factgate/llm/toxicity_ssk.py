"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

The kernel of two words counts the letter triples they share as subsequences, each occurrence weighted by DECAY to the
power of its span, so letters put between or into those of an insult only lower it.  Words are rows of bytes between
two boundary marks, with punctuation deleted.  Labels are of documents, and a document is read as one labelled sentence: a
bag of words, whose margin is that of its worst word.  No text is split further.  The words that bear a positive label are
found by how surely they occur in toxic documents alone; all of them train the SVM, with inserted and gapped variants.
Against them stand the words of clean documents.  Training works on a growing set of those: as long as any clean word
of the whole labelled sample lies inside the margin, the hardest join the set, so the machine is that of all of them.
Landmarks make the kernel expansion a short sum, which collapses into one weight per triple: documents are scored by
table look-ups.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import _slices
from .common import hold, prepare, stored, whole

DECAY, ALPHABET, LETTERS = 0.6, 64, 22
#: Labelled documents used at most; rank of the Nyström approximation.
LABELLED, LANDMARKS = 50_000, 800
#: Clean words that training begins with and that join it at a time; how far inside the margin (-1) those left out may lie.
STEP, TOLERANCE = 4000, 0.05
REMEMBERED = 400_000
#: Weight of the training errors against the norm.
STRICT = 20_000

_DELETED = bytes(b for b in range(33, 127) if not chr(b).isalnum()) + b"\xc2\xc3"


def _codes() -> np.ndarray:
    """Byte -> code: letters, one for digits, the low bits of continuation bytes, one for the rest."""
    of = np.full(256, 59, np.uint8)
    of[ord("a") : ord("z") + 1] = range(26)
    of[ord("0") : ord("9") + 1] = 26
    of[0x80:0xC0] = 27 + np.arange(64) % 32
    return of


CODES, OPEN, CLOSE = _codes(), 60, 61


def words_of(text: str) -> set[bytes]:
    """The distinct units of a text: its words without punctuation, in pieces of LETTERS with half overlap where longer, and runs of three or more single letters joined."""
    tokens = text.lower().encode().translate(None, _DELETED).split()
    found = set(tokens)
    if len(found) and any(len(t) == 1 for t in found):
        run: list[bytes] = []
        for t in [*tokens, b"  "]:
            if len(t) == 1:
                run.append(t)
            else:
                if len(run) > 2:
                    found.add(b"".join(run))
                run = []
    for t in [t for t in found if len(t) > LETTERS]:
        found.remove(t)
        found.update(t[i : i + LETTERS] for i in range(0, len(t) - LETTERS // 2, LETTERS // 2))
    return found


def signature(text: str) -> int:
    """The least hash of the text's runs of three words (of all of it, if shorter): near copies mostly share it."""
    w = text.lower().encode().split()
    return min((xxhash.xxh3_64_intdigest(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2)))) - (1 << 63)


def coded(words: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate([[OPEN], CODES[np.frombuffer(w, np.uint8)], [CLOSE]]).astype(np.int64) for w in words]


@lru_cache(maxsize=64)
def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of n positions, and the weights of their spans."""
    t = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
    return t, (DECAY ** (t[:, 2] - t[:, 0] + 1)).astype(np.float32)


def features(words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(triple codes, weights) of each word, scaled to length 1."""
    out = []
    for c in coded(words):
        t, w = triples(len(c))
        keys, at = np.unique((c[t[:, 0]] * ALPHABET + c[t[:, 1]]) * ALPHABET + c[t[:, 2]], return_inverse=True)
        v = np.bincount(at, w, len(keys))
        out.append((keys, v / max(1e-12, math.sqrt((v**2).sum()))))
    return out


class Machine(NamedTuple):
    table: np.ndarray
    bias: float
    cut: float


def kernel(left: list, right: list) -> np.ndarray:
    """Normalised kernel of words given by their features."""
    out, row = np.empty((len(left), len(right))), np.zeros(ALPHABET**3)
    keys, values = np.concatenate([k for k, _ in left]), np.concatenate([v for _, v in left])
    starts = np.cumsum([0, *(len(k) for k, _ in left)])[:-1]
    for j, (k, v) in enumerate(right):
        row[k] = v
        out[:, j] = np.add.reduceat(row[keys] * values, starts)
        row[k] = 0
    return out


@lru_cache(maxsize=64)
def _paired(n: int) -> tuple[np.ndarray, ...]:
    """The first two positions of all pairs, and for all triples the number of their pair, their last position and their weight."""
    t, w = triples(n)
    first, second = np.triu_indices(n, 1)
    number = np.zeros((n, n), np.int32)
    number[first, second] = np.arange(len(first))
    return first, second, number[t[:, 0], t[:, 1]], t[:, 2], w


def self_kernel(c: np.ndarray) -> np.ndarray:
    """The kernel of each row of codes with itself, by the subsequence dynamic programme, all rows at once."""
    m, n = c.shape
    same = (c[:, :, None] == c[:, None, :]) * (DECAY * DECAY)
    before = np.ones((n + 1, n + 1, m))  # of subsequences of one length less, by prefixes of both copies
    for _ in range(2):
        now = np.zeros((n + 1, n + 1, m))
        for i in range(1, n + 1):
            run = np.zeros(m)
            for j in range(1, n + 1):
                run = DECAY * run + same[:, i - 1, j - 1] * before[i - 1, j - 1]
                now[i, j] = DECAY * now[i - 1, j] + run
        before = now
    return np.einsum("mij,ijm->m", same, before[:n, :n])


def margins(m: Machine, words: list[bytes]) -> np.ndarray:
    """The SVM's margins, by length: the table's weights over all triples, divided by the word's norm."""
    out = np.full(len(words), -1.0)
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        first, second, pair, third, w = _paired(int(n) + 2)
        for part in np.array_split(at, max(1, len(at) * len(w) // 1_000_000)):
            c = np.full((len(part), n + 2), OPEN, np.int32)
            c[:, 1:-1] = CODES[np.frombuffer(b"".join(words[i] for i in part), np.uint8)].reshape(len(part), n)
            c[:, -1] = CLOSE
            pairs = (c[:, first] * ALPHABET + c[:, second]) * ALPHABET
            raw = m.table[pairs[:, pair] + c[:, third]] @ w
            out[part] = raw / np.sqrt(self_kernel(c)) + m.bias
    return out


def variants(word: bytes) -> list[bytes]:
    """Inserted and gapped forms that the training adds."""
    if len(word) < 4:
        return []
    mid = len(word) // 2
    return [word[:mid] + b"x" + word[mid:], word[:2] + word[1:], b"x".join([word[:2], word[2:4], word[4:]])[:LETTERS]]


class Trainer:
    """Squared-hinge SVM on Nyström features, by Newton steps from the weights before; both classes weigh the same.

    Landmarks are fixed, so the features of a word are computed once, however often others join.
    """

    def __init__(self, positive: list[bytes], negative: list[bytes], landmarks: int = LANDMARKS) -> None:
        pos = features(positive + [v for p in positive for v in variants(p)])
        neg = features(negative)
        self.base = pos[: landmarks // 2] + neg[: landmarks // 2]  # insults and their variants; the hardest clean words
        values, axes = np.linalg.eigh(kernel(self.base, self.base))
        good = values > 1e-6 * values.max()
        self.to = axes[:, good] / np.sqrt(values[good])
        self.x = [self._rows(pos), self._rows(neg)]
        self.w = np.zeros(self.to.shape[1] + 1)

    def _rows(self, words: list) -> np.ndarray:
        return np.hstack([kernel(words, self.base) @ self.to, np.ones((len(words), 1))]).astype(np.float32)

    def add(self, negative: list[bytes]) -> None:
        self.x[1] = np.vstack([self.x[1], self._rows(features(negative))])

    def fit(self) -> Machine:
        ridge = np.eye(len(self.w))
        ridge[-1, -1] = 1e-6
        for _ in range(30):
            left, right = ridge.copy(), np.zeros(len(self.w))
            for x, y in zip(self.x, (1.0, -1.0)):
                on = x[y * (x @ self.w.astype(np.float32)) < 1].astype(np.float64)
                left += on.T @ on * (STRICT / len(x))
                right += on.sum(axis=0) * (y * STRICT / len(x))
            new = np.linalg.solve(left, right)
            done = np.allclose(new, self.w, atol=1e-6)
            self.w = new
            if done:
                break
        table = np.zeros(ALPHABET**3)
        for a, (keys, v) in zip(self.to @ self.w[:-1], self.base):
            table[keys] += a * v
        return Machine(table.astype(np.float32), float(self.w[-1]), 0.0)


def fit(positive: list[bytes], negative: list[bytes], landmarks: int = LANDMARKS) -> Machine:
    """A machine of these words alone."""
    return Trainer(positive, negative, landmarks).fit()


def train(docs: DataFrame, labels: DataFrame, label_col: str, use: Column, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED) -> Machine | None:
    """A machine from at most `labelled` labelled documents, the first by hash of their ids; None where no word is surely toxic."""
    prepare(docs.sparkSession)
    known = labels.where(use & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) == 1).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(labelled)
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).join(F.broadcast(sample), "id").select("label", "text")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            texts = b.column(1).to_pylist()
            columns = [b.column(0), pa.array(map(signature, texts), pa.int64()), pa.array([sorted(words_of(t)) for t in texts], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "signature", "words"])

    # A word is as sure as the texts that hold it are many: copies and most near copies count once.
    texts = rows.mapInArrow(units, "label int, signature long, words array<binary>").dropDuplicates(["label", "signature"])
    words = stored(texts.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg")))
    share = sample.agg(F.avg("label")).first()[0]
    if not share:
        return None
    share = max(share, 0.05)
    # So many toxic documents a word needs, and no clean one, that by chance no word would have them.
    often = {r["d"]: r["n"] for r in words.groupBy(F.least(F.col("pos") + F.col("neg"), F.lit(64)).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    need = next((d for d in range(3, 65) if sum(n for k, n in often.items() if k >= d) * share**d < 0.25), 64)
    sure = words.where((F.col("pos") >= need) & (F.col("neg") <= F.col("pos") / 50) & (F.length("word") > 1)).orderBy(F.desc("pos"), "word").collect()
    if not sure:
        return None
    positive = [bytes(r["word"]) for r in sure]
    clean = words.where(F.col("neg") > F.col("pos") / 5)  # also what both kinds of documents say: an insult is as good as never in clean ones
    frequent = [bytes(r["word"]) for r in clean.orderBy(F.desc("neg"), "word").limit(STEP // 4).collect()]
    others = [bytes(r["word"]) for r in clean.orderBy(F.xxhash64("word"), "word").limit(STEP // 4).collect()]
    negative = list(dict.fromkeys(frequent + others))
    trainer: Trainer | None = None
    machine, top = fit(positive, negative), -1.0
    while True:
        inside = _margins(clean.select("word"), machine).where(F.col("margin") > TOLERANCE - 1).orderBy(F.desc("margin"), "word")
        known = set(negative)
        hard = [(float(r["margin"]), bytes(r["word"])) for r in inside.limit(len(known) + STEP).collect()]  # known ones stay inside where they must
        top = max((x for x, _ in hard), default=-1.0)
        new = [w for _, w in hard if w not in known][:STEP]
        if not new:
            break
        negative = new + negative
        if trainer is None:  # landmarks are the hardest words of the first look at all of them
            trainer = Trainer(positive, negative)
        else:
            trainer.add(new)
        machine = trainer.fit()
    low = float(np.quantile(margins(machine, positive), 0.02))
    return machine._replace(cut=top + (low - top) * (0.35 if top < low else 0.5))  # nearer to the clean words: insults unseen so far lie in between


def _margins(words: DataFrame, machine: Machine) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast(machine)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(margins(shared.value, b.column(0).to_pylist()))], ["word", "margin"])

    return words.mapInArrow(per_task, "word binary, margin double")


class _Seen(dict):
    """Margins of words already met by a worker, kept from task to task."""

    def worst(self, machine: Machine, words: list[set[bytes]]) -> list[float]:
        new = list({w for ws in words for w in ws if w not in self})
        if new:
            if len(self) + len(new) > REMEMBERED:
                self.clear()
                new = list({w for ws in words for w in ws})
            self.update(zip(new, margins(machine, new).tolist()))
        return [max(map(self.__getitem__, ws), default=-math.inf) for ws in words]


@lru_cache(maxsize=1)
def _seen(token: str) -> _Seen:
    return _Seen()


def score_toxicity(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row's whole text.

    Scores lie in 0..1 and rise with the margin of the text's worst word; 0.7 stands for the cut between toxic and
    clean words.  Texts without words, null ones too, score 0, and so does every text when nothing could be learnt.
    Equal texts have equal scores; repeated rows and ids stay as they are, long texts are read whole, and an empty table
    gives no rows.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    if machine is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"))
    shared, token = spark.sparkContext.broadcast(machine), uuid.uuid4().hex

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity_ssk", _seen.cache_clear)
        seen = _seen(token)
        for b in _slices(batches):
            worst = np.array(seen.worst(shared.value, [words_of(t) for t in b.column(1).to_pylist()]))
            score = 1 / (1 + np.exp(-np.clip(8 * (worst - shared.value.cut) + math.log(0.7 / 0.3), -60, 60)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.where(np.isinf(worst), 0.0, score))], ["id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(per_task, f"id {kind}, score double").select(F.col("id").alias(id_col), "score")
