"""Language-model scores from a class-based log-bilinear model trained with noise-contrastive estimation.

P(word | history) = P(class | two classes before) * P(word | class).  The first factor is a log-bilinear neural model:
the history's predicted vector is a linear map of the two class vectors, its products with the output vectors and a
bias give scores, and a softmax over all classes, as batched matrix products, normalises them.  The most frequent words
are classes of their own, all others share classes by their endings, so a class needs no vocabulary.  The second factor
is additively smoothed from exact counts of all training words, with room for one unknown word in each class.

Everything gathered covers all training texts: word counts by an ordinary shuffle, and class trigrams, which number at
most CLASSES**3 however large the corpus is and on which numpy trains the model: with those counts the expectation over
noise samples is taken exactly instead of drawn.  Words beyond a bounded head join their counts by a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import _slices
from .common import prepare, stored, whole

#: Classes; of these the first SINGLE are single words (end of text among them), the last is the start of a text.
CLASSES, SINGLE = 128, 50
START = CLASSES - 1
#: Words with broadcast counts at most, and the longest of them in bytes (longer ones have stand-ins); entries a task counts before it hands on.
HEAD, WORD_BYTES, FLUSH = 150_000, 64, 300_000
#: Vector size, noise samples per word, training steps, and the mass added to each count.
SIZE, NOISE, STEPS, ADDED = 32, 10, 150, 0.1
END = b""


def tokens(text: str) -> list[bytes]:
    """Words with A-Z in lower case, very long ones by their stand-ins, then the end, which no word equals."""
    words = text.encode().lower().split()
    if words and len(max(words, key=len)) > WORD_BYTES:
        words = [w if len(w) <= WORD_BYTES else _short(w) for w in words]
    words.append(END)
    return words


def _short(word: bytes) -> bytes:
    """A very long word's stand-in: 128 bits of it, and its ending."""
    return b"\x00" + xxhash.xxh3_128_digest(word) + word[-2:]


def ending_class(word: bytes) -> int:
    return SINGLE + zlib.crc32(word[-2:]) % (START - SINGLE)


class Model(NamedTuple):
    vectors: np.ndarray
    maps: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray

    def log10_table(self) -> np.ndarray:
        """[class before last, last class, class]: normalised log10 probabilities."""
        history = (self.vectors @ self.maps[1])[:, None, :] + (self.vectors @ self.maps[0])[None, :, :]
        s = history.reshape(-1, history.shape[-1]) @ self.outputs.T + self.bias
        s -= s.max(axis=1, keepdims=True)
        s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
        return (s / np.log(10)).astype(np.float32).reshape(CLASSES, CLASSES, CLASSES)


def train(counts: np.ndarray, steps: int = STEPS, seed: int = 1) -> Model:
    """Noise-contrastive estimation on counts[class before last, last class, class], by Adam over all of it."""
    k, rng = CLASSES, np.random.default_rng(seed)
    n = counts.reshape(k * k, k).astype(np.float32)
    total = max(1.0, float(n.sum()))
    noise = (n.sum(0) + 0.5) / (n.sum() + 0.5 * k)
    rows = np.flatnonzero(n.sum(1))
    n, before, last = n[rows] / total, rows // k, rows % k
    drawn = NOISE * n.sum(1, keepdims=True) * noise
    p = [rng.normal(0, 0.1, (k, SIZE)), rng.normal(0, 0.1, (2, SIZE, SIZE)) + np.eye(SIZE), rng.normal(0, 0.1, (k, SIZE)), np.log(noise)]
    p = [x.astype(np.float32) for x in p]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    shift = np.log(NOISE * noise).astype(np.float32)
    for step in range(1, steps + 1) if len(rows) else ():
        r, c, q, b = p
        history = (r @ c[1])[before] + (r @ c[0])[last]
        real = 1 / (1 + np.exp(-np.clip(history @ q.T + b - shift, -30, 30)))  # that a word is data rather than noise
        g = n * (1 - real) - drawn * real
        by_history = g @ q
        d_before, d_last = np.zeros_like(r), np.zeros_like(r)
        np.add.at(d_before, before, by_history)
        np.add.at(d_last, last, by_history)
        grads = [d_before @ c[1].T + d_last @ c[0].T, np.stack([r.T @ d_last, r.T @ d_before]), g.T @ history, g.sum(0)]
        for i, x in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * x
            v[i] = 0.99 * v[i] + 0.01 * x * x
            p[i] = p[i] + (0.05 * (1 - step / (steps + 1)) + 0.002) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-10)
    return Model(*p)


class Words(NamedTuple):
    """The head: number of each word, its class, its count."""

    number: dict[bytes, int]
    classes: np.ndarray
    counts: np.ndarray


def word_classes(words: list[bytes], head: Words) -> tuple[np.ndarray, np.ndarray]:
    """(number in the head or -1, class) of each word."""
    get = head.number.get
    at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    classes = head.classes[at]
    for i in np.flatnonzero(at < 0):
        classes[i] = ending_class(words[i])
    return at, classes


def histories(classes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class before last, last class) of each token of texts laid end to end; a text's first two see its start."""
    last = np.concatenate([[START], classes[:-1]])
    last[ends[:-1]] = START
    before = np.concatenate([[START], last[:-1]])
    before[ends[:-1]] = START
    return before, last


def _laid_out(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    words: list[bytes] = []
    ends = [0]
    for t in texts:
        words += tokens(t)
        ends.append(len(words))
    return words, np.array(ends)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) of all tokens of a one-column table of texts; counted within tasks before the shuffle."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for b in _slices(batches):
            for t in b.column(0).to_pylist():
                held.update(tokens(t))
            if len(held) > FLUSH:
                yield out()
                held.clear()
        yield out()

    return texts.mapInArrow(per_task, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame) -> Column:
    """Which rows of (word, n) are the head: those from the smallest count on that at most HEAD words reach, by eighths of octaves.

    A histogram of counts decides, so no task sorts words and only the head itself reaches the driver.
    """
    real = F.col("word") != F.lit(END)
    octave = F.floor(8 * F.log2(F.col("n").cast("double")))
    seen, least = 0, 0
    for r in sorted(counts.where(real).groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["o"]):
        seen += r["words"]
        if seen > HEAD:
            least = r["o"] + 1
            break
    return real & (octave >= least)


def count_trigrams(texts: DataFrame, head: Words) -> np.ndarray:
    """[class before last, last class, class] over all tokens of all texts; at most CLASSES**3 numbers reach the driver."""
    shared = texts.sparkSession.sparkContext.broadcast(head)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CLASSES**3, np.int64)
        for b in _slices(batches):
            words, ends = _laid_out(b.column(0).to_pylist())
            if words:
                _, classes = word_classes(words, shared.value)
                before, last = histories(classes, ends)
                held += np.bincount((before * CLASSES + last) * CLASSES + classes, minlength=CLASSES**3)
        code = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(held[code])], ["code", "n"])

    got = texts.mapInArrow(per_task, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES**3)
    out[got.column("code").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(CLASSES, CLASSES, CLASSES)


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row's whole text.

    The model learns from the rows where `training` holds; held_out tells that it does not (null: held out).  Tokens are
    the words and one end, so null and empty texts have one token.  n_known counts tokens that training has; base_score
    is the additively smoothed unigram log10 probability, score the model's.  Without training rows every token has base
    probability 1 and the model is uniform over classes.  Rows are independent of each other's ids: repeated and null
    ids stay as they are, texts of any length are read whole, and only the named columns are read; an empty table gives
    no rows.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), (~F.coalesce(training, F.lit(False))).alias("held_out"), whole(text_col).alias("text"))
    learnt = rows.where(~F.col("held_out")).select("text")
    counts = stored(count_words(learnt))
    n_all, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    in_head = head_words(counts)
    top = counts.where(in_head).toArrow()  # at most HEAD rows
    end = counts.where(F.col("word") == F.lit(END)).collect()
    words = [(END, end[0]["n"] if end else 0)] + sorted(zip(top.column("word").to_pylist(), top.column("n").to_pylist()), key=lambda x: (-x[1], x[0]))
    # -1, the number of words beyond the head, reads the last entry: a filler.
    head = Words({w: i for i, (w, _) in enumerate(words)}, np.array([i if i < SINGLE else ending_class(w) for i, (w, _) in enumerate(words)] + [0]), np.array([n for _, n in words] + [0], np.float64))
    model = train(count_trigrams(learnt, head))
    # Mass of each shared class: all its words and one unknown.
    tail = counts.where(~in_head & (F.col("word") != F.lit(END)))

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CLASSES)
        for b in batches:
            np.add.at(held, [ending_class(w) for w in b.column(0).to_pylist()], b.column(1).to_numpy() + ADDED)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(held)], ["c", "mass"])

    mass = np.full(CLASSES, ADDED)
    np.add.at(mass, head.classes[SINGLE : len(words)], head.counts[SINGLE : len(words)] + ADDED)
    for r in tail.mapInArrow(masses, "c int, mass double").groupBy("c").agg(F.sum("mass").alias("mass")).collect():
        mass[r["c"]] += r["mass"]
    base_of = np.log10((head.counts + ADDED) / (n_all + ADDED * (distinct + 1)))
    within = np.where(np.arange(len(words) + 1) < SINGLE, 0.0, np.log10((head.counts + ADDED) / mass[head.classes]))
    base_of[-1] = within[-1] = 0
    shared = spark.sparkContext.broadcast((head, model, base_of, within, np.log10(mass)))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, model, base_of, within, log_mass = shared.value
        table = model.log10_table().reshape(-1)
        for b in _slices(batches):
            words, ends = _laid_out(b.column(2).to_pylist())
            at, classes = word_classes(words, head)
            before, last = histories(classes, ends)
            far = at < 0
            gained = table[(before * CLASSES + last) * CLASSES + classes].astype(np.float64) + within[at] - np.where(far, log_mass[classes], 0)
            each = lambda x: np.add.reduceat(x, ends[:-1]) if len(x) else x
            where = np.flatnonzero(far)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(where, ends).astype(np.int32)), pa.array([words[i] for i in where], pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.diff(ends)), pa.array(each((~far & (head.counts[at] > 0)).astype(np.int64))), pa.array(each(base_of[at])), pa.array(each(gained)), lists],
                ["id", "held_out", "n_tokens", "known", "base", "gained", "far"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    first = stored(rows.mapInArrow(per_task, f"id {kind}, held_out boolean, n_tokens long, known long, base double, gained double, far array<binary>").withColumn("uid", F.monotonically_increasing_id()))
    # Words beyond the head: one row per text and word, joined with their counts.  None has more than 1 / HEAD of all tokens.
    far = first.select("uid", F.explode("far").alias("word")).groupBy("uid", "word").agg(F.count(F.lit(1)).alias("times")).join(tail, "word", "left")
    c = F.coalesce("n", F.lit(0)) + F.lit(ADDED)
    more = far.groupBy("uid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known_far"),
        F.sum(F.col("times") * F.log10(c / F.lit(n_all + ADDED * (distinct + 1)))).alias("base_far"),
        F.sum(F.col("times") * F.log10(c)).alias("gained_far"),
    )
    zero = lambda name: F.coalesce(name, F.lit(0))
    return first.drop("far").join(more, "uid", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + zero("known_far")).cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_far")).alias("base_score"),
        (F.col("gained") + zero("gained_far")).alias("score"),
    )
