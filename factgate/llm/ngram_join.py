"""N-gram Jaccard join: near-duplicate classes of documents by a grouped prefix join.

A document is the set of its word shingles.  Documents of equal sets are one member; members with the same prefix and
the same size are one group.  The order that prefixes are cut from goes from rare to frequent by a counting sketch of
all shingles (any order gives the same links; this one keeps common passages out of the prefixes).  Groups meet through
the shingles of their prefixes:

1. Postings are dealt by range over (shingle, hash), so no shingle, however common, fills a task.  Each posting is paired
   with the next one of its shingle only, in an order that differs from shingle to shingle; these pairs are verified on
   the whole texts and nearly always connect what belongs together.
2. What is left to find are links between different components.  Shingles whose postings still lie in several components
   are joined exhaustively by size class, in blocks of bounded size, on groups: component, size, position and, for groups
   of one member, parity-signature bounds, none of which can lose a link, drop nearly all group pairs.  The pairs that
   stay are expanded to their members, in blocks again, filtered by their signatures, and the rest is verified on the
   texts.  Members of one group share all of its prefix: a group in several components is paired with itself.

So every pair that could link two components is looked at, and no task, broadcast or result grows with the square of a
group of copies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import _slices
from .common import hold, packed, prepare, stored, whole

#: Words of a shingle; a link needs 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 5, 80
#: Counters of the sketch (it is broadcast at one byte each), and the parts it is summed in.
SKETCH, PARTS = 1 << 22, 64
#: Entries of a block in the exhaustive step, at least; keys that are broadcast at most when texts are fetched; pairs of a member before it is split,
#: and shingles of these pairs, as they are texts in one task.
BLOCK, FETCH_BROADCAST, HOT, HOT_SHINGLES = 256, 200_000, 256, 1 << 17
#: Entries up to which runs are compared together, and rows of a tile of longer ones.
SHORT, TILE = 64, 64
#: Map tasks whose counts one task of the sketch sums, and rows of a key from which on a join broadcasts its entry.
FAN_IN, HOT_ROWS = 256, 512
REMEMBERED = 150_000


class _Hashes(dict):
    """64-bit hashes of words already met by a worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


HASHES = _Hashes()
_STEP, _STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles: A-Z lowered, words between ASCII white space; with fewer words, the whole sequence is one."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(HASHES.__getitem__, found), np.uint64, len(found))
    k = min(words, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = h * _STEP + w[i : i + n]
    h = (h ^ (h >> np.uint64(32))) * _STIR
    return np.unique(h ^ (h >> np.uint64(29)))


def least_overlap(total: int, percent: int = PERCENT) -> int:
    """The smallest intersection with which sets of `total` elements together can link."""
    return -(-percent * total // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Of two linked sets, the prefixes of this length have an element in common."""
    return n - -(-percent * n // 100) + 1


def signature(s: np.ndarray) -> bytes:
    """Parity bits: element x flips bit x mod size; at least as many bits as twice the elements."""
    bits = 64
    while bits < 2 * len(s):
        bits *= 2
    return np.packbits((np.bincount((s >> np.uint64(16) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def differ(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of the sets that the signatures are of."""
    if len(a) < len(b):
        a, b = b, a
    x, bits = int.from_bytes(a, "little"), 8 * len(a)
    while bits > 8 * len(b):
        bits //= 2
        x = (x & ((1 << bits) - 1)) ^ (x >> bits)
    return (x ^ int.from_bytes(b, "little")).bit_count()


def frequency_sketch(texts: DataFrame) -> np.ndarray:
    """log2 of how often shingles of each slot occur, one byte a slot; of fixed size, and summed in parts on the executors."""
    size = SKETCH // PARTS

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("ngram_join", HASHES.clear)
        held = np.zeros(SKETCH, np.uint32)
        for b in _slices(batches):
            sets = [shingles(t) for t in b.column(0).to_pylist()]
            slots, times = np.unique(np.concatenate(sets) & np.uint64(SKETCH - 1), return_counts=True)
            held[slots] += times.astype(np.uint32)
        small = np.minimum(held, 65535).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([small[i * size : (i + 1) * size].tobytes() for i in range(PARTS)], pa.binary())], ["part", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[part] = held.get(part, 0) + np.frombuffer(counts, np.uint16).astype(np.uint64)
        return held

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = summed(batches)
        small = [np.minimum(x, 65535).astype(np.uint16).tobytes() for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(small, pa.binary())], ["part", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = summed(batches)
        logs = [zlib.compress(np.log2(np.maximum(x, 1).astype(np.float64)).astype(np.uint8).tobytes()) for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(logs, pa.binary())], ["part", "logs"])

    counted = texts.mapInArrow(per_task, "part int, counts binary")
    salts = -(-texts.rdd.getNumPartitions() // FAN_IN)
    if salts > 1:
        counted = counted.withColumn("salt", F.spark_partition_id() % salts).repartition(PARTS * salts, "part", "salt").mapInArrow(partial, "part int, counts binary")
    parts = counted.repartition(PARTS, "part").mapInArrow(total, "part int, logs binary").collect()
    out = np.zeros(SKETCH, np.uint8)
    for r in parts:
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(zlib.decompress(r["logs"]), np.uint8)
    return out


def _described(docs: DataFrame, logs: np.ndarray, percent: int) -> DataFrame:
    """(id, tkey, n, member, grp, prefix, sig) of every document; member is a digest of its set, null where that is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("ngram_join", HASHES.clear)
        logs = shared.value
        for b in _slices(batches):
            out: list[list] = [[], [], [], [], []]
            for t in b.column(2).to_pylist():
                s = shingles(t)
                if not len(s):
                    row = (0, None, None, None, None)
                else:
                    order = np.lexsort((s, logs[(s & np.uint64(SKETCH - 1)).astype(np.int64)]))
                    prefix = s[order[: prefix_length(len(s), percent)]]
                    grp = xxhash.xxh64_intdigest(prefix.tobytes(), len(s)) - (1 << 63)
                    row = (len(s), xxhash.xxh3_128_digest(s.tobytes()), grp, prefix.view(np.int64), signature(s))
                for to, x in zip(out, row):
                    to.append(x)
            arrays = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], ["id", "tkey", "n", "member", "grp", "prefix", "sig"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(per_task, f"id {kind}, tkey binary, n long, member binary, grp long, prefix array<long>, sig binary")


def _meetings(postings: DataFrame) -> DataFrame:
    """The postings (grp, n, shingle, pos) whose shingle has others, with the next posting of the shingle as (next, next_n).

    The first and last shingles of a task may go on in the neighbouring task, so their postings always stay.
    """

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["grp", "n", "shingle", "pos", "next", "next_n"]
        held: pa.Table | None = None
        first, before = None, False

        def out(t: pa.Table, keep: np.ndarray, same_next: np.ndarray) -> pa.RecordBatch:
            grp, n = t.column("grp").to_numpy(), t.column("n").to_numpy()
            nxt = lambda x: pa.array(np.append(x[1:], 0)[: len(keep)], mask=~same_next)
            cols = [pa.array(t.column(c).to_numpy()[: len(keep)]) for c in names[:4]] + [nxt(grp), nxt(n)]
            return pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep))

        for b in batches:
            if not b.num_rows:
                continue
            new = pa.Table.from_batches([b]).select(names[:4])
            t = new if held is None else pa.concat_tables([held, new])
            s = t.column("shingle").to_numpy()
            first = s[0] if first is None else first
            same_next = s[:-1] == s[1:]
            same_before = np.concatenate([[before], same_next])
            if len(s) > 1:
                yield out(t, same_next | same_before[:-1] | (s[:-1] == first), same_next)
            held, before = t.slice(len(s) - 1), bool(same_before[-1])
        if held is not None:
            yield out(held, np.array([True]), np.array([False]))

    dealt = postings.withColumn("turn", F.xxhash64("grp", "shingle"))
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartitionByRange(parts, "shingle", "turn").sortWithinPartitions("shingle", "turn")
    return dealt.mapInArrow(per_task, "grp long, n long, shingle long, pos int, next long, next_n long")


def _could_link(pairs: DataFrame) -> DataFrame:
    """Of (a, b, a_n, b_n, a_sig, b_sig), the (a, b) that the signatures do not rule out."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [differ(x, y) <= m + n - 2 * least_overlap(m + n) for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("a_n", "b_n", "a_sig", "b_sig")))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(per_task, "a binary, b binary")


def _texts_dealt(pairs: DataFrame, active: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, a_copy, b, text): the text of each a with a null b, and behind it those of the b that it is paired with; a row holds one text.

    active (member, pairs, n) are the members of the pairs.  Texts of members with very many or very long pairs are copied,
    and the pairs dealt to the copies, so that neither a task nor a batch of rows has to hold them all.
    """
    share = F.greatest(F.col("pairs") / HOT, F.least(F.col("pairs") * F.col("n") / HOT_SHINGLES, F.col("pairs")))
    hot = active.select("member", F.ceil(share).cast("int").alias("copies")).where(F.col("copies") > 1).checkpoint()
    n_hot = hot.count()
    hot = F.broadcast(hot) if n_hot <= FETCH_BROADCAST else hot
    copies = F.coalesce("copies", F.lit(1))
    for x, y in (("b", "a"), ("a", "b")):
        copy = F.pmod(F.xxhash64(y), copies).cast("int") if n_hot else F.lit(0)
        pairs = (pairs.join(hot.withColumnRenamed("member", x), x, "left") if n_hot else pairs).withColumn(f"{x}_copy", copy).drop("copies")
    texts = (texts.join(hot, "member", "left") if n_hot else texts).withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)) if n_hot else F.lit(0)).drop("copies")
    side = lambda x: texts.select(F.col("member").alias(x), F.col("copy").alias(f"{x}_copy"), "text")
    left = side("a").join(pairs.select("a").distinct(), "a", "left_semi").withColumn("b", F.lit(None).cast("binary"))
    rows = left.unionByName(pairs.join(side("b"), ["b", "b_copy"]).drop("b_copy"))
    return rows.repartition("a", "a_copy").sortWithinPartitions("a", "a_copy", F.col("b").asc_nulls_first()).select("a", "a_copy", "b", "text")


def _verified(pairs: DataFrame, members: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of the member pairs (a, b), those that link, by the shingle sets of their whole texts."""
    pairs = pairs.checkpoint()
    active = pairs.select(F.col("a").alias("member")).union(pairs.select("b")).groupBy("member").agg(F.count(F.lit(1)).alias("pairs")).join(members.select("member", "tkey", "n"), "member").checkpoint()
    keys = active.select(F.col("tkey").alias("key"))
    if active.count() <= FETCH_BROADCAST:
        keys = F.broadcast(keys)
    texts = docs.join(keys, F.col("tkey") == F.col("key"), "left_semi").groupBy("tkey").agg(F.first("text").alias("text"))
    texts = stored(active.join(texts, "tkey").select("member", "text"))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("ngram_join", HASHES.clear)
        own, left = "", None
        for batch in _slices(batches):
            keep = []
            for b, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if b is None:
                    own, left = text, None
                    keep.append(False)
                    continue
                left = shingles(own) if left is None else left
                right = shingles(text)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _texts_dealt(pairs, active, texts).mapInArrow(per_task, "a binary, b binary").checkpoint()


def components(links: DataFrame) -> DataFrame:
    """(member, label) of every member with links (a, b): the label is a member of the component.

    Each round hooks every node to its smallest neighbour and contracts; nodes are digests, in random order, so the graph
    shrinks by a constant factor a round.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        hook = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to")).checkpoint()
        rounds.append(hook)
        of = lambda x: hook.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to"))  # noqa: B023, E731
        moved = edges.join(of("a"), "a").join(of("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges = moved.where("a <> b").distinct().checkpoint()
    if not rounds:
        return links.select(F.col("a").alias("member"), F.col("b").alias("label")).limit(0)
    labels = rounds[0].select(F.col("node").alias("member"), F.col("to").alias("label"))
    for hook in rounds[1:]:
        labels = labels.join(hook.withColumnRenamed("to", "further"), F.col("label") == F.col("node"), "left").select("member", F.coalesce("further", "label").alias("label"))
    return labels.checkpoint()


def _further(placed: DataFrame, links: DataFrame) -> DataFrame:
    """placed (member, comp, label, …) with the labels that further links (a, b) of members give: only components that these connect are looked at again."""
    of = lambda x: placed.select(F.col("member").alias(x), F.col("comp").alias(f"{x}_comp"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    merged = components(between).select(F.col("member").alias("comp"), F.col("label").alias("further"))
    return placed.join(merged, "comp", "left").withColumn("label", F.coalesce("further", "label")).drop("further")


def _next_in_group(members: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n, a_sig, b_sig): each member with the next one of its group, dealt by range; the last of a task has none.

    Written out: whoever filters them in Python would have two workers a task otherwise.
    """
    names = ["member", "n", "sig"]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in (x for x in batches if x.num_rows):
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            grp, held = t.column("grp").to_numpy(), t.slice(t.num_rows - 1)
            same = pa.array(grp[:-1] == grp[1:])
            left, right = t.slice(0, t.num_rows - 1).filter(same), t.slice(1).filter(same)
            yield from pa.Table.from_arrays([x.column(c) for c in names for x in (left, right)], ["a", "b", "a_n", "b_n", "a_sig", "b_sig"]).to_batches()

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select("grp", *names).repartitionByRange(parts, "grp", "member").sortWithinPartitions("grp", "member")
    return dealt.mapInArrow(per_task, "a binary, b binary, a_n long, b_n long, a_sig binary, b_sig binary").checkpoint()


def _blocked(entries: DataFrame, keys: list[str], sizes: DataFrame, sigs: DataFrame) -> DataFrame:
    """entries with their sig from sigs (id, sig), copied to pairs of blocks (lo, hi) of their key; sizes (keys, size) is the number of entries of each key."""
    # Blocks grow with the root of the size, so that neither they nor the copies of an entry get too many.
    blocks = sizes.select(*keys, F.ceil(F.col("size") / F.greatest(F.lit(float(BLOCK)), 4 * F.sqrt("size"))).cast("int").alias("blocks"))
    dealt = entries.join(blocks, keys).withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sigs, "id")  # signatures last: they are the long part
    dealt = dealt.select(*keys, F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "role", "id", "comp", "n", "pos", "sig")
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *keys, "lo", "hi").sortWithinPartitions(*keys, "lo", "hi")


def _across(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ids of different components that share a key and that size, position and signature let link.

    Entries (key…, lo, hi, side, role, id, comp, n, pos, sig) with equal (key…, lo, hi) are two blocks of entries, or one
    where lo = hi.  A null comp differs from all, a null sig rules nothing out.  Entries meet whose roles have no bit in common.
    """
    keyed = [c for c in entries.columns if c not in ("side", "role", "id", "comp", "n", "pos", "sig")]

    def looked_at(run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (i, j), i < j, of one run: short runs together, by distance; each long one by itself, in tiles."""
        starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(run)))
        left = np.flatnonzero(np.repeat(sizes <= SHORT, sizes))
        for d in range(1, SHORT):
            left = left[left + d < len(run)]
            left = left[run[left] == run[left + d]]
            if not len(left):
                break
            yield left, left + d
        for start, size in zip(starts[sizes > SHORT], sizes[sizes > SHORT]):
            for top in range(start, start + size, TILE):
                i, j = np.meshgrid(np.arange(top, min(top + TILE, start + size)), np.arange(top, start + size), indexing="ij")
                yield i[i < j], j[i < j]

    def of_runs(t: pa.Table, run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        side, role, n, pos = (t.column(c).to_numpy().astype(np.int64) for c in ("side", "role", "n", "pos"))
        one, sig = t.column("lo").to_numpy() == t.column("hi").to_numpy(), t.column("sig").to_pylist()
        comp = t.column("comp").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        open_ = np.isnan(comp) if comp.dtype.kind == "f" else np.zeros(len(comp), bool)
        for i, j in looked_at(run):
            both = n[i] + n[j]
            need = -(-percent * both // (100 + percent))
            ok = ((comp[i] != comp[j]) | open_[i]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)
            ok &= ((role[i] & role[j]) == 0) & (one[i] | (side[i] != side[j]))
            i, j, most = i[ok], j[ok], (both - 2 * need)[ok]
            near = [sig[x] is None or sig[y] is None or differ(sig[x], sig[y]) <= m for x, y, m in zip(i.tolist(), j.tolist(), most.tolist())]
            yield i[near], j[near]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, run in _runs(batches, keyed):
            ids = t.column("id").combine_chunks()
            for i, j in of_runs(t, run):
                if len(i):
                    x, y = ids.take(pa.array(i)), ids.take(pa.array(j))
                    less = pc.less(x, y)
                    pairs = pa.table([pc.if_else(less, x, y), pc.if_else(less, y, x)], ["a", "b"])
                    yield from pairs.group_by(["a", "b"]).aggregate([]).to_batches()

    name = entries.schema["id"].dataType.simpleString()
    return entries.mapInArrow(per_task, f"a {name}, b {name}").distinct()


def _runs(batches: Iterator[pa.RecordBatch], keyed: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys, and the number of each row's run, of batches that are sorted by their key columns."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for c in keyed:
            x = b.column(c).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
            new[0] |= not held or held[-1].column(c)[-1].as_py() != x[0]
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if new.any() and (held or last):
            t = pa.Table.from_batches([*held, b.slice(0, last)])
            if t.num_rows:
                yield t, np.concatenate([np.zeros(t.num_rows - last, np.int64), np.cumsum(new[:last])])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held), np.zeros(sum(x.num_rows for x in held), np.int64)


def _joined(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(id, tkey, n, member, label, least_id) of every row; label is null where nothing links, least_id that of the member."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("tkey"), whole(text_col).alias("text"))
    every = stored(_described(rows, frequency_sketch(rows.select("text")), percent))
    real = every.where("member IS NOT NULL")
    members = stored(real.groupBy("member").agg(*(F.min(c).alias(c) for c in ("id", "tkey", "n", "grp", "sig")), F.count(F.lit(1)).alias("copies")))
    groups = real.groupBy("grp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    met = stored(_meetings(groups.select("grp", "n", F.posexplode("prefix").alias("pos", "shingle")).select("grp", "n", "shingle", "pos")))

    # 1. Neighbours of the same shingle, and neighbours within a group.
    first = F.struct("member", "n", "sig")
    heads = members.groupBy("grp").agg(F.min(first).alias("head"))
    head = lambda x: heads.select(F.col("grp").alias(f"{x}_grp"), F.col("head.member").alias(x), F.col("head.n").alias(f"{x}_n"), F.col("head.sig").alias(f"{x}_sig"))
    near = met.where(F.col("next").isNotNull() & (F.col("next") != F.col("grp")) & (100 * F.least("n", "next_n") >= percent * F.greatest("n", "next_n")))
    near = near.select(F.least("grp", "next").alias("a_grp"), F.greatest("grp", "next").alias("b_grp")).distinct()
    between = near.join(head("a"), "a_grp").join(head("b"), "b_grp").select("a", "b", "a_n", "b_n", "a_sig", "b_sig")
    links = _verified(_could_link(between.unionByName(_next_in_group(members))), members, rows, percent)

    # 2. Whatever may still link two components: group pairs, then their members.
    placed = members.join(components(links), "member", "left").select("member", "id", "copies", "grp", "n", "sig", "label", F.coalesce("label", "member").alias("comp")).checkpoint()
    lone = F.count(F.lit(1)) == 1
    spread = placed.groupBy("grp").agg(
        F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.when(lone, F.first("sig")).alias("sig"), F.when(lone, F.first("member")).alias("only")
    ).checkpoint()
    at = met.select("shingle", "grp", "pos").join(spread.select("grp", "least", "most", "n"), "grp")
    mixed = at.groupBy("shingle").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most").select("shingle")
    step = float(np.log(101 / percent))  # a little over the largest ratio of linked sizes, so that these are in neighbouring classes
    own = F.floor(F.log(F.col("n").cast("double")) / step).cast("int")
    ladder = F.explode(F.array(F.struct(own.alias("klass"), F.lit(0).alias("role")), F.struct((own + 1).alias("klass"), F.lit(1).alias("role")))).alias("l")
    at = at.join(mixed, "shingle", "left_semi").select("shingle", ladder, F.col("grp").alias("id"), F.when(F.col("least") == F.col("most"), F.col("least")).alias("comp"), "n", "pos")
    at = at.select("shingle", "l.klass", "l.role", "id", "comp", "n", "pos").checkpoint()
    # Of a key, only entries of its own class meet those of the class below and each other; a key of one component has no pair.
    keys = ["shingle", "klass"]
    sizes = at.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.min("role").alias("role"), F.min("comp").alias("least"), F.max("comp").alias("most"), F.count_if(F.col("comp").isNull()).alias("open"))
    sizes = sizes.where("size > 1 AND role = 0 AND (open > 0 OR least <> most)").select(*keys, "size")
    pairs = _across(_blocked(at, keys, sizes, spread.select(F.col("grp").alias("id"), "sig")), percent).checkpoint()
    known = lambda x: spread.select(F.col("grp").alias(x), F.col("only").alias(f"{x}_only"), F.col("size").alias(f"{x}_size"))
    pairs = pairs.join(known("a"), "a").join(known("b"), "b").checkpoint()
    single = pairs.where("a_only IS NOT NULL AND b_only IS NOT NULL").select(F.least("a_only", "b_only").alias("a"), F.greatest("a_only", "b_only").alias("b"))
    # Groups of several members: each with the other groups it is paired with, and with itself where it lies in several components.
    many = pairs.where("a_only IS NULL OR b_only IS NULL").select(F.col("a").alias("a_grp"), F.col("b").alias("b_grp"), (F.col("a_size") + F.col("b_size")).alias("size"))
    many = many.unionByName(spread.where("least <> most").select(F.col("grp").alias("a_grp"), F.col("grp").alias("b_grp"), "size")).checkpoint()
    if many.isEmpty():
        more = single
    else:
        itself = F.array(F.struct(F.col("a_grp").alias("grp"), F.lit(0).alias("role")))
        both = F.array(F.struct(F.col("a_grp").alias("grp"), F.lit(1).alias("role")), F.struct(F.col("b_grp").alias("grp"), F.lit(2).alias("role")))
        told = many.select("a_grp", "b_grp", F.explode(F.when(F.col("a_grp") == F.col("b_grp"), itself).otherwise(both)).alias("e")).select("a_grp", "b_grp", "e.grp", "e.role")
        told = told.join(placed.select("grp", "member", "comp", "n"), "grp").select("a_grp", "b_grp", "role", F.col("member").alias("id"), "comp", "n", F.lit(0).alias("pos"))
        more = single.unionByName(_across(_blocked(told, ["a_grp", "b_grp"], many, placed.select(F.col("member").alias("id"), "sig")), percent)).distinct()
    labels = _further(placed, _verified(more, members, rows, percent))

    copies = labels.select("member", F.col("id").alias("least_id"), "copies", "label")
    return _joined_to(every.select("id", "tkey", "n", "member"), copies, "member", "copies")


def _joined_to(rows: DataFrame, entries: DataFrame, key: str, size: str) -> DataFrame:
    """rows left-joined to entries, which are unique by key and tell in `size` how many rows have it: hot keys meet their entry by broadcast, if these are few as counted."""
    entries = entries.checkpoint()
    hot, cold = entries.where(F.col(size) > HOT_ROWS).drop(size), entries.where(F.col(size) <= HOT_ROWS).drop(size)
    if not 0 < hot.count() <= FETCH_BROADCAST:
        return rows.join(entries.drop(size), key, "left")
    met = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return met.unionByName(others)


def text_key(text_col: str) -> Column:
    """128 bits that stand for a whole text."""
    return F.unhex(F.md5(whole(text_col)))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    Two documents link when 100 * intersection >= percent * union of their shingle sets; component_id is the smallest id
    reachable by links, the row's own included, and null only where all of them are null.  Rows of equal sets are linked,
    repeated rows and ids too.  Null and empty texts, and texts without words, have no shingles and link with nothing.
    Only the two named columns are read; an empty table gives no rows.
    """
    every = _joined(docs, id_col, text_col, percent)
    least = every.where("label IS NOT NULL").groupBy("label").agg(F.min("least_id").alias("reached"), F.count(F.lit(1)).alias("size"))
    return _joined_to(every, least, "label", "size").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("reached", "least_id", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the row with the smallest id (null ids last).

    Where several rows have that id, those with the smallest hash of the text stay; rows without words all stay.
    """
    every = _joined(docs, id_col, text_col, percent)
    rank = F.min(F.struct(F.col("id").isNull(), "id", "tkey"))
    kept = every.where("member IS NOT NULL").groupBy(F.coalesce("label", "member")).agg(rank.alias("r")).select(F.col("r.id").alias("k_id"), F.col("r.tkey").alias("k_key"))
    empty = every.where("member IS NULL").select(F.col("id").alias("k_id"), F.col("tkey").alias("k_key"))
    rows = packed(docs, id=F.col(id_col), key=text_key(text_col))
    return rows.join(kept.unionByName(empty), F.col("id").eqNullSafe(F.col("k_id")) & (F.col("key") == F.col("k_key")), "left_semi").select("row.*")
