"""Near-duplicate texts by Golay-code fuzzy hashing of SimHash segments, verified on whole shingle sets.

The setting of the SimHash operator for texts: two texts are linked if their sets of SHINGLE-word
shingles have a Jaccard similarity of SIMILARITY or more.  At that similarity about 15 of 100
SimHash bits differ, too many for keys of a short fingerprint, so the fingerprint is long: 23 bits
to a segment, a few segments to a key.  Each segment is decoded to the NEAREST codewords of the
Golay code [23,12,7].  The decoder is given the bits' sums and not only their signs: the bits that a
similar text is likely to flip have small sums and weigh little.  At the threshold a segment of one
text shares a codeword with the other's with probability 0.55, so a pair is unseen by all tables of
keys with probability 0.0002, and less the more alike the texts are.

Texts that meet in a key and differ in few of 128 further SimHash bits are coarsely linked, by a
star for each group of a key and not by its pairs.  Inside a coarse component every pair is then
verified on the whole sets, in blocks of bounded size, which again leave as stars.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterframe.durable import durable
from utterframe.llm.common import components
from utterframe.llm.decontaminate import rolled
from utterframe.llm.simhash_dedup import GOLAY, least_id, remainder, roots

SHINGLE = 5
#: Numerator and denominator, so that the threshold is exact.
SIMILARITY = (4, 5)
SEGMENT = 23
#: Codewords that a segment is decoded to.
NEAREST = 2
#: Segments of a key, the tables of keys that leave a pair at the threshold unseen with probability 0.0002, and the distinct texts up to which a key is that short.
PLANS = ((2, 24, 1 << 32), (3, 47, 1 << 62))
#: Of SKETCH bits, pairs at the threshold differ in 19 on average; more than RADIUS is 4.6 standard deviations off.
SKETCH, RADIUS = 128, 38
#: Texts of a key that are compared in one place; keys with more are dealt out in blocks of this size.
HOT = 1024
#: Groups up to this size give their pairs, larger ones a star for each part.
PAIRS = 8
#: Texts and shingles of a block that is verified.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 1 << 21
SEED = 42
#: Shingles that are spread out to bits at once, no more than a byte counts.
CHUNK = 255
#: Vocabulary of shingles that are counted at once.
COLUMNS = 2048
#: Texts that are decoded at once.
DECODED = 32
#: Links of which a task keeps no more than a forest, and texts for each such task.
FOREST, FOREST_TEXTS = 1 << 18, 1 << 20
#: Bits of the filter that keeps texts without a coarse link out of the shuffle: this many for each that has one, and at most so many.
FILTER_SHARE, FILTER_MOST = 16, 1 << 28


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of the whole text; a text with fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words or [b""]), np.uint64, max(1, len(words)))
    return np.unique(rolled(hashes, min(size, len(hashes))))


@cache
def _codewords() -> np.ndarray:
    """Codewords of the messages 0 to 2047 as columns of signs; message 4095 - m has the complement of m's."""
    words = np.array([m << 11 | remainder(m << 11) for m in range(2048)])
    return ((words[None, :] >> np.arange(SEGMENT)[:, None] & 1) * 2 - 1).astype(np.float32)


@cache
def _mixers(words: int) -> tuple[np.ndarray, np.ndarray]:
    odd, plus = np.random.default_rng(SEED).integers(0, 1 << 63, (2, words), dtype=np.uint64)
    return 2 * odd + np.uint64(1), plus


def sums(hashes: np.ndarray, bits: int) -> np.ndarray:
    """For each of ``bits`` pseudo-random signs of a shingle, their sum over the shingles."""
    odd, plus = _mixers(-(-bits // 64))
    ones = np.zeros(64 * len(odd), np.int64)
    for at in range(0, len(hashes), CHUNK):
        x = hashes[at : at + CHUNK, None] * odd + plus
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return (2 * ones - len(hashes))[:bits]


def decoded(segments: np.ndarray) -> np.ndarray:
    """For rows of SEGMENT sums, the messages of the NEAREST codewords, best first (ties: smaller message below 2048)."""
    score = segments.astype(np.float32) @ _codewords()
    size, rows, out = np.abs(score), np.arange(len(score)), []
    for _ in range(NEAREST):
        m = size.argmax(axis=1)
        out.append(np.where(score[rows, m] >= 0, m, 4095 - m))
        size[rows, m] = -1
    return np.stack(out, axis=1)


def keys(found: np.ndarray, width: int) -> np.ndarray:
    """Keys of texts (a row each) from their segments' messages (texts x segments x NEAREST): in each table, every choice of a codeword for each of its segments."""
    by = found.reshape(len(found), -1, width, NEAREST).astype(np.int64)
    key = np.broadcast_to(np.arange(by.shape[1])[None, :, None], (*by.shape[:2], 1))
    for s in range(width):
        key = (key[..., None] << 12 | by[:, :, s, None, :]).reshape(*by.shape[:2], -1)
    return key.reshape(len(found), -1)


def signatures(docs: DataFrame, width: int, tables: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, th, node, n, h1, h2, found)`` of every row: hash of the text, hash and size of its set, SimHash, and the segments' messages."""
    id_type = dict(docs.dtypes)[id_col]
    segments = width * tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DECODED):
                part = batch.slice(at, DECODED)
                sets = [shingles(t) for t in part.column(2).to_pylist()]
                total = np.stack([sums(s, SKETCH + segments * SEGMENT) for s in sets])
                sketch = np.packbits(total[:, :SKETCH] > 0, axis=1, bitorder="little").view("<i8")
                found = decoded(total[:, SKETCH:].reshape(-1, SEGMENT)).reshape(len(sets), segments, NEAREST)
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), pa.array([f.astype("<u2").tobytes() for f in found], pa.binary())],
                    ["id", "th", "node", "n", "h1", "h2", "found"],
                )

    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, f"id {id_type}, th bigint, node bigint, n bigint, h1 bigint, h2 bigint, found binary")


def least_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 and links i to j, the smallest node that each reaches."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def thinned(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what the links u to v connect: one for each group, at its smallest node."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = least_of(len(nodes), place[: len(u)], place[len(u) :])
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[tied], nodes[label[tied]]


def forest(links: DataFrame, tasks: int, most: int = FOREST) -> DataFrame:
    """``(u, v)``: connects what ``links(u, v)`` (both bigint) connect, with fewer links.

    A text of a large group is linked once for each key or block that it is in.  Links are dealt evenly
    to ``tasks``, and each folds those that it has into stars as they come, so a node keeps at most one
    of them.  Where the stars themselves come to more than half of ``most`` they leave and the task
    starts afresh, so memory is bounded; then a node may keep several, but no connection is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda *cols: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v"])
        u = v = np.zeros(0, np.int64)
        for batch in batches:
            u, v = (np.concatenate([a, batch.column(c).to_numpy()]) for c, a in enumerate((u, v)))
            if len(u) >= most:
                u, v = thinned(u, v)
                if len(u) > most // 2:
                    yield give(u, v)
                    u = v = np.zeros(0, np.int64)
        yield give(*thinned(u, v))

    return links.select("u", "v").repartition(tasks).mapInArrow(run, "u bigint, v bigint")


def _close(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(h[a] ^ h[b]).sum(axis=-1) <= RADIUS


def met(key: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that the close ones of each key are linked by: a star at the first of a group, and what it does not reach by pairs in small groups, by further stars in larger ones.

    Rows are sorted by key and then SimHash, so that the groups of one text's many keys have few
    different centres.
    """
    first = np.searchsorted(key, key, side="left")
    size = np.searchsorted(key, key, side="right") - first
    small = (size > 1) & (size <= PAIRS)
    here = np.flatnonzero(small & (first < np.arange(len(key))))
    tied = here[_close(h, first[here], here)]
    left, right, reached = [first[tied]], [tied], np.zeros(len(key), bool)
    reached[tied] = reached[first[tied]] = True
    here = np.flatnonzero(small)
    for d in range(1, PAIRS):
        here = here[here - first[here] + d < size[here]]
        good = here[_close(h, here, here + d) & ~(reached[here] & reached[here + d])]
        left.append(good)
        right.append(good + d)
    for at in np.unique(first[size > PAIRS]).tolist():
        n = int(size[at])
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a in range(0, n, 256):
            d = np.bitwise_count(h[at + a : at + min(n, a + 256), None, :] ^ h[None, at : at + n, :]).sum(axis=-1)
            i, j = np.nonzero(d <= RADIUS)
            pairs.append((i[i + a < j] + a, j[i + a < j]))
        label = least_of(n, *(np.concatenate(x) for x in zip(*pairs, strict=True)))
        tied = np.flatnonzero(label != np.arange(n))
        left.append(at + label[tied])
        right.append(at + tied)
    return np.concatenate(left), np.concatenate(right)


def whole_groups(batches: Iterator[pa.RecordBatch], most: int | None, give: Callable[[list[np.ndarray | list]], pa.RecordBatch], refuse: Callable[[list], pa.RecordBatch] | None = None) -> Iterator[pa.RecordBatch]:
    """Hands sorted groups (equal in the first column) to ``give``, a batch's worth at once; rows of groups of more than ``most`` go to ``refuse`` as they come."""
    kept: list = []
    shut = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = [np.asarray(c.to_pylist(), dtype=object) if pa.types.is_binary(c.type) else c.to_numpy() for c in batch.columns]
        kept = [np.concatenate(x) for x in zip(kept, part, strict=True)] if kept else part
        if shut is not None:
            n = int(np.searchsorted(kept[0], shut, side="right"))
            if n:
                yield refuse([c[:n] for c in kept])
                kept = [c[n:] for c in kept]
            if not len(kept[0]):
                continue
            shut = None
        last = int(np.searchsorted(kept[0], kept[0][-1], side="left"))
        yield from _given([c[:last] for c in kept], most, give, refuse)
        kept = [c[last:] for c in kept]
        if most is not None and len(kept[0]) > most:
            shut = kept[0][0]
            yield refuse(kept)
            kept = [c[:0] for c in kept]
    if kept and len(kept[0]):
        yield from _given(kept, most, give, refuse)


def _given(rows: list, most: int | None, give: Callable, refuse: Callable | None) -> Iterator[pa.RecordBatch]:
    if most is not None and len(rows[0]):
        size = np.searchsorted(rows[0], rows[0], side="right") - np.searchsorted(rows[0], rows[0], side="left")
        if (size > most).any():
            yield refuse([c[size > most] for c in rows])
            rows = [c[size <= most] for c in rows]
    if len(rows[0]):
        yield give(rows)


def dealt(rows: DataFrame, key: list[str], parts: str, by: str) -> DataFrame:
    """Rows of big groups, dealt by the hash of ``by`` to ``parts`` blocks; every two blocks of a group meet under a ``key`` of their own."""
    block = F.pmod(F.xxhash64(by), F.col(parts))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(parts).cast("bigint") - 1))
    both = rows.withColumn("__block", block).withColumn("__other", other)
    return both.withColumn("key", F.xxhash64(*key, F.least("__block", "__other"), F.greatest("__block", "__other"))).drop("__block", "__other")


def coarse_links(marked: DataFrame, width: int) -> DataFrame:
    """``(u, v)`` between the distinct ``(h1, h2)`` of ``marked(h1, h2, found)``, as structs: connects all that meet in a key within RADIUS bits."""
    schema = "key bigint, a1 bigint, a2 bigint, b1 bigint, b2 bigint"

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, h = rows[0], np.stack(rows[1:], axis=1).view(np.uint64)
        i, j = met(key, h)
        cols = [h[i, 0], h[i, 1], h[j, 0], h[j, 1]]
        return pa.RecordBatch.from_arrays([pa.nulls(len(i), pa.int64()), *(pa.array(c.view(np.int64)) for c in cols)], ["key", "a1", "a2", "b1", "b2"])

    def hot(rows: list[np.ndarray]) -> pa.RecordBatch:
        none = pa.nulls(len(rows[0]), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in rows), none, none], ["key", "a1", "a2", "b1", "b2"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                key = keys(np.frombuffer(b"".join(part.column(2).to_pylist()), "<u2").reshape(part.num_rows, -1, NEAREST), width)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(pa.array(np.repeat(part.column(c).to_numpy(), key.shape[1])) for c in (0, 1))], ["key", "h1", "h2"])

    at = marked.select("h1", "h2", "found").dropDuplicates().mapInArrow(spread, "key bigint, h1 bigint, h2 bigint")
    most = HOT
    first = durable(at.repartition("key").sortWithinPartitions("key", "h1", "h2").mapInArrow(lambda b: whole_groups(b, most, links, hot), schema))
    hots = first.filter("key is not null").select("key", F.col("a1").alias("h1"), F.col("a2").alias("h2"))
    parts = hots.groupBy("key").agg(F.ceil(F.count("*") / HOT).alias("parts"))
    blocks = dealt(hots.join(parts, "key").withColumn("th", F.xxhash64("h1", "h2")), ["key"], "parts", "th").select("key", "h1", "h2")
    more = blocks.repartition("key").sortWithinPartitions("key", "h1", "h2").mapInArrow(lambda b: whole_groups(b, None, links), schema)
    return first.filter("key is null").unionByName(more).select(F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2")).alias("u"), F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2")).alias("v")).filter("u <> v").distinct()


def similar_pairs(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sets that are similar enough."""
    up, down = SIMILARITY
    size = np.array([len(s) for s in sets], np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1  # a shingle that one set alone has is in no intersection
    row, col = row[count[col] > 1], shared[col[count[col] > 1]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        a, b = np.searchsorted(col, (at, at + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[a:b], col[a:b] - at] = 1
        both += m @ m.T
    both = both.astype(np.int64)
    i, j = np.nonzero(down * both >= up * (size[:, None] + size[None, :] - both))
    return i[i < j], j[i < j]


def _whole_sets(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """``(th, shingles)`` of the texts whose hashes ``wanted(th)`` has."""
    bits = 1 << max(10, min(FILTER_MOST, FILTER_SHARE * wanted.count()).bit_length())
    place = F.pmod("th", F.lit(bits))
    found = wanted.groupBy((place / 64).cast("int").alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(th, {bits}) % 64 as int))")).alias("w")).toArrow()  # at most bits / 64 rows
    words = np.zeros(bits // 64, np.int64)
    words[found.column("i").to_numpy()] = found.column("w").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(words.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(shared.value, np.int64)
        for batch in batches:
            at = batch.column(0).to_numpy() % bits
            hits = np.flatnonzero(words[at // 64] >> (at % 64) & 1)
            for some in range(0, len(hits), 256):
                part = batch.take(pa.array(hits[some : some + 256]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["th", "shingles"])

    passed = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).mapInArrow(run, "th bigint, shingles binary")
    return passed.join(wanted, "th", "left_semi").dropDuplicates(["th"])


def verified_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``(u, v)``: connects the nodes of ``members(root, node, th, n)`` whose sets are similar, all pairs of a root looked at in blocks."""

    def run(rows: list) -> pa.RecordBatch:
        key, node, sets = rows
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        u, v = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            label = least_of(b - a, *similar_pairs([np.frombuffer(s, "<u8") for s in sets[a:b]]))
            tied = np.flatnonzero(label != np.arange(b - a))
            u.append(node[a:b][tied])
            v.append(node[a:b][label[tied]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    parts = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    placed = dealt(members.join(parts, "root"), ["root"], "parts", "node").select("key", "node", "th").join(sets, "th")
    return placed.select("key", "node", "shingles").repartition("key").sortWithinPartitions("key", "node").mapInArrow(lambda b: whole_groups(b, None, run), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component)`` of every row of ``docs``, as ``simhash_dedup.near_duplicates`` gives them; ``fp`` is a hash of the set of shingles.

    Texts with equal sets are one node and ``component`` is the smallest id reachable over links.
    Null and wordless texts have one and the same shingle and are one node.  A null id takes no part
    in the minimum.  Repeated rows stay repeated; other columns are ignored; no rows give no rows.
    """
    n = docs.count()
    width, tables = next((w, t) for w, t, most in PLANS if n <= most)
    signed = durable(signatures(docs, width, tables, id_col, text_col))
    nodes = durable(signed.groupBy("node", "h1", "h2", "n").agg(F.min(least_id(signed)).alias("first"), F.min("th").alias("th")))
    # coarse components, over numbers of the SimHashes (equal ones are one, as are those that happen to share a number)
    number = lambda c: F.xxhash64(f"{c}.h1", f"{c}.h2").alias(c)
    tasks = 1 + n // FOREST_TEXTS
    met_in = components(forest(coarse_links(signed, width).select(number("u"), number("v")), tasks))
    coarse = roots(nodes.withColumn("s", F.struct("h1", "h2")).select("node", "first", "th", "n", number("s")), "s", met_in)
    crowd = coarse.groupBy("root").agg(F.count("*").alias("c")).filter("c > 1").select("root")
    members = durable(coarse.join(crowd, "root", "left_semi").select("root", "node", "th", "n"))
    tree = components(forest(verified_links(members, _whole_sets(docs, members.select("th").distinct(), text_col)), tasks))
    rooted = roots(nodes.select("node", "first"), "node", tree)
    named = rooted.groupBy("root").agg(F.min("first").alias("component"))
    of = rooted.join(named, "root").select("node", "component")
    return signed.select("id", "node").join(of, "node").select("id", F.col("node").alias("fp"), "component")
