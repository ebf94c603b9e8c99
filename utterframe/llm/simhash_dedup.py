"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments (22, 21 and 21 bits).  Of at most three differing
bits, two segments always hold (0, 0), (0, 1), (1, 0) or (1, 1): the pigeonhole.  Each segment,
padded to 23 bits, is decoded by the perfect binary Golay code, which maps every word to the one
codeword within three bits; a word and its one-bit neighbours decode to about five codewords.  A
pair of segments gives a key of two 12-bit codeword indices: one document stands at the key of its
own codewords, the other at those of its neighbours, so every link within the radius meets in at
least one key.  Of more than PAIRED fingerprints too many would share a pair; their keys are all three
codewords, looked up for every way to spread three errors.  An equi-join on the key verifies the true distance; only verified links leave it.
Keys that very many fingerprints share are joined in blocks, which connect what they find by stars.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterframe.durable import durable
from utterframe.llm.common import components, fresh, slices

SEED = 42
SHINGLE = 3
RADIUS = 3
WIDTHS = (22, 21, 21)
#: Generator polynomial of the binary Golay code [23, 12, 7]: x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY = 0b101011100011
#: Fingerprints up to which keys are pairs of codewords (24 bits); more of them have keys of three (36 bits), with 16 times as many look-ups.
PAIRED = 1 << 31
#: Fingerprints that stand at a key above which it is hot: its links are sought in blocks of this size.
HOT = 1024
#: Shingle hashes that are spread out to bits at once.
CHUNK = 65536


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the whole text; zero if there are no words (or the text is null)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = np.array([h(joined, seed)], dtype="<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: len(words) - shingle])).tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        hashes = np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), "<u8", len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def remainder(word: int) -> int:
    """Of a 23-bit word divided by the generator: zero for codewords."""
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GOLAY << (bit - 11)
    return word


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of all 23-bit words by byte (3 x 256), and the error of each syndrome."""
    rest = remainder
    by_byte = np.array([[rest(b << (8 * k)) if b << (8 * k) < 1 << 23 else 0 for b in range(256)] for k in range(3)], np.int32)
    errors = np.zeros(2048, np.int32)
    bits = [1 << i for i in range(23)]
    for i in range(23):
        errors[rest(bits[i])] = bits[i]
        for j in range(i):
            errors[rest(bits[i] | bits[j])] = bits[i] | bits[j]
            for k in range(j):
                errors[rest(bits[i] | bits[j] | bits[k])] = bits[i] | bits[j] | bits[k]
    return by_byte, errors


def codeword(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    by_byte, errors = _golay()
    w = words.astype(np.int32)
    syndrome = by_byte[0][w & 255] ^ by_byte[1][w >> 8 & 255] ^ by_byte[2][w >> 16]
    return (w ^ errors[syndrome]) >> 11


def keys(fp: int) -> tuple[list[int], list[int]]:
    """The keys of a fingerprint's own codewords (one per pair of segments), and all keys it looks up."""
    own, near, at = [], [], 0
    for width in WIDTHS:
        w = fp >> at & ((1 << width) - 1)
        at += width
        c = codeword(np.array([w, *(w ^ 1 << i for i in range(width))]))
        own.append(int(c[0]))
        near.append(sorted(set(c.tolist())))
    key = lambda pair, a, b: pair << 24 | a << 12 | b
    pairs = ((0, 0, 1), (1, 0, 2), (2, 1, 2))
    looked = {key(0, a, b) for a in near[0] for b in near[1]}  # one pair takes (1, 1); the rest need a clean segment
    for p, i, j in pairs[1:]:
        looked |= {key(p, own[i], b) for b in near[j]} | {key(p, a, own[j]) for a in near[i]}
    return [key(p, own[i], own[j]) for p, i, j in pairs], sorted(looked)


def triple_keys(fp: int) -> tuple[list[int], list[int]]:
    """The key of all three own codewords, and the keys of every word that at most RADIUS errors, however spread, may have made of it."""
    near, at = [], 0
    for width in WIDTHS:
        w = fp >> at & ((1 << width) - 1)
        at += width
        words = [np.array([w])]
        for n in range(1, RADIUS + 1):
            flips = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(width), n)])
            words.append(w ^ flips)
        near.append([np.unique(codeword(x)) for x in words])
    looked = set()
    for spread in itertools.product(range(RADIUS + 1), repeat=3):
        if sum(spread) == RADIUS:
            # errors of one segment up to its share; smaller shares are in other spreads or here
            a, b, c = (np.unique(np.concatenate(near[s][: e + 1])) for s, e in enumerate(spread))
            looked.update((a[:, None, None].astype(np.int64) << 24 | b[None, :, None] << 12 | c[None, None, :]).ravel().tolist())
    own = int(near[0][0][0]) << 24 | int(near[1][0][0]) << 12 | int(near[2][0][0])
    return [own], sorted(looked)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every row; ``fp`` is the fingerprint as a signed bigint."""
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                out += [fingerprint(t) for t in batch.column(1).slice(at, 256).to_pylist()]
            fps = pa.array(np.array(out, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, fp bigint")


def links(fps: DataFrame) -> DataFrame:
    """``(u, v)``: pairs of different fingerprints of ``fps(fp)`` whose connected components are those of "at most RADIUS bits differ".

    Outside hot keys these are exactly the pairs within the radius; hot keys give connections only.
    """
    find = keys if fps.count() <= PAIRED else triple_keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,) in slices(batches):
            found = [find(x & (1 << 64) - 1) for x in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int64()), pa.array([o for o, _ in found], pa.list_(pa.int64())), pa.array([n for _, n in found], pa.list_(pa.int64()))],
                ["fp", "own", "near"],
            )

    keyed = durable(fps.select("fp").mapInArrow(run, "fp bigint, own array<bigint>, near array<bigint>"))
    at = keyed.select(F.col("fp").alias("u"), F.explode("own").alias("key"))
    seen = keyed.select(F.col("fp").alias("v"), F.explode("near").alias("key"))
    n = at.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT)
    hot = durable(n.select("key", F.ceil(F.col("n") / HOT).cast("int").alias("parts")))
    if hot.isEmpty():
        return _verified(at, seen)
    cool = _verified(at.join(hot, "key", "left_anti"), seen.join(hot, "key", "left_anti"))
    return cool.unionByName(_forests(at.join(hot, "key"), seen.join(hot, "key"))).distinct()


def _verified(at: DataFrame, seen: DataFrame) -> DataFrame:
    """Links of keys that few fingerprints share: a join that lets only true ones out."""
    return at.join(seen, "key").filter((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)).select("u", "v").distinct()


def _forests(at: DataFrame, seen: DataFrame) -> DataFrame:
    """Links of hot keys ``(key, parts, u)`` and ``(key, parts, v)``, thinned out without losing a connection.

    Both sides of a key are dealt to ``parts`` blocks; every block of the one meets every block of the
    other, all distances are looked at, and each pair of blocks gives a star for each group that it
    connects: at most a row per fingerprint, not one per pair.
    """
    block = lambda c: F.pmod(F.xxhash64(c), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    a = at.select("key", block("u").alias("i"), F.explode(every).alias("j"), F.lit(False).alias("looks"), F.col("u").alias("fp"))
    b = seen.select("key", F.explode(every).alias("i"), block("v").alias("j"), F.lit(True).alias("looks"), F.col("v").alias("fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = looks = fps = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = (np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1), batch.column(3).to_numpy(zero_copy_only=False).astype(bool), batch.column(4).to_numpy())
            keys, looks, fps = part if keys is None else (np.concatenate(x) for x in zip((keys, looks, fps), part, strict=True))
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                yield stars(fps[x:y][~looks[x:y]], fps[x:y][looks[x:y]])
            keys, looks, fps = keys[cuts[-1] :], looks[cuts[-1] :], fps[cuts[-1] :]
        if keys is not None:
            yield stars(fps[~looks], fps[looks])

    return a.unionByName(b).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "u bigint, v bigint")


def stars(own: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    """For the groups that links between ``own`` and ``near`` connect, each member with its group's smallest fingerprint."""
    nodes, place = np.unique(np.concatenate([own, near]), return_inverse=True)
    label = np.arange(len(nodes))
    i, j = place[: len(own)], place[len(own) :]
    pairs = []
    for at in range(0, len(own), 256):
        x, y = np.nonzero(np.bitwise_count(own[at : at + 256, None].view(np.uint64) ^ near[None, :].view(np.uint64)) <= RADIUS)
        pairs.append(np.unique(i[at + x] * len(nodes) + j[y]))
    pairs = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
    i, j = pairs // max(1, len(nodes)), pairs % max(1, len(nodes))
    while True:  # the smaller label wins, then labels of labels
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved], pa.int64()), pa.array(nodes[label[moved]], pa.int64())], ["u", "v"])


def least_id(marked: DataFrame) -> Column:
    """The id, so that a minimum passes over nulls: a struct counts as null only by its first field."""
    if not dict(marked.dtypes)["id"].startswith("struct"):
        return F.col("id")
    return F.struct(F.col("id.id").isNull().alias("none"), F.col("id.id").alias("id"), F.col("id.th").alias("th"))


def roots(nodes: DataFrame, by: str, tree: DataFrame) -> DataFrame:
    """``nodes`` and the ``root`` of each one's component, by its column ``by``; itself where ``tree(node, root)`` lacks it."""
    return nodes.join(tree.withColumnRenamed("node", by), by, "left").withColumn("root", F.coalesce("root", by))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component)`` of every row of ``docs``.

    Rows with equal fingerprints are one node, so copies are never paired; nodes within RADIUS bits
    are linked and ``component`` is the smallest id reachable, the row's own included.  Null and
    wordless texts have fingerprint zero and are linked like any other.  A null id takes no part in
    the minimum: its component is the smallest id that is not null, or null if there is none.
    Repeated rows stay repeated; other columns of ``docs`` are ignored; no rows give no rows.
    """
    marked = durable(fingerprints(docs, id_col, text_col))
    nodes = durable(marked.groupBy("fp").agg(F.min(least_id(marked)).alias("first")))
    rooted = roots(nodes, "fp", components(links(nodes)))
    named = rooted.groupBy("root").agg(F.min("first").alias("component"))
    of = rooted.join(named, "root").select("fp", "component")
    return marked.join(of, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """The rows of ``docs`` with their columns, one of each group of ``near``: the one with the group's smallest id.

    Rows without an id represent a group only if the group has no id at all.  Of several rows with
    that id in the group one with the smallest text hash stays, of these the one whose other columns
    come first (columns of maps apart).  Null texts are one group with wordless ones; no rows give no rows.
    """
    th = F.xxhash64(F.col(text_col))
    id_name, h_name, th_name, copy_name = (fresh(c, docs.columns) for c in ("id", "h", "th", "copy"))
    of = near(docs.select(F.struct(F.col(id_col).alias("id"), th.alias("th")).alias("id"), F.col(text_col).alias("text")), "id", "text")
    kept = of.groupBy("component").agg(F.lit(1).alias("one")).select(F.col("component.id").alias(id_name), F.col("component.th").alias(th_name))
    joined = docs.withColumn(h_name, th).join(kept, F.col(id_col).eqNullSafe(F.col(id_name)) & (F.col(h_name) == F.col(th_name)), "left_semi")
    by = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    copy = F.row_number().over(Window.partitionBy(id_col, h_name).orderBy(*by))
    return joined.withColumn(copy_name, copy).filter(F.col(copy_name) == 1).drop(h_name, copy_name)
