"""Packing of tokenised documents by minimum bin slack.

Documents are tokenised where they lie and cut into pieces.  What is packed is the histogram of
piece lengths, which has at most CAPACITY entries however large the corpus is: per bin, starting
from the longest length left, a bitset subset-sum over the available lengths finds the fullest
feasible combination, which is then removed as often as the counts allow.  Pieces get ranks within
their length by two distributed passes and look their place up in the list of combinations.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utterframe.durable import durable
from utterframe.llm.common import fresh

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k"
END_ID = 0
#: Pieces of one length are ranked in ranges of about so many.
RANGE_ROWS = 200_000
SPECIAL = "<|endoftext|>"


def default_vocabulary() -> tuple[str, str]:
    """Paths of the vocabulary as a ``tokenizers`` file and as ranks."""
    import public_tokenizers

    return public_tokenizers.path(f"{VOCABULARY}.json"), public_tokenizers.path(f"{VOCABULARY}.tiktoken")


@cache
def encoder(json_path: str, ranks_path: str | None):
    """A function from a text to its ids.

    The ids are those of the ``tokenizers`` file.  Byte-level BPE with the same ranks gives the same
    ids in a quarter of the time, so ranks are used where given; texts that hold the special token's
    string, and texts on which that library gives up, go through ``tokenizers`` itself.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    exact = lambda text: slow.encode(text, add_special_tokens=False).ids
    if not ranks_path:
        return exact
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(text: str) -> list[int]:
        if SPECIAL in text:
            return exact(text)
        try:
            return fast(text)
        except BaseException as e:  # a panic of the library on odd texts is not an Exception
            if type(e).__name__ not in ("PanicException", "ValueError"):
                raise
            return exact(text)

    return ids


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: tuple[str, str | None] | None = None) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: each document's ids and END_ID, cut into full pieces after a first one that holds the rest."""
    id_type = dict(docs.dtypes)[id_col]
    paths = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(*paths)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = np.array([*(ids_of(text) if text else ()), END_ID], dtype="<u4")
                    a, k = 0, 0
                    while a < len(ids):
                        b = a + ((len(ids) % capacity or capacity) if k == 0 else capacity)
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(crc32(ids[a:b].tobytes()))
                        a, k = b, k + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


def fullest(counts: dict[int, int], room: int) -> Counter:
    """Of the multiset ``counts``, a combination with the largest sum up to ``room``; long lengths are preferred.

    Bit s of the reachable set is set if some combination sums to s.  A length that occurs k times
    is shifted in as 1, 2, 4, ... copies, so a set costs a few word operations.
    """
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for size in sorted((s for s in counts if 0 < s <= room and counts[s] > 0)):  # the last ones in are taken first
        left, copies = min(counts[size], room // size), 1
        while left > 0:
            k = min(copies, left)
            steps.append((size, k, reach))
            reach |= reach << size * k & mask
            left, copies = left - k, copies * 2
    best, taken = reach.bit_length() - 1, Counter()
    for size, k, before in reversed(steps):
        if best >= size * k and before >> best - size * k & 1:
            taken[size] += k
            best -= size * k
    return taken


def combinations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """The bins as ``(lengths of a bin, longest first; number of such bins)``; every piece of the histogram is in one."""
    left, out = {k: v for k, v in histogram.items() if v > 0}, []
    while left:
        top = max(left)
        left[top] -= 1
        use = fullest(left, capacity - top)
        left[top] += 1
        use[top] += 1
        times = min(left[s] // k for s, k in use.items())
        for s, k in use.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
        out.append((sorted(use.elements(), reverse=True), times))
    return out


def places(bins: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length, rows ``(first rank, copies per bin, first bin, offset of the first copy)``: copies of a length lie side by side."""
    rank, out, base = Counter(), {}, 0
    for sizes, times in bins:
        offset = 0
        for size, k in sorted(Counter(sizes).items(), reverse=True):
            out.setdefault(size, []).append((rank[size], k, base, offset))
            rank[size] += k * times
            offset += size * k
        base += times
    return {s: np.array(v, dtype=np.int64) for s, v in out.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (any columns, with ``length`` from 1 to ``capacity``) and ``sequence_id``, ``offset``.

    ``cut`` is read more than once and must be stable (a table or a checkpoint).  Pieces of a length
    are ranked in ranges of about RANGE_ROWS, so no task holds a length that a third of them have.
    Columns may have any names but ``sequence_id`` and ``offset``, which are replaced; repeated rows
    have places of their own; no rows give no rows.
    """
    names = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    parts_col, salt_col, rank_col = (fresh(c, names) for c in ("parts", "salt", "rank"))
    spark = cut.sparkSession
    histogram = [(r["length"], r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()]  # at most ``capacity`` rows
    ranges = spark.createDataFrame([(size, -(-n // RANGE_ROWS)) for size, n in histogram], f"length long, `{parts_col}` long")
    # by place and not by content, so that repeated rows are dealt out too; the places of a stable frame are stable
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(parts_col)).cast("int")
    cut = cut.select(*names).join(F.broadcast(ranges), "length").select(*names, deal.alias(salt_col))
    counts = cut.groupBy("length", salt_col).agg(F.count("*").alias("n"))
    per = {(r["length"], r[salt_col]): r["n"] for r in counts.collect()}  # a row per range
    total: Counter = Counter()
    before: dict[tuple[int, int], int] = {}
    for (size, salt), n in sorted(per.items()):
        before[size, salt] = total[size]
        total[size] += n
    where = spark.sparkContext.broadcast((before, places(combinations(total, capacity))))
    # each (length, salt) is ranked by itself; the order within a length is of no matter, but must not change between attempts
    order = Window.partitionBy("length", salt_col).orderBy(*[c for c in names if c != "length"])
    ranked = cut.withColumn(rank_col, F.row_number().over(order) - 1)
    fields = [f for f in ranked.schema.fields if f.name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, table = where.value
        for batch in batches:
            size, salt, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", salt_col, rank_col))
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                r = rank[at] + np.array([first[int(s), int(x)] for x in salt[at]], np.int64)
                rows = table[int(s)]
                hit = rows[np.searchsorted(rows[:, 0], r, side="right") - 1]
                k = r - hit[:, 0]
                seq[at] = hit[:, 2] + k // hit[:, 1]
                off[at] = hit[:, 3] + k % hit[:, 1] * s
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], [*(f.name for f in fields), "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: tuple[str, str | None] | None = None) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)``, a row per piece.

    Null and empty texts are the end id alone, one piece of length 1.  Null ids and repeated rows are
    packed like others.  Texts of any length are cut into pieces, none is dropped; ties among equal
    lengths are broken by the pieces' own columns.  Other columns of ``docs`` are left out; no rows
    give no rows.
    """
    return pack(durable(pieces(docs, id_col, text_col, capacity, vocabulary)), capacity)
