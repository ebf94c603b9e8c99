"""Benchmark decontamination by SimHash of item-sized windows.

Every benchmark item has a 128-bit SimHash of its weighted five-word shingles.  So has every window
of a document that is as long as an item.  The window's fingerprint is looked up in a multi-index
over the items of that length: ten blocks of 12 or 13 bits, of which one has at most three wrong
bits if all 128 have at most RADIUS, so that every item within the radius is proposed.  What the
index proposes, and nothing else, is verified by the exact weighted Jaccard similarity of the
shingles.  Of pairs at that similarity 15 of 100 bits differ on average; RADIUS is 4.9 standard
deviations above that.

Windows without any shingle of an item of their length have similarity zero to all of them; their
fingerprints are not computed.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SHINGLE = 5
SIMILARITY = 0.8
BITS = 128
#: Bits of the blocks of the multi-index, and the wrong bits that a lookup allows in a block.
WIDTHS, BLOCK_ERRORS = (13,) * 8 + (12,) * 2, 3
#: (BLOCK_ERRORS + 1) errors in each block, less one.
RADIUS = len(WIDTHS) * (BLOCK_ERRORS + 1) - 1
#: Windows whose fingerprints are held at once.
WINDOWS_AT_ONCE = 4096
#: Benchmark items that are sent to the executors at once; more are done in blocks.
ITEMS_AT_ONCE = 2048
#: A-Z to lower case, other ASCII that is neither letter nor digit to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of each run of k words (of all words if there are fewer)."""
    n = max(1, len(words) - k + 1)
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + k])) for i in range(n)), np.uint64, n) if words else np.zeros(0, np.uint64)


def bits(hashes: np.ndarray) -> np.ndarray:
    """BITS signs for each shingle hash: its own bits and those of a mix of it."""
    mixed = (hashes ^ hashes >> np.uint64(33)) * MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    return np.unpackbits(np.stack([hashes, mixed], axis=1).view(np.uint8), axis=1, bitorder="little").astype(np.int32)


def fingerprints(ones: np.ndarray, shingles: int) -> np.ndarray:
    """Rows of BITS zeros and ones from counts of ones among so many shingles."""
    return (2 * ones > shingles).astype(np.uint8)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two multisets of shingles."""
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


class MultiIndex:
    """Fingerprints by the values of their blocks, each under all values within BLOCK_ERRORS bits."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.cuts = fps, np.concatenate(([0], np.cumsum(WIDTHS)))
        self.tables = [np.zeros((1 << w, -(-len(fps) // 8)), np.uint8) for w in WIDTHS]
        for table, values, width in zip(self.tables, self._values(fps), WIDTHS, strict=True):
            every = np.arange(1 << width, dtype=np.uint16)
            near = every[np.bitwise_count(every) <= BLOCK_ERRORS]
            for n, v in enumerate(values.tolist()):
                table[near ^ v, n // 8] |= 1 << n % 8

    def _values(self, fps: np.ndarray) -> list[np.ndarray]:
        return [fps[:, a:b] @ (1 << np.arange(b - a, dtype=np.uint16)) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def proposed(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``fps`` and numbers of the fingerprints that share a block with them but for BLOCK_ERRORS bits."""
        hit = np.zeros((len(fps), self.tables[0].shape[1]), np.uint8)
        for table, values in zip(self.tables, self._values(fps), strict=True):
            hit |= table[values]
        return np.nonzero(np.unpackbits(hit, axis=1, bitorder="little", count=len(self.fps)))

    def within(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of what is proposed, that within RADIUS: rows, numbers and wrong bits."""
        row, number = self.proposed(fps)
        wrong = np.concatenate([np.count_nonzero(fps[row[a : a + 65536]] != self.fps[number[a : a + 65536]], axis=1) for a in range(0, len(row), 65536)] or [np.zeros(0, np.int64)])
        good = wrong <= RADIUS
        return row[good], number[good], wrong[good]


class Items:
    """A block of benchmark items: their shingles, fingerprints and, by length, the multi-indexes."""

    def __init__(self, items: list[tuple[object, str | None]]):
        rows = [(i, w) for i, t in items if (w := words_of(t))]
        self.ids, self.sizes = [i for i, _ in rows], np.array([len(w) for _, w in rows], dtype=np.int64)
        self.vocab = {w: n for n, w in enumerate(sorted({x for _, ws in rows for x in ws}), 1)}
        hashes = [shingle_hashes(w, SHINGLE) for _, w in rows]
        self.counts = [Counter(h.tolist()) for h in hashes]
        self.fps = np.array([fingerprints(bits(h).sum(axis=0), len(h)) for h in hashes]).reshape(-1, BITS)
        self.of_size = {int(size): np.flatnonzero(self.sizes == size) for size in np.unique(self.sizes)}
        self.indexes: dict[int, MultiIndex] = {}
        # rolling hashes of word numbers, by shingle length: sorted, with the lengths of the items that have each
        self.tables = {}
        for k in sorted({min(SHINGLE, size) for size in self.of_size}):
            has: dict[int, set[int]] = defaultdict(set)
            for _, w in rows:
                if min(SHINGLE, len(w)) == k:
                    for h in rolled(np.array([self.vocab[x] for x in w], np.int64), k).tolist():
                        has[h].add(len(w))
            self.tables[k] = (np.array(sorted(has), dtype=np.uint64), [sorted(has[h]) for h in sorted(has)])

    def leaks(self, text: str | None) -> list[tuple[int, float, int, int, int]]:
        """``(item, similarity, first word, words, wrong bits)`` of the best window for each item found in the whole text."""
        words = words_of(text)
        n, get = len(words), self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, n)
        known = np.cumsum(np.concatenate(([0], ids > 0)))
        spans: dict[int, list[int]] = defaultdict(list)
        for k, (sorted_hashes, sizes) in self.tables.items():
            if n < k:
                continue
            starts = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(starts):
                continue
            h = rolled(ids, k)[starts]
            at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
            for p, j in zip(starts[sorted_hashes[at] == h].tolist(), at[sorted_hashes[at] == h].tolist(), strict=True):
                for size in sizes[j]:
                    spans[size].append(p)
        best: dict[int, tuple[float, int, int, int]] = {}
        for size, hits in spans.items():
            self._look(words, size, hits, best)
        return [(item, s, -start, length, wrong) for item, (s, start, length, wrong) in sorted(best.items())]

    def _look(self, words: list[bytes], of: int, hits: list[int], best: dict[int, tuple[float, int, int, int]]) -> None:
        """Looks up the windows of the length ``of`` that hold one of the shingles that begin at ``hits``."""
        size, k, at = min(of, len(words)), min(SHINGLE, of), 0
        while at < len(hits):  # hits so close that windows may hold both are one region
            end = at
            while end + 1 < len(hits) and hits[end + 1] - hits[end] < size:
                end += 1
            lo, hi = max(0, hits[at] + k - size), min(hits[end], len(words) - size)
            for a in range(lo, hi + 1, WINDOWS_AT_ONCE):  # bounded memory in a text that repeats an item throughout
                self._verify(words, of, size, a, min(hi, a + WINDOWS_AT_ONCE - 1), best)
            at = end + 1

    def _verify(self, words: list[bytes], of: int, size: int, a: int, b: int, best: dict[int, tuple[float, int, int, int]]) -> None:
        """Takes the windows that start in a..b through the index; what it proposes and the exact similarity confirms goes to ``best`` as (similarity, -start, size, wrong bits)."""
        part, per = words[a : b + size], max(1, size - SHINGLE + 1)
        hashes = shingle_hashes(part, SHINGLE) if size >= SHINGLE else np.concatenate([shingle_hashes(part[i : i + size], SHINGLE) for i in range(b - a + 1)])
        sums = np.vstack((np.zeros((1, BITS), np.int32), np.cumsum(bits(hashes), axis=0, dtype=np.int32)))
        w = np.arange(b - a + 1)
        if of not in self.indexes:
            self.indexes[of] = MultiIndex(self.fps[self.of_size[of]])
        row, number, wrong = self.indexes[of].within(fingerprints(sums[w + per] - sums[w], per))
        whole: set[int] = set()
        for x in np.lexsort((row, wrong)).tolist():
            item, i = int(self.of_size[of][number[x]]), int(row[x])
            if item not in whole:
                s = similarity(self.counts[item], Counter(hashes[i : i + per].tolist()))
                if s >= SIMILARITY and (item not in best or (s, -(a + i)) > best[item][:2]):
                    best[item] = (s, -(a + i), size, int(wrong[x]))
                if s == 1:  # the first such window is the best
                    whole.add(item)


def rolled(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k word numbers."""
    v = (ids.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
    v ^= v >> np.uint64(29)
    n, h = len(ids) - k + 1, np.zeros(max(0, len(ids) - k + 1), np.uint64)
    for j in range(k):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + v[j : j + n]
        h ^= h >> np.uint64(31)
    return h


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list]:
    """Rows ``(item, text, how often)`` of the different items, about ITEMS_AT_ONCE at once."""
    items = benchmark.groupBy(F.col(item_col).alias("item"), F.col(text_col).alias("text")).agg(F.count("*").alias("n"))
    blocks = max(1, -(-items.count() // ITEMS_AT_ONCE))
    for b in range(blocks):
        yield sorted(items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect(), key=lambda r: (str(r["item"]), str(r["text"])))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id, item_id, similarity, first_word, n_words, wrong_bits)``: the benchmark items that each document holds.

    A row for each row of ``docs`` and each item whose best window has weighted similarity of
    SIMILARITY or more within RADIUS bits; of equal windows the first.  Null, empty and wordless texts
    on either side match nothing.  Items of fewer than five words are one shingle; a document shorter
    than an item is one window.  Repeated items and rows each give their own rows; null ids are passed
    on; other columns are left out.  The documents are read once for each block of about
    ITEMS_AT_ONCE items, so a benchmark of millions of items wants few, large blocks.
    """
    id_type, item_field = dict(docs.dtypes)[id_col], benchmark.schema[item_col].dataType
    item_arrow = to_arrow_type(item_field)
    out = None
    for mine in item_blocks(benchmark, item_col, item_text_col):
        numbered = [((r["item"], r["n"]), r["text"]) for r in mine]
        shared = docs.sparkSession.sparkContext.broadcast(Items(numbered))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                rows, found = [], []
                for at in range(0, batch.num_rows, 256):
                    for i, text in enumerate(batch.column(1).slice(at, 256).to_pylist(), at):
                        for x in items.leaks(text):
                            item, times = items.ids[x[0]]
                            rows += [i] * times
                            found += [(item, *x[1:])] * times
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([f[0] for f in found], item_arrow), pa.array([f[1] for f in found], pa.float64()), *(pa.array([f[k] for f in found], pa.int64()) for k in (2, 3, 4))],
                    ["id", "item_id", "similarity", "first_word", "n_words", "wrong_bits"],
                )

        part = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, item_id {item_field.simpleString()}, similarity double, first_word bigint, n_words bigint, wrong_bits bigint")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item by ``find_leaks``.

    No shuffle: each text is judged where it lies.  Null, empty and wordless texts stay; repeated rows
    stay or go together; an empty benchmark drops nothing; no rows give no rows.
    """
    at_col = docs.columns.index(text_col)
    for mine in item_blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(Items([(r["item"], r["text"]) for r in mine]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                keep = []
                for at in range(0, batch.num_rows, 256):
                    keep += [not items.leaks(t) for t in batch.column(at_col).slice(at, 256).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
