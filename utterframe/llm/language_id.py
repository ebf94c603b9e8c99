"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent character n-grams (one to three characters of
words padded on both sides).  A document's own most frequent n-grams are compared to each profile by
the out-of-place distance: the sum of rank differences, with the largest penalty for an n-gram that
the profile lacks.  The nearest profile names the language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterframe.llm.common import slices

#: N-grams of a profile, and of a document that are compared.
PROFILE_SIZE = 400
DOCUMENT_SIZE = 300
#: Labelled documents of a language that its profile is fitted on, as expected (a fixed bound: documents are taken by a hash of their id).
FIT_DOCUMENTS = 3000
UND = "und"
#: Fit of a document to its nearest profile below which a filter rejects it.
MIN_SCORE = 0.1
#: Runs of letters and, as ``re`` has no class of letters, of numerals that are not digits; these are taken out after.
WORD = re.compile(r"[^\W\d_]+")
PAD = "\x01"
CACHE_WORDS, CACHE_GRAMS = 200_000, 100_000


def words_of(text: str) -> Counter:
    """The different runs of letters of the lower-cased text, with their counts."""
    words = Counter(WORD.findall(text.lower()))
    for w in [w for w in words if not w.isalpha()]:
        n = words.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            words[part] += n
    return words


class Numbers(dict):
    """A number for each n-gram met, and its code: up to three code points, 21 bits each."""

    def __init__(self) -> None:
        self.codes: list[int] = []

    def __missing__(self, gram: str) -> int:
        code = 0
        for c in gram:
            code = code << 21 | ord(c)
        self.codes.append(code)
        self[gram] = len(self)
        return self[gram]


class Grams:
    """The n-grams that a worker has met, and each word's as an array of numbers; emptied when it has grown large."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, np.ndarray] = {}
        self.numbers, self.codes, self.known = Numbers(), np.zeros(1024, np.int64), 0

    def of(self, word: str) -> np.ndarray:
        number, padded = self.numbers, f"{PAD}{word}{PAD}"
        n = [number[c] for c in word]
        n += [number[padded[i : i + 2]] for i in range(len(word) + 1)]
        n += [number[padded[i : i + 3]] for i in range(len(word))]
        out = np.array(n, dtype=np.int32)
        if len(word) < 64:
            self.words[word] = out
        return out

    def counted(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The whole text's different n-grams and their counts."""
        words = words_of(text)
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.words) > CACHE_WORDS or len(self.numbers) > CACHE_GRAMS:
            self.clear()
        get, of = self.words.get, self.of
        parts = [p if (p := get(w)) is not None else of(w) for w in words]
        weights = np.repeat(np.fromiter(words.values(), np.float64, len(words)), [len(p) for p in parts])
        counts = np.bincount(np.concatenate(parts), weights)
        if self.known < len(self.numbers):
            if len(self.codes) < len(self.numbers):
                self.codes = np.resize(self.codes, 2 * len(self.numbers))
            self.codes[self.known : len(self.numbers)] = self.numbers.codes[self.known :]
            self.known = len(self.numbers)
        met = np.flatnonzero(counts)
        return self.codes[met], counts[met].astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams (ties: smaller code) and their ranks; equal counts share the middle rank."""
    if len(counts) > most:
        enough = counts >= np.partition(counts, len(counts) - most)[len(counts) - most]
        codes, counts = codes[enough], counts[enough]
    order = np.lexsort((codes, -counts))[:most]
    c = counts[order]
    lo = np.searchsorted(-c, -c, side="left")
    hi = np.searchsorted(-c, -c, side="right")
    return codes[order], (lo + hi - 1) / 2


class Profiles:
    """The profiles as one sorted table of n-grams with a rank per language."""

    def __init__(self, ranks: dict[str, dict[int, float]], size: int = PROFILE_SIZE):
        self.langs, self.size = sorted(ranks), size
        self.codes = np.array(sorted({g for r in ranks.values() for g in r}), dtype=np.int64)
        # the last column stands for an n-gram that no profile has
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), np.inf)
        at = {int(g): i for i, g in enumerate(self.codes)}
        for k, lang in enumerate(self.langs):
            for g, r in ranks[lang].items():
                self.ranks[k, at[g]] = r

    def predict(self, text: str | None, cache: Grams, most: int = DOCUMENT_SIZE) -> tuple[str, float]:
        """Language and fit (1: in place, 0: nothing in common); ties to the smaller name."""
        codes, counts = cache.counted(text or "")
        if not len(codes) or not self.langs:
            return UND, 0.0
        top, rank = ranked(codes, counts, most)
        i = np.searchsorted(self.codes, top)
        i = np.where((i < len(self.codes)) & (self.codes[np.minimum(i, len(self.codes) - 1)] == top), i, len(self.codes))
        total = np.minimum(np.abs(self.ranks[:, i] - rank), self.size).sum(axis=1)
        best = int(np.argmin(total))
        return self.langs[best], float(max(0.0, 1 - total[best] / (self.size * len(top))))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; a null id is held out of nothing and not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


#: Hashes of ids are cut to so many values.
HASHES = 1 << 62


def share_below(most: int, n: int) -> int:
    """Of HASHES values, how many take about ``most`` of ``n`` rows: all if there are no more, some however many there are."""
    return HASHES if n <= most else HASHES * most // n


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", most: int = FIT_DOCUMENTS) -> Profiles:
    """Profiles from the labelled rows of ``docs``, at most about ``most`` of a language, whole texts."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    per = {r[lang_col]: r["n"] for r in known.groupBy(lang_col).agg(F.count("*").alias("n")).collect()}  # a row per language
    if not per:
        return Profiles({})
    keep, hashed = F.lit(False), F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(HASHES))
    for lang, n in per.items():
        keep = keep | ((F.col(lang_col) == lang) & (hashed < share_below(most, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Grams()
        for langs, texts in slices(batches):
            sums: dict[str, Counter] = {}
            for lang, text in zip(langs, texts, strict=True):
                codes, counts = cache.counted(text)
                c = sums.setdefault(lang, Counter())
                for g, n in zip(codes.tolist(), counts.tolist(), strict=True):
                    c[g] += n
            rows = [(lang, g, n) for lang, c in sums.items() for g, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "gram", "n"])

    counts = known.filter(keep).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("k", rank).filter(F.col("k") <= PROFILE_SIZE).select("lang", "gram", "n").collect()  # PROFILE_SIZE rows per language
    by: dict[str, list[tuple[int, int]]] = {}
    for r in top:
        by.setdefault(r["lang"], []).append((r["gram"], r["n"]))
    out = {}
    for lang, rows in by.items():
        codes, ranks = ranked(np.array([g for g, _ in rows]), np.array([n for _, n in rows]), PROFILE_SIZE)
        out[lang] = dict(zip(codes.tolist(), ranks.tolist(), strict=True))
    return Profiles(out)


def predict(docs: DataFrame, profiles: Profiles, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``lang_pred``, ``score`` (0 to 1), a row for each row.

    Null texts and texts without letters are ``und`` with score 0.  Whole texts of any length count.
    Repeated rows get equal results; columns of ``docs`` named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    fields = [f for f in docs.select(*keep).schema.fields if f.name not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, Grams()
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 256):
                found += [model.predict(t, cache) for t in batch.column(batch.num_columns - 1).slice(at, 256).to_pylist()]
            cols = [batch.column(i) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*(f.name for f in fields), "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string", "score double"])
    return docs.select(*[F.col(f.name) for f in fields], F.col(text_col).alias("__text")).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id, held_out, lang_pred, score)``: profiles from the documents that are not held out, predictions for all."""
    profiles = fit(docs.filter(~held_out(id_col)), lang_col, text_col, id_col)
    return predict(docs.withColumn("held_out", held_out(id_col)), profiles, [id_col, "held_out"], text_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, with their columns, whose text has letters and fits some language by ``least`` at least.

    Null texts and texts without letters go; repeated rows stay or go together; columns of any name
    are passed through; no rows give no rows.
    Where no row is labelled nothing is known of any language, and only texts without letters go.
    """
    profiles = fit(docs.filter(~held_out(id_col)), lang_col, text_col, id_col)
    shared, at = docs.sparkSession.sparkContext.broadcast(profiles), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, Grams()
        for batch in batches:
            keep = []
            for a in range(0, batch.num_rows, 256):
                for text in batch.column(at).slice(a, 256).to_pylist():
                    lang, score = model.predict(text, cache)
                    keep.append(lang != UND and score >= least if model.langs else any(map(str.isalpha, text or "")))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
