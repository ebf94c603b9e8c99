"""Language-model scoring by a hidden Markov model.

Baum-Welch: each partition runs the scaled forward-backward recursion over its texts, expected
counts are summed across partitions, and the driver re-estimates the model, which has a fixed size.
Rounds over shares of the texts come first, then over all, each until the training likelihood stands
still.
The EMISSIONS most frequent training tokens have emission probabilities of their own; all others
share one class, inside which a token has its smoothed relative frequency.  The scaled forward
recursion gives the exact likelihood of a whole text.

Token counts cover all training texts and stay distributed.  The most frequent ones, about
HEAD of them, are broadcast; the others are looked up by an equi-join on the token, where the hot
tokens are already gone.
"""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count
from math import ceil, log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterframe.durable import durable

log = logging.getLogger(__name__)

STATES = 8
EMISSIONS = 8192
HEAD = 200_000
#: Frequencies are first counted by class, so many to a doubling, to find the head without a global sort.
SIZES_AN_OCTAVE = 64
#: Shares of the training texts, by a hash of the id, that rounds of Baum-Welch run over in turn; the last is all.  Training goes on to
#: the next after so many rounds, one upon the other, that each raised the log10 likelihood of a token by less: it rises slowly at first.
SHARES = ((1 / 32, 3, 2e-4), (1 / 8, 2, 5e-4), (1.0, 1, 1e-3))
SEED = 7
#: Added to expected counts, so that no probability is zero.
SMOOTH = 0.01
#: Tokens whose forward variables a worker holds at once; of a longer text it keeps those at every so many tokens and computes the rest again.
BATCH_TOKENS = 1_000_000
#: The end of a text; a word is never empty.
END = b""
COUNTED_AT_ONCE = 250_000


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased words between ASCII white space."""
    return (text or "").encode().lower().split()


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


@dataclass
class Model:
    start: np.ndarray  # (states)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states); each column sums to 1
    rounds: int = 0
    frequency: np.ndarray | None = None  # of the classes, which the start is made of

    @staticmethod
    def initial(frequency: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
        """The unigram distribution, with most of a class's weight on few states: a start near symmetry stays there for many rounds."""
        rng = np.random.default_rng(seed)
        emit = (frequency[:, None] + 1e-9) * rng.exponential(1, (len(frequency), states)) ** 3
        move = rng.uniform(0.5, 1.5, (states, states))
        return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), 0, frequency)


class Batch:
    """Sequences laid out by time: the longest first, so that the ones that go on are a prefix."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences], dtype=np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        longest = int(lengths[0]) if len(lengths) else 0
        alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, longest + 1), side="left")
        self.at = np.concatenate(([0], np.cumsum(alive)))
        self.alive, self.n = alive, len(lengths)
        flat = np.concatenate([sequences[i] for i in self.order]) if len(lengths) else np.zeros(0, np.int64)
        time = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.codes = np.empty(len(flat), dtype=np.int64)
        self.codes[self.at[time] + np.repeat(np.arange(len(lengths)), lengths)] = flat

    def _forward(self, m: Model, first: int, last: int, a: np.ndarray | None, keep: bool) -> tuple:
        """From time ``first`` to ``last``, after the variables ``a``: log10 likelihoods, the last variables, and with ``keep`` all variables and scales."""
        total, lo = np.zeros(self.n), self.at[first]
        kept = int(self.at[last] - lo) if keep else 0
        alphas, scales = np.empty((kept, len(m.start)), m.emit.dtype), np.empty(kept, m.emit.dtype)
        for t in range(first, last):
            n, at = int(self.alive[t]), int(self.at[t])
            e = m.emit[self.codes[at : at + n]]
            a = e * m.start if t == 0 else (a[:n] @ m.move) * e
            s = a.sum(axis=1)
            a /= s[:, None]
            total[:n] += np.log10(s)
            if keep:
                alphas[at - lo : at - lo + n], scales[at - lo : at - lo + n] = a, s
        return total, a, alphas, scales

    def forward(self, m: Model) -> np.ndarray:
        """log10 likelihood of each sequence, as given."""
        out = np.empty(self.n)
        out[self.order] = self._forward(m, 0, len(self.alive), None, False)[0]
        return out

    def expected(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions over whole sequences; the log10 likelihood of all is left in ``likelihood``."""
        states, end = len(m.start), len(self.alive)
        cuts, entering, a = [0], {0: None}, None
        while (to := int(np.searchsorted(self.at, self.at[cuts[-1]] + BATCH_TOKENS, side="right")) - 1) < end:
            to = max(to, cuts[-1] + 1)
            a = entering[to] = self._forward(m, cuts[-1], to, a, False)[1]
            cuts.append(to)
        self.likelihood, starts, moves, emits = 0.0, np.zeros(states), np.zeros((states, states)), np.zeros((len(m.emit), states))
        b = np.ones((0, states), m.emit.dtype)
        for first, last in zip(reversed(cuts), reversed([*cuts[1:], end]), strict=True):
            total, _, gamma, scales = self._forward(m, first, last, entering[first], True)
            self.likelihood += float(total.sum())
            base = int(self.at[first])
            for t in range(last - 1, first - 1, -1):
                n, lo = int(self.alive[t]), int(self.at[t]) - base
                beta = np.ones((n, states), m.emit.dtype)
                if len(b):
                    beta[: len(b)] = b @ m.move.T
                    moves += gamma[lo : lo + len(b)].T @ b
                here = slice(lo, lo + n)
                b = m.emit[self.codes[base + lo : base + lo + n]] * beta / scales[here, None]
                gamma[here] *= beta
            if first == 0 and self.n:
                starts += gamma[: self.alive[0]].sum(axis=0)
            codes = self.codes[base : base + len(gamma)]
            emits += np.stack([np.bincount(codes, gamma[:, k], minlength=len(m.emit)) for k in range(states)], axis=1)
        return starts, moves * m.move, emits


def grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows and their codes, about BATCH_TOKENS at once, texts of like length together."""
    for batch in batches:
        batch = batch.take(pa.array(np.argsort([-len(x.as_buffer()) for x in batch.column(column)], kind="stable"), pa.int64()))
        codes = [np.frombuffer(x.as_buffer(), dtype="<u2") for x in batch.column(column)]
        at = 0
        while at < len(codes):
            end, size = at, 0
            while end < len(codes) and (end == at or size + len(codes[end]) <= BATCH_TOKENS):
                size, end = size + len(codes[end]), end + 1
            yield batch.slice(at, end - at), codes[at:end]
            at = end


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(token, n)`` over the whole texts, END once for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([k.decode() for k in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], ["token", "n"])
            sums.clear()
            return b

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                for text in batch.column(0).slice(at, 128).to_pylist():
                    sums.update(tokens(text))
                    sums[END] += 1
                if len(sums) > COUNTED_AT_ONCE:
                    yield out()
        yield out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def encode(docs: DataFrame, head: dict[bytes, tuple[int, int]], classes: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each row of ``docs``: emission classes, what the head tokens add to the scores, and the tokens beyond the head."""
    shared = docs.sparkSession.sparkContext.broadcast(head)
    id_type = dict(docs.dtypes)[id_col]
    rare = classes - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        logs = {w: (k, log10(n + 0.5), n > 0) for w, (k, n) in known.items()}
        key, get = TaskContext.get().partitionId() << 40, logs.get
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys, sizes, codes, n_head, heads, rares, tails = [], [], [], [], [], [], []
                for text in part.column(2).to_pylist():
                    words = tokens(text)
                    words.append(END)
                    found = [get(w) for w in words]
                    hit = [x for x in found if x is not None]
                    keys.append(key)
                    key += 1
                    sizes.append(len(words))
                    codes.append(np.array([rare if x is None or x[0] >= rare else x[0] for x in found], dtype="<u2").tobytes())
                    n_head.append(sum(x[2] for x in hit))
                    heads.append(sum(x[1] for x in hit))
                    rares.append(sum(x[1] for x in hit if x[0] >= rare))
                    tails.append(b" ".join([w for w, x in zip(words, found, strict=True) if x is None]).decode())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(codes, pa.binary()), pa.array(n_head, pa.int64()), pa.array(heads, pa.float64()), pa.array(rares, pa.float64()), pa.array(tails, pa.string())],
                    ["key", "id", "held_out", "n_tokens", "codes", "n_head", "head_sum", "rare_sum", "tail"],
                )

    return docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(
        run, f"key bigint, id {id_type}, held_out boolean, n_tokens bigint, codes binary, n_head bigint, head_sum double, rare_sum double, tail string"
    )


def train(encoded: DataFrame, model: Model, rounds: int | None = None) -> Model:
    """Baum-Welch on ``encoded(id, codes)``: over each of SHARES until the likelihood stands still, or over all rows for as many rounds as asked.

    Each round sums expected counts over whole texts across partitions.
    """
    states, classes = len(model.start), len(model.emit)
    size = states + states * states + classes * states
    hashed = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20))
    for share, patience, rise in SHARES if rounds is None else ((1.0, 1, 0.0),):
        some, before, still = encoded.select("codes"), -np.inf, 0
        if share < 1:  # laid out by itself, so that a round reads the share and not all
            some = encoded.filter(hashed < int(share * (1 << 20))).select("codes")
            some = durable(some.coalesce(max(1, ceil(some.rdd.getNumPartitions() * share))))
        for done in count(1):
            if rounds is not None and done > rounds:
                break
            shared = encoded.sparkSession.sparkContext.broadcast(Model(*(x.astype(np.float32) for x in (model.start, model.move, model.emit))))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                m, sums = shared.value, np.zeros(size + 1)
                for _, part in grouped(batches, 0):
                    b = Batch(part)
                    sums[:size] += np.concatenate([x.ravel() for x in b.expected(m)])
                    sums[size] += b.likelihood
                full = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(sums[full])], ["i", "v"])

            found = some.mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # at most ``size`` + 1 rows
            sums = np.zeros(size + 1)
            sums[found.column("i").to_numpy()] = found.column("v").to_numpy()
            start, move, emit = sums[:states], sums[states : states + states * states].reshape(states, states), sums[states + states * states : size].reshape(classes, states)
            tokens_read = emit.sum()
            if not tokens_read:
                break
            mean = sums[size] / tokens_read
            # a share may lack tokens that others have: the start's frequencies count as one token in a hundred
            lacking = 0.0 if share == 1 else model.frequency[:, None] * tokens_read / states / 100
            start, move, emit = start + SMOOTH, move + SMOOTH, emit + SMOOTH + lacking
            model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), model.rounds + 1, model.frequency)
            log.info("Baum-Welch over %.4f of the texts: log10 likelihood of a token %.5f before round %d", share, mean, model.rounds)
            still = still + 1 if mean - before < rise else 0
            if rounds is None and still == patience:
                break
            before = mean
    return model


def most_frequent(words: DataFrame, most: int) -> pa.Table:
    """About ``most`` rows of ``words(token, n)`` with the largest ``n``, all of them if there are fewer; of equal ones those with smaller hashes.

    Found by counting: classes of frequency, then the frequencies of the class at the border, then
    of the frequency at the border the tokens whose hash is small enough.
    """
    sized = words.withColumn("size", F.floor(F.log2("n") * SIZES_AN_OCTAVE))

    def border(counted: DataFrame, room: int) -> tuple[int | None, int, int]:
        """The value from which on groups fit into ``room``, what room is left, and the rows of the next smaller value's group."""
        for r in counted.orderBy(F.desc("x")).collect():  # some thousand classes, or the frequencies of one
            if r["c"] > room:
                return r["x"], room, r["c"]
            room -= r["c"]
        return None, room, 0

    size, room, _ = border(sized.groupBy(F.col("size").alias("x")).agg(F.count("*").alias("c")), most)
    if size is None:
        taken = sized
    else:
        n, room, c = border(sized.filter(F.col("size") == size).groupBy(F.col("n").alias("x")).agg(F.count("*").alias("c")), room)
        taken = sized.filter((F.col("n") > n) | ((F.col("n") == n) & (F.pmod(F.xxhash64("token"), F.lit(1 << 62)) < (1 << 62) * room // c)))
    return taken.select("token", "n").toArrow().sort_by([("n", "descending"), ("token", "ascending")])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, emissions: int = EMISSIONS, head_size: int = HEAD, rounds: int | None = None) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, a row for each row of ``docs``.

    Learns from the rows with an id that are not held out.  A null text is empty: its only token is
    the end.  Scores are log10 probabilities of whole texts of any length.  Tokens that training
    lacks share the probability of one unseen token.  Repeated rows are learned from and scored as
    often as they are there; ties in token frequency are broken by the token; without training rows
    every token is unseen.  Other columns are left out; no rows give no rows.
    """
    counts = durable(count_tokens(docs.filter(~held_out(id_col) & F.col(id_col).isNotNull()), text_col))
    size = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = size["n"] or 0, size["v"]
    ends = counts.filter(F.col("token") == "").agg(F.sum("n").alias("n")).first()["n"] or 0
    # as Arrow columns and not as a row object each; the end is always an emission of its own
    top = most_frequent(counts.filter(F.col("token") != ""), max(emissions, head_size))
    numbers = [ends, *top.column("n").to_pylist()]
    head = {END: (0, ends)} | {w.encode(): (k, numbers[k]) for k, w in enumerate(top.column("token").to_pylist(), 1)}
    own = numbers[: min(emissions, 65534)]
    del top, numbers
    classes = len(own) + 1
    n_rare, v_rare = n_all - sum(own), v_all - sum(n > 0 for n in own)
    coded = encode(docs, head, classes, id_col, text_col)
    del head
    rows = durable(coded)

    frequency = np.array([*own, n_rare], dtype=float) + 0.5
    model = train(rows.filter(~F.col("held_out") & F.col("id").isNotNull()), Model.initial(frequency / frequency.sum(), states), rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, codes in grouped(batches, 4):
            likelihood = Batch(codes).forward(m)
            rare = np.array([np.count_nonzero(c == len(m.emit) - 1) for c in codes], dtype=np.int64)
            cols = [part.column(i) for i in (0, 1, 2, 3, 5, 6, 7)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(rare), pa.array(likelihood)], ["key", "id", "held_out", "n_tokens", "n_head", "head_sum", "rare_sum", "n_rare", "likelihood"])

    scored = rows.select("key", "id", "held_out", "n_tokens", "codes", "n_head", "head_sum", "rare_sum").mapInArrow(
        run, f"key bigint, id {id_type}, held_out boolean, n_tokens bigint, n_head bigint, head_sum double, rare_sum double, n_rare bigint, likelihood double"
    )
    beyond = rows.filter("tail <> ''").select("key", F.explode(F.split("tail", " ", -1)).alias("token"))
    looked = beyond.join(counts, "token", "left").groupBy("key").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("tail_sum"), F.count("n").alias("n_tail"))
    j = scored.join(looked, "key", "left")
    tail = F.coalesce("tail_sum", F.lit(0.0))
    base = F.col("head_sum") + tail - F.col("n_tokens") * log10(n_all + 0.5 * (v_all + 1))
    total = F.col("likelihood") + F.col("rare_sum") + tail - F.col("n_rare") * log10(n_rare + 0.5 * (v_rare + 1))
    return j.select("id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"), F.lit(n_all).cast("bigint").alias("train_tokens"), base.alias("base_score"), total.alias("score"))
