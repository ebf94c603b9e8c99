"""Alignment of word sequences, the one place where grouped Python is needed."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterframe.operators.sequence import islands, order


def lcs_missing(expected: list[str], actual: list[str]) -> list[int]:
    """Places of ``expected`` outside a longest common subsequence; of equal ways back, a word of ``actual`` is dropped first.

    The way back begins at the end, so a common end is matched as it stands and left out of the table
    (a common beginning is not: an earlier word may go in place of an equal later one).  Rows of the
    table are computed as vectors; every so many of them are kept, and the way back computes those
    between again, so that memory grows with the square root of the table and not with the table.
    """
    b = 0
    while b < min(len(expected), len(actual)) and expected[-1 - b] == actual[-1 - b]:
        b += 1
    x, y = expected[: len(expected) - b], actual[: len(actual) - b]
    if not x or not y:
        return list(range(len(x)))
    number: dict[str, int] = {}
    xs = np.array([number.setdefault(w, len(number)) for w in x])
    ys = np.array([number.setdefault(w, len(number)) for w in y])

    def below(row: np.ndarray, w: int) -> np.ndarray:
        new = row.copy()
        np.maximum(row[1:], np.where(ys == w, row[:-1] + 1, 0), out=new[1:])
        return np.maximum.accumulate(new, out=new)

    step = max(1, int(len(x) ** 0.5))
    kept = [row := np.zeros(len(y) + 1, np.int32)]
    for i, w in enumerate(xs, 1):
        row = below(row, w)
        if i % step == 0:
            kept.append(row)
    out, i, j, part, base = [], len(x), len(y), [], len(x) + 1
    while i and j:
        if i <= base:  # the rows from the last kept one up to this
            base = (i - 1) // step * step
            part = [kept[base // step]]
            for w in xs[base:i]:
                part.append(below(part[-1], w))
        if xs[i - 1] == ys[j - 1]:
            i, j = i - 1, j - 1
        elif part[i - 1 - base][j] > part[i - base][j - 1]:
            i -= 1
            out.append(i)
        else:
            j -= 1
    return sorted(out + list(range(i)))


def _renamed(df: DataFrame, *cols: str) -> DataFrame:
    """Columns under other names, so that both sides may come from one frame."""
    return df.select(*[F.col(c).alias(f"__{c}") for c in cols])


def missing_words(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """D18's first step: words ``(rec_id, word_idx, tok, start_ms, end_ms)`` that the other track of the recording lacks."""

    def run(key: tuple, e: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        e, a = e.sort_values("word_idx"), a.sort_values("__word_idx")
        return e.iloc[lcs_missing(e["tok"].tolist(), a["__tok"].tolist())]

    cols = ["rec_id", "word_idx", "tok", "start_ms", "end_ms"]
    e, a = expected.select(*cols), _renamed(actual, "rec_id", "word_idx", "tok")
    return e.groupBy("rec_id").cogroup(a.groupBy("__rec_id")).applyInPandas(run, e.schema)


def missing_runs(missing: DataFrame, gap_ms: int = 1000, least: int = 3) -> DataFrame:
    """Missing words less than ``gap_ms`` apart form a run; runs of ``least`` or more are issues."""
    w = order("word_idx")
    runs = islands(missing, F.col("start_ms") - F.lag("end_ms").over(w) >= gap_ms, ["word_idx"], "run")
    return runs.groupBy("rec_id", "run").agg(F.min("word_idx").alias("w_from"), F.max("word_idx").alias("w_to"), F.count("*").alias("n_words"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).filter(F.col("n_words") >= least).drop("run")


def align_sentences(before: DataFrame, after: DataFrame, alike: float = 0.7, autojunk: bool = True) -> DataFrame:
    """Which sentences of ``before(rec_id, sent_idx, text)`` were kept, by matching blocks; inside replaced blocks a ratio above ``alike`` rescues one.

    With ``autojunk``, difflib's own default, a sentence that makes up over a hundredth of 200 or more
    sentences starts no match.  One recording is aligned in one task.
    """

    def run(key: tuple, b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        b, a = b.sort_values("sent_idx"), a.sort_values("__sent_idx")
        xs, ys = b["text"].tolist(), a["__text"].tolist()
        state = ["deleted"] * len(xs)
        for op, i0, i1, j0, j1 in SequenceMatcher(None, xs, ys, autojunk).get_opcodes():
            if op == "equal":
                state[i0:i1] = ["kept"] * (i1 - i0)
            elif op == "replace":
                free = list(range(j0, j1))
                for i in range(i0, i1):
                    ratios = [(SequenceMatcher(None, xs[i], ys[j]).ratio(), -j) for j in free]
                    if ratios and max(ratios)[0] > alike:
                        free.remove(-max(ratios)[1])
                        state[i] = "changed"
        return pd.DataFrame({"rec_id": b["rec_id"], "sent_idx": b["sent_idx"], "state": state})

    b, a = before.select("rec_id", "sent_idx", "text"), _renamed(after, "rec_id", "sent_idx", "text")
    return b.groupBy("rec_id").cogroup(a.groupBy("__rec_id")).applyInPandas(run, f"rec_id {dict(b.dtypes)['rec_id']}, sent_idx bigint, state string")
