"""Sequence operators over time-stamped words: timelines, folds, gaps, runs and islands.

Every operator takes ``rec_id`` as its first key, so windows and joins partition by recording, and
carries order in explicit columns.  Frames of words have ``rec_id, word_idx, turn, raw, tok,
speaker, start_ms, end_ms, sent_idx``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterframe.params import PARAMS, Params, Timeline


def order(*by: str, keys: Sequence[str] = ("rec_id",)) -> Window:
    return Window.partitionBy(*keys).orderBy(*by)


def islands(df: DataFrame, starts: Column, by: Sequence[str], name: str, keys: Sequence[str] = ("rec_id",)) -> DataFrame:
    """Number the runs that begin where ``starts`` holds (rows before the first start are run 0)."""
    flag = F.coalesce(starts, F.lit(False)).cast("int")
    return df.withColumn("__new", flag).withColumn(name, F.sum("__new").over(order(*by, keys=keys).rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("__new")


def timeline(turns: DataFrame, t: Timeline = Timeline()) -> DataFrame:
    """Words with times from ``turns(conv_id, turn, role, text)``: W1, W3, W4's boundaries and the time layout."""
    raw = turns.select(F.col("conv_id").alias("rec_id"), "turn", F.col("role").alias("speaker"), F.posexplode(F.split("text", r"\s+")).alias("pos", "raw"))
    words = raw.withColumn("tok", F.lower(F.regexp_replace("raw", r"[^\p{L}\p{N}]+", ""))).filter("tok <> ''")
    w = order("turn", "pos")
    size = F.length("tok") * t.ms_per_char + t.ms_per_word
    pause = F.when(F.col("raw").rlike("[.!?]$"), t.gap_stop).when(F.col("raw").rlike(",$"), t.gap_comma).otherwise(t.gap)
    other = F.coalesce(F.lag("speaker").over(w) != F.col("speaker"), F.lit(False))
    words = words.withColumn("dur", size.cast("bigint")).withColumn("step", (size + pause).cast("bigint")).withColumn("wait", F.when(other, t.gap_speaker).otherwise(0).cast("bigint"))
    words = words.withColumn("fresh", F.coalesce(F.lag("raw").over(w).rlike("[.!?]$") | other, F.lit(True)).cast("int"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    words = words.withColumn("start_ms", F.sum(F.col("step") + F.col("wait")).over(upto) - F.col("step"))
    words = words.withColumn("word_idx", (F.row_number().over(w) - 1).cast("bigint")).withColumn("sent_idx", (F.sum("fresh").over(upto) - 1).cast("bigint"))
    return words.select("rec_id", "word_idx", "turn", "raw", "tok", "speaker", "start_ms", (F.col("start_ms") + F.col("dur")).alias("end_ms"), "sent_idx")


def sentences(words: DataFrame) -> DataFrame:
    """Fold words to sentences; the text is the tokens in order, one space between."""
    return words.groupBy("rec_id", "sent_idx").agg(
        F.min("word_idx").alias("w_start"),
        F.max("word_idx").alias("w_end"),
        F.min_by("speaker", "word_idx").alias("speaker"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "tok"))), lambda x: x["tok"]), " ").alias("text"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
    )


def sentences_by_pause(words: DataFrame, least: int = PARAMS.gap_min) -> DataFrame:
    """The other fold: a new sentence at a change of speaker or after a pause over ``least``; with the pause that follows."""
    w = order("word_idx")
    new = (F.lag("speaker").over(w) != F.col("speaker")) | (F.col("start_ms") - F.lag("end_ms").over(w) > least)
    s = islands(words, new, ["word_idx"], "part").groupBy("rec_id", "part").agg(
        F.min("word_idx").alias("w_start"), F.max("word_idx").alias("w_end"), F.min_by("speaker", "word_idx").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")
    )
    return s.withColumn("gap_after", F.lead("start_ms").over(order("part")) - F.col("end_ms"))


def speaker_stats(words: DataFrame) -> DataFrame:
    """A1: words by speaker, and their share in basis points."""
    n = words.groupBy("speaker").agg(F.count("*").alias("n_words"))
    return n.select("speaker", "n_words", F.expr("n_words * 10000 div sum(n_words) over ()").cast("bigint").alias("share_bp"))


def first_sentences(sents: DataFrame, n: int = 5) -> DataFrame:
    """O3: the first n sentences of each speaker of a recording."""
    rank = F.row_number().over(order("sent_idx", keys=("rec_id", "speaker")))
    return sents.withColumn("k", rank.cast("bigint")).filter(F.col("k") <= n).select("rec_id", "speaker", "k", "sent_idx", "text")


def gaps(words: DataFrame, least: int = PARAMS.gap_min) -> DataFrame:
    """Pauses of at least ``least`` ms after the running maximum end (tracks may overlap)."""
    before = F.max("end_ms").over(order("start_ms", "word_idx").rowsBetween(Window.unboundedPreceding, -1))
    g = words.withColumn("gap_start", before).withColumn("gap_ms", F.col("start_ms") - F.col("gap_start"))
    return g.filter(F.col("gap_ms") >= least).select("rec_id", F.col("word_idx").alias("next_word"), "gap_start", F.col("start_ms").alias("gap_end"), "gap_ms", "sent_idx")


def gap_histogram(g: DataFrame, bounds: tuple[int, int] = (1000, 2000), target: int = PARAMS.silence) -> DataFrame:
    """Gaps by length class, and what is over ``target``."""
    lo, hi = bounds
    name = F.when(F.col("gap_ms") < lo, "short").when(F.col("gap_ms") < hi, "medium").otherwise("long")
    return g.groupBy(name.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.greatest(F.col("gap_ms") - target, F.lit(0))).cast("bigint").alias("excess_ms"))


def sentence_starts(sents: DataFrame) -> DataFrame:
    """Each sentence's end is the next one's start; the last keeps its own."""
    nxt = F.lead("start_ms").over(order("sent_idx"))
    return sents.select("rec_id", "sent_idx", "start_ms", "end_ms", F.coalesce(nxt, F.col("end_ms")).alias("until_ms"))


def silence_edits(g: DataFrame, sents: DataFrame, p: Params = PARAMS) -> DataFrame:
    """D1 with J4: gaps over the limit, each given to the last sentence whose span, with slack, holds its start.

    The slack is under a second, so only a few sentences around a gap qualify: the join is on the
    recording and a coarse time bucket, not a nested loop over the recording.
    """
    bucket = 60_000
    long = g.filter((F.col("gap_ms") > p.silence) & (F.col("gap_ms") - p.silence >= p.silence_least_cut)).withColumn("b", F.expr(f"gap_start div {bucket}"))
    spans = sentence_starts(sents).select("rec_id", F.col("sent_idx").alias("s"), F.col("start_ms").alias("s0"), F.col("until_ms").alias("s1"))
    lo, hi = F.expr(f"greatest(s0 - {p.sentence_slack}, 0) div {bucket}"), F.expr(f"(s1 + {p.sentence_slack}) div {bucket}")
    spans = spans.withColumn("b", F.explode(F.sequence(lo, F.greatest(lo, hi))))
    fits = (F.col("gap_start") >= F.col("s0") - p.sentence_slack) & (F.col("gap_start") <= F.col("s1") + p.sentence_slack)
    found = long.join(spans, ["rec_id", "b"]).filter(fits).groupBy("rec_id", "next_word", "gap_start", "gap_end", "gap_ms").agg(F.max("s").alias("sent_idx"))
    return found.select("rec_id", "sent_idx", "gap_start", "gap_end", (F.col("gap_start") + p.silence).alias("trim_start"), F.lit(p.silence).cast("bigint").alias("keep_ms"), (F.col("gap_ms") - p.silence).alias("cut_ms"))


def speaker_segments(words: DataFrame, join_ms: int = PARAMS.speaker_join) -> DataFrame:
    """Stretches of one speaker, going on while the pause is under ``join_ms``."""
    w = order("word_idx")
    new = (F.lag("speaker").over(w) != F.col("speaker")) | (F.col("start_ms") - F.lag("end_ms").over(w) >= join_ms)
    runs = islands(words, new, ["word_idx"], "seg_id")
    return runs.groupBy("rec_id", "seg_id").agg(F.min_by("speaker", "word_idx").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_words"))


def equal_runs(words: DataFrame, by: str = "tok", within: Sequence[str] = ("rec_id", "sent_idx")) -> DataFrame:
    """Adjacent equal values inside a sentence, two or more, as runs of words."""
    new = F.lag(by).over(order("word_idx", keys=within)) != F.col(by)
    runs = islands(words, new, ["word_idx"], "run", keys=within)
    return runs.groupBy(*within, "run", by).agg(F.min("word_idx").alias("w_from"), F.max("word_idx").alias("w_to"), F.count("*").alias("run_len"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).filter("run_len >= 2").drop("run")


def epoch(ts: str, unit: str = "MILLISECOND") -> Column:
    """Whole units since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff({unit}, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def session_islands(events: DataFrame, gap_seconds: int, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """W5 over events: sessions of a key that end with a pause longer than ``gap_seconds``."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    us = epoch(ts, "MICROSECOND")
    new = us - F.lag(us).over(w) > gap_seconds * 1_000_000
    runs = islands(events, new, [ts, "event_id"], "session", keys=(key,))
    return runs.groupBy(key, "session").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"), F.max_by("event_id", F.struct(F.col(ts), F.col("event_id"))).alias("last_event"))


def running_gaps(tracks: DataFrame, least: int) -> DataFrame:
    """W3 and W2 for merged tracks ``(rec_id, track, id, start_ms, end_ms)``: order by start, end, track; gaps after the running maximum end."""
    w = order("start_ms", "end_ms", "track", "id")
    before = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    merged = tracks.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint")).withColumn("gap_ms", F.col("start_ms") - before)
    return merged.filter(F.col("gap_ms") >= least).select("rec_id", "pos", "track", "id", "gap_ms")


def greedy_spacing(points: DataFrame, gap: int, by: str = "at", keys: Sequence[str] = ("rec_id",)) -> DataFrame:
    """Keep a point if it is more than ``gap`` after the last one kept.

    The state is the last kept point, so no window expresses it.  Points pass in order, and a task
    holds no more than a batch of them.
    """
    schema = points.select(*keys, by).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last = None
        for batch in batches:
            at = batch.column(len(keys)).to_numpy()
            names = list(zip(*(c.to_pylist() for c in batch.columns[: len(keys)]), strict=True))
            starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            kept = []
            for a, b in zip(starts, [*starts[1:], len(names)], strict=True):
                i = a
                if names[a] == last_key:
                    i = a + int(np.searchsorted(at[a:b], last + gap, side="right"))
                while i < b:
                    kept.append(i)
                    last_key, last = names[a], int(at[i])
                    i = a + int(np.searchsorted(at[a:b], last + gap, side="right"))
            yield batch.take(pa.array(kept, pa.int64()))

    return points.select(*keys, by).filter(F.col(by).isNotNull()).repartition(*keys).sortWithinPartitions(*keys, by).mapInArrow(run, schema)
