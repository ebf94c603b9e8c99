"""Interval operators: merge, complement, containment, coverage and time mapping.

Intervals are ``(rec_id, start_ms, end_ms)``, half-open in overlap tests.  Joins are on the recording
and, where spans are short against a recording, on a time bucket as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterframe.operators.sequence import islands, order
from utterframe.params import PARAMS, Params


def merge(iv: DataFrame, slack: int = PARAMS.merge_slack) -> DataFrame:
    """Disjoint, sorted union; intervals that come within ``slack`` are joined."""
    reach = F.max("end_ms").over(order("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1))
    runs = islands(iv.select("rec_id", "start_ms", "end_ms").withColumn("reach", reach), F.col("start_ms") > F.col("reach") + slack, ["start_ms", "end_ms"], "run")
    return runs.groupBy("rec_id", "run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("run")


def complement(iv: DataFrame, lengths: DataFrame) -> DataFrame:
    """What ``lengths(rec_id, duration_ms)`` leaves outside disjoint intervals; a recording without any is kept whole."""
    cuts = iv.select("rec_id", "start_ms", "end_ms").unionByName(lengths.select("rec_id", F.col("duration_ms").alias("start_ms"), F.col("duration_ms").alias("end_ms")))
    before = F.coalesce(F.max("end_ms").over(order("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    return cuts.select("rec_id", before.alias("start_ms"), F.col("start_ms").alias("end_ms")).filter("end_ms > start_ms")


def durations(words: DataFrame) -> DataFrame:
    return words.groupBy("rec_id").agg(F.max("end_ms").alias("duration_ms"))


def last_before(rows: DataFrame, at: Column, ranges: DataFrame, carry: list[str]) -> DataFrame:
    """As-of: for each row the last of ``ranges`` (by ``start_ms``) that starts at or before ``at``.

    Both sides meet in one ordered pass over the recording (union and ``last(ignore nulls)``), so the
    plan has no range join.  Adds ``r_start`` and ``r_end``, null if there is none.
    """
    left = rows.select("rec_id", *carry, at.alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast("bigint").alias("__s"), F.lit(None).cast("bigint").alias("__e"))
    right = ranges.select("rec_id", *[F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in carry], F.col("start_ms").alias("__at"), F.lit(0).alias("__side"), F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e"))
    w = Window.partitionBy("rec_id").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("r_start", F.last("__s", ignorenulls=True).over(w)).withColumn("r_end", F.last("__e", ignorenulls=True).over(w))
    return both.filter("__side = 1").select("rec_id", *carry, "r_start", "r_end")


def kept_words(words: DataFrame, ranges: DataFrame, slack: int = PARAMS.contain_slack) -> DataFrame:
    """Words that lie in no (disjoint) range, give or take ``slack`` at both ends."""
    carry = [c for c in words.columns if c != "rec_id"]
    found = last_before(words, F.col("start_ms") + slack, ranges, carry)
    return found.filter(F.col("r_end").isNull() | (F.col("end_ms") > F.col("r_end") + slack)).drop("r_start", "r_end")


def virtual_time(words: DataFrame, ranges: DataFrame) -> DataFrame:
    """The time a word has once the (disjoint) ranges are cut: its start less all cut before it."""
    upto = order("start_ms").rowsBetween(Window.unboundedPreceding, 0)
    total = ranges.withColumn("cut", F.sum(F.col("end_ms") - F.col("start_ms")).over(upto))
    marks = total.select("rec_id", "start_ms", F.col("cut").alias("end_ms"))  # carried as the range's second value
    ends = ranges.select("rec_id", F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e"))
    found = last_before(words, F.col("start_ms"), marks, ["word_idx", "start_ms"])
    j = found.join(ends, (found.rec_id == ends.rec_id) & (found.r_start == ends.__s), "left").select(found.rec_id, "word_idx", "start_ms", "r_end", "__e")
    over = F.greatest(F.coalesce(F.col("__e"), F.lit(0)) - F.col("start_ms"), F.lit(0))
    return j.select("rec_id", "word_idx", "start_ms", (F.col("start_ms") - F.coalesce(F.col("r_end"), F.lit(0)) + over).alias("virtual_ms"))


def snap_segments(deleted: DataFrame, first_ms: int = PARAMS.first_snap) -> DataFrame:
    """Neighbouring deleted sentences ``(rec_id, sent_idx, start_ms, end_ms)`` form one segment; a first one that starts early starts at 0."""
    new = F.col("sent_idx") > F.lag("sent_idx").over(order("sent_idx")) + 1
    runs = islands(deleted, new, ["sent_idx"], "seg_id")
    segs = runs.groupBy("rec_id", "seg_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_sentences"))
    start = F.when((F.col("seg_id") == 0) & (F.col("start_ms") < first_ms), 0).otherwise(F.col("start_ms")).cast("bigint")
    return segs.withColumn("start_ms", start)


def rescan_gaps(kept: DataFrame, ranges: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Pauses between words that are kept, cut down to the limit unless a range already begins there."""
    w = order("word_idx")
    g = kept.select("rec_id", "word_idx", F.lag("end_ms").over(w).alias("prev_end"), F.col("start_ms"))
    g = g.filter(F.col("start_ms") - F.col("prev_end") > p.silence).select("rec_id", F.col("word_idx").alias("next_word"), (F.col("prev_end") + p.silence).alias("start_ms"), F.col("start_ms").alias("end_ms"))
    g = g.filter(F.col("end_ms") - F.col("start_ms") >= p.rescan_least)
    near = last_before(g, F.col("start_ms") + p.rescan_least, ranges, ["next_word", "start_ms", "end_ms"])
    return near.filter(F.col("r_start").isNull() | (F.col("r_start") < F.col("start_ms") - p.rescan_least)).select("rec_id", "next_word", "start_ms", "end_ms")


def overlapping(left: DataFrame, right: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """Pairs of ``left(rec_id, l_id, l_start, l_end)`` and ``right(rec_id, r_id, r_start, r_end)`` that overlap.

    Both sides are cut at bucket bounds, meet by an equi-join, and each pair counts in the bucket
    where the later of the two begins, so no pair comes twice and nothing is sorted out after.
    """
    cut = lambda df, a, b: df.withColumn("bucket", F.explode(F.sequence(F.expr(f"{a} div {bucket_ms}"), F.expr(f"greatest({a}, {b} - 1) div {bucket_ms}"))))
    l, r = cut(left.filter("l_end > l_start"), "l_start", "l_end"), cut(right.filter("r_end > r_start"), "r_start", "r_end")
    j = l.join(r, ["rec_id", "bucket"])
    return j.filter((F.greatest("l_start", "r_start") < F.least("l_end", "r_end")) & (F.col("bucket") == F.expr(f"greatest(l_start, r_start) div {bucket_ms}"))).drop("bucket")


def gap_dependencies(gap_edits: DataFrame, edits: DataFrame) -> DataFrame:
    """For each gap, the edits that overlap its span."""
    l = gap_edits.select("rec_id", F.col("next_word").alias("l_id"), F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))
    r = edits.select("rec_id", F.col("edit_id").alias("r_id"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    return overlapping(l, r).groupBy("rec_id", F.col("l_id").alias("next_word")).agg(F.count("*").alias("n_edits"), F.array_join(F.array_sort(F.collect_list("r_id")).cast("array<string>"), ",").alias("depends_on"))


def dominant_speaker(segments: DataFrame, speaker_segs: DataFrame) -> DataFrame:
    """The speaker with the largest overlap; of equal ones the one who speaks first in the segment."""
    l = segments.select("rec_id", F.col("seg_id").alias("l_id"), F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))
    r = speaker_segs.select("rec_id", F.col("speaker").alias("r_id"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    part = overlapping(l, r).groupBy("rec_id", "l_id", "r_id").agg(F.sum(F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).alias("ms"), F.min("r_start").alias("first"))
    return part.groupBy("rec_id", F.col("l_id").alias("seg_id")).agg(F.max_by("r_id", F.struct("ms", (-F.col("first")).alias("f"))).alias("speaker"), F.max("ms").alias("overlap_ms"))


def silence_trims(g: DataFrame, target: int) -> DataFrame:
    """What to cut from a gap so that half of ``target`` stays on each side."""
    half = target // 2
    t = g.select("rec_id", "next_word", (F.col("gap_start") + half).alias("start_ms"), (F.col("gap_end") - half).alias("end_ms"))
    return t.filter("end_ms - start_ms > 10")
