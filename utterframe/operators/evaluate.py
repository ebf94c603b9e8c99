"""Evaluation, feedback and learning: best matches, precision and recall, rates, ladders, issues."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterframe.functions.formats import ramp


def best_matches(gold: DataFrame, predicted: DataFrame, keys: Sequence[str] = ("rec_id", "sent_idx")) -> DataFrame:
    """Per gold edit ``(.., g_id, g_from, g_to)`` the best prediction ``(.., p_id, p_from, p_to)`` of its sentence: exact, else overlapping, else none.

    Of equal matches the first prediction counts; a prediction may serve several gold edits.
    """
    j = gold.join(predicted, list(keys), "left")
    rank = F.when((F.col("g_from") == F.col("p_from")) & (F.col("g_to") == F.col("p_to")), 2).when((F.col("p_from") <= F.col("g_to")) & (F.col("p_to") >= F.col("g_from")), 1)
    best = F.max(F.when(rank.isNotNull(), F.struct(rank.alias("m"), (-F.col("p_id")).alias("neg"))))
    g = j.groupBy(*keys, "g_id").agg(best.alias("b"))
    return g.select(*keys, "g_id", (-F.col("b.neg")).alias("p_id"), F.when(F.col("b.m") == 2, "exact").when(F.col("b.m") == 1, "partial").otherwise("missed").alias("match"))


def prf(rows: DataFrame, by: str, gold: Column, predicted: Column) -> DataFrame:
    """Counts, precision and recall in basis points, by class and over all (a rollup: one pass)."""
    c = lambda x: F.count_if(x)
    t = rows.rollup(by).agg(c(gold & predicted).alias("tp"), c(~gold & predicted).alias("fp"), c(gold & ~predicted).alias("fn"))
    return t.select(F.coalesce(by, F.lit("all")).alias(by), "tp", "fp", "fn", F.expr("if(tp + fp = 0, null, tp * 10000 div (tp + fp))").alias("precision_bp"), F.expr("if(tp + fn = 0, null, tp * 10000 div (tp + fn))").alias("recall_bp"))


def occurrences(text: str, token: str) -> Column:
    """Non-overlapping occurrences of a token in a text."""
    return F.expr(f"(length({text}) - length(replace({text}, {token}, ''))) div length({token})")


def filler_rates(texts: DataFrame, fillers: Sequence[str]) -> DataFrame:
    """Occurrences of each filler in all ``texts(text, deleted)`` and in deleted ones; the rate in basis points.  The list is a literal: no join."""
    each = texts.select("deleted", F.col("text"), F.explode(F.array(*map(F.lit, fillers))).alias("filler")).withColumn("n", occurrences("text", "filler"))
    t = each.groupBy("filler").agg(F.sum("n").cast("bigint").alias("total"), F.sum(F.when(F.col("deleted"), F.col("n")).otherwise(0)).cast("bigint").alias("deleted_n"))
    return t.withColumn("rate_bp", F.expr("if(total = 0, 0, deleted_n * 10000 div total)").cast("bigint"))


def overrides(rates: DataFrame, often: int = 6000, sometimes: int = 3000) -> DataFrame:
    """A filler's rule by how often it is deleted."""
    return rates.select("filler", F.when(F.col("rate_bp") >= often, "always").when(F.col("rate_bp") >= sometimes, "review").otherwise("keep").alias("rule"))


def by_type(edits: DataFrame, examples: int = 3) -> DataFrame:
    """Count, time and the first examples of each type.  Examples are ranked, so no group is gathered."""
    k = F.row_number().over(Window.partitionBy("type").orderBy("rec_id", "w_from", "start_ms"))
    first = edits.select("type", "rec_id", "w_from", "start_ms").withColumn("k", k).filter(F.col("k") <= examples)
    named = first.groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(":", "rec_id", "w_from").alias("x")))), lambda s: s["x"]), ",").alias("examples"))
    return edits.groupBy("type").agg(F.count("*").alias("n_edits"), F.sum(F.col("end_ms") - F.col("start_ms")).cast("bigint").alias("total_ms")).join(named, "type")


def aggressiveness(cut: DataFrame, lengths: DataFrame) -> DataFrame:
    """P10: the share of a recording that is cut, and its class: below 15 % light, below 30 % medium."""
    c = cut.groupBy("rec_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("cut_ms"))
    j = lengths.join(c, "rec_id", "left").withColumn("cut_ms", F.coalesce("cut_ms", F.lit(0)).cast("bigint")).withColumn("share_bp", F.expr("cut_ms * 10000 div duration_ms"))
    return j.select("rec_id", "cut_ms", "share_bp", F.when(F.col("share_bp") < 1500, "light").when(F.col("share_bp") < 3000, "medium").otherwise("heavy").alias("style"))


def adjustments(feedback: DataFrame, by: str, id_col: str, least: int = 2) -> DataFrame:
    """Feedback by type with confidence min(.5 + .1 n, .95), in basis points, and three examples.

    Only the first three of a type and task are sorted; the counts are summed where the rows lie.
    """
    k = F.row_number().over(Window.partitionBy(by).orderBy(id_col))
    first = feedback.select(by, id_col).withColumn("k", k).filter("k <= 3").groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(id_col)).cast("array<string>"), ",").alias("examples"))
    n = feedback.groupBy(by).agg(F.count("*").alias("n"), ramp(F.count("*")).cast("bigint").alias("confidence_bp")).filter(F.col("n") >= least)
    return n.join(first, by)


def most_confident(adjusted: DataFrame, by: str) -> DataFrame:
    """Adjustments numbered by falling confidence, then count; there is one for each type, so they fit one task."""
    k = F.row_number().over(Window.orderBy(F.desc("confidence_bp"), F.desc("n"), by))
    return adjusted.withColumn("place", k.cast("bigint"))


def ladder(feedback: DataFrame, up: Column, down: Column, start: int = 1, top: int = 2, chunk: int = 10_000, bottom: int = 0) -> DataFrame:
    """Per key a level that rises and falls with feedback in order, held between ``bottom`` and ``top``.

    The threshold of silences is the same in steps of half a second: from 6 steps, between 3 and 12.

    Clamped steps compose: any run of them is x -> min(max(x + add, lo), hi).  So a key's feedback is
    folded in chunks of bounded size, and then the chunks: no key is gathered in one array.
    """
    moves = feedback.select("key", "at", F.when(up, 1).when(down, -1).otherwise(0).alias("move")).filter("move <> 0")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("at"))
    moves = moves.withColumn("k", rank).withColumn("chunk", F.expr(f"(k - 1) div {chunk}"))
    hold = lambda x: F.least(F.greatest(x, F.lit(bottom)), F.lit(top))
    step = lambda f, x: F.struct((f["add"] + x["move"]).alias("add"), hold(f["lo"] + x["move"]).alias("lo"), hold(f["hi"] + x["move"]).alias("hi"))
    same = F.struct(F.lit(0).alias("add"), F.lit(bottom).alias("lo"), F.lit(top).alias("hi"))
    parts = moves.groupBy("key", "chunk").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("k", "move"))), same, step).alias("f"), F.count("*").alias("n"))
    run = F.aggregate(F.array_sort(F.collect_list(F.struct("chunk", "f"))), F.lit(start), lambda x, c: F.least(F.greatest(x + c["f"]["add"], c["f"]["lo"]), c["f"]["hi"]))
    return parts.groupBy("key").agg(run.cast("bigint").alias("level"), F.sum("n").alias("n_moves"))


def severity_score(issues: DataFrame) -> DataFrame:
    """max(1, 10 - .8 high - .3 medium - .1 low), in tenths."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return issues.groupBy("key").agg(n("high").alias("high"), n("medium").alias("medium"), n("low").alias("low")).withColumn("score10", F.greatest(100 - 8 * F.col("high") - 3 * F.col("medium") - F.col("low"), F.lit(10)).cast("bigint"))


def score_class(score10: Column) -> Column:
    """D41."""
    return F.when(score10.isNull(), "").when(score10 >= 80, "good").when(score10 >= 60, "ok").otherwise("bad")


def merged_score(signal10: Column, listening10: Column) -> Column:
    """.4 signal and .6 listening, in hundredths; one alone counts fully."""
    return F.when(listening10.isNull(), signal10 * 10).when(signal10.isNull(), listening10 * 10).otherwise(signal10 * 4 + listening10 * 6)


def rank_of(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).otherwise(1)


def most_severe(issues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One issue per key, the most severe, of equal ones the first."""
    best = F.max_by(F.struct("issue_id", "severity"), F.struct(rank_of(F.col("severity")), (-F.col("issue_id"))))
    return issues.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.issue_id", "b.severity")


def fuse(layers: Sequence[DataFrame], bucket_ms: int = 100) -> DataFrame:
    """Issues ``(key, time_ms, layer, severity, issue_id)`` of all layers; of later layers those whose time, rounded to the bucket, no earlier layer has.

    ``place`` is the order of a key's list: by severity, then time.
    """
    out = layers[0]
    for more in layers[1:]:
        b = lambda df: df.withColumn("bucket", F.expr(f"(time_ms + {bucket_ms // 2}) div {bucket_ms}"))
        out = out.unionByName(b(more).join(b(out).select("key", "bucket").distinct(), ["key", "bucket"], "left_anti").drop("bucket"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(rank_of(F.col("severity"))), "time_ms", "layer", "issue_id"))
    return out.withColumn("place", place.cast("bigint"))


def silence_threshold(gaps: DataFrame, least: int = 500, head: int = 10) -> DataFrame:
    """A10: of the gaps ``(rec_id, gap_ms)`` after deleted sentences, those over ``least``: how many, the smallest in tenths of a second, and the ``head`` smallest."""
    long = gaps.filter(F.col("gap_ms") > least)
    k = F.row_number().over(Window.partitionBy("rec_id").orderBy("gap_ms"))
    first = long.select("rec_id", "gap_ms").withColumn("k", k).filter(F.col("k") <= head).groupBy("rec_id").agg(F.array_join(F.array_sort(F.collect_list("gap_ms")).cast("array<string>"), ",").alias("smallest"))
    n = long.groupBy("rec_id").agg(F.count("*").alias("n"), F.expr("(min(gap_ms) + 50) div 100").alias("threshold_ds"))
    return n.join(first, "rec_id")


def merge_gold(missed: DataFrame, restored: DataFrame) -> DataFrame:
    """U4: feedback files as one gold set, keyed by recording and sentence.

    ``missed(file, audio, sentence, speaker, text, type)`` and ``restored(file, audio, sentence,
    speaker, text)``; an expected edit counts once by text and type, a false positive once by text;
    the sentence's speaker is that of its first file, missed ones before restored.
    """
    at = ["audio", "sentence"]
    expected = missed.select(*at, "text", "type").dropDuplicates().groupBy(*at).agg(F.count("*").alias("n_expected"))
    wrong = restored.select(*at, "text").dropDuplicates().groupBy(*at).agg(F.count("*").alias("n_false"))
    named = missed.select(*at, "file", "speaker", F.lit(0).alias("kind")).unionByName(restored.select(*at, "file", "speaker", F.lit(1).alias("kind")))
    first = named.groupBy(*at).agg(F.min(F.struct("file", "kind", "speaker")).alias("f")).select(*at, F.col("f.speaker").alias("speaker"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return first.join(expected, at, "left").join(wrong, at, "left").select(*at, "speaker", zero("n_expected"), zero("n_false"))


def common_length(a: str, b: str) -> int:
    """Length of the longest common substring of texts of any length: one row of the table of common suffixes at a time."""
    x, y = (np.frombuffer(t.encode("utf-32-le"), "<u4") for t in (a, b))
    if len(x) > len(y):
        x, y = y, x
    row, best = np.zeros(len(y) + 1, np.int64), 0
    for c in x:
        row[1:] = np.where(y == c, row[:-1] + 1, 0)
        best = max(best, int(row.max()))
    return best


def with_common(pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``pairs`` and ``out``, the common_length of its texts ``a`` and ``b`` (null if one is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True)
            n = [None if x is None or y is None else common_length(x, y) for x, y in both]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, out])

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField(out, T.LongType())]))


def match_ladder(a: str, b: str, common: Column) -> Column:
    """T4: exact, trimmed, contained, or half in common (``common``: T1); else none."""
    t = lambda x: f"regexp_replace(regexp_replace({x}, '^[[:punct:][:space:]]+', ''), '[[:punct:][:space:]]+$', '')".replace("[:punct:]", "\\\\p{Punct}").replace("[:space:]", "\\\\s")
    half = 2 * common >= F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))
    return F.when(F.col(a) == F.col(b), "exact").when(F.expr(f"{t(a)} = {t(b)}"), "trimmed").when(F.contains(a, F.col(b)) | F.contains(b, F.col(a)), "contained").when(half, "common").otherwise("none")
