"""What an edited sample says about its editor's style: classes of deletions, rates, and rules to recommend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterframe.functions.formats import has_repeat
from utterframe.operators.evaluate import occurrences, silence_threshold

#: Shares, in percent, from which a filler counts as deleted or as kept, and of deleted sentences by style.
HIGH, LOW, LIGHT, MEDIUM = 60, 30, 15, 30


def marked(before: DataFrame, deleted: DataFrame) -> DataFrame:
    """``before(rec_id, sent_idx, text, start_ms, end_ms)`` with ``deleted``, the gap after it, and how many of the three sentences on either side went."""
    flag = deleted.select("rec_id", "sent_idx").distinct().withColumn("deleted", F.lit(True))
    w = Window.partitionBy("rec_id").orderBy("sent_idx")
    b = before.join(flag, ["rec_id", "sent_idx"], "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    gone = F.col("deleted").cast("bigint")
    return b.withColumn("gap_after", F.lead("start_ms").over(w) - F.col("end_ms")).withColumn("n_near", F.sum(gone).over(w.rangeBetween(-3, 3)) - gone)


def deletion_class(fillers: Sequence[str]) -> Column:
    """The first of these that holds: a filler alone, something said twice, under five characters, part of a block, before a long silence."""
    return (
        F.when(F.col("text").isin(*fillers), "filler_word")
        .when(has_repeat(F.regexp_replace("text", " ", "")), "stutter")
        .when(F.length("text") < 5, "residual")
        .when(F.col("n_near") >= 2, "content_block")
        .when(F.col("gap_after") > 2000, "silence_related")
        .otherwise("other")
    )


def classes(sample: DataFrame, fillers: Sequence[str]) -> DataFrame:
    """Deletions of a ``marked`` sample by class: how many, and their time."""
    d = sample.filter("deleted").withColumn("type", deletion_class(fillers))
    return d.groupBy("rec_id", "type").agg(F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))


def recommendations(sample: DataFrame, fillers: Sequence[str]) -> DataFrame:
    """Rules ``(rec_id, rule, action, value, confidence_bp)`` that a ``marked`` sample recommends."""
    each = sample.select("rec_id", "deleted", "text", F.explode(F.array(*map(F.lit, fillers))).alias("filler")).withColumn("n", occurrences("text", "filler"))
    rates = each.groupBy("rec_id", "filler").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("deleted"), F.col("n")).otherwise(0)).alias("gone")).filter("total > 0").withColumn("pct", F.expr("(gone * 200 + total) div (2 * total)"))
    words = lambda keep: F.array_join(F.array_sort(F.collect_list(F.when(keep, F.col("filler")))), ",")
    by = rates.groupBy("rec_id").agg(words(F.col("pct") > HIGH).alias("high"), words(F.col("pct") < LOW).alias("low"))
    row = lambda df, rule, action, value, sure: df.select("rec_id", F.lit(rule).alias("rule"), F.lit(action).alias("action"), value.cast("string").alias("value"), F.lit(sure).cast("bigint").alias("confidence_bp"))
    gaps = silence_threshold(sample.filter("deleted").select("rec_id", F.col("gap_after").alias("gap_ms")))
    share = sample.groupBy("rec_id").agg((F.sum(F.col("deleted").cast("bigint")) * 100).alias("d"), F.count("*").alias("n"))
    style = F.when(F.col("d") < LIGHT * F.col("n"), "conservative").when(F.col("d") < MEDIUM * F.col("n"), "moderate").otherwise("aggressive")
    return (
        row(by.filter("high <> ''"), "filler_words", "set_high_deletion", F.col("high"), 8500)
        .unionByName(row(by.filter("low <> ''"), "filler_words", "preserve", F.col("low"), 8000))
        .unionByName(row(gaps, "silence", "set_threshold", F.col("threshold_ds"), 7500))
        .unionByName(row(share, "aggressiveness", "set", style, 9000))
    )


def learn(before: DataFrame, aligned: DataFrame, fillers: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The whole way from an alignment ``(rec_id, sent_idx, state)`` (``align.align_sentences``) to classes and recommendations."""
    sample = marked(before, aligned.filter("state = 'deleted'"))
    return classes(sample, fillers), recommendations(sample, fillers)
