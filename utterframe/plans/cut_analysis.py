"""The rule layer as one lazy plan: words to accepted edits, in the order in which rules see each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterframe.operators import detect, resolve, sequence
from utterframe.params import PARAMS, Params


def candidates(words: DataFrame, p: Params = PARAMS) -> DataFrame:
    """What every rule proposes, with ``rule_priority``: the place of the rule in the order in which rules see each other."""
    sents = sequence.sentences(words)
    pauses = sequence.silence_edits(sequence.gaps(words, p.gap_min), sents, p)
    none = F.lit(None).cast("bigint")
    silence = pauses.select("rec_id", "sent_idx", F.lit("silence").alias("type"), none.alias("w_from"), none.alias("w_to"), F.col("gap_start").alias("start_ms"), F.col("gap_end").alias("end_ms"), F.lit(False).alias("needs_review"), F.lit(1.0).alias("confidence"))
    rules = [
        detect.leading_filler(words, p),
        silence,
        detect.stutter(words, p),
        detect.suffix_stutter(words, p, skip_ascii=False),
        detect.mid_filler(words, p),
        detect.phrase_repeat(words, p),
        detect.consecutive_filler(words, p),
        detect.restart_marker(words, p),
    ]
    out = None
    for k, rule in enumerate(rules):
        rule = rule.withColumn("rule_priority", F.lit(k))
        out = rule if out is None else out.unionByName(rule)
    return out


def accept(proposed: DataFrame, p: Params = PARAMS) -> DataFrame:
    """D0, D1 and D2 stand; D3, D5 and D6 where nothing accepted before overlaps (a pause is no obstacle); D4 and D7 where nothing accepted begins close by.

    One shuffle on the sentence and one fold over its candidates, instead of a chain of anti-joins
    that would plan every rule again and again.
    """
    cols = [c for c in detect.EDIT if c not in detect.SENT]
    cand = F.array_sort(F.collect_list(F.struct("rule_priority", "start_ms", *[c for c in cols if c != "start_ms"])))

    def step(acc, x):
        before = lambda y: y["rule_priority"] < x["rule_priority"]
        overlap = F.exists(acc, lambda y: before(y) & (y["type"] != "silence") & (x["start_ms"] < y["end_ms"]) & (x["end_ms"] > y["start_ms"]))
        near = F.exists(acc, lambda y: before(y) & (F.abs(x["start_ms"] - y["start_ms"]) < p.near))
        ok = F.when(x["rule_priority"].isin(3, 5, 6), ~overlap).when(x["rule_priority"].isin(4, 7), ~near).otherwise(True)
        return F.when(ok, F.concat(acc, F.array(x))).otherwise(acc)

    g = proposed.groupBy(*detect.SENT).agg(cand.alias("c"))
    kept = g.select(*detect.SENT, F.explode(F.aggregate("c", F.expr("slice(c, 1, 0)"), step)).alias("k"))
    return kept.select(*detect.SENT, *[F.col(f"k.{c}").alias(c) for c in cols]).select(*detect.EDIT)


def rule_edits(words: DataFrame, p: Params = PARAMS) -> DataFrame:
    """All rules, accepted in order, with boundaries drawn to close neighbours."""
    return resolve.extend_boundaries(accept(candidates(words, p), p), words, p)
