"""Review and reporting: routing, roll-ups, gains, contracts and look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterframe.operators.intervals import last_before
from utterframe.operators.sequence import order

#: Issue types that stand in recordings of conversation.
CONVERSATION_TYPES = ("spectral_jump", "unnatural_silence")


def conversation_mode(issues: DataFrame, types: Sequence[str] = CONVERSATION_TYPES) -> DataFrame:
    """P11."""
    return issues.filter(F.col("type").isin(*types))


def unnatural_silences(pauses: DataFrame, cuts: DataFrame, short: int = 100, long: int = 2000, window: int = 2000) -> DataFrame:
    """Cuts ``(rec_id, seg_id, at_ms)`` inside a pause ``(rec_id, start_ms, end_ms)`` that is shorter than ``short`` or longer than ``long``.

    The pause has to end, on both sides, less than ``window`` from the cut.
    """
    j = last_before(cuts, F.col("at_ms"), pauses, ["seg_id", "at_ms"]).withColumn("silence_ms", F.col("r_end") - F.col("r_start"))
    holds = (F.col("r_end") >= F.col("at_ms")) & (F.col("r_start") > F.col("at_ms") - window) & (F.col("r_end") < F.col("at_ms") + window)
    return j.filter(holds & ((F.col("silence_ms") < short) | (F.col("silence_ms") > long))).select("rec_id", "seg_id", "at_ms", "silence_ms", F.lit("medium").alias("severity"))


def rollup_states(issues: DataFrame, states: DataFrame) -> DataFrame:
    """By severity, how many issues are ok, flagged and pending (those without a state)."""
    j = issues.select("issue_id", "severity").join(states.select("issue_id", "status"), "issue_id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    return j.groupBy("severity").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "flagged", "pending")])


def shown(issues: DataFrame, states: DataFrame, severity: str | None = None, layer: str | None = None, unconfirmed: bool = False) -> DataFrame:
    """The issues ``(issue_id, severity, layer, ..)`` that a filter leaves: of a severity, of a layer or its judge (``layer_ai``), or without a state that is not pending."""
    rows = issues
    if severity:
        rows = rows.filter(F.col("severity") == severity)
    if layer:
        rows = rows.filter(F.col("layer").isin(layer, f"{layer}_ai"))
    if unconfirmed:
        rows = rows.join(states.filter("status <> 'pending'").select("issue_id"), "issue_id", "left_anti").select(*issues.columns)
    return rows


def route(kind: Column, methods: Sequence[str], preferences: Sequence[str]) -> Column:
    """What an issue changes: the method, the user's preferences, or neither."""
    return F.when(kind.isin(*methods), "methodology").when(kind.isin(*preferences), "preference").otherwise("none")


def listening_score(evals: DataFrame) -> DataFrame:
    """Per key the mean of what was scored, less half a point per confirmed issue, at least 1, 5 if nothing was scored; in hundredths."""
    e = evals.groupBy("key").agg(F.sum("score").alias("s"), F.count("score").alias("n"), F.count_if("confirmed").alias("c"))
    return e.select("key", F.greatest(F.coalesce(F.expr("s * 100 div n"), F.lit(500)) - 50 * F.col("c"), F.lit(100)).cast("bigint").alias("score100"))


def spaced_sample(segments: DataFrame, keys: Sequence[str], n: int = 30) -> DataFrame:
    """At most n evenly spaced rows of each key, by rank (a sampling operator): of c rows those numbered ``floor(k c / n)``."""
    w = Window.partitionBy(*keys).orderBy("seg_id")
    s = segments.withColumn("i", F.row_number().over(w) - 1).withColumn("c", F.count("*").over(Window.partitionBy(*keys)))
    return s.filter(F.expr(f"c <= {n} or (i + 1) * {n} > c * ((i * {n} + c - 1) div c)")).drop("i", "c")


def loudness(sampled: DataFrame, keys: Sequence[str], least_ms: int = 300) -> DataFrame:
    """Mean level of each key over its sampled segments ``(.., level, dur_ms)`` that are long enough to measure, weighted by their length."""
    long = sampled.filter(F.col("dur_ms") >= least_ms)
    return long.groupBy(*keys).agg(F.expr("sum(level * dur_ms) div sum(dur_ms)").cast("bigint").alias("level"), F.count("*").alias("n_segments"))


def gains(levels: DataFrame, most: int = 60, least: int = 5) -> DataFrame:
    """Tenths of a decibel that bring each speaker ``(key, speaker, level)`` up to the loudest, at most ``most``, none under ``least``."""
    up = F.least(F.max("level").over(Window.partitionBy("key")) - F.col("level"), F.lit(most))
    return levels.select("key", "speaker", F.when(up < least, 0).otherwise(up).cast("bigint").alias("gain"))


def pass_rate(cuts: Column, issues: Column) -> Column:
    """A21, in basis points."""
    return F.floor((cuts - issues) * 10000 / F.greatest(cuts, F.lit(1)))


def duration_gap(total: Column, target: Column, certain: Column) -> Column:
    """What is still to cut for a target length."""
    return F.greatest(total - target, F.lit(0)) - certain


def last_edit(edits: DataFrame) -> DataFrame:
    """Of a sentence's edits the last one wins."""
    return edits.groupBy("rec_id", "sent_idx").agg(F.max_by(F.struct("edit_id", "type"), "edit_id").alias("e")).select("rec_id", "sent_idx", "e.edit_id", "e.type")


def complete(prefs: DataFrame, needed: Sequence[str]) -> DataFrame:
    """Whether a user has a value for each needed key."""
    return prefs.filter(F.col("key").isin(*needed) & F.col("value").isNotNull()).groupBy("user_id").agg(F.countDistinct("key").alias("n")).select("user_id", (F.col("n") == len(needed)).alias("complete"))


def contract(judged: DataFrame, sents: DataFrame) -> DataFrame:
    """``judged(rec_id, sent_idx, span)`` against its sentence: whether the span stands there, and what is left without its first occurrence."""
    j = judged.join(sents.select("rec_id", "sent_idx", "text"), ["rec_id", "sent_idx"], "left")
    at = F.expr("instr(text, span)")
    ok = F.coalesce((at > 0) & (F.col("span") != ""), F.lit(False))
    return j.select("rec_id", "sent_idx", "span", ok.alias("valid"), F.when(ok, F.expr("concat(left(text, instr(text, span) - 1), substr(text, instr(text, span) + length(span)))")).alias("after_text"))


def top_spaced(issues: DataFrame, k: int = 10, gap: int = 5000) -> DataFrame:
    """Per key the k issues ``(key, at, metric)`` of largest metric that lie at least ``gap`` from all taken before.

    A pick bars issues of three stretches of ``gap`` at most, its own and the two beside it.  Before
    the k-th pick fewer than 4 k stretches can so have lost their largest issue, and every pick lies in
    one of the 4 k stretches with the largest.  Only their issues are folded, not a key's whole list.
    """
    by = [F.desc("metric"), F.col("at")]
    s = issues.withColumn("stretch", F.floor(F.col("at") / gap))
    head = s.withColumn("n", F.row_number().over(Window.partitionBy("key", "stretch").orderBy(*by)))
    first = head.filter("n = 1").withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(*by))).filter(F.col("r") <= 4 * k).select("key", "stretch")
    srt = F.array_sort(F.collect_list(F.struct((-F.col("metric")).alias("m"), F.col("at"))))

    def step(acc, x):
        far = F.forall(acc, lambda y: F.abs(y["at"] - x["at"]) >= gap)
        return F.when((F.size(acc) < k) & far, F.concat(acc, F.array(x))).otherwise(acc)

    g = issues.withColumn("stretch", F.floor(F.col("at") / gap)).join(first, ["key", "stretch"], "left_semi").groupBy("key").agg(srt.alias("xs"))
    return g.select("key", F.explode(F.aggregate("xs", F.expr("slice(xs, 1, 0)"), step)).alias("x")).select("key", F.col("x.at").alias("at_ms"), (-F.col("x.m")).alias("metric"))


def sentence_join(sents: DataFrame, words: DataFrame) -> DataFrame:
    """Words of each sentence by an equi-join on the sentence's number, which words carry from the fold on."""
    return sents.select("rec_id", "sent_idx", "w_start", "w_end").join(words.select("rec_id", "sent_idx", "word_idx", "tok"), ["rec_id", "sent_idx"])


def pauses_between(words: DataFrame) -> DataFrame:
    """All pauses, natural ones too."""
    w = order("word_idx")
    return words.select("rec_id", "sent_idx", F.lag("end_ms").over(w).alias("gap_start"), (F.col("start_ms") - F.lag("end_ms").over(w)).alias("gap_ms")).filter("gap_ms is not null")
