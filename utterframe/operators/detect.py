"""Detectors: each a function of words (or sentences) and parameters to candidate edits.

Edits have ``rec_id, sent_idx, type, w_from, w_to, start_ms, end_ms, needs_review, confidence``.
Which candidates stand beside others is decided by ``utterframe.operators.resolve``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterframe.operators.sequence import equal_runs, islands, order
from utterframe.params import PARAMS, Params

SENT = ("rec_id", "sent_idx")
EDIT = ["rec_id", "sent_idx", "type", "w_from", "w_to", "start_ms", "end_ms", "needs_review", "confidence"]


def edit(df: DataFrame, kind: str, review: Column | bool, confidence: Column | float) -> DataFrame:
    lift = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.withColumn("type", F.lit(kind)).withColumn("needs_review", lift(review)).withColumn("confidence", lift(confidence).cast("double")).select(*EDIT)


def placed(words: DataFrame) -> DataFrame:
    """Words with their place ``i`` in the sentence and its length ``n``."""
    w = order("word_idx", keys=SENT)
    return words.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def sentence_words(words: DataFrame) -> DataFrame:
    """A sentence as one row: its words in order, as an array of structs."""
    return words.groupBy(*SENT).agg(F.array_sort(F.collect_list(F.struct("word_idx", "tok", "start_ms", "end_ms"))).alias("ws")).withColumn("n", F.size("ws"))


def leading_filler(words: DataFrame, p: Params = PARAMS) -> DataFrame:
    """A filler of three, two or one tokens that begins a sentence with content after it."""
    s = sentence_words(words).filter("n >= 2").withColumn("toks", F.transform("ws", lambda w: w["tok"]))
    head = lambda k: F.array_join(F.slice("toks", 1, k), "")
    k = (
        F.when(head(3).isin(*p.fillers3) & (F.col("n") > 3), 3)
        .when(head(2).isin(*p.fillers2) & (F.col("n") > 2), 2)
        .when(head(1).isin(*p.fillers), 1)
        .when(head(1).isin(*p.ambiguous), 1)
    )
    s = s.withColumn("k", k).filter("k is not null")
    rest = F.length(F.array_join(F.expr("slice(toks, k + 1, n - k)"), ""))
    s = s.filter(rest >= 2)
    doubt = (F.col("k") == 1) & ~head(1).isin(*p.fillers)
    s = s.select(*SENT, F.expr("ws[0].word_idx").alias("w_from"), F.expr("ws[k - 1].word_idx").alias("w_to"), F.expr("ws[0].start_ms").alias("start_ms"), F.expr("ws[k - 1].end_ms").alias("end_ms"), doubt.alias("doubt"))
    return edit(s, "filler_start", F.col("doubt"), F.when(F.col("doubt"), 0.8).otherwise(0.95))


def stutter(words: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Repeats of a token, an edit for each but the last; listed reduplications, numbers and a doubled character inside a sentence are exempt."""
    first = words.groupBy(*SENT).agg(F.min("word_idx").alias("first_word"))
    runs = equal_runs(words).join(first, list(SENT))
    runs = runs.filter(~F.concat("tok", "tok").isin(*p.reduplicated) & ~F.col("tok").rlike(r"^\p{N}+$"))
    runs = runs.filter(~((F.col("run_len") == 2) & (F.length("tok") == 1) & (F.col("w_from") > F.col("first_word"))))
    doubt = (F.col("run_len") == 2) & F.col("tok").isin(*p.high_frequency)
    each = runs.select(*SENT, F.explode(F.sequence("w_from", F.col("w_to") - 1)).alias("word_idx"), doubt.alias("doubt"))
    each = each.join(words.select("rec_id", "word_idx", "start_ms", "end_ms"), ["rec_id", "word_idx"])
    each = each.withColumn("w_from", F.col("word_idx")).withColumn("w_to", F.col("word_idx"))
    return edit(each, "stutter", F.col("doubt"), F.when(F.col("doubt"), 0.7).otherwise(0.9))


def suffix_stutter(words: DataFrame, p: Params = PARAMS, skip_ascii: bool = True) -> DataFrame:
    """D3: a token that the one before it ends with."""
    w = order("word_idx", keys=SENT)
    t = words.withColumn("before", F.lag("tok").over(w))
    t = t.filter((F.length("tok") >= 2) & (F.length("before") > F.length("tok")) & F.endswith("before", "tok"))
    if skip_ascii:
        t = t.filter(~F.col("tok").rlike("^[a-z]+$") & ~F.col("before").rlike("^[a-z]+$"))
    return edit(t.withColumn("w_from", F.col("word_idx")).withColumn("w_to", F.col("word_idx")), "suffix_stutter", True, 0.8)


def mid_filler(words: DataFrame, p: Params = PARAMS) -> DataFrame:
    """A short filler inside a sentence; the special one only in sentences of more than three words."""
    t = placed(words).filter(F.col("tok").isin(*p.mid_fillers) & (F.col("i") > 0) & (F.col("i") < F.col("n") - 1) & (F.col("end_ms") - F.col("start_ms") <= p.filler_longest))
    special = F.col("tok") == p.mid_special
    t = t.filter(~special | (F.col("n") > 3)).withColumn("w_from", F.col("word_idx")).withColumn("w_to", F.col("word_idx"))
    return edit(t, "filler_mid", special, F.when(special, 0.7).otherwise(0.9))


def consecutive_filler(words: DataFrame, p: Params = PARAMS) -> DataFrame:
    """A stretch of fillers from the first place where two neighbours differ."""
    lists = [*p.fillers, *p.ambiguous, *p.mid_fillers]
    w = order("word_idx", keys=SENT)
    t = words.withColumn("f", F.col("tok").isin(*lists))
    t = islands(t, F.lag("f").over(w) != F.col("f"), ["word_idx"], "run", keys=SENT).filter("f")
    t = t.withColumn("next_tok", F.lead("tok").over(order("word_idx", keys=(*SENT, "run"))))
    from_ = F.min(F.when(F.col("next_tok") != F.col("tok"), F.struct("word_idx", "start_ms")))
    runs = t.groupBy(*SENT, "run").agg(from_.alias("from"), F.max("word_idx").alias("w_to"), F.max("end_ms").alias("end_ms")).filter("from is not null")
    return edit(runs.select(*SENT, F.col("from.word_idx").alias("w_from"), "w_to", F.col("from.start_ms").alias("start_ms"), "end_ms"), "consecutive_filler", False, 0.95)


def filler_run(words: DataFrame, p: Params = PARAMS, least: int = 3) -> DataFrame:
    """A sentence's leading run of fillers and confirmations, ``least`` or more."""
    lists = [*p.fillers, *p.ambiguous, *p.mid_fillers, *p.confirmations]
    lead = F.min(F.col("tok").isin(*lists).cast("int")).over(order("word_idx", keys=SENT).rowsBetween(Window.unboundedPreceding, 0))
    runs = words.withColumn("lead", lead).filter("lead = 1").groupBy(*SENT).agg(F.min("word_idx").alias("w_from"), F.max("word_idx").alias("w_to"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("c"))
    return edit(runs.filter(F.col("c") >= least), "filler_run", False, 0.95)


def repeated_adjacent(sents: DataFrame, prefix: int = 5) -> DataFrame:
    """Neighbours that begin alike; the shorter goes, of equal ones the first."""
    w = order("sent_idx")
    s = sents.withColumn("next_text", F.lead("text").over(w)).withColumn("next_idx", F.lead("sent_idx").over(w))
    s = s.filter((F.length("text") >= prefix) & (F.substring("text", 1, prefix) == F.substring("next_text", 1, prefix)))
    return s.select("rec_id", "sent_idx", "next_idx", F.when(F.length("text") <= F.length("next_text"), F.col("sent_idx")).otherwise(F.col("next_idx")).alias("delete_idx"))


def repeated_across(sents: DataFrame, prefix: int = 5, middle: int = 5) -> DataFrame:
    """A sentence that begins again after a short one between; both go."""
    w = order("sent_idx")
    s = sents.withColumn("mid", F.lead("text", 1).over(w)).withColumn("again", F.lead("text", 2).over(w))
    s = s.filter((F.length("text") >= prefix) & (F.substring("text", 1, prefix) == F.substring("again", 1, prefix)) & (F.length("mid") <= middle))
    return s.select("rec_id", "sent_idx", (F.col("sent_idx") + 1).alias("mid_idx"), (F.col("sent_idx") + 2).alias("again_idx"))


def word_repeat_gap(words: DataFrame, most: int = 3) -> DataFrame:
    """A word, one to ``most`` others, and the word again; the nearest return counts."""
    w = order("word_idx", keys=SENT)
    d = F.coalesce(*[F.when(F.lead("tok", k).over(w) == F.col("tok"), k) for k in range(2, most + 2)])
    t = words.withColumn("next_tok", F.lead("tok").over(w)).withColumn("d", d).filter("d is not null and next_tok <> tok")
    return t.select(*SENT, "tok", F.col("word_idx").alias("w_from"), (F.col("word_idx") + F.col("d") - 1).alias("w_to"), F.col("d").cast("bigint").alias("distance"))


def phrase_repeat(words: DataFrame, p: Params = PARAMS, longest: int = 20, shortest: int = 3) -> DataFrame:
    """The longest phrase (by characters, then leftmost) that comes again within twice its length.

    The second occurrence is looked for in the next 3 L characters only, so the work for a sentence
    is linear in its length.
    """
    w = order("word_idx", keys=SENT)
    chars = words.withColumn("c1", F.sum(F.length("tok")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("c0", F.col("c1") - F.length("tok"))
    s = sentence_words(words).select(*SENT, "n", F.array_join(F.transform("ws", lambda x: x["tok"]), "").alias("text")).filter(F.length("text") >= 8)
    s = s.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("text") - 2 * shortest)))
    # a phrase comes again only where its first characters do: few places are left to try all lengths at
    s = s.filter(F.expr(f"instr(substr(text, at + 1 + {shortest}, {3 * longest}), substr(text, at + 1, {shortest})) > 0"))
    s = s.withColumn("len", F.explode(F.sequence(F.lit(shortest), F.least(F.expr("length(text) div 2").cast("int"), F.lit(longest))))).filter("at <= length(text) - 2 * len")
    s = s.withColumn("phrase", F.expr("substr(text, at + 1, len)")).withColumn("gap", F.expr("instr(substr(text, at + len + 1, 3 * len), phrase) - 1"))
    alike = F.expr("phrase = repeat(left(phrase, 1), len)")
    conj = F.lit(False)
    for c in p.conjunctions:
        conj = conj | F.startswith("phrase", F.lit(c))
    s = s.filter((F.col("gap") >= 0) & ~((F.col("len") <= 3) & (F.col("gap") == 0)) & ~alike & ~conj)
    best = s.groupBy(*SENT, "n").agg(F.max(F.struct("len", (-F.col("at")).alias("neg"), "gap", "phrase")).alias("b"))
    best = best.select(*SENT, "n", F.col("b.phrase").alias("phrase"), F.col("b.len").alias("len"), (-F.col("b.neg")).alias("at"), F.col("b.gap").alias("gap"))
    j = best.join(chars, list(SENT)).filter("c1 > at and c0 <= at + len + gap - 1")
    g = j.groupBy(*SENT, "n", "phrase", "len", "gap").agg(F.min("word_idx").alias("w_from"), F.max("word_idx").alias("w_to"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum(F.length("tok")).alias("cut"))
    g = g.filter("w_to - w_from + 1 < n and cut <= len + gap + 4")
    sure = (F.col("len") >= 5) & (F.col("gap") <= 3)
    return edit(g, "in_sentence_repeat", ~sure, F.when(sure, 0.9).when(F.col("len") <= 4, 0.5).otherwise(0.7))


def restart_marker(words: DataFrame, p: Params = PARAMS, alike: float = 0.6) -> DataFrame:
    """A marker with similar words on both sides (character membership, up to five words each); the first in a sentence."""
    s = sentence_words(words).filter("n >= 4").withColumn("toks", F.transform("ws", lambda x: x["tok"]))
    s = s.withColumn("m", F.explode(F.sequence(F.lit(1), F.col("n") - 2)))
    one, two = F.expr("toks[m]"), F.expr("toks[m] || coalesce(try_element_at(toks, m + 2), '')")
    k = F.when(two.isin(*p.markers2) & (F.col("m") + 1 < F.col("n") - 1), 2).when(one.isin(*p.markers), 1)
    s = s.withColumn("k", k).filter("k is not null and m + k < n")
    s = s.withColumn("c", F.expr("least(m, n - m - k, 5)"))
    s = s.withColumn("before", F.expr("array_join(slice(toks, m - c + 1, c), '')")).withColumn("after", F.expr("array_join(slice(toks, m + k + 1, c), '')"))
    share = F.expr("size(filter(split(before, ''), x -> contains(after, x))) / length(before)")
    s = s.filter(share >= alike)
    first = s.groupBy(*SENT).agg(F.min(F.struct("m", "k", "ws")).alias("b"))
    first = first.select(*SENT, F.expr("b.ws[0].word_idx").alias("w_from"), F.expr("b.ws[b.m + b.k - 1].word_idx").alias("w_to"), F.expr("b.ws[0].start_ms").alias("start_ms"), F.expr("b.ws[b.m + b.k - 1].end_ms").alias("end_ms"))
    return edit(first, "self_correction", True, 0.7)


def prefix_expansion(words: DataFrame, p: Params = PARAMS, longest: int = 5, within: int = 8, chars: int = 3) -> DataFrame:
    """Two to five words said again within the next eight, with more after; the first saying goes.

    At each place the longest repeat, then the nearest, decides.  It is a parallel structure, and no
    edit, if both sayings go on differently (hesitations apart) after a gap without hesitation, after a
    gap of more than one word with substance, or where the words stand three times in the sentence.  A
    repeat that goes on word for word is passed over.  Places inside a cut do not begin another.
    """
    s = sentence_words(words).filter("n >= 4").withColumn("toks", F.transform("ws", lambda x: x["tok"]))
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 4))).withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(longest))))
    s = s.filter("i + 2 * k < n").withColumn("j", F.explode(F.expr(f"sequence(i + k, greatest(i + k, least(i + {within}, n - k - 1)))")))
    s = s.filter("j + k < n and slice(toks, i + 1, k) = slice(toks, j + 1, k)").withColumn("prefix", F.expr("array_join(slice(toks, i + 1, k), '')"))
    hes = "array(" + ", ".join(f"'{h}'" for h in p.hesitations) + ")"
    s = s.filter(F.length("prefix") >= chars).withColumn("between", F.expr("slice(toks, i + k + 1, j - i - k)"))
    s = s.filter("not (j > i + k + 1 and j + k + 1 < n and toks[i + k] = toks[j + k] and toks[i + k + 1] = toks[j + k + 1])")
    s = s.withColumn("goes_on", F.expr(f"try_element_at(filter(between, x -> not array_contains({hes}, x)), 1)")).withColumn("goes_on2", F.expr(f"try_element_at(filter(slice(toks, j + k + 1, n - j - k), x -> not array_contains({hes}, x)), 1)"))
    times = F.expr("size(filter(sequence(0, n - k), q -> slice(toks, q + 1, k) = slice(toks, i + 1, k)))")
    hesitates = F.expr(f"arrays_overlap(between, {hes})")
    parallel = F.expr("coalesce(goes_on <> goes_on2, false)") & (~hesitates | (F.expr("j - i - k > 1")) | (times >= 3))
    s = s.withColumn("parallel", parallel)
    best = s.groupBy(*SENT, "i").agg(F.max(F.struct("k", (-F.col("j")).alias("neg"), "prefix", "parallel", "ws")).alias("b")).filter("not b.parallel")
    best = best.select(*SENT, "i", (-F.col("b.neg")).alias("j"), F.expr("b.ws[i].word_idx").alias("w_from"), F.expr("b.ws[-b.neg - 1].word_idx").alias("w_to"), F.expr("b.ws[i].start_ms").alias("start_ms"), F.expr("b.ws[-b.neg - 1].end_ms").alias("end_ms"), F.length("b.prefix").alias("size"))
    cols = ["i", "j", "w_from", "w_to", "start_ms", "end_ms", "size"]
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["j"], F.lit(0))
    kept = F.aggregate("c", F.expr("slice(c, 1, 0)"), lambda acc, x: F.when(x["i"] >= last(acc), F.concat(acc, F.array(x))).otherwise(acc))
    g = best.groupBy(*SENT).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("c")).select(*SENT, F.explode(kept).alias("e")).select(*SENT, "e.*")
    return edit(g, "same_prefix", True, F.when(F.col("size") >= 4, 0.9).otherwise(0.7))


def residual_filler(words: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Sentences that are a filler and nothing else."""
    t = placed(words).filter((F.col("n") == 1) & F.col("tok").isin(*p.fillers, *p.ambiguous, *p.mid_fillers))
    return t.select(*SENT, "word_idx", "tok", "start_ms")


def residual_stutter(words: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Equal neighbours with less than ``stutter_gap`` between, whatever the sentence."""
    w = order("word_idx")
    t = words.withColumn("gap_ms", F.col("start_ms") - F.lag("end_ms").over(w)).withColumn("before", F.lag("tok").over(w)).filter((F.col("before") == F.col("tok")) & (F.col("gap_ms") < p.stutter_gap))
    return t.select("rec_id", "word_idx", "tok", "start_ms", "gap_ms")
