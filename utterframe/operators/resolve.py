"""Which edits stand, and where exactly they cut: acceptance, greedy resolution, boundaries and text spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utterframe.operators.detect import SENT

from utterframe.operators.sequence import order
from utterframe.params import PARAMS, Params


def without_overlap(candidates: DataFrame, accepted: DataFrame) -> DataFrame:
    """Candidates that overlap no accepted edit of their sentence (a pause is no obstacle).  Equi-join on the sentence, so groups are small."""
    a = accepted.filter("type <> 'silence'").select(*[F.col(c).alias(f"a_{c}") for c in (*SENT, "start_ms", "end_ms")])
    same = [F.col(c) == F.col(f"a_{c}") for c in SENT]
    return candidates.join(a, [*same, F.col("start_ms") < F.col("a_end_ms"), F.col("end_ms") > F.col("a_start_ms")], "left_anti")


def without_near(candidates: DataFrame, accepted: DataFrame, near: int = PARAMS.near) -> DataFrame:
    """Candidates that begin at least ``near`` ms from every accepted edit of their sentence."""
    a = accepted.select(*[F.col(c).alias(f"a_{c}") for c in (*SENT, "start_ms")])
    same = [F.col(c) == F.col(f"a_{c}") for c in SENT]
    return candidates.join(a, [*same, F.abs(F.col("start_ms") - F.col("a_start_ms")) < near], "left_anti")


def greedy_larger(edits: DataFrame) -> DataFrame:
    """By start, an edit that overlaps accepted ones of its sentence replaces the first of them if it is longer, else it goes.

    Replacing does not look at the others again, so the outcome depends on the order: a fold over the
    sentence's sorted edits, in one Catalyst expression.
    """
    e = F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "edit_id"))), lambda x: F.struct(x["start_ms"].alias("a"), x["end_ms"].alias("b"), x["edit_id"].alias("id")))

    def step(acc, x):
        hits = F.filter(acc, lambda y: (F.greatest(y["a"], x["a"]) < F.least(y["b"], x["b"])))
        first = F.element_at(hits, 1)
        swapped = F.transform(acc, lambda y: F.when((y["id"] == first["id"]), x).otherwise(y))
        return F.when(F.size(hits) == 0, F.concat(acc, F.array(x))).when(x["b"] - x["a"] > first["b"] - first["a"], swapped).otherwise(acc)

    g = edits.groupBy(*SENT).agg(e.alias("es"))
    empty = F.expr("slice(es, 1, 0)")
    return g.select(*SENT, F.explode(F.aggregate("es", empty, step)).alias("k")).select(*SENT, F.col("k.id").alias("edit_id"), F.col("k.a").alias("start_ms"), F.col("k.b").alias("end_ms"))


def apply_reviews(edits: DataFrame, reviews: DataFrame) -> DataFrame:
    """``reviews(rec_id, sent_idx, action)``: reject drops all doubtful edits of the sentence, confirm clears the first, the others are confirmed by default at .75."""
    r = reviews.groupBy(*SENT).agg(F.bool_or(F.col("action") == "reject").alias("reject"), F.bool_or(F.col("action") == "confirm").alias("confirm"))
    e = edits.join(r, list(SENT), "left").filter(~(F.col("needs_review") & F.coalesce("reject", F.lit(False))))
    k = F.row_number().over(Window.partitionBy(*SENT, "needs_review").orderBy("start_ms", "w_from", "type"))
    sure = F.when(~F.col("needs_review"), F.col("confidence")).when(F.coalesce("confirm", F.lit(False)) & (k == 1), 0.9).otherwise(0.75)
    return e.withColumn("confidence", sure).withColumn("needs_review", F.lit(False)).drop("reject", "confirm")


def keep_tail(edits: DataFrame, words: DataFrame) -> DataFrame:
    """Of ``edits(rec_id, edit_id, w_from, w_to, keep_text)`` the range without the whole words at its end that are kept.

    A word is kept while the text from it to the end of the range is no longer than ``keep_text``; one
    that would be split stays in the cut.
    """
    w = words.select("rec_id", "word_idx", "tok")
    inside = edits.withColumn("word_idx", F.explode(F.sequence("w_from", "w_to"))).join(w, ["rec_id", "word_idx"])
    back = Window.partitionBy("rec_id", "edit_id").orderBy(F.desc("word_idx")).rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("tail", F.sum(F.length("tok")).over(back))
    return inside.filter(F.col("tail") > F.length("keep_text")).groupBy("rec_id", "edit_id").agg(F.min("word_idx").alias("w_from"), F.max("word_idx").alias("w_to"))


def promote(edits: DataFrame, sents: DataFrame, types: tuple[str, ...] = ("single_filler", "residual_sentence")) -> DataFrame:
    """Edits of whole-sentence types span their sentence, whatever their text was."""
    s = sents.select(*SENT, F.col("w_start").alias("s_from"), F.col("w_end").alias("s_to"), F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1"))
    j = edits.join(s, list(SENT))
    whole = F.col("type").isin(*types)
    for c, v in (("w_from", "s_from"), ("w_to", "s_to"), ("start_ms", "s0"), ("end_ms", "s1")):
        j = j.withColumn(c, F.when(whole, F.col(v)).otherwise(F.col(c)))
    return j.drop("s_from", "s_to", "s0", "s1")


def neighbours(words: DataFrame) -> DataFrame:
    """J10 at every word: end of the one before and start of the one after, in the recording and in the sentence."""
    w, s = order("word_idx"), order("word_idx", keys=SENT)
    return words.select("rec_id", "sent_idx", "word_idx", F.lag("end_ms").over(w).alias("prev_end"), F.lead("start_ms").over(w).alias("next_start"), F.lag("end_ms").over(s).alias("sent_prev_end"), F.lead("start_ms").over(s).alias("sent_next_start"))


def extend_boundaries(edits: DataFrame, words: DataFrame, p: Params = PARAMS) -> DataFrame:
    """A boundary within ``snap`` ms of a neighbour in the same sentence moves to it."""
    n = neighbours(words)
    a = n.select("rec_id", F.col("word_idx").alias("w_from"), F.col("sent_prev_end").alias("pe"))
    b = n.select("rec_id", F.col("word_idx").alias("w_to"), F.col("sent_next_start").alias("ns"))
    j = edits.join(a, ["rec_id", "w_from"], "left").join(b, ["rec_id", "w_to"], "left")
    close = lambda gap: (gap >= 0) & (gap < p.snap)
    start = F.when(close(F.col("start_ms") - F.col("pe")), F.col("pe")).otherwise(F.col("start_ms"))
    end = F.when(close(F.col("ns") - F.col("end_ms")), F.col("ns")).otherwise(F.col("end_ms"))
    return j.withColumn("start_ms", start).withColumn("end_ms", end).select(*edits.columns)


def extend_onset(edits: DataFrame, words: DataFrame, p: Params = PARAMS) -> DataFrame:
    """A cut begins ``onset_gap`` after the word before it if the pause is longer; tight sides are marked for refinement."""
    n = neighbours(words)
    a = n.select("rec_id", F.col("word_idx").alias("w_from"), F.col("prev_end").alias("pe"))
    b = n.select("rec_id", F.col("word_idx").alias("w_to"), F.col("next_start").alias("ns"))
    j = edits.join(a, ["rec_id", "w_from"], "left").join(b, ["rec_id", "w_to"], "left")
    gap = F.col("start_ms") - F.col("pe")
    start = F.when(gap > p.onset_gap, F.col("pe") + p.onset_gap).otherwise(F.col("start_ms"))
    tight = lambda g: F.coalesce(g < p.onset_gap, F.lit(False))
    return j.select("rec_id", "w_from", "w_to", start.alias("start_ms"), "end_ms", tight(gap).alias("refine_start"), tight(F.col("ns") - F.col("end_ms")).alias("refine_end"))


def map_spans(spans: DataFrame, words: DataFrame) -> DataFrame:
    """Where the text of ``spans(rec_id, sent_idx, span)`` stands in its sentence, or else in the one before.

    Times inside a word are interpolated by characters (integer arithmetic), so a span may cut a word;
    ``partial`` says so.  Spans that stand in neither sentence are left out.
    """
    w = order("word_idx", keys=SENT)
    chars = words.select(*SENT, "word_idx", "tok", "start_ms", "end_ms").withColumn("c1", F.sum(F.length("tok")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("c0", F.col("c1") - F.length("tok"))
    text = words.groupBy(*SENT).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "tok"))), lambda x: x["tok"]), "").alias("text"))
    tries = spans.withColumn("in_sent", F.explode(F.array("sent_idx", F.col("sent_idx") - 1)))
    t = text.select("rec_id", F.col("sent_idx").alias("in_sent"), "text")
    hit = tries.join(t, ["rec_id", "in_sent"]).withColumn("at", F.expr("instr(text, span) - 1")).filter("at >= 0 and span <> ''")
    best = hit.groupBy("rec_id", "sent_idx", "span").agg(F.max(F.struct("in_sent", "at")).alias("b")).select("rec_id", "sent_idx", "span", F.col("b.in_sent").alias("in_sent"), F.col("b.at").alias("p0"), (F.col("b.at") + F.length("span")).alias("p1"))
    c = chars.withColumnRenamed("sent_idx", "in_sent")
    j = best.join(c, ["rec_id", "in_sent"]).filter("c1 > p0 and c0 < p1")
    inner = lambda p: F.expr(f"start_ms + (end_ms - start_ms) * ({p} - c0) div (c1 - c0)")
    s = F.when(F.col("c0") <= F.col("p0"), inner("p0"))
    e = F.when(F.col("c1") >= F.col("p1"), inner("p1"))
    cut = F.bool_or(((F.col("c0") < F.col("p0"))) | (F.col("c1") > F.col("p1")))
    return j.groupBy("rec_id", "sent_idx", "span", "in_sent").agg(F.min("word_idx").alias("w_from"), F.max("word_idx").alias("w_to"), F.min(s).alias("start_ms"), F.max(e).alias("end_ms"), cut.alias("partial"))


def apply_refined(edits: DataFrame, refined: DataFrame, least: float = 0.5) -> DataFrame:
    """``refined(rec_id, edit_id, new_start, new_end, conf)``: sure shifts of 1 ms or more, a start only to the right, an end only to the left."""
    j = edits.join(refined, ["rec_id", "edit_id"], "left")
    sure = F.coalesce(F.col("conf") >= least, F.lit(False))
    start = F.when(sure & (F.col("new_start") > F.col("start_ms")), F.col("new_start")).otherwise(F.col("start_ms"))
    end = F.when(sure & (F.col("new_end") < F.col("end_ms")), F.col("new_end")).otherwise(F.col("end_ms"))
    return j.withColumn("start_ms", start).withColumn("end_ms", end).select(*edits.columns)


def rough_cut(sents: DataFrame, blocks: DataFrame) -> DataFrame:
    """A4: per recording of ``sents(rec_id, sent_idx, start_ms, end_ms)`` what the blocks ``(rec_id, block_id, s_from, s_to)`` of deleted sentences come to; the ratio in tenths of a percent."""
    b = block_times(sents, blocks)
    cut = b.groupBy("rec_id").agg(F.count("*").alias("n_blocks"), F.sum(F.col("s_to") - F.col("s_from") + 1).alias("n_deleted"), F.sum("dur_ms").alias("deleted_ms"))
    total = sents.groupBy("rec_id").agg(F.max("end_ms").alias("total_ms"), F.count("*").alias("n_sentences"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    j = total.join(cut, "rec_id", "left").select("rec_id", "total_ms", "n_sentences", zero("n_blocks"), zero("n_deleted"), zero("deleted_ms"))
    return j.withColumn("ratio_pm", F.expr("(deleted_ms * 2000 + total_ms) div (2 * total_ms)"))


def block_times(sents: DataFrame, blocks: DataFrame) -> DataFrame:
    """A4: start, end and length of each block, from its first and last sentence."""
    first = sents.select("rec_id", F.col("sent_idx").alias("s_from"), "start_ms")
    last = sents.select("rec_id", F.col("sent_idx").alias("s_to"), "end_ms")
    return blocks.join(first, ["rec_id", "s_from"]).join(last, ["rec_id", "s_to"]).withColumn("dur_ms", F.col("end_ms") - F.col("start_ms"))


def summary(edits: DataFrame) -> DataFrame:
    """A2 and A3: edits by type, how many need review, and the time they save (a pause saves what is over the limit)."""
    saved = F.sum(F.col("end_ms") - F.col("start_ms") - F.coalesce("keep_ms", F.lit(0))) if "keep_ms" in edits.columns else F.sum(F.col("end_ms") - F.col("start_ms"))
    return edits.groupBy("type").agg(F.count("*").alias("n_edits"), F.count_if("needs_review").alias("n_review"), saved.cast("bigint").alias("saved_ms"))


