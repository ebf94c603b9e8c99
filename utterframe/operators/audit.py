"""Joins of cuts, words and feedback: context, coverage, audit checks and fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utterframe.operators.intervals import last_before, overlapping
from utterframe.operators.sequence import order
from utterframe.params import PARAMS, Params


def _words_as(words: DataFrame) -> DataFrame:
    return words.select("rec_id", F.col("word_idx").alias("r_id"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), "tok")


def context(cuts: DataFrame, words: DataFrame, n: int = 8, within: int = 5000) -> DataFrame:
    """The last n words that end before a cut ``(rec_id, seg_id, start_ms, end_ms)`` and the first n after it, inside ``within`` ms."""
    l = cuts.select("rec_id", F.col("seg_id").alias("l_id"), F.greatest(F.col("start_ms") - within, F.lit(0)).alias("l_start"), (F.col("end_ms") + within).alias("l_end"), F.col("start_ms").alias("c0"), F.col("end_ms").alias("c1"))
    j = overlapping(l, _words_as(words))
    side = F.when(F.col("r_end") <= F.col("c0"), "before").when(F.col("r_start") >= F.col("c1"), "after")
    j = j.withColumn("side", side).filter("side is not null")
    near = F.when(F.col("side") == "before", -F.col("r_id")).otherwise(F.col("r_id"))
    k = F.row_number().over(Window.partitionBy("rec_id", "l_id", "side").orderBy(near))
    j = j.withColumn("k", k).filter(F.col("k") <= n)
    text = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("r_id", "tok")))), lambda x: x["tok"]), " ")
    got = j.groupBy("rec_id", F.col("l_id").alias("seg_id")).agg(text("before").alias("before_text"), text("after").alias("after_text"))
    return cuts.select("rec_id", "seg_id").join(got, ["rec_id", "seg_id"], "left").select("rec_id", "seg_id", F.coalesce("before_text", F.lit("")).alias("before_text"), F.coalesce("after_text", F.lit("")).alias("after_text"))


def nearest_word(points: DataFrame, words: DataFrame, within: int = 3000) -> DataFrame:
    """The word whose start is nearest to each point ``(rec_id, p_id, at)`` inside ``within`` ms (ties: the earlier), and how many words are there."""
    l = points.select("rec_id", F.col("p_id").alias("l_id"), F.greatest(F.col("at") - within, F.lit(0)).alias("l_start"), (F.col("at") + within).alias("l_end"), "at")
    j = overlapping(l, _words_as(words))
    best = F.min(F.struct(F.abs(F.col("r_start") - F.col("at")).alias("away"), F.col("r_id"), F.col("tok")))
    return j.groupBy("rec_id", F.col("l_id").alias("p_id")).agg(best.alias("b"), F.count("*").alias("n_context")).select("rec_id", "p_id", F.col("b.r_id").alias("word_idx"), F.col("b.tok").alias("tok"), F.col("b.away").alias("away_ms"), "n_context")


def restored_coverage(restored: DataFrame, words: DataFrame, segments: DataFrame, intended: DataFrame) -> DataFrame:
    """Words of ``restored(rec_id, sent_idx)`` that a segment still cuts, unless an intended edit covers over half of the segment's part or .3 s of it."""
    w = words.join(restored.select("rec_id", "sent_idx"), ["rec_id", "sent_idx"], "left_semi")
    l = segments.select("rec_id", F.col("seg_id").alias("l_id"), F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))
    r = w.select("rec_id", F.col("word_idx").alias("r_id"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), "sent_idx")
    hit = overlapping(l, r).groupBy("rec_id", "l_id", "sent_idx").agg(F.count("*").alias("n_words"), F.sum(F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).alias("overlap_ms"))
    e = intended.select("rec_id", F.lit(0).alias("r_id"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    meant = overlapping(l, e).filter("2 * (least(l_end, r_end) - greatest(l_start, r_start)) > l_end - l_start or least(l_end, r_end) - greatest(l_start, r_start) > 300").select("rec_id", "l_id").distinct()
    return hit.join(meant, ["rec_id", "l_id"], "left_anti").withColumnRenamed("l_id", "seg_id")


def not_deleted(requests: DataFrame, segments: DataFrame) -> DataFrame:
    """Requests ``(rec_id, req_id, start_ms, end_ms)`` that no segment touches."""
    l = requests.select("rec_id", F.col("req_id").alias("l_id"), F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))
    r = segments.select("rec_id", F.col("seg_id").alias("r_id"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    done = overlapping(l, r).select("rec_id", F.col("l_id").alias("req_id")).distinct()
    return requests.join(done, ["rec_id", "req_id"], "left_anti")


def cut_point_gaps(segments: DataFrame, words: DataFrame, p: Params = PARAMS) -> DataFrame:
    """A pause between neighbouring segments, short enough to be one cut, with no word inside."""
    w = order("start_ms")
    g = segments.select("rec_id", "seg_id", F.col("end_ms").alias("start_ms"), F.lead("start_ms").over(w).alias("end_ms"))
    g = g.withColumn("gap_ms", F.col("end_ms") - F.col("start_ms")).filter((F.col("gap_ms") > p.cut_gap_least) & (F.col("gap_ms") <= p.cut_gap_most))
    return not_deleted(g.withColumnRenamed("seg_id", "req_id"), words.withColumnRenamed("word_idx", "seg_id")).withColumnRenamed("req_id", "seg_id").select("rec_id", "seg_id", "start_ms", "end_ms", "gap_ms")


def large_deletions(segments: DataFrame, words: DataFrame, p: Params = PARAMS) -> DataFrame:
    """D24's fourth check: long segments, listed with their context."""
    big = segments.filter(F.col("end_ms") - F.col("start_ms") >= p.large_deletion)
    return big.join(context(big, words), ["rec_id", "seg_id"])


def remove_segments(segments: DataFrame, keys: DataFrame) -> DataFrame:
    """Segments but for those whose start and end, to the hundredth of a second, are in ``keys(rec_id, start_ms, end_ms)``."""
    cs = lambda df: df.withColumn("k0", F.expr("(start_ms + 5) div 10")).withColumn("k1", F.expr("(end_ms + 5) div 10"))
    return cs(segments).join(cs(keys).select("rec_id", "k0", "k1"), ["rec_id", "k0", "k1"], "left_anti").drop("k0", "k1")


def fix_gaps(segments: DataFrame, g: DataFrame, near: int = 50) -> DataFrame:
    """Each gap ``(rec_id, start_ms, end_ms)`` is cut as well: the segment that ends within ``near`` of its start is drawn out over it, else the one that starts within ``near`` of its end, else it becomes a segment."""
    s = segments.select("rec_id", "seg_id", F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1"))
    b = lambda c: F.expr(f"{c} div {near + 1}")
    around = lambda c: F.explode(F.array(*[b(c) + d for d in (-1, 0, 1)]))
    prev = g.withColumn("k", around("start_ms")).join(s.withColumn("k", b("s1")), ["rec_id", "k"]).filter(F.abs(F.col("s1") - F.col("start_ms")) <= near)
    prev = prev.groupBy("rec_id", "start_ms", "end_ms").agg(F.min("seg_id").alias("p"))
    nxt = g.withColumn("k", around("end_ms")).join(s.withColumn("k", b("s0")), ["rec_id", "k"]).filter(F.abs(F.col("s0") - F.col("end_ms")) <= near)
    nxt = nxt.groupBy("rec_id", "start_ms", "end_ms").agg(F.min("seg_id").alias("n"))
    j = g.select("rec_id", "start_ms", "end_ms").join(prev, ["rec_id", "start_ms", "end_ms"], "left").join(nxt, ["rec_id", "start_ms", "end_ms"], "left")
    to_prev = j.filter("p is not null").groupBy("rec_id", F.col("p").alias("seg_id")).agg(F.max("end_ms").alias("new_end"))
    to_next = j.filter("p is null and n is not null").groupBy("rec_id", F.col("n").alias("seg_id")).agg(F.min("start_ms").alias("new_start"))
    out = segments.join(to_prev, ["rec_id", "seg_id"], "left").join(to_next, ["rec_id", "seg_id"], "left")
    out = out.select("rec_id", F.coalesce("new_start", "start_ms").alias("start_ms"), F.greatest("end_ms", F.coalesce("new_end", "end_ms")).alias("end_ms"))
    return out.unionByName(j.filter("p is null and n is null").select("rec_id", "start_ms", "end_ms"))


def next_kept_sentence(g: DataFrame, sents: DataFrame, deleted: DataFrame) -> DataFrame:
    """For each pause, the first sentence from its end on that is kept."""
    kept = sents.join(deleted.select("rec_id", "sent_idx").distinct(), ["rec_id", "sent_idx"], "left_anti").select("rec_id", (-F.col("start_ms")).alias("start_ms"), F.col("sent_idx").alias("end_ms"))
    found = last_before(g, -F.col("gap_end"), kept, ["next_word", "gap_start", "gap_end"])
    return found.select("rec_id", "next_word", "gap_start", "gap_end", F.col("r_end").alias("sent_idx"))


def expand_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks(rec_id, block_id, s_from, s_to)`` to sentences; the later block wins."""
    return blocks.withColumn("sent_idx", F.explode(F.sequence("s_from", "s_to"))).groupBy("rec_id", "sent_idx").agg(F.max("block_id").alias("block_id"))


def deleted_around(sents: DataFrame, deleted: DataFrame, reach: int = 3) -> DataFrame:
    """How many sentences within ``reach`` of each are deleted, itself apart."""
    d = sents.select("rec_id", "sent_idx").join(deleted.select("rec_id", "sent_idx").distinct().withColumn("d", F.lit(1)), ["rec_id", "sent_idx"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    near = F.sum("d").over(Window.partitionBy("rec_id").orderBy("sent_idx").rangeBetween(-reach, reach)) - F.col("d")
    return d.select("rec_id", "sent_idx", F.col("d").cast("bigint").alias("deleted"), near.cast("bigint").alias("n_near"))


def review_rows(sents: DataFrame, edits: DataFrame) -> DataFrame:
    """Each sentence with its edits nested, the first as primary, and how many more."""
    e = edits.groupBy("rec_id", "sent_idx").agg(F.array_sort(F.collect_list(F.struct("start_ms", "type", "w_from", "w_to", "end_ms", "needs_review"))).alias("edits"))
    j = sents.join(e, ["rec_id", "sent_idx"], "left")
    return j.select("rec_id", "sent_idx", "speaker", "text", "start_ms", "end_ms", F.expr("try_element_at(edits, 1)").alias("primary"), F.coalesce(F.expr("slice(edits, 2, greatest(size(edits) - 1, 0))"), F.expr("cast(array() as array<struct<start_ms:bigint,type:string,w_from:bigint,w_to:bigint,end_ms:bigint,needs_review:boolean>>)")).alias("extra"))
