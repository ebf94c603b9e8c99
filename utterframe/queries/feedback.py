"""Evaluation, feedback, audit, signal, plans and pages."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from utterframe.functions import formats
from utterframe.durable import durable
from utterframe.operators import align, audit, detect, evaluate, intervals, resolve, sequence, signal
from utterframe.sources import readers
from utterframe.queries import query, table
from utterframe.queries.base import CUTS, MERGED, P, TL, cuts, numbered, quoted, segments, stored, words
from utterframe.queries.words import KEPT, NUM, REP, RESCAN, SPK
from utterframe.streaming import events as streams

BAD_WORDS = ("stupid", "trash", "disgusting", "clown", "idiot")
FILLERS = ("the ", "of ", "and ", "de ", "la ", "und ")


@query(
    f"""WITH j AS (SELECT lang, toxic = 1 AS g, regexp_matches(lower(text), '\\b({'|'.join(BAD_WORDS)})\\b') AS p FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM j GROUP BY ROLLUP (lang))
SELECT coalesce(lang, 'all') AS lang, tp, fp, fn, CASE WHEN tp + fp > 0 THEN (tp * 10000 // (tp + fp))::BIGINT END AS precision_bp, CASE WHEN tp + fn > 0 THEN (tp * 10000 // (tp + fn))::BIGINT END AS recall_bp FROM c"""
)
def eval_prf_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lower("text").rlike(rf"\b({'|'.join(BAD_WORDS)})\b").alias("p")).join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluate.prf(rows, "lang", F.col("toxic") == 1, F.col("p"))


@query(
    MERGED + """, p AS (SELECT rec_id, sent_idx, word_idx AS p_id FROM pw WHERE before = tok),
x AS (SELECT m2.rec_id, m2.sent_idx, g_id, max(CASE WHEN w_from = p_id AND w_to = p_id THEN 2 WHEN p_id BETWEEN w_from AND w_to THEN 1 ELSE 0 END) AS m FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms, type, w_from) - 1 AS g_id FROM cut) m2 LEFT JOIN p ON p.rec_id = m2.rec_id AND p.sent_idx = m2.sent_idx GROUP BY ALL)
SELECT CASE m WHEN 2 THEN 'exact' WHEN 1 THEN 'partial' ELSE 'missed' END AS match, count(*) AS n FROM x GROUP BY 1"""
)
def boundary_accuracy(spark, sf_dir):
    # the detectors' edits as gold, repeated words as predictions
    w = stored(spark, sf_dir)
    gold = numbered(cuts(w)).select("rec_id", "sent_idx", F.col("edit_id").alias("g_id"), F.col("w_from").alias("g_from"), F.col("w_to").alias("g_to"))
    p = w.withColumn("before", F.lag("tok").over(sequence.order("word_idx", keys=detect.SENT))).filter("before = tok")
    p = p.select("rec_id", "sent_idx", F.col("word_idx").alias("p_id"), F.col("word_idx").alias("p_from"), F.col("word_idx").alias("p_to"))
    return evaluate.best_matches(gold, p).groupBy("match").agg(F.count("*").alias("n"))


RATES = f"""WITH x AS (SELECT text, coalesce(quality = 0, false) AS deleted FROM documents LEFT JOIN labels USING (doc_id)),
e AS (SELECT *, unnest([{quoted(FILLERS)}]) AS filler FROM x), n AS (SELECT filler, deleted, (length(text) - length(replace(text, filler, ''))) // length(filler) AS n FROM e),
r AS (SELECT filler, sum(n)::BIGINT AS total, sum(CASE WHEN deleted THEN n ELSE 0 END)::BIGINT AS deleted_n FROM n GROUP BY filler),
rates AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE deleted_n * 10000 // total END::BIGINT AS rate_bp FROM r)"""


def _rates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return evaluate.filler_rates(d.select("text", F.coalesce(F.col("quality") == 0, F.lit(False)).alias("deleted")), FILLERS)


@query(RATES + " SELECT * FROM rates")
def filler_rates(spark, sf_dir):
    return _rates(spark, sf_dir)


@query(RATES + " SELECT filler, CASE WHEN rate_bp >= 6000 THEN 'always' WHEN rate_bp >= 3000 THEN 'review' ELSE 'keep' END AS rule FROM rates")
def rule_overrides(spark, sf_dir):
    return evaluate.overrides(_rates(spark, sf_dir))


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) SELECT event_type, count(*) AS n, least(5000 + 1000 * count(*), 9500)::BIGINT AS confidence_bp, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (k <= 3) AS examples FROM k GROUP BY event_type HAVING count(*) >= 2")
def feedback_adjustments(spark, sf_dir):
    return evaluate.adjustments(table(spark, sf_dir, "events"), "event_type", "event_id")


@query(
    """WITH m AS (SELECT user_id, list(CASE event_type WHEN 'purchase' THEN 1 ELSE -1 END ORDER BY ts, event_id) AS ms FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)
SELECT user_id AS key, list_reduce(ms, lambda s, x: least(greatest(s + x, 0), 2), 1)::BIGINT AS level, len(ms)::BIGINT AS n_moves FROM m"""
)
def ladder_apply(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("at"), "event_type")
    return evaluate.ladder(e, F.col("event_type") == "purchase", F.col("event_type") == "error")


@query("SELECT event_type, count(*) FILTER (value >= 10) AS kept, count(*) FILTER (value < 10) AS flagged, count(*) FILTER (value IS NULL) AS pending FROM events GROUP BY event_type")
def feedback_tallies(spark, sf_dir):
    status = F.when(F.col("value").isNull(), "pending").when(F.col("value") >= 10, "kept").otherwise("flagged")
    return table(spark, sf_dir, "events").select("event_type", status.alias("status")).groupBy("event_type").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("kept", "flagged", "pending")])


@query("SELECT coalesce(lang, 'all') AS lang, count(*) AS n_gold, count(DISTINCT source) AS n_sources, count(*) FILTER (toxic = 1) AS n_toxic FROM (SELECT DISTINCT doc_id, lang, source, toxic FROM documents JOIN labels USING (doc_id)) GROUP BY ROLLUP (lang)")
def gold_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").distinct()
    g = d.rollup("lang").agg(F.count("*").alias("n_gold"), F.countDistinct("source").alias("n_sources"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))
    return g.withColumn("lang", F.coalesce("lang", F.lit("all")))


RESTORED = """, rs AS (SELECT DISTINCT rec_id, sent_idx FROM cut WHERE needs_review), meant AS (SELECT DISTINCT m.rec_id, m.seg_id FROM m JOIN (SELECT * FROM cut WHERE NOT needs_review) c ON c.rec_id = m.rec_id AND greatest(m.start_ms, c.start_ms) < least(m.end_ms, c.end_ms)
  WHERE 2 * (least(m.end_ms, c.end_ms) - greatest(m.start_ms, c.start_ms)) > m.end_ms - m.start_ms OR least(m.end_ms, c.end_ms) - greatest(m.start_ms, c.start_ms) > 300)"""


@query(
    MERGED + RESTORED + """ SELECT m.rec_id, m.seg_id, w.sent_idx, count(*) AS n_words, sum(least(m.end_ms, w.end_ms) - greatest(m.start_ms, w.start_ms))::BIGINT AS overlap_ms
FROM m JOIN w ON w.rec_id = m.rec_id AND greatest(m.start_ms, w.start_ms) < least(m.end_ms, w.end_ms) JOIN rs ON rs.rec_id = w.rec_id AND rs.sent_idx = w.sent_idx
WHERE (m.rec_id, m.seg_id) NOT IN (SELECT (rec_id, seg_id) FROM meant) GROUP BY ALL"""
)
def restored_coverage(spark, sf_dir):
    w = stored(spark, sf_dir)
    c = cuts(w)
    return audit.restored_coverage(c.filter("needs_review").select("rec_id", "sent_idx").distinct(), w, segments(w), c.filter("not needs_review"))


REQ = f""", rq AS (SELECT rec_id, sent_idx AS req_id, start_ms, end_ms FROM s WHERE (rec_id, sent_idx) IN (SELECT (rec_id, delete_idx) FROM rep) OR (rec_id, sent_idx) IN (SELECT (rec_id, sent_idx) FROM pw WHERE n = 1 AND tok IN ({quoted([*P.fillers, *P.ambiguous, *P.mid_fillers])})))"""


@query(MERGED + REP + REQ + " SELECT * FROM rq WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.rec_id = rq.rec_id AND greatest(m.start_ms, rq.start_ms) < least(m.end_ms, rq.end_ms))")
def manual_not_deleted(spark, sf_dir):
    w = stored(spark, sf_dir)
    s = sequence.sentences(w)
    asked = detect.repeated_adjacent(s).select("rec_id", F.col("delete_idx").alias("sent_idx")).unionByName(detect.residual_filler(w).select("rec_id", "sent_idx")).distinct()
    return audit.not_deleted(s.join(asked, ["rec_id", "sent_idx"], "left_semi").select("rec_id", F.col("sent_idx").alias("req_id"), "start_ms", "end_ms"), segments(w))


@query(MERGED + ", x AS (SELECT rec_id, seg_id, end_ms AS start_ms, lead(start_ms) OVER (PARTITION BY rec_id ORDER BY start_ms) AS end_ms FROM m) SELECT *, end_ms - start_ms AS gap_ms FROM x WHERE end_ms - start_ms > 300 AND end_ms - start_ms <= 3000 AND NOT EXISTS (SELECT 1 FROM w WHERE w.rec_id = x.rec_id AND greatest(w.start_ms, x.start_ms) < least(w.end_ms, x.end_ms))")
def cut_point_silence(spark, sf_dir):
    w = stored(spark, sf_dir)
    return audit.cut_point_gaps(segments(w), w)


@query(
    MERGED + """, b AS (SELECT m.rec_id, seg_id, tok, word_idx, row_number() OVER (PARTITION BY m.rec_id, seg_id ORDER BY word_idx DESC) AS k FROM m JOIN w ON w.rec_id = m.rec_id AND w.end_ms <= m.start_ms AND w.end_ms > m.start_ms - 5000),
a AS (SELECT m.rec_id, seg_id, tok, word_idx, row_number() OVER (PARTITION BY m.rec_id, seg_id ORDER BY word_idx) AS k FROM m JOIN w ON w.rec_id = m.rec_id AND w.start_ms >= m.end_ms AND w.start_ms < m.end_ms + 5000)
SELECT rec_id, seg_id, start_ms, end_ms, coalesce((SELECT string_agg(tok, ' ' ORDER BY word_idx) FROM b WHERE b.rec_id = m.rec_id AND b.seg_id = m.seg_id AND k <= 8), '') AS before_text, coalesce((SELECT string_agg(tok, ' ' ORDER BY word_idx) FROM a WHERE a.rec_id = m.rec_id AND a.seg_id = m.seg_id AND k <= 8), '') AS after_text
FROM m WHERE end_ms - start_ms >= 800"""
)
def large_deletions(spark, sf_dir):
    w = stored(spark, sf_dir)
    return audit.large_deletions(segments(w), w, replace(P, large_deletion=800))


@query(
    MERGED + KEPT + RESCAN + """, j AS (SELECT q.*, (SELECT min(seg_id) FROM m WHERE m.rec_id = q.rec_id AND abs(m.end_ms - q.start_ms) <= 50) AS p, (SELECT min(seg_id) FROM m WHERE m.rec_id = q.rec_id AND abs(m.start_ms - q.end_ms) <= 50) AS n FROM (SELECT DISTINCT rec_id, start_ms, end_ms FROM q) q)
SELECT rec_id, coalesce((SELECT min(start_ms) FROM j WHERE j.rec_id = m.rec_id AND p IS NULL AND n = seg_id), start_ms) AS start_ms, greatest(end_ms, coalesce((SELECT max(end_ms) FROM j WHERE j.rec_id = m.rec_id AND p = seg_id), end_ms)) AS end_ms FROM m
UNION ALL SELECT rec_id, start_ms, end_ms FROM j WHERE p IS NULL AND n IS NULL"""
)
def auto_fix(spark, sf_dir):
    w = stored(spark, sf_dir)
    m = durable(segments(w))
    return audit.fix_gaps(m, intervals.rescan_gaps(intervals.kept_words(w, m), m).select("rec_id", "start_ms", "end_ms"))


@query(MERGED + " SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM d0 WHERE d0.rec_id = m.rec_id AND (d0.start_ms + 5) // 10 = (m.start_ms + 5) // 10 AND (d0.end_ms + 5) // 10 = (m.end_ms + 5) // 10)")
def segments_removed(spark, sf_dir):
    w = stored(spark, sf_dir)
    return audit.remove_segments(segments(w), detect.leading_filler(w))


@query(CUTS + " SELECT g.rec_id, next_word, gap_start, gap_end, (SELECT min(s.sent_idx) FROM s WHERE s.rec_id = g.rec_id AND s.start_ms >= gap_end AND (s.rec_id, s.sent_idx) NOT IN (SELECT (rec_id, sent_idx) FROM d2)) AS sent_idx FROM g")
def incoming_pause(spark, sf_dir):
    w = words(spark, sf_dir)
    return audit.next_kept_sentence(sequence.gaps(w), sequence.sentences(w), detect.stutter(w))


@query(TL + SPK + ", b AS (SELECT p.rec_id, seg_id, min(sent_idx) AS a, max(sent_idx) AS z FROM p JOIN w ON w.rec_id = p.rec_id AND w.start_ms >= p.start_ms AND w.end_ms <= p.end_ms GROUP BY ALL) SELECT s.rec_id, s.sent_idx, max(seg_id) AS block_id FROM s JOIN b ON b.rec_id = s.rec_id AND s.sent_idx BETWEEN a AND z GROUP BY ALL")
def block_sentences(spark, sf_dir):
    w = words(spark, sf_dir)
    inside = intervals.overlapping(
        sequence.speaker_segments(w).select("rec_id", F.col("seg_id").alias("l_id"), F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end")),
        w.select("rec_id", F.col("sent_idx").alias("r_id"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end")),
    )
    return audit.expand_blocks(inside.groupBy("rec_id", F.col("l_id").alias("block_id")).agg(F.min("r_id").alias("s_from"), F.max("r_id").alias("s_to")))


@query(CUTS + ", d AS (SELECT s.rec_id, s.sent_idx, ((s.rec_id, s.sent_idx) IN (SELECT (rec_id, sent_idx) FROM cut))::BIGINT AS deleted FROM s) SELECT *, (sum(deleted) OVER (PARTITION BY rec_id ORDER BY sent_idx RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) - deleted)::BIGINT AS n_near FROM d")
def deleted_neighbours(spark, sf_dir):
    w = stored(spark, sf_dir)
    return audit.deleted_around(sequence.sentences(w), cuts(w))


@query(
    CUTS + """, k AS (SELECT *, row_number() OVER (PARTITION BY rec_id, sent_idx ORDER BY start_ms, type, w_from) AS k, count(*) OVER (PARTITION BY rec_id, sent_idx) AS c FROM cut)
SELECT s.rec_id, s.sent_idx, s.text, k.type AS primary_type, coalesce(c - 1, 0)::BIGINT AS n_extra FROM s LEFT JOIN k ON k.rec_id = s.rec_id AND k.sent_idx = s.sent_idx AND k = 1"""
)
def review_dataset(spark, sf_dir):
    w = stored(spark, sf_dir)
    return audit.review_rows(sequence.sentences(w), cuts(w)).select("rec_id", "sent_idx", "text", F.col("primary.type").alias("primary_type"), F.size("extra").cast("bigint").alias("n_extra"))


@query(
    CUTS + """, ax AS (SELECT rec_id, sent_idx, bool_or(d < 1500) AS reject, bool_or(d >= 1500) AS confirm FROM (SELECT *, end_ms - start_ms AS d FROM s) GROUP BY rec_id, sent_idx),
k AS (SELECT cut.*, reject, confirm, row_number() OVER (PARTITION BY cut.rec_id, cut.sent_idx, needs_review ORDER BY start_ms, w_from, type) AS k FROM cut JOIN ax USING (rec_id, sent_idx) WHERE NOT (needs_review AND reject))
SELECT rec_id, sent_idx, type, w_from, w_to, start_ms, end_ms, false AS needs_review, CASE WHEN NOT needs_review THEN confidence WHEN confirm AND k = 1 THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM k"""
)
def review_application(spark, sf_dir):
    # a judge that rejects in sentences under 1.5 s and confirms in others
    w = stored(spark, sf_dir)
    reviews = sequence.sentences(w).select("rec_id", "sent_idx", F.when(F.col("end_ms") - F.col("start_ms") < 1500, "reject").otherwise("confirm").alias("action"))
    return resolve.apply_reviews(cuts(w), reviews)


@query(
    CUTS + NUM + """, i AS (SELECT e.rec_id, edit_id, w.word_idx, sum(length(tok)) OVER (PARTITION BY e.rec_id, edit_id ORDER BY word_idx DESC) AS tail, (SELECT length(tok) FROM w z WHERE z.rec_id = e.rec_id AND z.word_idx = e.w_to) AS keep FROM e JOIN w ON w.rec_id = e.rec_id AND w.word_idx BETWEEN w_from AND w_to)
SELECT rec_id, edit_id, min(word_idx) AS w_from, max(word_idx) AS w_to FROM i WHERE tail > keep GROUP BY rec_id, edit_id"""
)
def keep_text_trim(spark, sf_dir):
    # every edit keeps its last word
    w = stored(spark, sf_dir)
    last = w.select("rec_id", F.col("word_idx").alias("w_to"), F.col("tok").alias("keep_text"))
    return resolve.keep_tail(numbered(cuts(w)).join(last, ["rec_id", "w_to"]), w)


@query(CUTS + " SELECT cut.rec_id, cut.sent_idx, type, CASE WHEN type = 'stutter' THEN w_start ELSE w_from END AS w_from, CASE WHEN type = 'stutter' THEN w_end ELSE w_to END AS w_to, CASE WHEN type = 'stutter' THEN s.start_ms ELSE cut.start_ms END AS start_ms, CASE WHEN type = 'stutter' THEN s.end_ms ELSE cut.end_ms END AS end_ms, needs_review, confidence FROM cut JOIN s USING (rec_id, sent_idx)")
def whole_sentence_promotion(spark, sf_dir):
    w = stored(spark, sf_dir)
    return resolve.promote(cuts(w), sequence.sentences(w), ("stutter",)).select(*detect.EDIT)


@query(CUTS + NUM + " SELECT rec_id, edit_id, CASE WHEN confidence >= 0.9 AND start_ms % 40 > 0 THEN start_ms + start_ms % 40 ELSE start_ms END AS start_ms, CASE WHEN confidence >= 0.9 AND 20 > 0 THEN end_ms - 20 ELSE end_ms END AS end_ms FROM e")
def refinement_apply(spark, sf_dir):
    w = stored(spark, sf_dir)
    e = numbered(cuts(w))
    refined = e.select("rec_id", "edit_id", (F.col("start_ms") + F.col("start_ms") % 40).alias("new_start"), (F.col("end_ms") - 20).alias("new_end"), F.when(F.col("confidence") >= 0.9, 1.0).otherwise(0.0).alias("conf"))
    return resolve.apply_refined(e, refined).select("rec_id", "edit_id", "start_ms", "end_ms")


# Signals: events by user, in order of time, values in hundredths.
FR = "WITH f AS (SELECT user_id AS key, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, round(value * 100)::BIGINT AS v FROM events)"
V = " WINDOW o AS (PARTITION BY key ORDER BY pos)"


def _frames(spark, sf_dir):
    return signal.frames(table(spark, sf_dir, "events"))


@query(FR + " SELECT key, pos, (sum(v) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))::BIGINT AS sum_v, count(v) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM f")
def moving_average(spark, sf_dir):
    return signal.moving_sums(_frames(spark, sf_dir))


@query(FR + " SELECT * FROM (SELECT key, pos, v - lag(v) OVER o AS dv FROM f" + V + ") WHERE dv IS NOT NULL")
def first_difference(spark, sf_dir):
    return signal.differences(_frames(spark, sf_dir))


MIN = ", mn AS (SELECT key, pos, v FROM (SELECT *, coalesce(v <= lag(v) OVER o, true) AND coalesce(v <= lead(v) OVER o, true) AS lo FROM f" + V + ") WHERE lo)"


@query(FR + MIN + " SELECT * FROM mn")
def local_minima(spark, sf_dir):
    return signal.local_minima(_frames(spark, sf_dir))


@query(
    FR + """, x AS (SELECT c.key, c.pos AS cut_pos, x.pos, x.v, coalesce(x.v <= lag(x.v) OVER o, true) AND coalesce(x.v <= lead(x.v) OVER o, true) AS low, avg(x.v) OVER (PARTITION BY c.key, c.pos) AS mean
  FROM f c JOIN f x ON x.key = c.key AND abs(x.pos - c.pos) <= 10 WINDOW o AS (PARTITION BY c.key, c.pos ORDER BY x.pos)),
d AS (SELECT *, CASE WHEN v <= 0 THEN 60 ELSE 20 * log10(mean / v) END AS db FROM x WHERE low),
k AS (SELECT *, row_number() OVER (PARTITION BY key, cut_pos ORDER BY db < 3, CASE WHEN db < 3 THEN v ELSE abs(pos - cut_pos) END, pos) AS k FROM d)
SELECT key, cut_pos AS pos, pos AS valley, round(10000 * CASE WHEN db < 3 THEN db / 3 * 0.4 ELSE least(1, 0.5 + (db - 3) / 9) END)::BIGINT AS confidence_bp FROM k WHERE k = 1"""
)
def nearest_valley(spark, sf_dir):
    return signal.nearest_valley(_frames(spark, sf_dir))


@query(FR + ", a AS (SELECT *, count(v) OVER (PARTITION BY key) AS n, sum(v) OVER (PARTITION BY key) AS s, sum(v * v) OVER (PARTITION BY key) AS q FROM f) SELECT key, pos, v FROM a WHERE n * v > s AND (n * v - s) * (n * v - s) > 4 * (n * q - s * s)")
def adaptive_threshold(spark, sf_dir):
    return signal.outliers(_frames(spark, sf_dir))


# loud places as segments of three samples, between the loud places on either side
LOUD = FR + """, l AS (SELECT key, pos FROM f WHERE v >= 2000), sg AS (SELECT key, pos AS seg_id, pos - 1 AS a, pos + 1 AS b, lag(pos) OVER o AS lo, lead(pos) OVER o AS hi FROM l WINDOW o AS (PARTITION BY key ORDER BY pos)),
ev AS (SELECT sg.*, f.pos, f.v FROM sg JOIN f ON f.key = sg.key AND f.pos BETWEEN a - 20 AND b + 20),
fl AS (SELECT key, seg_id, list(v ORDER BY v) FILTER ((pos < a AND pos >= a - 2) OR (pos > b AND pos <= b + 2)) AS quiet, list(v ORDER BY v) AS every FROM ev GROUP BY key, seg_id),
nf AS (SELECT key, seg_id, CASE WHEN len(quiet) > 0 THEN quiet[len(quiet) // 2 + 1] ELSE every[greatest(1, len(every) // 10) // 2 + 1] END AS floor_v, coalesce(len(quiet), 0) AS n FROM fl)"""


def _loud(spark, sf_dir):
    f = _frames(spark, sf_dir)
    o = Window.partitionBy("key").orderBy("pos")
    segs = f.filter("v >= 2000").select("key", F.col("pos").alias("seg_id"), (F.col("pos") - 1).alias("a"), (F.col("pos") + 1).alias("b"), F.lag("pos").over(o).alias("lo"), F.lead("pos").over(o).alias("hi"))
    return signal.around(f, segs, 20)


@query(LOUD + " SELECT * FROM nf")
def noise_floor(spark, sf_dir):
    return signal.noise_floor(_loud(spark, sf_dir), 2).select("key", "seg_id", "floor_v", "n")


EN = FR + """, a AS (SELECT *, sum(v * v) OVER b AS eb, sum(v * v) OVER c AS ea, count(v) OVER b AS nb, count(v) OVER c AS na FROM f WINDOW b AS (PARTITION BY key ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), c AS (PARTITION BY key ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
ej AS (SELECT key, pos, CASE WHEN greatest(eb, ea) > 25 * least(eb, ea) THEN 'high' ELSE 'medium' END AS severity FROM a WHERE nb = 3 AND na = 3 AND eb > 0 AND ea > 0 AND greatest(eb, ea) > 9 * least(eb, ea))"""


@query(EN + " SELECT * FROM ej")
def energy_jump(spark, sf_dir):
    return signal.energy_jumps(_frames(spark, sf_dir))


@query(FR + ", a AS (SELECT *, sum(v * v) OVER (PARTITION BY key) AS q, count(*) OVER (PARTITION BY key) AS n, count(*) OVER b AS c, sum(v * v) OVER b AS s, sum(v * v) OVER h AS a FROM f WINDOW b AS (PARTITION BY key ORDER BY pos ROWS 3 PRECEDING), h AS (PARTITION BY key ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING)) SELECT key, pos FROM a WHERE c = 4 AND 400 * s * n > 4 * q AND 16 * s * n < 4 * q AND 4 * a > 3 * s")
def breath_truncation(spark, sf_dir):
    return signal.truncations(_frames(spark, sf_dir))


@query(
    FR + """, u AS (SELECT *, v * count(v) OVER (PARTITION BY key) >= sum(v) OVER (PARTITION BY key) AS up, count(*) OVER (PARTITION BY key) AS len FROM f), x AS (SELECT *, coalesce((lag(up) OVER o <> up)::INT, 0) AS x FROM u""" + V + """),
r AS (SELECT key, pos AS cut_pos, len, unnest(range(-5, 5)) AS i FROM x), c AS (SELECT r.key, cut_pos, i, sum(x) AS c FROM r JOIN x ON x.key = r.key AND x.pos >= cut_pos + i * 4 AND x.pos < cut_pos + i * 4 + 4 WHERE cut_pos + i * 4 >= 0 AND cut_pos + i * 4 + 4 <= r.len GROUP BY ALL),
z AS (SELECT key, cut_pos, list(c) FILTER (i < 0) AS b, list(c) FILTER (i >= 0) AS a, list(c) AS e FROM c GROUP BY key, cut_pos)
SELECT key, cut_pos AS pos, list_sum(b)::BIGINT AS before_n, list_sum(a)::BIGINT AS after_n FROM z WHERE len(a) > 0 AND len(b) > 0 AND abs(list_avg(a) - list_avg(b)) / (list_stddev_pop(e) + 1e-10) > 2"""
)
def crossing_jump(spark, sf_dir):
    return signal.crossings(_frames(spark, sf_dir))


@query(
    """WITH v AS (SELECT vec_id // 50 AS key, vec_id % 50 AS pos, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT DISTINCT key, unnest(range(5, 50, 5)) AS cut_pos FROM v),
m AS (SELECT c.key, cut_pos, i, sum(x) FILTER (pos < cut_pos) AS p, sum(x) FILTER (pos >= cut_pos) AS q FROM c JOIN v ON v.key = c.key AND pos >= cut_pos - 4 AND pos < cut_pos + 4 GROUP BY ALL),
s AS (SELECT key, cut_pos, sum(p * q) / sqrt(sum(p * p) * sum(q * q)) AS c FROM m GROUP BY key, cut_pos)
SELECT key, cut_pos::BIGINT AS cut_pos, CASE WHEN c < 0.5 THEN 'high' ELSE 'medium' END AS severity FROM s WHERE c < 0.7 AND (SELECT count(DISTINCT pos) FROM v WHERE v.key = s.key AND pos < cut_pos AND pos >= cut_pos - 4) >= 1 AND (SELECT count(DISTINCT pos) FROM v WHERE v.key = s.key AND pos >= cut_pos AND pos < cut_pos + 4) >= 1"""
)
def spectral_jump(spark, sf_dir):
    # fifty vectors as the frames of a recording, cut at every fifth
    v = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 50").alias("key"), (F.col("vec_id") % 50).alias("pos"), F.col("embedding").alias("v"))
    cuts = v.select("key").distinct().select("key", F.explode(F.expr("sequence(5L, 45L, 5L)")).alias("cut_pos"))
    return signal.spectral_jumps(v, cuts)


@query(
    LOUD + """, s0 AS (SELECT sg.*, 2 * floor_v AS th FROM sg JOIN nf USING (key, seg_id)),
mv AS (SELECT key, seg_id, a, b, lo, hi, (SELECT max(pos) FROM f WHERE f.key = s0.key AND f.v <= th AND pos < a AND pos >= a - 20) AS na, (SELECT min(pos) FROM f WHERE f.key = s0.key AND f.v <= th AND pos > b AND pos <= b + 20) AS nb FROM s0)
SELECT key, seg_id, greatest(coalesce(na, a), coalesce(lo, 0)) AS a, CASE WHEN hi IS NULL THEN coalesce(nb, b) ELSE least(coalesce(nb, b), hi) END AS b FROM mv"""
)
def boundary_calibration(spark, sf_dir):
    env = _loud(spark, sf_dir)
    return signal.calibrate(env, signal.noise_floor(env, 2), 20)


SEV = "CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' ELSE 'low' END"


def _issues(spark, sf_dir):
    severity = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "purchase", "medium").otherwise("low")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("issue_id"), "ts", severity.alias("severity"))


@query(f"WITH i AS (SELECT user_id AS key, {SEV} AS sv FROM events), c AS (SELECT key, count(*) FILTER (sv = 'high') AS high, count(*) FILTER (sv = 'medium') AS medium, count(*) FILTER (sv = 'low') AS low FROM i GROUP BY key) SELECT *, greatest(100 - 8 * high - 3 * medium - low, 10)::BIGINT AS score10, CASE WHEN greatest(100 - 8 * high - 3 * medium - low, 10) >= 80 THEN 'good' WHEN greatest(100 - 8 * high - 3 * medium - low, 10) >= 60 THEN 'ok' ELSE 'bad' END AS class FROM c")
def severity_score(spark, sf_dir):
    return evaluate.severity_score(_issues(spark, sf_dir)).withColumn("class", evaluate.score_class(F.col("score10")))


@query(f"SELECT key, day, issue_id, severity FROM (SELECT user_id AS key, ts::DATE AS day, event_id AS issue_id, {SEV} AS severity, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END DESC, event_id) AS k FROM events) WHERE k = 1")
def keep_most_severe(spark, sf_dir):
    return evaluate.most_severe(_issues(spark, sf_dir).withColumn("day", F.to_date("ts")), ["key", "day"])


@query(
    TL + """, a AS (SELECT rec_id AS key, gap_start AS time_ms, 'signal' AS layer, CASE WHEN gap_ms > 2000 THEN 'high' ELSE 'low' END AS severity, next_word AS issue_id FROM g),
b AS (SELECT rec_id AS key, start_ms AS time_ms, 'semantic' AS layer, 'medium' AS severity, word_idx AS issue_id FROM pw WHERE before = tok),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE (key, (time_ms + 50) // 100) NOT IN (SELECT (key, (time_ms + 50) // 100) FROM a))
SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, time_ms, layer, issue_id) AS place FROM u"""
)
def issue_fusion(spark, sf_dir):
    w = words(spark, sf_dir)
    a = sequence.gaps(w).select(F.col("rec_id").alias("key"), F.col("gap_start").alias("time_ms"), F.lit("signal").alias("layer"), F.when(F.col("gap_ms") > 2000, "high").otherwise("low").alias("severity"), F.col("next_word").alias("issue_id"))
    t = w.withColumn("before", F.lag("tok").over(sequence.order("word_idx", keys=detect.SENT))).filter("before = tok")
    b = t.select(F.col("rec_id").alias("key"), F.col("start_ms").alias("time_ms"), F.lit("semantic").alias("layer"), F.lit("medium").alias("severity"), F.col("word_idx").alias("issue_id"))
    return evaluate.fuse([a, b])


@query(
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
x AS (SELECT *, sum((p IS NOT NULL AND us - p > 43200000000)::INT) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM e)
SELECT user_id, session::BIGINT AS session, count(*) AS n_events, min(event_id) AS first_event, arg_max(event_id, (us, event_id)) AS last_event FROM x GROUP BY user_id, session"""
)
def session_islands(spark, sf_dir):
    return sequence.session_islands(table(spark, sf_dir, "events"), 12 * 3600)


@query(
    """WITH t AS (SELECT user_id // 10 AS rec_id, user_id AS track, event_id AS id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + round(value * 1000)::BIGINT AS end_ms FROM events),
m AS (SELECT *, row_number() OVER o - 1 AS pos, max(end_ms) OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms, track, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t WINDOW o AS (PARTITION BY rec_id ORDER BY start_ms, end_ms, track, id))
SELECT rec_id, pos, track, id, start_ms - reach AS gap_ms FROM m WHERE start_ms - reach >= 3600000"""
)
def track_merge_running_max_gap(spark, sf_dir):
    ms = F.floor(sequence.epoch("ts", "MICROSECOND") / 1000)
    t = table(spark, sf_dir, "events").select(F.expr("user_id div 10").alias("rec_id"), F.col("user_id").alias("track"), F.col("event_id").alias("id"), ms.alias("start_ms"), (ms + F.round(F.col("value") * 1000).cast("bigint")).alias("end_ms"))
    return sequence.running_gaps(t, 3_600_000)


@query(
    r"""SELECT page_id, regexp_extract(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '([^.]+)\.[^.]+$', 1) AS platform,
coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+property="og:title"[^>]+content="([^"]*)"', 1), ''), nullif(regexp_extract(html, '(?is)<title>([^<]*)</title>', 1), '')) AS title,
coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+property="og:description"[^>]+content="([^"]*)"', 1), ''), nullif(regexp_extract(html, '(?i)<meta[^>]+name="description"[^>]+content="([^"]*)"', 1), '')) AS description,
nullif(regexp_extract(url, '/(\d+)', 1), '')::BIGINT AS number FROM pages"""
)
def page_metadata(spark, sf_dir):
    return readers.page_metadata(table(spark, sf_dir, "pages"))


@query(TL + SPK + " SELECT rec_id, seg_id, (sum(end_ms - start_ms + 300) OVER (PARTITION BY rec_id ORDER BY seg_id) - (end_ms - start_ms + 300))::BIGINT AS at_ms, end_ms - start_ms AS dur_ms FROM p")
def teaser_timeline(spark, sf_dir):
    p = sequence.speaker_segments(words(spark, sf_dir)).withColumn("dur_ms", F.col("end_ms") - F.col("start_ms"))
    return p.select("rec_id", "seg_id", (F.sum(F.col("dur_ms") + 300).over(sequence.order("seg_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("dur_ms") - 300).alias("at_ms"), "dur_ms")


KEEPS = MERGED + ", k1 AS (SELECT rec_id, start_ms, end_ms FROM m UNION ALL SELECT rec_id, max(end_ms), max(end_ms) FROM w GROUP BY rec_id), kp AS (SELECT * FROM (SELECT rec_id, coalesce(lag(end_ms) OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms), 0) AS start_ms, start_ms AS end_ms FROM k1) WHERE end_ms > start_ms)"


@query(KEEPS + ", d AS (SELECT rec_id, start_ms, end_ms - start_ms AS d FROM kp) SELECT rec_id, start_ms, d AS dur_ms, CASE WHEN d < 300 THEN 0 ELSE least(greatest(d * 8 // 100, 30), 300, d * 3 // 10) END::BIGINT AS fade_ms FROM d")
def fade_plan(spark, sf_dir):
    w = stored(spark, sf_dir)
    k = intervals.complement(intervals.merge(cuts(w)), intervals.durations(w)).withColumn("dur_ms", F.col("end_ms") - F.col("start_ms"))
    return k.select("rec_id", "start_ms", "dur_ms", formats.fade_ms(F.col("dur_ms")).alias("fade_ms"))


@query(TL + ", d AS (SELECT rec_id, max(end_ms) AS d FROM w GROUP BY rec_id), i AS (SELECT *, unnest(range(0, 7)) AS i FROM d) SELECT rec_id, i::BIGINT AS i, (d // 10 + d * 8 * i // 60)::BIGINT AS at_ms FROM i")
def sample_times(spark, sf_dir):
    d = intervals.durations(words(spark, sf_dir))
    return d.select("rec_id", F.posexplode(formats.sample_times(F.col("duration_ms"))).alias("i", "at_ms")).select("rec_id", F.col("i").cast("bigint").alias("i"), F.col("at_ms").cast("bigint").alias("at_ms"))


@query(
    TL + SPK + """, t AS (SELECT rec_id, seg_id, start_ms, end_ms, unnest(range(0, 5)) AS i FROM p)
SELECT rec_id, seg_id, i::BIGINT AS i, start_ms + (end_ms - start_ms) * i // 4 AS at_ms, CASE WHEN i IN (0, 4) THEN 100 WHEN least((end_ms - start_ms) * i // 4, end_ms - start_ms - (end_ms - start_ms) * i // 4) >= 500 THEN 20 ELSE 100 - 80 * least((end_ms - start_ms) * i // 4, end_ms - start_ms - (end_ms - start_ms) * i // 4) // 500 END::BIGINT AS volume FROM t"""
)
def volume_envelope(spark, sf_dir):
    # music at full volume between stretches of speech, ramped down to a fifth over half a second inside
    p = sequence.speaker_segments(words(spark, sf_dir)).withColumn("d", F.col("end_ms") - F.col("start_ms"))
    t = p.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("x", F.expr("d * i div 4")).withColumn("edge", F.expr("least(x, d - x)"))
    volume = F.when(F.col("i").isin(0, 4), 100).when(F.col("edge") >= 500, 20).otherwise(F.expr("100 - 80 * edge div 500"))
    return t.select("rec_id", "seg_id", F.col("i").cast("bigint").alias("i"), (F.col("start_ms") + F.col("x")).alias("at_ms"), volume.cast("bigint").alias("volume"))


T4 = TL + """, n AS (SELECT rec_id, sent_idx, text AS a, lead(text) OVER (PARTITION BY rec_id ORDER BY sent_idx) AS b FROM s),
c AS (SELECT *, coalesce(list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2), lambda k: CASE WHEN contains(b, substr(a, i, k)) THEN k ELSE 0 END)))), 0) AS l FROM n WHERE b IS NOT NULL)
SELECT rec_id, sent_idx, CASE WHEN a = b THEN 'exact' WHEN contains(a, b) OR contains(b, a) THEN 'contained' WHEN 2 * l >= least(length(a), length(b)) THEN 'common' ELSE 'none' END AS match, l::BIGINT AS n_common FROM c"""


@query(T4)
def text_match_ladder(spark, sf_dir):
    # each sentence against the one after it
    s = sequence.sentences(words(spark, sf_dir)).select("rec_id", "sent_idx", F.col("text").alias("a"), F.lead("text").over(sequence.order("sent_idx")).alias("b"))
    s = evaluate.with_common(s.filter("b is not null"), "a", "b", "n_common")
    return s.select("rec_id", "sent_idx", evaluate.match_ladder("a", "b", F.col("n_common")).alias("match"), "n_common")


# what is kept is a part of what was there, so of the longest common words the way back takes the last places: one fold from the end
LCS = MERGED + KEPT + """, xs AS (SELECT rec_id, list({'i': word_idx, 't': tok} ORDER BY word_idx DESC) AS xs FROM w GROUP BY rec_id), ys AS (SELECT rec_id, list(tok ORDER BY word_idx) AS ys FROM kw GROUP BY rec_id),
lf AS (SELECT rec_id, list_reduce(xs, lambda a, x: CASE WHEN a.j > 0 AND x.t = coalesce(ys, [])[a.j] THEN {'j': a.j - 1, 'm': a.m} ELSE {'j': a.j, 'm': list_append(a.m, x.i)} END, {'j': len(coalesce(ys, [])), 'm': []::BIGINT[]}).m AS m FROM xs LEFT JOIN ys USING (rec_id)),
ms AS (SELECT w.* FROM (SELECT rec_id, unnest(m) AS word_idx FROM lf) u JOIN w USING (rec_id, word_idx)),
mi AS (SELECT *, coalesce(start_ms - lag(end_ms) OVER (PARTITION BY rec_id ORDER BY word_idx) >= 1000, false)::INT AS b FROM ms), mr AS (SELECT *, sum(b) OVER (PARTITION BY rec_id ORDER BY word_idx) AS run FROM mi)
SELECT rec_id, min(word_idx) AS w_from, max(word_idx) AS w_to, count(*) AS n_words, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM mr GROUP BY rec_id, run HAVING count(*) >= 3"""


@query(LCS)
def lcs_missing_runs(spark, sf_dir):
    w = stored(spark, sf_dir)
    return align.missing_runs(align.missing_words(w, intervals.kept_words(w, intervals.merge(cuts(w)))))


@query(None)
def align_before_after(spark, sf_dir):
    w = stored(spark, sf_dir)
    return align.align_sentences(sequence.sentences(w), sequence.sentences(intervals.kept_words(w, intervals.merge(cuts(w)))))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS from_ts, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL")
def stream_tumbling_counts(spark, sf_dir):
    return streams.tumbling_counts(table(spark, sf_dir, "events"))


@query(
    """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), x AS (SELECT *, sum((p IS NOT NULL AND ts - p > INTERVAL 12 HOUR)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS from_ts, count(*) AS n FROM x GROUP BY user_id, k"""
)
def stream_session_gaps(spark, sf_dir):
    return streams.session_counts(table(spark, sf_dir, "events"))
