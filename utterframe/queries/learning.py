"""Learning from corrections: thresholds, summaries, styles, gold sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterframe.operators import evaluate, resolve, review, sequence
from utterframe.plans import edit_style
from utterframe.queries import query, table
from utterframe.queries.base import CUTS, P, TL, cuts, quoted, stored, words
from utterframe.queries.feedback import SEV

FILLERS = (*P.fillers, *P.ambiguous)

# sentences that hold a cut count as deleted
SAMPLE = CUTS + """, sm AS (SELECT s.*, (rec_id, sent_idx) IN (SELECT (rec_id, sent_idx) FROM cut) AS deleted, lead(start_ms) OVER (PARTITION BY rec_id ORDER BY sent_idx) - end_ms AS gap_after FROM s),
sample AS (SELECT *, sum(deleted::INT) OVER (PARTITION BY rec_id ORDER BY sent_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) - deleted::INT AS n_near FROM sm),
lg AS (SELECT rec_id, gap_after AS gap_ms, row_number() OVER (PARTITION BY rec_id ORDER BY gap_after) AS k FROM sample WHERE deleted AND gap_after > 500),
th AS (SELECT rec_id, count(*) AS n, ((min(gap_ms) + 50) // 100)::BIGINT AS threshold_ds, string_agg(gap_ms::VARCHAR, ',' ORDER BY k) FILTER (k <= 10) AS smallest FROM lg GROUP BY rec_id)"""


def _sample(spark, sf_dir):
    w = stored(spark, sf_dir)
    return edit_style.marked(sequence.sentences(w), cuts(w))


@query(SAMPLE + " SELECT * FROM th")
def silence_threshold(spark, sf_dir):
    return evaluate.silence_threshold(_sample(spark, sf_dir).filter("deleted").select("rec_id", F.col("gap_after").alias("gap_ms")))


@query(
    SAMPLE + f""", c AS (SELECT *, CASE WHEN text IN ({quoted(FILLERS)}) THEN 'filler_word' WHEN (SELECT bool_or(substr(t, i, k) = substr(t, i + k, k) AND i + 2 * k - 1 <= length(t)) FROM (SELECT replace(text, ' ', '') AS t), (SELECT unnest(range(1, length(replace(text, ' ', '')) + 1)) AS i), (VALUES (1), (2), (3)) v(k)) THEN 'stutter'
  WHEN length(text) < 5 THEN 'residual' WHEN n_near >= 2 THEN 'content_block' WHEN gap_after > 2000 THEN 'silence_related' ELSE 'other' END AS type FROM sample WHERE deleted)
SELECT rec_id, type, count(*) AS n, sum(end_ms - start_ms)::BIGINT AS total_ms FROM c GROUP BY rec_id, type"""
)
def style_classes(spark, sf_dir):
    return edit_style.classes(_sample(spark, sf_dir), FILLERS)


@query(
    SAMPLE + f""", e AS (SELECT rec_id, deleted, text, unnest([{quoted(FILLERS)}]) AS filler FROM sample), n AS (SELECT *, (length(text) - length(replace(text, filler, ''))) // length(filler) AS n FROM e),
fr AS (SELECT rec_id, filler, sum(n) AS total, sum(CASE WHEN deleted THEN n ELSE 0 END) AS gone FROM n GROUP BY rec_id, filler HAVING sum(n) > 0), p AS (SELECT *, (gone * 200 + total) // (2 * total) AS pct FROM fr),
sh AS (SELECT rec_id, 100 * sum(deleted::INT) / count(*) AS pct FROM sample GROUP BY rec_id)
SELECT rec_id, 'filler_words' AS rule, 'set_high_deletion' AS action, string_agg(filler, ',' ORDER BY filler) AS value, 8500::BIGINT AS confidence_bp FROM p WHERE pct > 60 GROUP BY rec_id
UNION ALL SELECT rec_id, 'filler_words', 'preserve', string_agg(filler, ',' ORDER BY filler), 8000 FROM p WHERE pct < 30 GROUP BY rec_id
UNION ALL SELECT rec_id, 'silence', 'set_threshold', threshold_ds::VARCHAR, 7500 FROM th
UNION ALL SELECT rec_id, 'aggressiveness', 'set', CASE WHEN pct < 15 THEN 'conservative' WHEN pct < 30 THEN 'moderate' ELSE 'aggressive' END, 9000 FROM sh"""
)
def style_recommendations(spark, sf_dir):
    return edit_style.recommendations(_sample(spark, sf_dir), FILLERS)


# runs of deleted sentences as blocks
BLOCKS = SAMPLE + """, bk AS (SELECT rec_id, min(sent_idx) AS s_from, max(sent_idx) AS s_to, row_number() OVER (PARTITION BY rec_id ORDER BY min(sent_idx)) - 1 AS block_id FROM (SELECT rec_id, sent_idx, sent_idx - row_number() OVER (PARTITION BY rec_id ORDER BY sent_idx) AS run FROM sample WHERE deleted) GROUP BY rec_id, run),
bt AS (SELECT bk.*, a.start_ms, z.end_ms, z.end_ms - a.start_ms AS dur_ms FROM bk JOIN s a ON a.rec_id = bk.rec_id AND a.sent_idx = s_from JOIN s z ON z.rec_id = bk.rec_id AND z.sent_idx = s_to)"""


def _blocks(sample):
    run = F.col("sent_idx") - F.row_number().over(sequence.order("sent_idx"))
    b = sample.filter("deleted").withColumn("run", run).groupBy("rec_id", "run").agg(F.min("sent_idx").alias("s_from"), F.max("sent_idx").alias("s_to"))
    return b.withColumn("block_id", (F.row_number().over(sequence.order("s_from")) - 1).cast("bigint")).drop("run")


@query(BLOCKS + " SELECT rec_id, block_id, s_from, s_to, start_ms, end_ms, dur_ms FROM bt")
def block_durations(spark, sf_dir):
    sample = _sample(spark, sf_dir)
    return resolve.block_times(sample, _blocks(sample)).select("rec_id", "block_id", "s_from", "s_to", "start_ms", "end_ms", "dur_ms")


@query(
    BLOCKS + """, c AS (SELECT rec_id, count(*) AS n_blocks, sum(s_to - s_from + 1) AS n_deleted, sum(dur_ms) AS deleted_ms FROM bt GROUP BY rec_id), t AS (SELECT rec_id, max(end_ms) AS total_ms, count(*) AS n_sentences FROM s GROUP BY rec_id)
SELECT rec_id, total_ms, n_sentences, coalesce(n_blocks, 0) AS n_blocks, coalesce(n_deleted, 0)::BIGINT AS n_deleted, coalesce(deleted_ms, 0)::BIGINT AS deleted_ms, ((coalesce(deleted_ms, 0) * 2000 + total_ms) // (2 * total_ms))::BIGINT AS ratio_pm FROM t LEFT JOIN c USING (rec_id)"""
)
def rough_cut_summary(spark, sf_dir):
    sample = _sample(spark, sf_dir)
    return resolve.rough_cut(sample, _blocks(sample))


@query(
    """WITH m AS (SELECT user_id, list(CASE event_type WHEN 'error' THEN 1 ELSE -1 END ORDER BY ts, event_id) AS ms FROM events WHERE event_type IN ('error', 'click') GROUP BY user_id)
SELECT user_id AS key, list_reduce(ms, lambda s, x: least(greatest(s + x, 3), 12), 6)::BIGINT AS level, len(ms)::BIGINT AS n_moves FROM m"""
)
def silence_ladder(spark, sf_dir):
    # half seconds: restored silences raise the threshold, missed ones lower it
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("at"), "event_type")
    return evaluate.ladder(e, F.col("event_type") == "error", F.col("event_type") == "click", start=6, top=12, bottom=3)


@query(
    """WITH k AS (SELECT lang AS type, count(*) AS n, least(5000 + 1000 * count(*), 9500)::BIGINT AS confidence_bp, list(doc_id ORDER BY doc_id)[1:3] AS ids FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 2)
SELECT type, n, confidence_bp, array_to_string(ids, ',') AS examples, row_number() OVER (ORDER BY confidence_bp DESC, n DESC, type) AS place FROM k"""
)
def adjustments_by_confidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("lang is not null").select(F.col("lang").alias("type"), "doc_id")
    return evaluate.most_confident(evaluate.adjustments(d, "type", "doc_id"), "type")


# events as feedback: the day is the file, the user's group the recording, the user the sentence
GOLD = """WITH e AS (SELECT ts::DATE::VARCHAR AS file, user_id // 10 AS audio, user_id % 10 AS sentence, event_type AS speaker, round(value)::BIGINT::VARCHAR AS text, event_type AS type FROM events),
m AS (SELECT * FROM e WHERE type <> 'error'), r AS (SELECT * FROM e WHERE type = 'error')"""


@query(
    GOLD + """, a AS (SELECT audio, sentence, count(DISTINCT (text, type)) AS n FROM m GROUP BY ALL), b AS (SELECT audio, sentence, count(DISTINCT text) AS n FROM r GROUP BY ALL),
f AS (SELECT audio, sentence, speaker, row_number() OVER (PARTITION BY audio, sentence ORDER BY file, kind, speaker) AS k FROM (SELECT *, 0 AS kind FROM m UNION ALL SELECT *, 1 FROM r))
SELECT f.audio, f.sentence, speaker, coalesce(a.n, 0) AS n_expected, coalesce(b.n, 0) AS n_false FROM f LEFT JOIN a USING (audio, sentence) LEFT JOIN b USING (audio, sentence) WHERE k = 1"""
)
def gold_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("file"), F.expr("user_id div 10").alias("audio"), (F.col("user_id") % 10).alias("sentence"), F.col("event_type").alias("speaker"), F.round("value").cast("bigint").cast("string").alias("text"), F.col("event_type").alias("type"))
    return evaluate.merge_gold(e.filter("type <> 'error'"), e.filter("type = 'error'").drop("type"))


LAYERS = f"WITH i AS (SELECT event_id AS issue_id, {SEV} AS severity, CASE user_id % 4 WHEN 0 THEN 'data' WHEN 1 THEN 'signal' WHEN 2 THEN 'semantic' ELSE 'semantic_ai' END AS layer, CASE WHEN event_type = 'click' THEN 'pending' WHEN event_type = 'view' THEN 'ok' END AS status FROM events)"


@query(LAYERS + " SELECT 'high' AS filter, issue_id, severity, layer FROM i WHERE severity = 'high' UNION ALL SELECT 'semantic', issue_id, severity, layer FROM i WHERE layer IN ('semantic', 'semantic_ai') UNION ALL SELECT 'unconfirmed', issue_id, severity, layer FROM i WHERE coalesce(status, 'pending') = 'pending'")
def review_filters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "purchase", "medium").otherwise("low")
    layer = F.element_at(F.array(*map(F.lit, ("data", "signal", "semantic", "semantic_ai"))), (F.col("user_id") % 4 + 1).cast("int"))
    issues = e.select(F.col("event_id").alias("issue_id"), severity.alias("severity"), layer.alias("layer"))
    states = e.filter("event_type in ('click', 'view')").select(F.col("event_id").alias("issue_id"), F.when(F.col("event_type") == "click", "pending").otherwise("ok").alias("status"))
    named = lambda name, rows: rows.withColumn("filter", F.lit(name))
    return named("high", review.shown(issues, states, severity="high")).unionByName(named("semantic", review.shown(issues, states, layer="semantic"))).unionByName(named("unconfirmed", review.shown(issues, states, unconfirmed=True)))


@query(
    TL + """, s1 AS (SELECT rec_id, speaker, turn AS seg_id, min(start_ms) AS start_ms, max(end_ms) - min(start_ms) AS dur_ms, (sum(length(tok)) * 100 // count(*))::BIGINT AS level FROM w GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY rec_id, speaker ORDER BY seg_id) - 1 AS i, count(*) OVER (PARTITION BY rec_id, speaker) AS c FROM s1),
k AS (SELECT rec_id, speaker, c, unnest(range(0, least(c, 3))) AS j FROM (SELECT DISTINCT rec_id, speaker, c FROM a)), p AS (SELECT a.* FROM a JOIN k ON k.rec_id = a.rec_id AND k.speaker = a.speaker AND a.i = k.j * k.c // least(k.c, 3))
SELECT rec_id, speaker, (sum(level * dur_ms) // sum(dur_ms))::BIGINT AS level, count(*) AS n_segments FROM p WHERE dur_ms >= 300 GROUP BY rec_id, speaker"""
)
def speaker_loudness(spark, sf_dir):
    # turns as segments, the mean length of their words as their level, three of each speaker
    w = words(spark, sf_dir)
    s = w.groupBy("rec_id", "speaker", F.col("turn").alias("seg_id")).agg((F.max("end_ms") - F.min("start_ms")).alias("dur_ms"), F.expr("sum(length(tok)) * 100 div count(*)").alias("level"))
    return review.loudness(review.spaced_sample(s, ["rec_id", "speaker"], 3), ["rec_id", "speaker"])
