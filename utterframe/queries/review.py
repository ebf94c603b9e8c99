"""Review, routing, gains and look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterframe.functions import formats
from utterframe.operators import evaluate, review, sequence, signal
from utterframe.queries import query, table
from utterframe.queries.base import CUTS, MERGED, TL, cuts, numbered, segments, stored, words
from utterframe.queries.feedback import FR, NUM, SEV, SPK


@query(
    MERGED + """, x AS (SELECT rec_id, lag(end_ms) OVER (PARTITION BY rec_id ORDER BY word_idx) AS a, start_ms AS b FROM w), p AS (SELECT * FROM x WHERE b > a),
j AS (SELECT m.rec_id, seg_id, m.start_ms AS at_ms, max(a) AS a FROM m JOIN p ON p.rec_id = m.rec_id AND p.a <= m.start_ms GROUP BY ALL)
SELECT j.rec_id, seg_id, at_ms, b - p.a AS silence_ms, 'medium' AS severity FROM j JOIN p ON p.rec_id = j.rec_id AND p.a = j.a WHERE b >= at_ms AND p.a > at_ms - 2000 AND b < at_ms + 2000 AND (b - p.a < 100 OR b - p.a > 2000)"""
)
def unnatural_silence(spark, sf_dir):
    # the recording is cut where a segment begins
    w = stored(spark, sf_dir)
    pauses = review.pauses_between(w).filter("gap_ms > 0").select("rec_id", F.col("gap_start").alias("start_ms"), (F.col("gap_start") + F.col("gap_ms")).alias("end_ms"))
    return review.unnatural_silences(pauses, segments(w).select("rec_id", "seg_id", F.col("start_ms").alias("at_ms")))


@query(f"SELECT {SEV} AS severity, count(*) AS total, count(*) FILTER (event_type <> 'view' AND value >= 10) AS ok, count(*) FILTER (event_type <> 'view' AND value < 10) AS flagged, count(*) FILTER (event_type = 'view' OR value IS NULL) AS pending FROM events GROUP BY 1")
def review_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "purchase", "medium").otherwise("low")
    states = e.filter("event_type <> 'view' and value is not null").select(F.col("event_id").alias("issue_id"), F.when(F.col("value") >= 10, "ok").otherwise("flagged").alias("status"))
    return review.rollup_states(e.select(F.col("event_id").alias("issue_id"), severity.alias("severity")), states)


@query("SELECT CASE WHEN event_type IN ('error') THEN 'methodology' WHEN event_type IN ('click', 'purchase') THEN 'preference' ELSE 'none' END AS route, count(*) AS n FROM events GROUP BY 1")
def issue_routing(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(review.route(F.col("event_type"), ("error",), ("click", "purchase")).alias("route")).agg(F.count("*").alias("n"))


@query(FR + ", a AS (SELECT f.key, v, event_type FROM f JOIN events USING (event_id)), b AS (SELECT key, sum(v) AS s, count(v) AS n, count(*) FILTER (event_type = 'error') AS c FROM a GROUP BY key) SELECT key, greatest(coalesce(s * 100 // n, 500) - 50 * c, 100)::BIGINT AS score100 FROM b")
def listening_score(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    f = signal.frames(e).join(e.select("event_id", "event_type"), "event_id")
    return review.listening_score(f.select("key", F.col("v").alias("score"), (F.col("event_type") == "error").alias("confirmed")))


@query(
    TL + SPK + """, a AS (SELECT *, row_number() OVER (PARTITION BY rec_id, speaker ORDER BY seg_id) - 1 AS i, count(*) OVER (PARTITION BY rec_id, speaker) AS c FROM p),
k AS (SELECT rec_id, speaker, c, unnest(range(0, least(c, 30))) AS j FROM (SELECT DISTINCT rec_id, speaker, c FROM a))
SELECT a.rec_id, seg_id, a.speaker, end_ms - start_ms AS dur_ms FROM a JOIN k ON k.rec_id = a.rec_id AND k.speaker = a.speaker AND a.i = k.j * k.c // least(k.c, 30)"""
)
def loudness_sample(spark, sf_dir):
    return review.spaced_sample(sequence.speaker_segments(words(spark, sf_dir)), ["rec_id", "speaker"]).select("rec_id", "seg_id", "speaker", (F.col("end_ms") - F.col("start_ms")).alias("dur_ms"))


@query("WITH l AS (SELECT user_id AS key, event_type AS speaker, (sum(round(value * 100)::BIGINT) // count(*) // 10)::BIGINT AS level FROM events GROUP BY ALL), g AS (SELECT *, least(max(level) OVER (PARTITION BY key) - level, 60) AS up FROM l) SELECT key, speaker, CASE WHEN up < 5 THEN 0 ELSE up END::BIGINT AS gain FROM g")
def gain_plan(spark, sf_dir):
    level = F.expr("sum(cast(round(value * 100) as bigint)) div count(*) div 10")
    return review.gains(table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("speaker")).agg(level.alias("level")))


@query(f"WITH i AS (SELECT user_id AS key, count(*) AS n, count(*) FILTER ({SEV} = 'high') AS bad FROM events GROUP BY 1) SELECT key, ((n - bad) * 10000 // greatest(n, 1))::BIGINT AS rate_bp FROM i")
def pass_rate(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    return t.select("key", review.pass_rate(F.col("n"), F.col("bad")).cast("bigint").alias("rate_bp"))


@query(MERGED + ", d AS (SELECT rec_id, max(end_ms) AS total FROM w GROUP BY rec_id), c AS (SELECT rec_id, sum(end_ms - start_ms) AS certain FROM m GROUP BY rec_id) SELECT rec_id, total, coalesce(certain, 0)::BIGINT AS certain_ms, (greatest(total - total * 7 // 10, 0) - coalesce(certain, 0))::BIGINT AS gap_ms FROM d LEFT JOIN c USING (rec_id)")
def duration_gap(spark, sf_dir):
    w = stored(spark, sf_dir)
    c = segments(w).groupBy("rec_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("certain_ms"))
    d = w.groupBy("rec_id").agg(F.max("end_ms").alias("total")).join(c, "rec_id", "left").withColumn("certain_ms", F.coalesce("certain_ms", F.lit(0)))
    return d.select("rec_id", "total", "certain_ms", review.duration_gap(F.col("total"), F.expr("total * 7 div 10"), F.col("certain_ms")).alias("gap_ms"))


@query(CUTS + NUM + " SELECT rec_id, sent_idx, max(edit_id) AS edit_id, arg_max(type, edit_id) AS type FROM e GROUP BY rec_id, sent_idx")
def last_edit(spark, sf_dir):
    return review.last_edit(numbered(cuts(stored(spark, sf_dir))))


@query("SELECT user_id, count(DISTINCT event_type) FILTER (event_type IN ('click', 'view', 'purchase')) = 3 AS complete FROM events WHERE event_type IN ('click', 'view', 'purchase') AND value IS NOT NULL GROUP BY user_id")
def onboarding_check(spark, sf_dir):
    prefs = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("key"), "value")
    return review.complete(prefs, ("click", "view", "purchase"))


@query(
    TL + """, j AS (SELECT DISTINCT rec_id, sent_idx + i % 2 AS sent_idx, tok || ' ' || after AS span FROM pw WHERE after IS NOT NULL)
SELECT j.rec_id, j.sent_idx, span, coalesce(contains(text, span), false) AS valid, CASE WHEN contains(text, span) THEN left(text, instr(text, span) - 1) || substr(text, instr(text, span) + length(span)) END AS after_text FROM j LEFT JOIN s ON s.rec_id = j.rec_id AND s.sent_idx = j.sent_idx"""
)
def edit_contract(spark, sf_dir):
    from utterframe.operators import detect

    w = stored(spark, sf_dir)
    t = detect.placed(w).withColumn("after", F.lead("tok").over(sequence.order("word_idx", keys=detect.SENT))).filter("after is not null")
    spans = t.select("rec_id", (F.col("sent_idx") + F.col("i") % 2).alias("sent_idx"), F.concat_ws(" ", "tok", "after").alias("span")).distinct()
    return review.contract(spans, sequence.sentences(w))


@query(
    TL + """, l AS (SELECT rec_id, list([{'m': -gap_ms, 'a': gap_start}] ORDER BY -gap_ms, gap_start) AS xs FROM g GROUP BY rec_id),
f AS (SELECT rec_id, list_reduce(xs, lambda acc, x: CASE WHEN len(acc) < 10 AND len(list_filter(acc, lambda y: abs(y.a - x[1].a) < 5000)) = 0 THEN list_concat(acc, x) ELSE acc END) AS ks FROM l), k AS (SELECT rec_id, unnest(ks) AS k FROM f)
SELECT rec_id AS key, k.a AS at_ms, -k.m AS metric FROM k"""
)
def top_issues_spaced(spark, sf_dir):
    g = sequence.gaps(words(spark, sf_dir))
    return review.top_spaced(g.select(F.col("rec_id").alias("key"), F.col("gap_start").alias("at"), F.col("gap_ms").alias("metric")))


@query(TL + " SELECT s.rec_id, s.sent_idx, w_start, w_end, word_idx, tok FROM s JOIN w ON w.rec_id = s.rec_id AND word_idx BETWEEN w_start AND w_end")
def sentence_words(spark, sf_dir):
    w = words(spark, sf_dir)
    return review.sentence_join(sequence.sentences(w), w)


@query(
    TL + """, c AS (SELECT rec_id, word_idx, tok, unnest(range(1, length(tok) + 1)) AS i FROM w), k AS (SELECT *, unnest([1, 2, 3]) AS k FROM c)
SELECT rec_id, word_idx, tok FROM k WHERE i + 2 * k - 1 <= length(tok) AND substr(tok, i, k) = substr(tok, i + k, k) GROUP BY ALL"""
)
def repetition_regex(spark, sf_dir):
    return words(spark, sf_dir).filter(formats.has_repeat(F.col("tok"))).select("rec_id", "word_idx", "tok")


@query(TL + " SELECT rec_id, sent_idx, CASE WHEN start_ms // 3600000 > 0 THEN (start_ms // 3600000)::VARCHAR || ':' || lpad((start_ms // 60000 % 60)::VARCHAR, 2, '0') ELSE (start_ms // 60000 % 60)::VARCHAR END || ':' || lpad((start_ms // 1000 % 60)::VARCHAR, 2, '0') AS clock FROM s")
def clock_format(spark, sf_dir):
    return sequence.sentences(words(spark, sf_dir)).select("rec_id", "sent_idx", formats.clock(F.col("start_ms")).alias("clock"))


@query(f"SELECT user_id AS key, event_id AS issue_id, {SEV} AS severity FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END DESC, ts, event_id) <= 5")
def severity_then_time(spark, sf_dir):
    # O2: the head of each user's list, by severity, then time
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "purchase", "medium").otherwise("low")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(evaluate.rank_of(severity)), "ts", "event_id"))
    return e.withColumn("k", k).filter("k <= 5").select(F.col("user_id").alias("key"), F.col("event_id").alias("issue_id"), severity.alias("severity"))


@query(
    TL + """, a AS (SELECT *, (lag(speaker) OVER o <> speaker OR start_ms - lag(end_ms) OVER o > 500) AS b FROM w WINDOW o AS (PARTITION BY rec_id ORDER BY word_idx)),
x AS (SELECT *, sum(coalesce(b, false)::INT) OVER (PARTITION BY rec_id ORDER BY word_idx) AS part FROM a),
y AS (SELECT rec_id, part::BIGINT AS part, min(word_idx) AS w_start, max(word_idx) AS w_end, arg_min(speaker, word_idx) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM x GROUP BY rec_id, part)
SELECT *, lead(start_ms) OVER (PARTITION BY rec_id ORDER BY part) - end_ms AS gap_after FROM y"""
)
def pause_fold(spark, sf_dir):
    return sequence.sentences_by_pause(words(spark, sf_dir))
