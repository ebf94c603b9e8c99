"""Sources, sinks and scalar formats: what is written is read again, what a document holds is laid flat."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterframe.durable import scratch
from utterframe.functions import formats
from utterframe.operators import evaluate, review, sequence
from utterframe.queries import query, table
from utterframe.queries.base import TL, words
from utterframe.queries.feedback import FR, SEV
from utterframe.sources import readers, writers


@query(TL + " SELECT rec_id, word_idx, tok, speaker, start_ms, end_ms FROM w")
def words_json(spark, sf_dir):
    # A document {words: [..]} for each recording, written and read; the text carries the recording
    w = words(spark, sf_dir).select("rec_id", "word_idx", F.struct(F.concat_ws(":", "rec_id", "tok").alias("text"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "speaker").alias("x"))
    docs = w.groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "x"))), lambda y: y["x"]).alias("words"))
    path = scratch(spark, "words")
    docs.select(F.to_json(F.struct("words")).alias("value"), "rec_id").write.partitionBy("rec_id").text(path)
    r = readers.read_words(spark, path, "file_path").withColumn("p", F.split("text", ":", 2))
    return r.select(F.col("p")[0].cast("bigint").alias("rec_id"), "word_idx", F.col("p")[1].alias("tok"), "speaker", "start_ms", "end_ms")


@query(TL + " SELECT rec_id, sent_idx, w_start, w_end, text FROM s")
def sentence_lines(spark, sf_dir):
    # K2 and S2; the speaker's field carries the recording
    path = scratch(spark, "sentences")
    writers.write_sentences(sequence.sentences(words(spark, sf_dir)).withColumn("speaker", F.col("rec_id").cast("string")), path)
    return readers.read_sentences(spark, path).select(F.col("speaker").cast("bigint").alias("rec_id"), "sent_idx", "w_start", "w_end", "text")


@query(TL + " SELECT rec_id, turn, count(*) AS n, sum(end_ms - start_ms)::BIGINT AS spoken_ms FROM w GROUP BY ALL")
def turns_json(spark, sf_dir):
    # K1
    path = scratch(spark, "turns")
    writers.write_json(words(spark, sf_dir).groupBy("rec_id", "turn").agg(F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("spoken_ms")), path)
    return spark.read.schema("rec_id bigint, turn bigint, n bigint, spoken_ms bigint").json(path)


def _names(spark):
    return spark.createDataFrame([(0, "ann"), (1, "bob"), (1, "bob")], "speaker_id int, name string")


@query(
    TL + """ SELECT rec_id, 0 AS ti, sent_idx::INT AS si, i::INT AS wi, tok || CASE WHEN word_idx % 2 = 1 THEN ',' ELSE '' END AS text, start_ms, end_ms, CASE sent_idx % 3 WHEN 0 THEN 'ann' WHEN 1 THEN 'bob' ELSE 'Speaker 2' END AS speaker FROM pw"""
)
def recognition_words(spark, sf_dir):
    # Nested documents laid flat, speakers by name
    mark = F.when(F.col("word_idx") % 2 == 1, ",")
    w = words(spark, sf_dir).select("rec_id", "sent_idx", "word_idx", F.struct(F.col("tok").alias("text"), F.col("start_ms").alias("begin_time"), F.col("end_ms").alias("end_time"), mark.alias("punctuation")).alias("x"))
    s = w.groupBy("rec_id", "sent_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "x"))), lambda y: y["x"]).alias("words"))
    s = s.select("rec_id", "sent_idx", F.struct(F.col("sent_idx").alias("sentence_id"), (F.col("sent_idx") % 3).cast("int").alias("speaker_id"), F.lit("").alias("text"), F.lit(0).cast("bigint").alias("begin_time"), F.lit(0).cast("bigint").alias("end_time"), "words").alias("s"))
    d = s.groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "s"))), lambda y: y["s"]).alias("sentences"))
    docs = d.select("rec_id", F.array(F.struct("sentences")).cast(readers.RECOGNITION.split(" ", 1)[1]).alias("transcripts"))
    return readers.flatten_recognition(docs, _names(spark))


@query(TL + " SELECT rec_id, word_idx, CASE WHEN speaker = 'user' THEN greatest(0, start_ms - 1500) ELSE start_ms END AS start_ms, CASE WHEN speaker = 'user' THEN greatest(0, end_ms - 1500) ELSE end_ms END AS end_ms FROM w")
def track_offsets(spark, sf_dir):
    # One track of two is moved
    w = words(spark, sf_dir).withColumn("track", F.col("speaker"))
    offsets = w.filter("track = 'user'").select("rec_id", "track", F.lit(-1500).alias("offset_ms")).distinct()
    return readers.shift_tracks(w, offsets).select("rec_id", "word_idx", "start_ms", "end_ms")


@query(
    """WITH t AS (SELECT DISTINCT user_id AS rec_id, event_type AS track, CASE event_type WHEN 'view' THEN 'click' ELSE event_type END AS speaker FROM events)
SELECT rec_id, 'duplicate speaker' AS fault, speaker AS name FROM t GROUP BY rec_id, speaker HAVING count(*) > 1 UNION ALL SELECT DISTINCT user_id, 'unknown offset', 'drums' FROM events"""
)
def track_faults(spark, sf_dir):
    # S5 and U2
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), F.col("event_type").alias("track"), F.when(F.col("event_type") == "view", "click").otherwise(F.col("event_type")).alias("speaker")).distinct()
    offsets = t.select("rec_id").distinct().withColumn("track", F.lit("drums")).unionByName(t.select("rec_id", "track"))
    return readers.track_faults(t, offsets)


@query("SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1")
def feedback_files(spark, sf_dir):
    # A file for each user, read as one text
    path = scratch(spark, "feedback")
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    e.select(F.to_json(F.struct(F.col("user_id").alias("key"), "n"), {"pretty": "true"}).alias("value"), "user_id").write.partitionBy("user_id").text(path)
    return readers.read_feedback(spark, path, "part-*").select(F.from_json("body", "key bigint, n bigint").alias("x")).select("x.*")


@query(
    """SELECT event_id AS key, event_id AS number, event_type AS name, '' AS description, CASE event_id % 5 WHEN 0 THEN 'a,' || event_type ELSE '' END AS theme, CASE event_id % 5 WHEN 1 THEN NULL ELSE 'artist ' || user_id END AS artist, user_id AS n_tracks, CASE event_id % 5 WHEN 0 THEN 'big' ELSE 'small' END AS artwork
FROM events WHERE event_id % 5 IN (0, 1, 2)"""
)
def lookup_profiles(spark, sf_dir):
    # Answers with all fields, with few, with a result of other names, without a result, and no JSON at all
    kind, none = F.col("event_id") % 5, F.lit(None).cast("string")
    of = lambda name, artist, art, genres: F.struct(F.col("event_type").alias(name), artist.alias("artistName"), F.col("user_id").alias("trackCount"), F.lit("small").alias("artworkUrl100"), art.alias("artworkUrl600"), genres.alias("genres"))
    artist, genres = F.concat(F.lit("artist "), "user_id"), F.array(F.lit("a"), "event_type")
    body = (
        F.when(kind == 0, F.to_json(F.struct(F.array(of("collectionName", artist, F.lit("big"), genres)).alias("results"))))
        .when(kind == 1, F.to_json(F.struct(F.array(of("trackName", none, none, F.lit(None).cast("array<string>"))).alias("results"))))
        .when(kind == 2, F.to_json(F.struct(F.array(of("trackName", artist, F.lit(""), F.array().cast("array<string>"))).alias("results"))))
        .when(kind == 3, '{"resultCount": 0, "results": []}')
        .otherwise("<html>")
    )
    answers = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.concat(F.lit("https://example.org/show/id"), "event_id", F.lit("?x=1")).alias("url"), body.alias("body"))
    p = readers.lookup_profiles(answers)
    return p.select("key", "number", "name", "description", F.array_join("theme", ",").alias("theme"), "artist", "n_tracks", "artwork")


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE round(value)::BIGINT END AS score FROM events")
def salvaged_json(spark, sf_dir):
    # An answer that is JSON, holds a fenced block, is wrapped in prose, or has none
    doc = F.to_json(F.struct(F.round("value").cast("bigint").alias("score")))
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, doc).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), doc, F.lit("\n```\nDone."))).when(kind == 2, F.concat(F.lit("The answer is "), doc, F.lit(", I think."))).otherwise("I cannot say.")
    return table(spark, sf_dir, "events").select("event_id", readers.salvage_json(text, "score bigint")["score"].alias("score"))


@query("SELECT event_id, event_type, (event_id % 3 = 0)::BIGINT AS version FROM events")
def latest_of_log(spark, sf_dir):
    # K3 and K4: two appends to a log, the last version of each row
    path = scratch(spark, "log")
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    writers.append_log(e.withColumn("version", F.lit(0).cast("bigint")), path)
    writers.append_log(e.filter("event_id % 3 = 0").withColumn("version", F.lit(1).cast("bigint")), path)
    return writers.latest(spark.read.parquet(path), ["event_id"], "version").select("event_id", "event_type", "version")


@query("SELECT event_type, count(*) AS n, 2::BIGINT AS version FROM events GROUP BY event_type")
def kept_versions(spark, sf_dir):
    # K5: versions side by side; a dry run writes none
    path = scratch(spark, "versions")
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    writers.write_version(n.limit(0), path, 1)
    writers.write_version(n, path, 2)
    writers.write_version(n.withColumn("n", F.lit(-1).cast("bigint")), path, 3, dry_run=True)
    return spark.read.parquet(path).select("event_type", "n", F.col("version").cast("bigint").alias("version"))


@query(
    TL + """, i AS (SELECT rec_id, gap_start AS time_ms, CASE WHEN gap_ms > 2000 THEN 'high' WHEN gap_ms > 1000 THEN 'medium' ELSE 'low' END AS severity, gap_ms::VARCHAR || ' ms' AS detail FROM g),
l AS (SELECT *, CASE WHEN time_ms // 3600000 > 0 THEN (time_ms // 3600000)::VARCHAR || ':' || lpad((time_ms // 60000 % 60)::VARCHAR, 2, '0') ELSE (time_ms // 60000 % 60)::VARCHAR END || ':' || lpad((time_ms // 1000 % 60)::VARCHAR, 2, '0') AS clock, CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS r FROM i)
SELECT rec_id, '# Issues' || chr(10) || chr(10) || string_agg('- **' || severity || '** ' || clock || ' pause: ' || detail, chr(10) ORDER BY r, time_ms) || chr(10) AS markdown, false AS passed FROM l GROUP BY rec_id"""
)
def issue_report(spark, sf_dir):
    # K6 and K9
    g = sequence.gaps(words(spark, sf_dir))
    severity = F.when(F.col("gap_ms") > 2000, "high").when(F.col("gap_ms") > 1000, "medium").otherwise("low")
    return writers.report(g.select("rec_id", F.col("gap_start").alias("time_ms"), severity.alias("severity"), F.lit("pause").alias("type"), F.concat(F.col("gap_ms").cast("string"), F.lit(" ms")).alias("detail")))


@query(
    TL + f""", x AS (SELECT rec_id, word_idx, '，' || raw || '。 ' || tok || '！' AS t FROM w)
SELECT rec_id, word_idx, regexp_replace(t, '{formats.FILLER_PUNCTUATION}', '', 'g') AS bare, regexp_replace(regexp_replace(t, '^[，。！？、：；\\"''（）\\s]+', ''), '[，。！？、：；\\"''（）\\s]+$', '') AS inner_text, regexp_replace(t, '[\\s\\p{{P}}]+', '', 'g') AS plain,
  regexp_replace(regexp_replace(t, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM x"""
)
def text_forms(spark, sf_dir):
    # P2, P3, P4 and P14
    t = words(spark, sf_dir).withColumn("t", F.concat(F.lit("，"), "raw", F.lit("。 "), "tok", F.lit("！")))
    return t.select("rec_id", "word_idx", formats.strip_class(F.col("t")).alias("bare"), formats.strip_ends(F.col("t")).alias("inner_text"), formats.normalise(F.col("t")).alias("plain"), formats.slug(F.col("t")).alias("slug"))


@query(
    FR + f""", i AS (SELECT user_id AS key, {SEV} AS sv FROM events), a AS (SELECT key, greatest(100 - 8 * count(*) FILTER (sv = 'high') - 3 * count(*) FILTER (sv = 'medium') - count(*) FILTER (sv = 'low'), 10) AS x FROM i WHERE key % 3 <> 0 GROUP BY key),
b AS (SELECT key, (sum(v) // count(*) // 10)::BIGINT AS y FROM f WHERE key % 3 <> 1 GROUP BY key) SELECT key, CASE WHEN y IS NULL THEN x * 10 WHEN x IS NULL THEN y * 10 ELSE x * 4 + y * 6 END::BIGINT AS score100 FROM a FULL JOIN b USING (key)"""
)
def combined_score(spark, sf_dir):
    # A signal score, a listening score, or both
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "purchase", "medium").otherwise("low")
    a = evaluate.severity_score(e.filter("user_id % 3 <> 0").select(F.col("user_id").alias("key"), severity.alias("severity"))).select("key", F.col("score10").alias("x"))
    b = e.filter("user_id % 3 <> 1").groupBy(F.col("user_id").alias("key")).agg(F.expr("sum(cast(round(value * 100) as bigint)) div count(*) div 10").alias("y"))
    return a.join(b, "key", "full").select("key", evaluate.merged_score(F.col("x"), F.col("y")).cast("bigint").alias("score100"))


@query("SELECT event_id, event_type AS type FROM events WHERE event_type IN ('click', 'view')")
def conversation_issues(spark, sf_dir):
    # Only the types that a conversation does not excuse
    return review.conversation_mode(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type")), ("click", "view"))


@query("SELECT user_id AS key, least(5000 + 1000 * count(*) FILTER (event_type = 'error'), 9500)::BIGINT AS confidence_bp FROM events GROUP BY 1")
def confidence_ramp(spark, sf_dir):
    # P12
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(formats.ramp(F.count_if(F.col("event_type") == "error")).cast("bigint").alias("confidence_bp"))


@query(
    """WITH b AS (SELECT 'silence' AS rule, 'threshold' AS key, '3.0' AS value UNION ALL SELECT 'fillers', 'mode', 'review' UNION ALL SELECT 'errors', 'mode', NULL), u AS (SELECT user_id, 'errors' AS rule, 'mode' AS key, count(*)::VARCHAR AS value FROM events WHERE event_type = 'error' GROUP BY user_id
UNION ALL SELECT user_id, 'silence', 'threshold', max(event_id)::VARCHAR FROM events WHERE user_id % 2 = 0 GROUP BY user_id)
SELECT us.user_id, b.rule, b.key, coalesce(u.value, b.value) AS value FROM (SELECT DISTINCT user_id FROM u) us CROSS JOIN b LEFT JOIN u ON u.user_id = us.user_id AND u.rule = b.rule AND u.key = b.key"""
)
def user_rules(spark, sf_dir):
    # A user's values win over the base's
    base = spark.createDataFrame([("silence", "threshold", "3.0"), ("fillers", "mode", "review"), ("errors", "mode", None)], "rule string, key string, value string")
    e = table(spark, sf_dir, "events")
    errors = e.filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").cast("string").alias("value")).select("user_id", F.lit("errors").alias("rule"), F.lit("mode").alias("key"), "value")
    even = e.filter("user_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").cast("string").alias("value")).select("user_id", F.lit("silence").alias("rule"), F.lit("threshold").alias("key"), "value")
    return readers.merge_rules(base, errors.unionByName(even))
