"""Readers, writers and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from utterframe.sources import readers, writers
from utterframe.streaming import events as streams

SF = "/root/testdata/sf0.001"


def test_words_in_three_shapes(spark, tmp_path):
    words = [{"text": "[A]", "start": 0, "end": 0, "isSpeakerLabel": True, "speaker": "A"}, {"word": "hi", "start": 0.5, "end": 0.75}, {"isGap": True, "start": 0.75, "end": 1.5}, {"w": "you", "s": 1.5, "e": 1.7}]
    for name, doc in (("a", words), ("b", {"words": words}), ("c", {"subtitles": [{"words": words[:2]}, {"words": words[2:]}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    rows = readers.read_words(spark, str(tmp_path)).orderBy("rec_id", "item_pos").collect()
    assert len(rows) == 12
    for k in range(3):
        assert [(r["kind"], r["word_idx"], r["text"], r["start_ms"], r["end_ms"]) for r in rows[4 * k : 4 * k + 4]] == [("label", None, "[A]", 0, 0), ("word", 0, "hi", 500, 750), ("gap", None, "", 750, 1500), ("word", 1, "you", 1500, 1700)]


def test_sentences_round_trip(spark, tmp_path):
    (tmp_path / "s.txt").write_text("0|0-3|A|one|two\n\nbad line\n1|4-6|B|three\n")
    rows = readers.read_sentences(spark, f"{tmp_path}/s.txt").orderBy("sent_idx")
    assert [tuple(r)[1:] for r in rows.collect()] == [(0, 0, 3, "A", "one|two"), (1, 4, 6, "B", "three")]
    writers.write_sentences(rows, f"{tmp_path}/out")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()) == ["0|0-3|A|one|two", "1|4-6|B|three"]


def test_recognition_documents(spark):
    doc = {"transcripts": [{"sentences": [{"sentence_id": 1, "speaker_id": 0, "words": [{"text": "hi", "begin_time": 10, "end_time": 20, "punctuation": ","}, {"text": "x", "begin_time": 20, "end_time": 30}]}, {"sentence_id": 2, "speaker_id": 7, "words": [{"text": "y", "begin_time": 40, "end_time": 50}]}]}]}
    docs = spark.createDataFrame([("r", json.dumps(doc))], "rec_id string, body string").select("rec_id", F.from_json("body", readers.RECOGNITION).alias("d")).select("rec_id", "d.*")
    names = spark.createDataFrame([("0", "Alice")], "speaker_id string, name string")
    rows = readers.flatten_recognition(docs, names).orderBy("start_ms").collect()
    assert [(r["text"], r["start_ms"], r["speaker"]) for r in rows] == [("hi,", 10, "Alice"), ("x", 20, "Alice"), ("y", 40, "Speaker 7")]
    whisper = {"segments": [{"id": 0, "words": [{"word": " hi", "start": 0.5, "end": 1.0, "probability": 0.9}]}]}
    w = spark.createDataFrame([("r", json.dumps(whisper))], "rec_id string, body string").select("rec_id", F.from_json("body", readers.WHISPER).alias("d")).select("rec_id", "d.*")
    assert [(r["text"], r["start_ms"], r["end_ms"]) for r in readers.flatten_whisper(w).collect()] == [("hi", 500, 1000)]


def test_tracks(spark):
    w = spark.createDataFrame([("r", "t1", 100, 200), ("r", "t2", 100, 200)], "rec_id string, track string, start_ms long, end_ms long")
    o = spark.createDataFrame([("r", "t1", -150), ("r", "t9", 5)], "rec_id string, track string, offset_ms long")
    assert sorted((r["track"], r["start_ms"], r["end_ms"]) for r in readers.shift_tracks(w, o).collect()) == [("t1", 0, 50), ("t2", 100, 200)]
    t = spark.createDataFrame([("r", "t1", "A"), ("r", "t2", "A")], "rec_id string, track string, speaker string")
    assert sorted((r["fault"], r["name"]) for r in readers.track_faults(t, o).collect()) == [("duplicate speaker", "A"), ("unknown offset", "t9")]


def test_feedback_rules_and_json(spark, tmp_path):
    (tmp_path / "feedback_1.json").write_text("{}")
    (tmp_path / "other.json").write_text("{}")
    assert [r["file"] for r in readers.read_feedback(spark, str(tmp_path)).collect()] == ["feedback_1.json"]
    base = spark.createDataFrame([("silence", "max", "0.8"), ("silence", "keep", "0.6")], "rule string, key string, value string")
    user = spark.createDataFrame([("u", "silence", "max", "1.5")], "user_id string, rule string, key string, value string")
    assert sorted((r["key"], r["value"]) for r in readers.merge_rules(base, user).collect()) == [("keep", "0.6"), ("max", "1.5")]
    texts = ['{"a": 1}', 'so:\n```json\n{"a": 2}\n```', 'well {"a": 3} then', "none", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(readers.salvage_json(F.col("t"), "a int").alias("j")).collect()
    assert [r["j"] and r["j"]["a"] for r in got] == [1, 2, 3, None, None]


def test_sinks(spark, tmp_path):
    log = f"{tmp_path}/log"
    for v in (1, 2):
        writers.append_log(spark.createDataFrame([("u", v)], "user string, v int"), log)
    rows = spark.read.parquet(log)
    assert rows.count() == 2 and [r["v"] for r in writers.latest(rows, ["user"], "v").collect()] == [2]
    to = writers.write_version(rows, f"{tmp_path}/v", 3, dry_run=True)
    assert to.endswith("version=000003") and not (tmp_path / "v").exists()
    writers.write_version(rows, f"{tmp_path}/v", 3)
    assert spark.read.parquet(f"{tmp_path}/v").count() == 2
    issues = spark.createDataFrame([("r", "high", 65000, "gap", "x"), ("r", "low", 1000, "gap", None)], "rec_id string, severity string, time_ms long, type string, detail string")
    md = writers.report(issues).first()
    assert md["markdown"].splitlines()[2].startswith("- **high** 1:05 gap: x") and not md["passed"]
    writers.write_json(issues, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2


def run_stream(spark, df, name, tmp_path, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    path = f"{tmp_path}/events"
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(path)
    e = spark.read.parquet(path)
    # a complete result keeps every window, so it equals the batch
    t = run_stream(spark, streams.tumbling_counts(streams.stream(spark, path, 1)), "tumbling", tmp_path / "a", "complete")
    assert sorted(map(str, t.collect())) == sorted(map(str, streams.tumbling_counts(e).collect()))
    s = run_stream(spark, streams.session_counts(streams.stream(spark, path, 10)), "sessions", tmp_path / "b", "complete")
    assert sorted(map(str, s.collect())) == sorted(map(str, streams.session_counts(e).collect()))
    o = run_stream(spark, streams.once(streams.stream(spark, path, 10).union(streams.stream(spark, path, 10))), "once", tmp_path / "c", "append")
    assert o.count() == e.count()
