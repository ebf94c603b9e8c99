"""Sources: JSON in several shapes, pipe-delimited text, nested recognition documents, pages, parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = "text string, word string, w string, start double, s double, end double, e double, isGap boolean, isSpeakerLabel boolean, speaker string"
RECOGNITION = "transcripts array<struct<sentences: array<struct<sentence_id: bigint, speaker_id: int, text: string, begin_time: bigint, end_time: bigint, words: array<struct<text: string, begin_time: bigint, end_time: bigint, punctuation: string>>>>>>"
WHISPER = "language string, duration double, segments array<struct<id: bigint, start: double, `end`: double, text: string, words: array<struct<text: string, word: string, start: double, `end`: double, probability: double>>>>"


def ms(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("bigint")


def read_words(spark: SparkSession, path: str, file: str = "file_name") -> DataFrame:
    """Words from files that hold a bare array, ``{words}`` or ``{subtitles: [{words}]}``, under any of their field names.

    One row per item in file order: ``rec_id`` (the file's name, or with ``file_path`` its path, where folders repeat names), ``item_pos``, ``word_idx`` (null for gaps and
    labels), ``kind``, ``text``, ``start_ms``, ``end_ms``, ``speaker``.
    """
    words = f"array<struct<{', '.join(f'`{a}`: {b}' for a, b in (x.split(' ', 1) for x in WORD.split(', ')))}>>"
    raw = spark.read.text(path, wholetext=True).select(F.col(f"_metadata.{file}").alias("rec_id"), "value")
    bare = F.from_json("value", words)
    doc = F.from_json("value", f"words {words}, subtitles array<struct<words: {words}>>")
    is_array = F.trim("value").startswith("[")
    items = F.when(is_array, bare).otherwise(F.coalesce(doc["words"], F.flatten(F.transform(doc["subtitles"], lambda s: s["words"]))))
    x = raw.select("rec_id", F.posexplode(items).alias("item_pos", "i"))
    kind = F.when(F.coalesce("i.isSpeakerLabel", F.lit(False)), "label").when(F.coalesce("i.isGap", F.lit(False)), "gap").otherwise("word")
    x = x.select("rec_id", F.col("item_pos").cast("bigint").alias("item_pos"), kind.alias("kind"), F.coalesce("i.text", "i.word", "i.w", F.lit("")).alias("text"), ms(F.coalesce("i.start", "i.s")).alias("start_ms"), ms(F.coalesce("i.end", "i.e")).alias("end_ms"), F.col("i.speaker").alias("speaker"))
    return number_words(x)


def number_words(items: DataFrame) -> DataFrame:
    """P1's view: the index of an item among the words of its recording."""
    from utterframe.operators.sequence import order

    n = F.count(F.when(F.col("kind") == "word", 1)).over(order("item_pos").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return items.withColumn("word_idx", F.when(F.col("kind") == "word", n))


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """``idx|from-to|speaker|text`` lines; blank lines and lines of fewer than four parts are dropped; what follows the third bar is the text."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("rec_id"), F.split("value", r"\|", 4).alias("p")).filter(F.size("p") == 4)
    span = F.split(F.col("p")[1], "-")
    return lines.select("rec_id", F.col("p")[0].cast("bigint").alias("sent_idx"), span[0].cast("bigint").alias("w_start"), span[1].cast("bigint").alias("w_end"), F.col("p")[2].alias("speaker"), F.col("p")[3].alias("text"))


def flatten_recognition(docs: DataFrame, speakers: DataFrame | None = None) -> DataFrame:
    """Nested recognition documents ``(rec_id, transcripts)`` to words; the token is text and punctuation; unknown speakers are ``Speaker N``."""
    t = docs.select("rec_id", F.posexplode("transcripts").alias("ti", "t")).select("rec_id", "ti", F.posexplode("t.sentences").alias("si", "s"))
    w = t.select("rec_id", "ti", "si", F.col("s.speaker_id").alias("speaker_id"), F.posexplode("s.words").alias("wi", "w"))
    w = w.select("rec_id", "ti", "si", "wi", "speaker_id", F.concat("w.text", F.coalesce("w.punctuation", F.lit(""))).alias("text"), F.col("w.begin_time").alias("start_ms"), F.col("w.end_time").alias("end_ms"))
    default = F.concat(F.lit("Speaker "), F.col("speaker_id").cast("string"))
    if speakers is None:
        return w.withColumn("speaker", default).drop("speaker_id")
    names = speakers.select(F.col("speaker_id").cast("int").alias("speaker_id"), "name").dropDuplicates(["speaker_id"])
    return w.join(names, "speaker_id", "left").withColumn("speaker", F.coalesce("name", default)).drop("speaker_id", "name")


def flatten_whisper(docs: DataFrame) -> DataFrame:
    """Segments with word times ``(rec_id, segments)`` to words."""
    s = docs.select("rec_id", F.posexplode("segments").alias("si", "s"))
    w = s.select("rec_id", "si", F.posexplode("s.words").alias("wi", "w"))
    return w.select("rec_id", "si", "wi", F.trim(F.coalesce("w.text", "w.word")).alias("text"), ms(F.col("w.start")).alias("start_ms"), ms(F.col("w.end")).alias("end_ms"), F.col("w.probability").alias("probability"))


def shift_tracks(words: DataFrame, offsets: DataFrame) -> DataFrame:
    """Words of tracks moved by their offset, not before 0; tracks without an offset do not move."""
    j = words.join(offsets.select("rec_id", "track", "offset_ms"), ["rec_id", "track"], "left")
    at = lambda c: F.greatest(F.lit(0), F.col(c) + F.coalesce("offset_ms", F.lit(0)))
    return j.withColumn("start_ms", at("start_ms")).withColumn("end_ms", at("end_ms")).drop("offset_ms")


def track_faults(tracks: DataFrame, offsets: DataFrame) -> DataFrame:
    """Speakers given to more than one track, and offsets of tracks that are not there."""
    twice = tracks.groupBy("rec_id", "speaker").agg(F.count("*").alias("n")).filter("n > 1").select("rec_id", F.lit("duplicate speaker").alias("fault"), F.col("speaker").alias("name"))
    unknown = offsets.join(tracks, ["rec_id", "track"], "left_anti").select("rec_id", F.lit("unknown offset").alias("fault"), F.col("track").alias("name"))
    return twice.unionByName(unknown)


def read_feedback(spark: SparkSession, path: str, glob: str = "feedback_*.json") -> DataFrame:
    """One row per feedback file of a folder, with its name and text."""
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("body"))


MOST_RULES = 10_000


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """``(rule, key, value)`` from a folder of YAML files, a rule each: its scalars, with those one level down under ``parent.key``.

    Comments, lists and deeper levels are left out; quotes around a value are taken off.
    """
    lines = spark.read.option("pathGlobFilter", "*.{yaml,yml}").text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.ya?ml$", "").alias("rule"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    found = lines.withColumn("m", F.regexp_extract("line", r"^( *)[A-Za-z_][\w-]*:", 1)).withColumn("key", F.regexp_extract("line", r"^ *([A-Za-z_][\w-]*):", 1)).filter("key <> '' and length(m) in (0, 2)")
    found = found.withColumn("value", F.regexp_extract("line", r"^ *[A-Za-z_][\w-]*: *(.*?) *(?: #.*)?$", 1))
    parent = F.last(F.when(F.length("m") == 0, F.col("key")), ignorenulls=True).over(Window.partitionBy("rule").orderBy("n"))
    named = found.withColumn("key", F.when(F.length("m") == 0, F.col("key")).otherwise(F.concat_ws(".", parent, "key")))
    return named.filter("value <> ''").select("rule", "key", F.regexp_replace("value", "^(['\"])(.*)\\1$", "$2").alias("value"))


def merge_rules(base: DataFrame, user: DataFrame) -> DataFrame:
    """Rules ``(rule, key, value)`` of a base, overridden by a user's.  The base is a configuration and becomes a literal; one of more than MOST_RULES rows is refused."""
    found = base.select("rule", "key", "value").limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"a base of more than {MOST_RULES} rules")
    rules = [F.struct(F.lit(r["rule"]).alias("rule"), F.lit(r["key"]).alias("key"), F.lit(r["value"]).alias("b")) for r in found]
    each = user.select("user_id").distinct().select("user_id", F.explode(F.array(*rules)).alias("r")).select("user_id", "r.*")
    own = user.select("user_id", "rule", "key", F.col("value").alias("u"))
    return each.join(own, ["user_id", "rule", "key"], "left").select("user_id", "rule", "key", F.coalesce("u", "b").alias("value"))


def salvage_json(text: Column, schema: str) -> Column:
    """A text as JSON: as it is, or its fenced block, or from its first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    tries = [F.from_json(F.when(F.trim(x).startswith("{"), x), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}) for x in (text, fenced, braces)]
    return F.coalesce(*[F.when(F.when(F.trim(x).startswith("{"), F.get_json_object(x, "$")).isNotNull(), t) for x, t in zip((text, fenced, braces), tries, strict=True)])


PROFILE = "results array<struct<collectionName: string, trackName: string, description: string, genres: array<string>, artistName: string, feedUrl: string, trackCount: bigint, artworkUrl600: string, artworkUrl100: string>>"


def lookup_profiles(answers: DataFrame) -> DataFrame:
    """Answers ``(key, url, body)`` of a look-up service as profiles: the first result's name, description, themes and links, and the number in the url.  Answers without a result are left out."""
    first = answers.withColumn("r", F.get(F.from_json("body", PROFILE)["results"], 0)).filter("r is not null")
    some = lambda *cols: F.coalesce(*[F.nullif(F.col(f"r.{c}"), F.lit("")) for c in cols])
    number = F.regexp_extract("url", r"id(\d+)", 1)
    return first.select(
        "key",
        F.when(number != "", number.cast("bigint")).alias("number"),
        F.coalesce(some("collectionName", "trackName"), F.lit("")).alias("name"),
        F.coalesce(some("description"), F.lit("")).alias("description"),
        F.coalesce("r.genres", F.array().cast("array<string>")).alias("theme"),
        F.col("r.artistName").alias("artist"),
        F.col("r.feedUrl").alias("feed_url"),
        F.col("r.trackCount").alias("n_tracks"),
        some("artworkUrl600", "artworkUrl100").alias("artwork"),
    )


def page_metadata(pages: DataFrame) -> DataFrame:
    """Platform by host, title (og:title, else <title>), description (og:description, else the meta description), numeric id in the url."""
    one = lambda pattern: F.nullif(F.regexp_extract("html", pattern, 1), F.lit(""))
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))
    og = lambda name: one(f'(?i)<meta[^>]+property="og:{name}"[^>]+content="([^"]*)"')
    number = F.regexp_extract("url", r"/(\d+)", 1)
    return pages.select(
        "page_id",
        F.regexp_extract(host, r"([^.]+)\.[^.]+$", 1).alias("platform"),
        F.coalesce(og("title"), one("(?is)<title>([^<]*)</title>")).alias("title"),
        F.coalesce(og("description"), one('(?i)<meta[^>]+name="description"[^>]+content="([^"]*)"')).alias("description"),
        F.when(number != "", number.cast("bigint")).alias("number"),
    )
