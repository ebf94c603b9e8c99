"""Sinks: files are written anew or appended to, never changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """K1."""
    df.write.mode("overwrite").json(path)


def write_sentences(sents: DataFrame, path: str) -> None:
    """K2: ``idx|from-to|speaker|text`` lines, a folder per recording, in order."""
    line = F.concat_ws("|", F.col("sent_idx").cast("string"), F.concat_ws("-", "w_start", "w_end"), F.coalesce("speaker", F.lit("")), "text")
    rows = sents.select("rec_id", "sent_idx", line.alias("value")).repartition("rec_id").sortWithinPartitions("rec_id", "sent_idx")
    rows.select("rec_id", "value").write.mode("overwrite").partitionBy("rec_id").text(path)


def append_log(events: DataFrame, path: str) -> None:
    """K3: stamped with the date, appended."""
    events.withColumn("date", F.current_date()).write.mode("append").parquet(path)


def latest(log: DataFrame, keys: list[str], version: str) -> DataFrame:
    """K4: the last version of each key of an append-only log, in place of an upsert."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))
    return log.withColumn("__k", k).filter("__k = 1").drop("__k")


def write_version(df: DataFrame, path: str, version: int, dry_run: bool = False) -> str:
    """K5: a new version beside the old ones; a dry run only names it."""
    to = f"{path}/version={version:06d}"
    if not dry_run:
        df.write.mode("errorifexists").parquet(to)
    return to


def report(issues: DataFrame) -> DataFrame:
    """K6 and K9: a Markdown list per recording, by severity and time, and whether it passes."""
    from utterframe.functions.formats import clock
    from utterframe.operators.evaluate import rank_of

    line = F.concat(F.lit("- **"), F.col("severity"), F.lit("** "), clock(F.col("time_ms")), F.lit(" "), F.col("type"), F.lit(": "), F.coalesce("detail", F.lit("")))
    rows = issues.groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct((-rank_of(F.col("severity"))).alias("r"), "time_ms", line.alias("line")))).alias("ls"), F.count("*").alias("n"))
    return rows.select("rec_id", F.concat(F.lit("# Issues\n\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n")).alias("markdown"), (F.col("n") == 0).alias("passed"))
