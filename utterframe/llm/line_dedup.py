"""Line de-duplication by overlapping three-line windows, in native DataFrame operations.

Every three consecutive lines are hashed; windows that occur again anywhere are found by one
aggregation over the hashes; the first occurrence (smallest document id, then position) stays, and
the positions covered by later occurrences are merged to runs and cut out.  A line that goes has an
equal line at an earlier place, so no line's content is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utterframe.durable import durable

WINDOW = 3
#: Bits of the filter of documents that are cut: so many for each of them, and at most 4 MB in all; where more are cut than it can tell apart, more of the others are shuffled too.
FILTER_SHARE, FILTER_MOST = 16, 1 << 25


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, dk, pos, h1, h2)``: 128 bits of hash for the window that starts at line ``pos``."""
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("dk"), F.split(F.col(text_col), "\n", -1).alias("l")).filter(F.size("l") >= WINDOW)
    rest = [F.slice("l", k + 1, F.greatest(F.size("l") - k, F.lit(0))).alias(f"l{k}") for k in range(WINDOW)]
    rows = lines.select("id", "dk", F.posexplode(F.arrays_zip(*rest)).alias("pos", "z"))
    parts = [F.col(f"z.l{k}") for k in range(WINDOW)]
    return rows.filter(parts[-1].isNotNull()).select("id", "dk", "pos", F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(7), *parts[::-1]).alias("h2"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, dk, runs)``: for each document with a later occurrence, its merged runs [a, b) of lines to cut, in order."""
    w = windows(docs, id_col, text_col)
    place = F.struct("id", "dk", "pos")
    again = w.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    later = w.join(again, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first"))).select("id", "dk", "pos")
    by_doc = Window.partitionBy("id", "dk").orderBy("pos")
    fresh = F.coalesce((F.col("pos") > F.lag("pos").over(by_doc) + WINDOW), F.lit(True)).cast("int")
    runs = later.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        runs.groupBy("id", "dk", "run")
        .agg(F.min("pos").alias("a"), (F.max("pos") + WINDOW).alias("b"))
        .groupBy("id", "dk")
        .agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))
    )


def marks(ids: DataFrame, bits: int) -> DataFrame:
    """One row with the array ``words``: a bit for each hash ``dk`` of ``ids``, at ``dk`` modulo ``bits``; its size does not depend on the data."""
    place = F.pmod("dk", F.lit(bits))
    bit = F.expr(f"shiftleft(1L, cast(pmod(dk, {bits}) % 64 as int))")
    some = ids.groupBy((place / 64).cast("long").alias("id")).agg(F.bit_or(bit).alias("w"))
    every = ids.sparkSession.range(bits // 64).join(some, "id", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0)).alias("w")))), lambda x: x["w"]).alias("words"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text cleaned, and ``n_lines``, ``n_removed`` added.

    Lines end at a newline and are compared as they are.  Fewer than three lines have no window and
    stay.  A null text stays null (no lines).  A null id sorts before all others.  Rows with one id
    but different texts are ordered by text hash; identical rows are one document given more than
    once and get the same result.  A document whose lines all go has the empty text.  Other columns
    stay, of any name; columns named ``n_lines`` or ``n_removed`` are replaced.  No rows give no rows.

    Only documents that a bit filter of the cut ones lets through are shuffled to meet their runs.
    """
    cut = durable(repeated_runs(docs, id_col, text_col).select(F.col("id").alias("cut_id"), F.col("dk").alias("cut_dk"), "runs"))
    # the row as one column, so that no name of its own is in the way
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("dk"))
    bits = min(FILTER_MOST, 1 << max(10, (FILTER_SHARE * cut.count()).bit_length()))
    mark = F.get(marks(cut.select(F.col("cut_dk").alias("dk")), bits).scalar(), (F.pmod("dk", F.lit(bits)) / 64).cast("int"))
    hit = mark.bitwiseAND(F.expr(f"shiftleft(1L, cast(pmod(dk, {bits}) % 64 as int))")) != 0
    met = rows.filter(hit).join(cut, (F.col("dk") == F.col("cut_dk")) & F.col(f"d.`{id_col}`").eqNullSafe(F.col("cut_id")), "left").select("d", "runs")
    j = met.unionByName(rows.filter(~hit).select("d", F.lit(None).cast(dict(met.dtypes)["runs"]).alias("runs")))
    line = F.split(F.col(f"d.`{text_col}`"), "\n", -1)
    j = j.withColumn("l", line)
    n = F.when(F.col(f"d.`{text_col}`").isNull(), 0).otherwise(F.size("l"))
    gone = F.coalesce(F.aggregate("runs", F.lit(0), lambda s, r: s + r["b"] - r["a"]), F.lit(0))
    ends = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["b"]))
    starts = F.concat(F.transform("runs", lambda r: r["a"]), F.array(F.size("l")))
    kept = F.flatten(F.transform(F.arrays_zip(ends.alias("e"), starts.alias("s")), lambda p: F.slice(F.col("l"), p["e"] + 1, p["s"] - p["e"])))
    text = F.when(F.col("runs").isNull(), F.col(f"d.`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    same = [text.alias(c) if c == text_col else F.col(f"d.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return j.select(*same, n.cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"))
