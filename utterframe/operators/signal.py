"""Signal-style operators on ordered integer samples ``(key, pos, v)``: averages, minima, thresholds, jumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frames(events: DataFrame) -> DataFrame:
    """Events as samples: user as key, order by time, value in hundredths."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("key"), "event_id", (F.row_number().over(w) - 1).cast("bigint").alias("pos"), F.round(F.col("value") * 100).cast("bigint").alias("v"))


def _w(a: int | None = None, b: int | None = None):
    w = Window.partitionBy("key").orderBy("pos")
    return w if a is None else w.rowsBetween(a, b)


def moving_sums(f: DataFrame, reach: int = 1) -> DataFrame:
    """Centred sum and count, cut off at the ends; the average is sum / n."""
    return f.select("key", "pos", F.sum("v").over(_w(-reach, reach)).alias("sum_v"), F.count("v").over(_w(-reach, reach)).alias("n"))


def differences(f: DataFrame) -> DataFrame:
    """First difference."""
    return f.withColumn("dv", F.col("v") - F.lag("v").over(_w())).filter("dv is not null").select("key", "pos", "dv")


def local_minima(f: DataFrame) -> DataFrame:
    """No larger than either neighbour; the ends count."""
    low = lambda o: F.coalesce(F.col("v") <= o, F.lit(True))
    return f.filter("v is not null").withColumn("lo", low(F.lag("v").over(_w())) & low(F.lead("v").over(_w()))).filter("lo").select("key", "pos", "v")


def nearest_valley(f: DataFrame, reach: int = 10, drop_db: int = 3) -> DataFrame:
    """For each sample the valley within ``reach`` places: of the local minima ``drop_db`` or more below the mean there the nearest, else the deepest.

    The ends of the stretch count as minima; ties go to the earlier place.  Confidence, in basis
    points, rises from a half with the drop, and lies under .4 for a valley that is not deep enough.
    """
    around = F.collect_list(F.struct("pos", "v")).over(_w(-reach, reach))
    s = f.filter("v is not null").withColumn("xs", around).withColumn("mean", F.avg("v").over(_w(-reach, reach)))
    at = lambda i: F.get(F.col("xs"), i)["v"]
    low = F.filter("xs", lambda x, i: F.coalesce(x["v"] <= at(i - 1), F.lit(True)) & F.coalesce(x["v"] <= at(i + 1), F.lit(True)))
    drop = lambda v: F.when(v <= 0, 60.0).otherwise(20 * F.log10(F.col("mean") / v))
    ranked = F.transform(low, lambda x: F.struct((drop(x["v"]) < drop_db).alias("shallow"), F.when(drop(x["v"]) < drop_db, x["v"]).otherwise(F.abs(x["pos"] - F.col("pos"))).alias("by"), x["pos"].alias("valley"), drop(x["v"]).alias("db")))
    b = s.withColumn("b", F.array_min(ranked))
    sure = F.when(F.col("b.shallow"), F.col("b.db") / drop_db * 0.4).otherwise(F.least(F.lit(1.0), 0.5 + (F.col("b.db") - drop_db) / (3 * drop_db)))
    return b.select("key", "pos", F.col("b.valley").alias("valley"), F.round(sure * 10000).cast("bigint").alias("confidence_bp"))


def around(f: DataFrame, segments: DataFrame, reach: int) -> DataFrame:
    """Samples within ``reach`` places of the segments ``(key, seg_id, a, b, ..)``, by an equi-join on blocks of places; every segment has a row."""
    block = 2 * reach + 1
    s = segments.withColumn("block", F.explode(F.sequence(F.expr(f"(a - {reach}) div {block}") - 1, F.expr(f"(b + {reach}) div {block}"))))
    x = f.select("key", F.col("pos"), "v", F.expr(f"pos div {block}").alias("block"))
    near = s.join(x, ["key", "block"]).filter((F.col("pos") >= F.col("a") - reach) & (F.col("pos") <= F.col("b") + reach)).drop("block")
    return segments.join(near.select("key", "seg_id", "pos", "v"), ["key", "seg_id"], "left")


def outliers(f: DataFrame, sigmas: int = 2) -> DataFrame:
    """Samples above mean + k population standard deviations, in integers: (n v - s)^2 > k^2 (n q - s^2)."""
    w = Window.partitionBy("key")
    t = f.withColumn("n", F.count("v").over(w)).withColumn("s", F.sum("v").over(w)).withColumn("q", F.sum(F.col("v") * F.col("v")).over(w))
    d = F.col("n") * F.col("v") - F.col("s")
    return t.filter((d > 0) & (d * d > sigmas * sigmas * (F.col("n") * F.col("q") - F.col("s") * F.col("s")))).select("key", "pos", "v")


def noise_floor(env: DataFrame, margin: int, by: tuple[str, ...] = ("key", "seg_id", "a", "b")) -> DataFrame:
    """For segments with the samples around them (``around``) the upper median of those up to ``margin`` places outside, else of the lowest tenth of all."""
    outside = (F.col("pos") < F.col("a")) & (F.col("pos") >= F.col("a") - margin) | (F.col("pos") > F.col("b")) & (F.col("pos") <= F.col("b") + margin)
    g = env.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(outside, F.col("v")))).alias("quiet"), F.sort_array(F.collect_list("v")).alias("every"))
    median = F.when(F.size("quiet") > 0, F.expr("get(quiet, size(quiet) div 2)")).otherwise(F.expr("get(every, greatest(1, size(every) div 10) div 2)"))
    return g.select(*by, median.alias("floor_v"), F.size("quiet").cast("bigint").alias("n"))


def energy_jumps(f: DataFrame, reach: int = 3) -> DataFrame:
    """RMS over ``reach`` samples before against as many from here on; ratio above 3 medium, above 5 high."""
    e = F.col("v") * F.col("v")
    t = f.withColumn("eb", F.sum(e).over(_w(-reach, -1))).withColumn("ea", F.sum(e).over(_w(0, reach - 1))).withColumn("nb", F.count("v").over(_w(-reach, -1))).withColumn("na", F.count("v").over(_w(0, reach - 1)))
    t = t.filter(f"nb = {reach} and na = {reach} and eb > 0 and ea > 0").withColumn("hi", F.greatest("eb", "ea")).withColumn("lo", F.least("eb", "ea"))
    return t.filter("hi > 9 * lo").select("key", "pos", F.when(F.col("hi") > 25 * F.col("lo"), "high").otherwise("medium").alias("severity"))


def truncations(f: DataFrame, reach: int = 4) -> DataFrame:
    """Energy of the last ``reach`` samples between .0025 and .0625 of the key's mean square, with most of it in the first half."""
    e = F.col("v") * F.col("v")
    half = reach // 2
    whole = Window.partitionBy("key")
    t = f.withColumn("q", F.sum(e).over(whole)).withColumn("n", F.count("*").over(whole))
    t = t.withColumn("c", F.count("*").over(_w(-reach + 1, 0))).withColumn("s", F.sum(e).over(_w(-reach + 1, 0))).withColumn("a", F.sum(e).over(_w(-reach + 1, -half))).filter(f"c = {reach}")
    # s / reach over q / n in (1/400, 1/16), and a over s above 3/4
    return t.filter(f"400 * s * n > {reach} * q and 16 * s * n < {reach} * q and 4 * a > 3 * s").select("key", "pos")


def crossings(f: DataFrame, size: int = 4, windows: int = 5, z: int = 2) -> DataFrame:
    """Changes of side of the key's mean, counted in up to ``windows`` windows of ``size`` samples before and from here on: places where the means differ by more than ``z`` population standard deviations of all windows.

    In integers: ``(N (Sa nb - Sb na))^2 > z^2 (na nb)^2 (N Q - S^2)``.
    """
    whole = Window.partitionBy("key")
    t = f.withColumn("up", F.col("v") * F.count("v").over(whole) >= F.sum("v").over(whole))
    t = t.withColumn("x", F.coalesce((F.lag("up").over(_w()) != F.col("up")).cast("bigint"), F.lit(0)))
    # the count of the window that ends here, if it is whole; the others are its neighbours a window away
    t = t.withColumn("c", F.when(F.count("x").over(_w(-size + 1, 0)) == size, F.sum("x").over(_w(-size + 1, 0))))
    t = t.withColumn("before", F.array_compact(F.array(*[F.lag("c", 1 + i * size).over(_w()) for i in range(windows)])))
    t = t.withColumn("after", F.array_compact(F.array(*[F.lead("c", size - 1 + i * size).over(_w()) for i in range(windows)])))
    total = lambda x, g: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, y: s + g(y))
    t = t.filter("size(before) > 0 and size(after) > 0").select(
        "key", "pos", F.size("before").cast("bigint").alias("nb"), F.size("after").cast("bigint").alias("na"), total("before", lambda y: y).alias("before_n"), total("after", lambda y: y).alias("after_n"), total(F.concat("before", "after"), lambda y: y * y).alias("q")
    )
    return t.filter(F.expr(f"pow((nb + na) * (after_n * nb - before_n * na), 2) > {z * z} * pow(na * nb, 2) * ((nb + na) * q - pow(before_n + after_n, 2))")).select("key", "pos", "before_n", "after_n")


def cosine(a: str, b: str) -> Column:
    """Cosine of two arrays of doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def spectral_jumps(vectors: DataFrame, cuts: DataFrame, reach: int = 4, medium: float = 0.7, high: float = 0.5) -> DataFrame:
    """Cuts ``(key, cut_pos)`` at which the mean vectors of the ``reach`` frames ``(key, pos, v)`` before and from there on point elsewhere.

    A cut with less than a quarter of the frames on a side is not judged.
    """
    near = cuts.select("key", "cut_pos", F.explode(F.sequence(F.col("cut_pos") - reach, F.col("cut_pos") + reach - 1)).alias("pos"))
    each = near.join(vectors, ["key", "pos"]).withColumn("after", F.col("pos") >= F.col("cut_pos"))
    n = lambda side: F.countDistinct(F.when(F.col("after") == side, F.col("pos")))
    enough = each.groupBy("key", "cut_pos").agg(n(False).alias("nb"), n(True).alias("na")).filter(f"4 * nb >= {reach} and 4 * na >= {reach}")
    sums = each.select("key", "cut_pos", "after", F.posexplode("v").alias("i", "x")).groupBy("key", "cut_pos", "i").agg(F.sum(F.when(~F.col("after"), F.col("x").cast("double"))).alias("p"), F.sum(F.when(F.col("after"), F.col("x").cast("double"))).alias("q"))
    c = sums.groupBy("key", "cut_pos").agg((F.sum(F.col("p") * F.col("q")) / F.sqrt(F.sum(F.col("p") * F.col("p")) * F.sum(F.col("q") * F.col("q")))).alias("c"))
    return c.filter(F.col("c") < medium).join(enough, ["key", "cut_pos"]).select("key", "cut_pos", F.when(F.col("c") < high, "high").otherwise("medium").alias("severity"))


def calibrate(env: DataFrame, floors: DataFrame, most: int = 200, times: int = 2, longest: int = 2000) -> DataFrame:
    """Segments ``(key, seg_id, a, b, lo, hi)`` with the samples around them: the ends move out to the nearest sample that is no louder than ``times`` the noise floor.

    They move at most ``most`` places and not past what is kept on either side (``lo``, ``hi``; null
    for none).  Segments longer than ``longest`` stay as they are.
    """
    by = ["key", "seg_id", "a", "b", "lo", "hi"]
    e = env.join(floors.select("key", "seg_id", "floor_v"), ["key", "seg_id"])
    quiet = F.col("v") <= times * F.col("floor_v")
    short = F.col("b") - F.col("a") <= longest
    a = F.max(F.when(quiet & short & (F.col("pos") < F.col("a")) & (F.col("pos") >= F.col("a") - most), F.col("pos")))
    b = F.min(F.when(quiet & short & (F.col("pos") > F.col("b")) & (F.col("pos") <= F.col("b") + most), F.col("pos")))
    moved = e.groupBy(*by).agg(a.alias("na"), b.alias("nb"))
    kept = (F.col("b") - F.col("a")) > longest
    return moved.select(
        "key", "seg_id",
        F.when(kept, F.col("a")).otherwise(F.greatest(F.coalesce("na", "a"), F.coalesce("lo", F.lit(0)))).alias("a"),
        F.when(kept, F.col("b")).otherwise(F.least(F.coalesce("nb", "b"), F.col("hi"))).alias("b"),
    )
