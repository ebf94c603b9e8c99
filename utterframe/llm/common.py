"""Shared helpers: durable cuts of lineage, bounded Arrow slices, connected components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterframe.durable import durable

#: Rows handled at once inside a Python worker; long texts make larger slices needless.
SLICE_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch of whole texts.  Spark's own 10,000 make batches of up to 64 MB, held several times on both sides of a worker's pipe.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Smaller Arrow batches for what runs inside, unless the session asks for fewer rows itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(name: str, taken: Sequence[str]) -> str:
    """The name, lengthened until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[list[list]]:
    """The columns of each Arrow batch as Python lists, a bounded number of rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield [c.to_pylist() for c in part.columns]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)`` (both bigint): ``(node, root)``, root the smallest node.

    Alternates the large-star and small-star contractions until the edge set stands still; then
    every node hangs directly on its component's smallest node.  Each round is two aggregations and
    two joins on a node key; groups are never collected, and stars are split by AQE's skew join.
    Nodes without an edge do not appear; self-loops and null ends are ignored.
    """
    cur = durable(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = _mark(cur)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .filter("u <> v")
            .distinct()
        )
        cur = durable(small)
        new = _mark(cur)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not converge")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(df: DataFrame) -> tuple:
    r = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).first()
    return (r["n"], r["x"], r["s"])
