"""Cutting lineage so that jobs survive lost executors, and a shared place for files."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where the setting is missing a folder of our own is made, but only in local mode, where driver and
    executors are one process; on a cluster that is an error.
    """
    sc = spark.sparkContext
    inner = sc._jsc.sc()
    if inner.getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="utterframe-"))
    return inner.getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder.

    Spark removes the files once neither the frame nor one made from it is referenced.  It does so
    only where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on, which is turned on here
    unless the application has set it.
    """
    shared_dir(df.sparkSession)
    conf = df.sparkSession.sparkContext._jsc.sc().conf()
    conf.setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"
