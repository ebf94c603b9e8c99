"""Executors need this package too: it is sent along once per Spark application."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's sources to the application's Python files, so that no installation is asked for."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        here = Path(__file__).parent
        to = Path(tempfile.mkdtemp(prefix="utterframe-")) / "utterframe.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(p for p in here.rglob("*") if p.suffix in (".py", ".txt")):
                z.write(p, p.relative_to(here.parent))
        spark.sparkContext.addPyFile(str(to))
        _sent.add(app)
    return spark
