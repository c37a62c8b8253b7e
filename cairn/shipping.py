"""Sends this package to the executors, so that functions in tasks can import it wherever Spark was started."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a ZIP file, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="cairn-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".json"):
                z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SENT.add(app)


def shipped(query):
    @functools.wraps(query)
    def run(spark, *args, **kwargs):
        ship(spark)
        return query(spark, *args, **kwargs)

    return run
