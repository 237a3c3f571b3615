"""Makes this package importable in Python workers when it runs from a checkout."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's files to the executors, once for each application, and keep Arrow batches small.

    A batch stands in the executor's memory several times over while Python works on it; Spark's
    default of 64 MB is lowered, another setting is left alone.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, "4m")
    if sc.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-ship-")) / f"{home.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
