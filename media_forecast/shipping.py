"""Ship the package to executors so that worker-side functions import by name.

Worker code that is pickled by reference needs the package on every worker.
``ship_package`` zips the package sources and hands the archive to
``SparkContext.addPyFile``, which serves it to all executors, present and
replaced ones alike.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE_ROOT = Path(__file__).resolve().parent
_FLAG = "media_forecast.shipped"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Add the package to the session's Python files once per Spark application.

    Also keeps Arrow batches small unless the session sets its own size.
    """
    if spark.conf.get(_ROWS) == "10000":  # Spark's default; rows here are whole texts
        spark.conf.set(_ROWS, "1000")
    sc = spark.sparkContext
    if getattr(sc, _FLAG, False):
        return
    archive = Path(tempfile.mkdtemp(prefix="mf-ship-")) / "media_forecast_src.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(PACKAGE_ROOT.rglob("*.py")):
            z.write(path, str(Path(PACKAGE_ROOT.name) / path.relative_to(PACKAGE_ROOT)))
    sc.addPyFile(str(archive))
    setattr(sc, _FLAG, True)
