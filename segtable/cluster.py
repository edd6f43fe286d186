"""What a session needs before its executors run this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch. Rows here can be whole texts, so a batch is bounded by its bytes and stays small.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once for each application, and bound the session's Arrow batches."""
    for name, value in BATCH.items():
        spark.conf.set(name, value)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="segtable-")) / "segtable.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
