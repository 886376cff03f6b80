"""What a session needs before Python code of this package runs on its executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors of the session, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        if root.parent.is_dir():  # a package that was itself imported from a shipped archive is there already
            target = f"{tempfile.mkdtemp(prefix='siftspark-')}/siftspark.zip"
            with zipfile.ZipFile(target, "w") as z:
                for p in sorted(root.rglob("*.py")):
                    z.write(p, p.relative_to(root.parent))
            sc.addPyFile(target)
        _shipped.add(sc.applicationId)
    return spark
