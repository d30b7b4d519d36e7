"""Makes this package importable by the Python workers of any cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def scratch() -> str:
    """A folder of the driver that goes with its process."""
    made = tempfile.mkdtemp(prefix="askbook-")
    atexit.register(shutil.rmtree, made, True)
    return made


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the workers, once per application; Spark fetches it from the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(scratch(), "askbook_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
