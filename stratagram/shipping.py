"""The package's own code for workers that can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the session's workers, once, unless their path has it already."""
    sc = spark.sparkContext
    here = str(_ROOT.parent)
    if sc.applicationId in _shipped or here in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="stratagram-"), "stratagram.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f.relative_to(_ROOT.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
