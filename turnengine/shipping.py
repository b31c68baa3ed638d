"""Shipping the package to Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers. Only those of a local master see the driver's PYTHONPATH and working
    directory; executors elsewhere always get an archive."""
    root = Path(__file__).resolve().parents[1]
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    at_hand = context.master.split("[")[0] == "local" and (os.getcwd() == str(root) or str(root) in known)
    if at_hand or context.applicationId in _SHIPPED:
        return
    target = Path(tempfile.mkdtemp(prefix="turnengine-")) / "turnengine.zip"
    atexit.register(shutil.rmtree, target.parent, True)
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted((root / "turnengine").rglob("*.py")):
            archive.write(source, source.relative_to(root))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
