"""Make this package importable in Python workers that do not share the driver's path."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    path = Path(folder) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(path))
    _done.add(context.applicationId)
