"""Makes the package importable in Python workers that don't have its folder on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a context, unless their path has it already; through Spark's own file server."""
    known = {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    context = spark.sparkContext
    if str(_ROOT) in known or getattr(context, "_docgrid_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="docgrid-"), "docgrid.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((_ROOT / "docgrid").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    context.addPyFile(path)
    context._docgrid_shipped = True
