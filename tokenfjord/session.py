"""What a session needs before its executors can run this package."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Used only where no folder is configured and Spark runs in one process, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/tokenfjord"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = LOCAL_CHECKPOINTS
    return found.rstrip("/") if ":/" in found else "file://" + found.rstrip("/")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application.

    The driver's own copy is served by Spark, so no folder need be shared.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{here.name}.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(here.rglob("*.py")):
                archive.write(path, path.relative_to(here.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark
