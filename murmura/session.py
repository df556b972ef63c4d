"""Session helpers: shipping this package to the executors, cutting lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per application.

    The package travels as a zip through ``addPyFile``, so a cluster needs no install step.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="murmura-")) / "murmura.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, os.path.join(root.name, path.relative_to(root)))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def written(df: DataFrame) -> DataFrame:
    """``df`` read back from the checkpoint folder that the cluster names in spark.checkpoint.dir; only in one process, as in tests, from a temporary one where it names none."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="murmura-checkpoint-"))
    return df.checkpoint()
