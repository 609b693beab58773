"""A session with the settings the operators expect."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, app: str = "obsframe", **settings: str) -> SparkSession:
    """UTC timestamps and adaptive plans. Partition counts are left to the cluster's own settings."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return (builder.master(master) if master else builder).getOrCreate()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the folder that the cluster names for that, so that its plan ends there. Where none is named, a
    temporary folder will do only if all runs in one process."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or _temporary("obsframe-checkpoint-"))
    return df.checkpoint()


def _temporary(prefix: str) -> str:
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for an application, so that Python workers find it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = _temporary("obsframe-code-")  # the driver serves the file from here; executors fetch it
    here = Path(__file__).resolve().parent
    path = Path(folder) / "obsframe.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(here.rglob("*.py")):
            z.write(source, Path(here.name) / source.relative_to(here))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
