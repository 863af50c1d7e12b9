"""Session defaults for the engine."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", app: str = "gridloom", **conf: str) -> SparkSession:
    """A session with the settings every operator is tested under: ANSI, UTC, AQE."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder where all executors can read and write: under spark.checkpoint.dir, or a temporary one if everything
    runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or tempfile.mkdtemp(prefix='gridloom-')}/scratch/{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers: where PYTHONPATH doesn't name its folder, a zip of its
    sources goes out with the job (the driver's file server delivers it to every executor)."""
    root = Path(__file__).resolve().parent.parent
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_gridloom_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="gridloom-")) / "gridloom.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted((root / "gridloom").rglob("*.py")):
            out.write(source, source.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    spark.sparkContext._gridloom_shipped = True
