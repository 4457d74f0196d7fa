"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> None:
    """Make sure checkpoints have a folder that every executor sees.

    The cluster names it in ``spark.checkpoint.dir``. Only a single-process master (``local`` or
    ``local[n]``), where driver and executors are one machine and one process, gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master == "local" or context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="folioscope-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there: survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever they run and start; once per session.

    The archive is only read by the driver, which sends it to the executors; it holds code, no data.
    """
    context = spark.sparkContext
    if getattr(context, "_folioscope_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="folioscope-code-")) / "folioscope.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._folioscope_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
