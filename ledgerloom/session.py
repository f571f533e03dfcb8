"""Session helpers: builder for local work, and shipping of this package to the Python workers of any cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Add this package, as a zip, to the files that the driver serves to its Python workers; once per context.

    The zip lies in the driver's own Spark folder; Spark serves it from there.
    """
    context = spark.sparkContext
    if not any(Path(p).name == "ledgerloom.zip" for p in context._python_includes):
        target = Path(context._temp_dir) / "ledgerloom.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(PACKAGE.rglob("*.py")):
                archive.write(path, Path("ledgerloom") / path.relative_to(PACKAGE))
        context.addPyFile(str(target))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the one set as checkpoint folder; all executors must share it.

    Only a local master without either, as in tests, gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerloom-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: its plan doesn't grow, and executors may be lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def local_session(cores: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("ledgerloom")
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
