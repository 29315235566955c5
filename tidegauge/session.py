"""Spark sessions, and shipping this package to the executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "6g") -> SparkSession:
    """A local session with the settings that the queries assume: UTC, adaptive execution."""
    made = (
        SparkSession.builder.master(f"local[{cores}]").appName("tidegauge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    return ship(made)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of our own only on a local master where that is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tidegauge-")


def cut(df: DataFrame) -> DataFrame:
    """df worked out once and written to the checkpoint folder, so that what follows reads it and a lost executor costs no more."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path inside the shared one; what is written there goes when this process ends."""
    folder, jvm, conf = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", spark._jvm, spark._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            where = jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # the session has ended before: the folder stays
            return

    atexit.register(remove)
    return folder


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors' Python once a context, so that their workers can import it wherever the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_tidegauge_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidegauge-code-")) / "tidegauge.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._tidegauge_shipped = True
    return spark
