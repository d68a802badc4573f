"""Session settings shared by tests, the bench and command-line use."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", memory: str = "12g") -> SparkSession:
    """A local session with this package for its workers; on a cluster the caller brings its own and calls `ship`."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tactus")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    ship(session)
    return session


def reliable_folder(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the one the cluster names; a fresh one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-tactus-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    spark.sparkContext.setCheckpointDir(named)
    return os.path.join(named, "tactus")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per session, so that functions run there find it."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    _SHIPPED.add(spark.sparkContext.applicationId)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tactus-")) / "tactus.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def settled(df: DataFrame) -> DataFrame:
    """A small derived table that several steps read, written once to reliable storage."""
    reliable_folder(df.sparkSession)
    return df.checkpoint()
