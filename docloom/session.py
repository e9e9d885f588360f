"""Session settings and the few environment-dependent helpers."""

from __future__ import annotations

import atexit
import os
import pathlib
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings an application should start with; a cluster may override any of them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def get_spark(app: str = "docloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS that has sent the package to its executors; ``conf`` keys use underscores for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers of the session, once, so that it need not be installed there."""
    if any(os.path.basename(p) == "docloom.zip" for p in getattr(spark.sparkContext, "_python_includes", [])):
        return spark
    home = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="docloom-code-")  # of the driver, which serves it to every executor while it lives
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.PyZipFile(f"{folder}/docloom.zip", "w") as z:
        z.writepy(str(home))  # compiled, so that a worker only loads it
    spark.sparkContext.addPyFile(f"{folder}/docloom.zip")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors that the session names; a local one only where none is named and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            folder = "file://" + tempfile.mkdtemp(prefix="docloom-")
        else:
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so that a lost executor costs no recomputation of the past."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
