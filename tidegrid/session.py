"""Session helpers: UTC clock, the package on the workers, shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


_shipped: set[str] = set()
_scratch: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers, once an application, so that none needs an installation."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="tidegrid-"), "tidegrid.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(root)))
        context.addPyFile(path)
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session clock to UTC, so that calendar parts have no DST jumps."""
    ship(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    A machine-local folder is made only where the setting is absent and the
    session runs in one process (tests); on a cluster its absence is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tidegrid-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    folder = f"{shared_folder(spark)}/scratch-{spark.sparkContext.applicationId}"
    if folder not in _scratch:
        _scratch.add(folder)
        atexit.register(release, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession, folder: str) -> None:
    """Remove the scratch tables of an application; called when Python ends, if Spark still runs."""
    context = spark.sparkContext
    if context._jsc is not None:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df, eager: bool = True):
    """Cut the lineage of ``df`` by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager)
