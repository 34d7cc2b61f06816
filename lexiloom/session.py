"""The shared folder: lineage is cut where all executors can read the result. And what executors need to import."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, set as the context's checkpoint folder.

    Where it is unset, a local session gets a temporary folder; on a cluster that
    would be a folder of one machine, so this raises RuntimeError there.
    """
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if place:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(place)
        return place.rstrip("/")
    if context.getCheckpointDir() is None:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lexiloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir("file://" + folder)
    return context.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()``, after making sure that a shared folder is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: no lineage, columns prunable. Deleted when the driver ends."""
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    _WRITTEN.append(place)
    return spark.read.schema(df.schema).parquet(place)


@atexit.register
def _delete_written() -> None:
    jvm = SparkContext._jvm
    if jvm is None:
        return
    with contextlib.suppress(Exception):  # the JVM may be gone
        conf = jvm.org.apache.hadoop.conf.Configuration()
        for place in _WRITTEN:
            path = jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; a local session has it on its path."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    if context.master.split("[")[0] == "local":
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="lexiloom-")  # the driver serves the file from here for as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"{folder}/{os.path.basename(top)}.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for place, _, files in os.walk(top):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(place, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(name)
