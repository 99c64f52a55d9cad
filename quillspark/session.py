"""Session settings and the one way in which this library cuts lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: What a session of this library sets where the caller has not.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quillspark")
    settings = DEFAULTS | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": "8"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    Reads ``spark.checkpoint.dir``. Where that is unset, a temporary folder
    is made for a session on this machine alone (``local`` master), which
    removes it when it ends; on a cluster this is an error.
    """
    context = spark.sparkContext
    set_already = context._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = f"file://{folder}"
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    The result survives the loss of executors and is computed once, so
    values such as row numbers of unordered rows stay what they were.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is not to be broadcast.

    Catalyst estimates sizes from the files, without exploded rows and as
    compressed, so it would send tables of many times its threshold through
    the driver.
    """
    return df.hint("merge")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return os.path.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per context."""
    context = spark.sparkContext
    if getattr(context, "_quillspark_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="quillspark-"), "quillspark_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(archive)
    context._quillspark_shipped = True
