"""Session set-up and the shared folder used to cut lineage."""

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app="flowspark", master=None, **conf):
    """A session with the settings the jobs here are written for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Without a stack trace for every column expression, plans are built quicker.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Give this package to the Python workers of a session, once."""
    context = spark.sparkContext
    if not getattr(context, "_flowspark_shipped", False):
        package = Path(__file__).parent
        archive = os.path.join(tempfile.mkdtemp(prefix="flowspark-"), "flowspark.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(archive)
        context._flowspark_shipped = True
    return spark


_local_root = {}


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below `spark.checkpoint.dir`, the cluster's shared folder.

    Only a local session may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root.get("root") or tempfile.mkdtemp(prefix="flowspark-")
        _local_root["root"] = root
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


# Spark 4.1 can drop a finished query's shuffle files at once instead of at some later
# garbage collection of the driver; a table written from them no longer needs them.
_DROP_SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder, read back: a lost executor costs only the tasks
    it held, and later passes do not redo the work before. It is computed once."""
    spark = ship(df.sparkSession)
    path = f"{scratch_dir(spark)}/cut"
    before = spark.conf.get(_DROP_SHUFFLE, None)
    spark.conf.set(_DROP_SHUFFLE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_DROP_SHUFFLE) if before is None else spark.conf.set(_DROP_SHUFFLE, before)
    return spark.read.schema(df.schema).parquet(path)
