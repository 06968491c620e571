"""Session helpers: a local session for tests, shipped code and the shared folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, app: str = "cellmetry") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is set only for a local master without a configured one, as in
    tests.  On a cluster a missing setting is an error: a machine's own folder would
    hide each executor's files from the others.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cellmetry-checkpoint-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Make the package importable where the Python tasks run, on any master."""
    context = spark.sparkContext
    if getattr(context, "_cellmetry_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="cellmetry-code-"), "cellmetry-code"),
        "zip",
        os.path.dirname(package),
        os.path.basename(package),
    )
    context.addPyFile(archive)
    context._cellmetry_shipped = True


def one_task_each(df: DataFrame, group: str, groups: int) -> DataFrame:
    """Rows of every group, numbered from 0, in a partition of its own, and its number in ``_task``.

    Hashes of the groups would put several in one partition.  Each gets a number whose hash
    names a partition that no other has.
    """
    numbers = df.sparkSession.range(64 * groups).groupBy(F.pmod(F.hash("id"), F.lit(groups)).alias("task"))
    found = {r["task"]: r["number"] for r in numbers.agg(F.min("id").alias("number")).collect()}
    named = F.array(*[F.lit(found.get(task, task)).cast("long") for task in range(groups)])
    return df.withColumn("_task", named[F.col(group).cast("int")]).repartition(groups, "_task")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder and read it back.

    It is computed once, survives lost executors, and later steps read only the
    columns they need.
    """
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``cut_lineage`` that nothing will read again.

    Only what is computed and written may have been made of them; others are left alone.
    """
    for table in tables:
        path = getattr(table, "_written_to", None)
        if path is not None:
            context = table.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
