"""Tables that a query writes on its way: in the folder the session names, of our own only on one machine without one.

They go when they are discarded, the rest when the driver's JVM ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where all of them are one process."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="lamina-")
        atexit.register(shutil.rmtree, _own[context.applicationId], ignore_errors=True)
    return f"file://{_own[context.applicationId]}"


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def folder(spark: SparkSession, label: str) -> str:
    """A path for a table to be written, in a folder of its own."""
    base = f"{shared_folder(spark)}/lamina-{uuid.uuid4().hex}"
    files, where = _place(spark, base)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return f"{base}/{label}"


def written(df: DataFrame, label: str, few: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends here, and lost executors cost nothing.

    ``few``: for tables that are small beside the texts, where a file costs more than its rows: in three files for each
    core or a quarter of the shuffle partitions, whichever is more, so that tasks grow in number with the data.
    """
    spark = df.sparkSession
    path = folder(spark, label)
    if few:
        df = df.coalesce(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote; no plan that is still to run may read it."""
    for df in tables:
        files, where = _place(df.sparkSession, df.scratch_path)
        files.delete(where.getParent(), True)
