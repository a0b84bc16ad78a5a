"""The folder that driver and executors share, intermediate tables in it, and inputs spread over all cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder: spark.checkpoint.dir. Only a local session without one, as in tests, gets a new local folder.

    On a cluster without the setting this fails: executors would write what others can't see to disks of their own.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="folioflux-shared-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the application's part of the shared folder, which is deleted when the application ends."""
    application = spark.sparkContext.applicationId
    if application not in _FOLDERS:
        _FOLDERS[application] = f"{shared_dir(spark)}/folioflux-{application}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS[application])
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{_FOLDERS[application]}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, *, by: str | None = None, codec: str = "snappy") -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read back; `by`: in a subfolder for each value of a column.

    What several steps need is computed once; a lost executor costs a re-read; and the planner knows the table's size, so that a
    small one is broadcast.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than half the cores over all of them, as a file may be one row group; others stay as they are.

    Files are only listed where the scan has few partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 4 * cores and 2 * len(df.inputFiles()) < cores else df
