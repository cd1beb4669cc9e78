"""Session helpers: the folder that all executors share, and tables kept in it.

Nothing here uses ``localCheckpoint``: what cuts lineage is either a reliable
checkpoint or a Parquet table in the shared folder, so a lost executor costs a
re-read and never the job.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder of its own that
    goes at exit; any other master is refused, since no machine-local folder is
    seen by its executors.
    """
    there = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if there:
        return there
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    there = tempfile.mkdtemp(prefix="partita-")
    atexit.register(shutil.rmtree, there, ignore_errors=True)
    there = f"file://{there}"
    spark.conf.set(_SETTING, there)
    return there


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/partita/{uuid.uuid4().hex}/{name}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage_tables(spark: SparkSession) -> None:
    """Delete every table that :func:`stage_table` left in the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/partita")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
