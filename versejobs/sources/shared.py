"""The folder that the driver and all executors share."""

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Bytes a core below which a table is dealt out.
DEALT_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the one that the cluster names in spark.checkpoint.dir.

    Where that is unset, a session on this machine alone gets a temporary one; on a cluster it is an error, as a local
    folder would be another one on each machine.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """The path of a new folder in the shared one."""
    return f"{shared_folder(spark)}/{uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors don't lose it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(rows: DataFrame, most: int = DEALT_BYTES) -> DataFrame:
    """rows of a table of fewer than `most` bytes a core, in as many partitions as there are cores, or as it has if these are more.

    A file's row groups are read by one task each, so a small table would leave most cores idle, however many partitions its
    plan has. A larger table stays as it is, without an exchange.
    """
    n = rows.sparkSession.sparkContext.defaultParallelism
    if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= n * most:
        return rows
    return rows.repartition(max(n, rows.rdd.getNumPartitions()))
