"""Rewards of completions as they come in; the batch expressions need no state."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.rewards import rewards


def reward_stream(spark: SparkSession, folder: str, schema: str = "prompt string, completion string", files: int = 1000) -> DataFrame:
    """A streaming DataFrame with the rewards of JSON lines that are put into a folder, `files` at most in a batch."""
    return rewards(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder))


def reward_files(spark: SparkSession, folder: str, sink: str, progress: str, schema: str = "prompt string, completion string", files: int = 1000) -> StreamingQuery:
    """Starts a run that scores all files of a folder that no run has scored yet, writes them to `sink` as Parquet, and ends.

    The folder `progress` tells what is done: a run that is stopped or fails is taken up by the next one, and each file counts
    once in the sink, as its list of files goes by batches. Both must be in a storage that the cluster shares.
    """
    writer = reward_stream(spark, folder, schema, files).writeStream.format("parquet").option("path", sink).option("checkpointLocation", progress)
    return writer.trigger(availableNow=True).start()
