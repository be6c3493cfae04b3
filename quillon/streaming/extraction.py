"""The work queue of extraction as a stream: new task files in, each paragraph processed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def process_tasks(spark: SparkSession, folder: str, out: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = ("guide_id", "paragraph_id")) -> StreamingQuery:
    """Processes parquet files of tasks as they come and appends the results; a key that was seen is not processed again.

    The keys seen are the stream's state: pass tasks of a bounded period, or restart with a new checkpoint, where they
    would outgrow it. Ends when the files there are done.
    """
    schema = spark.read.parquet(folder).schema
    tasks = spark.readStream.schema(schema).parquet(folder).dropDuplicates(list(keys))
    return process(tasks).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
