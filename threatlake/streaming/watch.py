"""Event tables as streams: every micro-batch is detected and added to the state on disk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from threatlake.operators import detect


def watch(spark: SparkSession, folder: str, schema: StructType, each: Callable[[DataFrame, int], None], checkpoint: str, form: str = "parquet", files: int = 1, once: bool = True, seconds: int = 5) -> StreamingQuery:
    """Calls each(batch, number) for new files, oldest first; what was seen is in the checkpoint, so restarts repeat nothing."""
    stream = spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files).option("latestFirst", False).load(folder)
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def store_matches(out: str, adapt: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """Writes a batch's matches into its own folder, so that a batch that is repeated replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        found = detect.all_matches(adapt(batch))
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return each
