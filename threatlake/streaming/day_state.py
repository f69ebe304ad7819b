"""Event files as a stream into the day state: every micro-batch is detected and merged into the state of its rows' days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from threatlake.operators import day_state, detect
from threatlake.sources.state_store import DayStateStore
from threatlake.streaming.watch import watch


def day_threats(events: DataFrame) -> DataFrame:
    """The threats of all rules, by day."""
    return detect.threats(detect.all_matches(events, keys=("day",)), ("day",))


def merging(store: DayStateStore, adapt: Callable[[DataFrame], DataFrame] = lambda df: df, name: str = "stream", find: Callable[[DataFrame], DataFrame] = day_threats) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch has its number for a name, so one that is repeated after a restart changes nothing.

    Late rows are merged into their own day; days that the store no longer keeps are counted as expired.
    """

    def each(batch: DataFrame, number: int) -> None:
        events = adapt(batch).withColumn("day", F.to_date("event_ts"))
        store.update(f"{name}-{number}", day_state.parts(events, find(events)))

    return each


def keep(spark: SparkSession, folder: str, schema: StructType, store: DayStateStore, checkpoint: str, adapt: Callable[[DataFrame], DataFrame] = lambda df: df, find: Callable[[DataFrame], DataFrame] = day_threats, **options) -> StreamingQuery:
    """Follows a folder of event files; find gives a batch's threats by day, options are those of watch()."""
    return watch(spark, folder, schema, merging(store, adapt, find=find), checkpoint, **options)
