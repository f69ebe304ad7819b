import pytest
from pyspark.sql import functions as F

from threatlake.operators import day_state, detect, rules
from threatlake.plans import adapter
from threatlake.sources.state_store import DayStateStore
from threatlake.streaming import day_state as stream


def rated(events):
    """Threats by rates alone, which need no scan of texts."""
    return detect.threats(rules.rate_matches(events, ("day",)).withColumn("phase", F.lit(1)), ("day",))


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_stream_restarted_in_the_middle_equals_batch(spark, sf, tmp_path):
    """Five files, the last with rows of an earlier day; the stream stops after two and within the third."""
    source = spark.read.parquet(f"{sf}/events.parquet").where("ts < timestamp '2024-01-05'")
    part = F.when((F.col("event_id") % 7 == 3) & (F.col("ts") < "2024-01-02"), 4).otherwise(F.least(F.floor(F.datediff("ts", F.lit("2024-01-01")) + F.hour("ts") / 24), F.lit(3)))
    split = source.withColumn("p", part.cast("int")).cache()
    folder, schema = tmp_path / "in", source.schema
    folder.mkdir()

    def arrive(k):
        split.where(F.col("p") == k).drop("p").coalesce(1).write.parquet(str(tmp_path / f"out{k}"))
        next((tmp_path / f"out{k}").glob("part-*.parquet")).rename(folder / f"{k}.parquet")

    store = DayStateStore(spark, str(tmp_path / "state"))
    checkpoint = str(tmp_path / "checkpoint")

    for k in range(2):
        arrive(k)
        stream.keep(spark, str(folder), schema, store, checkpoint, adapter.adapt, rated).awaitTermination()
    arrive(2)
    each = stream.merging(store, adapter.adapt, find=rated)

    def broken(batch, number):
        each(batch, number)
        raise RuntimeError("lost after its commit, before the stream's")

    with pytest.raises(Exception, match="lost after its commit"):
        from threatlake.streaming.watch import watch

        watch(spark, str(folder), schema, broken, checkpoint).awaitTermination()
    for k in (3, 4):
        arrive(k)
    stream.keep(spark, str(folder), schema, store, checkpoint, adapter.adapt, rated).awaitTermination()

    whole = DayStateStore(spark, str(tmp_path / "whole"))
    for k in range(5):
        e = adapter.adapt(split.where(F.col("p") == k).drop("p")).withColumn("day", F.to_date("event_ts"))
        whole.update(f"f{k}", day_state.parts(e, rated(e)))
    assert rows_of(store.actors()) == rows_of(whole.actors())
    assert rows_of(store.findings()) == rows_of(whole.findings())
    assert store.commits().where("number > 0").agg(F.sum("events")).first()[0] == source.count()
    first_day = store.commits().where("day = '2024-01-01'").agg(F.max("number")).first()[0]
    assert first_day >= 2  # the late file went to its day
