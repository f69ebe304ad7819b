"""The day state on disk: versions by batch and day, and a commit for each batch.

    actors/batch=B/day=D     the sources of day D after batch B
    findings/batch=B/day=D   what the correlation rules found first after batch B
    commits/batch=B          one row for each day that B touched: day, number, events, expired

A batch first writes its version of the days that it touches, then its commit, one file that appears as a whole. Readers
take each day's last committed version. A batch that was committed changes nothing when it comes again; one that broke
off before its commit is written anew. There is one writer at a time. A version is removed when two newer ones of its
day are committed.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.operators import day_state
from threatlake.sources.workspace import Files, written

COMMIT = "day date, number int, events bigint, expired bigint"
FINDING = "day date, src_ip string, correlation_rule string, category string, severity string, confidence double, description string, evidence map<string, string>, number int"


class DayStateStore:
    def __init__(self, spark: SparkSession, path: str, days: int | None = None):
        """days: how many days are kept, counted from the newest that was seen; rows of older days are only counted."""
        self.spark, self.path, self.days, self.files = spark, path, days, Files(spark)

    def commits(self) -> DataFrame:
        """(batch, day, number, events, expired) of all committed batches."""
        names = [n for n in self.files.names(f"{self.path}/commits") if self.files.exists(f"{self.path}/commits/{n}/_SUCCESS")]
        if not names:
            return self.spark.createDataFrame([], f"batch string, {COMMIT}")
        reader = self.spark.read.schema(f"{COMMIT}, batch string").option("basePath", f"{self.path}/commits")
        return reader.parquet(*(f"{self.path}/commits/{n}" for n in names)).select("batch", "day", "number", "events", "expired")

    def versions(self) -> dict[datetime.date, list[tuple[int, str]]]:
        """For each day its committed batches, oldest first: a row of metadata for each batch and day that is kept."""
        out: dict = {}
        for r in self.commits().where("number > 0").orderBy("day", "number").collect():
            out.setdefault(r["day"], []).append((r["number"], r["batch"]))
        return out

    def _read(self, table: str, schema: str, folders: list[str]) -> DataFrame:
        there = [f for f in folders if self.files.exists(f"{self.path}/{table}/{f}")]
        if not there:
            return self.spark.createDataFrame([], schema)
        columns = [c.strip().split(" ")[0] for c in self.spark.createDataFrame([], schema).columns]
        reader = self.spark.read.schema(f"{schema}, batch string").option("basePath", f"{self.path}/{table}")
        return reader.parquet(*(f"{self.path}/{table}/{f}" for f in there)).select(*columns)

    def actors(self, days: list[datetime.date] | None = None) -> DataFrame:
        """The state of all days, or of some."""
        last = {d: v[-1][1] for d, v in self.versions().items() if days is None or d in days}
        return self._read("actors", day_state.SCHEMA, [f"batch={b}/day={d}" for d, b in last.items()])

    def findings(self, days: list[datetime.date] | None = None) -> DataFrame:
        """All findings of these days, each with the number of the batch after which it held first."""
        return self._read("findings", FINDING, [f"batch={b}/day={d}" for d, v in self.versions().items() if days is None or d in days for _, b in v])

    def update(self, batch: str, new: DataFrame) -> bool:
        """Merges a batch, rows of day_state.parts(), each into the state of its day; False if the batch was committed before."""
        if self.files.exists(f"{self.path}/commits/batch={batch}/_SUCCESS"):
            return False
        new = written(new, "parts")
        seen = {r["day"]: r["events"] for r in new.groupBy("day").agg(F.sum("requests").alias("events")).collect()}  # a row a day
        versions = self.versions()
        days = [d for d in seen if d is not None]
        newest = max([*versions, *days], default=None)
        first = newest - datetime.timedelta(days=self.days - 1) if self.days and newest else None
        touched = [d for d in days if first is None or d >= first]
        number = {d: versions[d][-1][0] + 1 if d in versions else 1 for d in touched}
        if touched:
            numbers = F.coalesce(*(F.when(F.col("day") == F.lit(d), F.lit(n)) for d, n in number.items()), F.lit(0))
            mine = new.where(F.col("day").isin(touched))
            day_state.merge(self.actors(touched), mine, numbers).write.partitionBy("day").mode("overwrite").parquet(f"{self.path}/actors/batch={batch}")
            now = self._read("actors", day_state.SCHEMA, [f"batch={batch}/day={d}" for d in touched])
            fresh = day_state.findings(now).join(self.findings(touched), [*day_state.KEYS, "correlation_rule"], "left_anti")
            fresh.withColumn("number", numbers.cast("int")).write.partitionBy("day").mode("overwrite").parquet(f"{self.path}/findings/batch={batch}")
        rows = [(d, number.get(d, 0), n if d in number else 0, 0 if d in number else n) for d, n in seen.items()]
        commit = self.spark.createDataFrame(rows or [(None, 0, 0, 0)], COMMIT)
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        for d in touched:
            for _, old in versions.get(d, [])[:-1]:
                self.files.delete(f"{self.path}/actors/batch={old}/day={d}")
        for d in versions:
            if first is not None and d < first:
                self.expire(d, versions[d])
        return True

    def expire(self, day: datetime.date, versions: list[tuple[int, str]]) -> None:
        """Removes a day's state and findings; its commits stay, so that its batches aren't merged again."""
        for _, batch in versions:
            for table in ("actors", "findings"):
                self.files.delete(f"{self.path}/{table}/batch={batch}/day={day}")
