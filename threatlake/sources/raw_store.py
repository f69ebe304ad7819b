"""Raw files kept unchanged by date, and a table of what is known of each file.

    raw/day=D         file_id, name, bytes, sha256, content, uploaded_at
    files/version=N   one row a file: id, name, status, counts, times

A raw file is never overwritten: putting the same content again changes nothing, other content under its id and name is
an error, and then nothing of that call is written. The file table is merged by file id into a new version, which counts
once it is written whole; there is one writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.sources.files import LARGEST
from threatlake.sources.workspace import Files

# States of a file, and how many files a list shows.
UPLOADED, PROCESSED, SHOWN = "uploaded", "processed", 100
# End of the fixed values.
RAW = "file_id string, name string, bytes bigint, sha256 string, content binary, uploaded_at timestamp, day date"
TABLE = (
    "file_id string, filename string, source string, status string, size_bytes bigint, checksum string, uploaded_at timestamp, processed_at timestamp, events_created bigint, "
    "chunks_created bigint, suspicious_chunks bigint, ai_analyses bigint, incidents_created bigint"
)


class StoreConflict(ValueError):
    """A stored file has other content."""


def safe_name(name: Column) -> Column:
    """A file name with `_` for everything but ASCII letters, digits, dot, dash and underscore."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


class RawStore:
    """Files of up to LARGEST bytes, a row each. Content goes from the reader to the store's files by the executors alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark)

    def _table(self) -> DataFrame:
        if not self.files.names(f"{self.path}/raw"):
            return self.spark.createDataFrame([], RAW)
        return self.spark.read.schema(RAW).parquet(f"{self.path}/raw")

    def listed(self, day: str | None = None) -> DataFrame:
        """All columns but the content, of all days or one; only that day's folder and no content is read."""
        t = self._table().drop("content")
        return t if day is None else t.where(F.col("day") == F.lit(day).cast("date"))

    def put(self, rows: DataFrame) -> DataFrame:
        """Stores rows (file_id, name, content, uploaded_at) and returns them without content, with sha256 and bytes.

        Rows that repeat id, name, day and content count once.
        """
        new = rows.select("file_id", safe_name(F.col("name")).alias("name"), F.length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content", "uploaded_at", F.to_date("uploaded_at").alias("day"))
        facts = new.drop("content").groupBy("file_id", "name", "day").agg(F.min("sha256").alias("sha256"), F.max("sha256").alias("other"), F.min("bytes").alias("bytes"), F.max("bytes").alias("most"), F.min("uploaded_at").alias("uploaded_at"))
        there = self.listed().select("file_id", "name", "day", F.col("sha256").alias("stored"))
        both = facts.join(there, ["file_id", "name", "day"], "left")
        wrong = both.where((F.col("sha256") != F.col("other")) | (F.col("stored") != F.col("sha256"))).select("file_id", "name").limit(5).collect()
        if wrong:
            raise StoreConflict(f"stored with different content: {[f'{r[0]}_{r[1]}' for r in wrong]}")
        if both.where(F.col("most") > LARGEST).limit(1).count():
            raise ValueError("too large")
        fresh = both.where("stored is null").select("file_id", "name", "day")
        add = new.join(fresh, ["file_id", "name", "day"], "left_semi").dropDuplicates(["file_id", "name", "day"])
        add.select(*[c.split(" ")[0] for c in RAW.split(", ")]).write.partitionBy("day").mode("append").parquet(f"{self.path}/raw")
        return facts.select("file_id", "name", "bytes", "sha256", "uploaded_at", "day")

    def put_folder(self, folder: str, pattern: str = "*") -> DataFrame:
        """Stores the files of a folder; an id is made of a file's path."""
        f = self.spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        name = F.element_at(F.split("path", "/"), -1)
        return self.put(f.where(F.col("length") <= LARGEST).select(F.sha2("path", 224).alias("file_id"), name.alias("name"), "content", F.col("modificationTime").alias("uploaded_at")))

    def content(self, ids: list[str], day: str | None = None) -> DataFrame:
        t = self._table().where(F.col("file_id").isin(ids))
        return t if day is None else t.where(F.col("day") == F.lit(day).cast("date"))

    def verify(self, expected: DataFrame) -> DataFrame:
        """expected (file_id, sha256) with intact: the stored content is there and has this digest now."""
        now = self._table().select(F.col("file_id").alias("_id"), F.sha2("content", 256).alias("_now"))
        return expected.join(now, F.col("file_id") == F.col("_id"), "left").withColumn("intact", F.coalesce(F.col("sha256") == F.col("_now"), F.lit(False))).drop("_id", "_now")

    def stats(self) -> DataFrame:
        return self.listed().agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.round(F.coalesce(F.sum("bytes"), F.lit(0)) / (1 << 20), 2).alias("megabytes"))


class FileTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark)

    def _versions(self) -> list[str]:
        return [n for n in self.files.names(f"{self.path}/files") if self.files.exists(f"{self.path}/files/{n}/_SUCCESS")]

    def rows(self) -> DataFrame:
        v = self._versions()
        return self.spark.read.schema(TABLE).parquet(f"{self.path}/files/{v[-1]}") if v else self.spark.createDataFrame([], TABLE)

    def upsert(self, changes: DataFrame, order: str | None = None) -> None:
        """Adds files and changes those that are there: a column that a change lacks, or has null in, stays as it is.

        Of several changes of a file the last non-null value by `order` counts for each column (the largest without it).
        """
        columns = [c.split(" ")[0] for c in TABLE.split(", ")]
        known = [c for c in columns[1:] if c in changes.columns]
        last = (lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c)))) if order else F.max
        new = changes.where("file_id is not null").groupBy("file_id").agg(*(last(c).alias(f"_{c}") for c in known), F.lit(True).alias("_there"))
        both = self.rows().join(new, "file_id", "full")
        out = both.select("file_id", *(F.coalesce(f"_{c}", c).alias(c) if c in known else F.col(c) for c in columns[1:]))
        out = out.withColumn("status", F.coalesce("status", F.lit(UPLOADED))).to(self.spark.createDataFrame([], TABLE).schema)
        before = self._versions()
        number = int(before[-1].split("=")[1].split("-")[0]) + 1 if before else 1
        out.write.parquet(f"{self.path}/files/version={number:08d}-{uuid.uuid4().hex[:8]}")
        for old in before[:-1]:  # the version before stays for those that read it now
            self.files.delete(f"{self.path}/files/{old}")

    def set_status(self, file_id: str, status: str) -> None:
        self.upsert(self.spark.createDataFrame([(file_id, status)], "file_id string, status string").join(self.rows().select("file_id"), "file_id", "left_semi"))

    def processed(self, counts: DataFrame) -> None:
        """counts: file_id, processed_at and the numbers of what was made of a file, which is processed then; unknown files are left out."""
        self.upsert(counts.withColumn("status", F.lit(PROCESSED)).join(self.rows().select("file_id"), "file_id", "left_semi"))

    def listed(self, status: str | None = None, limit: int = SHOWN) -> DataFrame:
        """The newest files first."""
        t = self.rows() if status is None else self.rows().where(F.col("status") == status)
        return t.orderBy(F.desc("uploaded_at"), "file_id").limit(limit)
