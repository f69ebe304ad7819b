"""Look-ups that aren't by equal keys: the newest result of a cache that isn't too old, and texts that hold other texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000
#: Columns that don't count for a content's key, and hours that a result stays valid.
VOLATILE, HOURS = ("chunk_id", "created_at", "file_id"), 24
#: Length of the parts of a text that are indexed.
GRAM = 3


def content_key(columns: list[str]) -> Column:
    """The digest of a row's content as JSON with sorted names, without VOLATILE columns."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in columns if c not in VOLATILE)), {"ignoreNullFields": "false"}), 256)


def newest(requests: DataFrame, entries: DataFrame, keys: list[str], at: str = "at", entry: str = "entry_id", hours: int = HOURS) -> DataFrame:
    """Every request with `entry` and entry_at of the newest entry of its keys that is no later and less than `hours` old, else nulls.

    Of entries of one time the largest id counts; null keys find nothing. Times are microseconds. A key's requests and
    entries are cut into hours, and what an hour inherits comes from a table of the newest entry of each key and hour,
    so a busy key is as many groups as it has hours.
    """
    hour = lambda: (F.col(at) - F.pmod(F.col(at), F.lit(HOUR))).alias("_hour")
    known = entries.dropna(subset=[*keys, at, entry]).groupBy(*keys, at).agg(F.max(entry).alias(entry)).select(*keys, hour(), at, F.struct(F.col(at).alias("at"), F.col(entry).alias("id")).alias("_e"))
    asked = requests.select(*keys, hour(), at, F.struct(*requests.columns).alias("_r"))
    last = known.groupBy(*keys, "_hour").agg(F.max("_e").alias("_last"))
    hours_of = asked.select(*keys, "_hour").distinct().join(last, [*keys, "_hour"], "full")
    before = Window.partitionBy(*keys).orderBy("_hour").rangeBetween(-(hours + 1) * HOUR, -1)
    inherited = hours_of.select(*keys, "_hour", F.last("_last", True).over(before).alias("_before")).where(F.col("_before").isNotNull())
    points = asked.select(*keys, "_hour", at, "_r", F.lit(None).cast(known.schema["_e"].dataType).alias("_e"), F.lit(1).alias("_kind")).unionByName(
        known.select(*keys, "_hour", at, F.lit(None).cast(asked.schema["_r"].dataType).alias("_r"), "_e", F.lit(0).alias("_kind"))
    )
    here = Window.partitionBy(*keys, "_hour").orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = points.withColumn("_e", F.last("_e", True).over(here)).where("_kind = 1").join(inherited, [*keys, "_hour"], "left")
    best = F.coalesce("_e", "_before")
    valid = F.col(at) - best["at"] < hours * HOUR
    return found.select("_r.*", F.when(valid, best["id"]).alias(entry), F.when(valid, best["at"]).alias("entry_at"))


def _grams(text: str, size: Column) -> Column:
    n = F.char_length(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, size)))


def contained(needles: DataFrame, texts: DataFrame, needle: str = "needle", text: str = "text") -> DataFrame:
    """The distinct needles that some text holds; no needle is compared with a text that lacks its rarest part.

    Texts are indexed by their parts of GRAM characters (shorter ones only where a needle is shorter). A needle with a
    part that no text has is out; the others are looked for in the texts that hold their rarest part. Nulls and empty
    needles find nothing.
    """
    n = needles.select(F.col(needle).alias("needle")).where("needle <> ''").distinct().withColumn("size", F.least(F.char_length("needle"), F.lit(GRAM)))
    sizes = [r["size"] for r in n.select("size").distinct().collect()]  # GRAM numbers at most
    t = texts.select(F.col(text).alias("text")).where("text <> ''").distinct()
    long_enough = F.char_length("text") >= F.col("size")
    index = t.withColumn("size", F.explode(F.array(*map(F.lit, sizes or [GRAM])))).where(long_enough).select("text", F.explode(_grams("text", F.col("size"))).alias("gram"))
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    parts = n.select("needle", F.explode(_grams("needle", F.col("size"))).alias("gram")).join(counts, "gram", "left")
    probe = parts.groupBy("needle").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_or(F.col("n").isNull()).alias("missing")).where("not missing").drop("missing")
    return probe.join(index, "gram").where(F.contains("text", "needle")).select("needle").distinct()


def stem(name: Column) -> Column:
    """A file's name without its ending, as it is compared."""
    return F.regexp_replace(F.lower(F.trim(name)), r"\.[^.]+$", "")


def has_report(files: DataFrame, reports: DataFrame) -> DataFrame:
    """files (file_id, filename, status, ...) with ready: processed, or a report has its id, or holds its id or its stem in its name, or its id in its path."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    f = files.withColumns({"_id": clean(F.col("file_id")), "_stem": stem(F.coalesce("filename", F.lit("")))})
    r = reports.select(clean(F.col("file_id")).alias("id"), clean(F.col("report_name")).alias("name"), clean(F.col("report_path")).alias("path"))
    by_id = r.where("id <> ''").select(F.col("id").alias("_id")).distinct()
    ids = contained(f.select("_id"), r.select("name").union(r.select("path")), "_id", "name").toDF("_id")
    stems = contained(f.select("_stem"), r, "_stem", "name").toDF("_stem")
    mark = lambda df, name: df.withColumn(name, F.lit(True))
    out = f.join(mark(by_id.union(ids).distinct(), "_a"), "_id", "left").join(mark(stems, "_b"), "_stem", "left")
    return out.select(*files.columns, (F.coalesce("_a", "_b", F.lit(False)) | (clean(F.col("status")) == "processed")).alias("ready"))
