"""Actors over all files: profiles from one row for each file and actor, and patterns that several files share.

The score and its factors are this library's own: up to 40 for denials, 20 each for targets, chunks and days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000_000
#: The score of an actor of high risk.
HIGH = 70
#: From here on a figure is named as a factor: share of denials, targets, days and files.
DENIALS, TARGETS, DAYS, FILES = 0.3, 10, 3, 3
LISTED = 20


def by_file(chunks: DataFrame, file: str = "file_id") -> DataFrame:
    """One row for each file and actor; chunks are those of sources, with the file they come from."""
    return chunks.where("strategy = 'src_ip'").groupBy(F.col(file).alias("file_id"), F.col("entity").alias("actor")).agg(
        F.count("*").alias("chunks"), F.sum("events").alias("events"), F.sum("denied").alias("denied"), F.max("targets").alias("targets"), F.min("window_start").alias("first_seen"), F.max("window_end").alias("last_seen"),
    )


def actors(chunks: DataFrame, file: str = "file_id") -> DataFrame:
    """One row for each actor over all files, with a score from 0 to 100 and what it comes from."""
    days = chunks.where("strategy = 'src_ip'").select(F.col("entity").alias("actor"), F.floor(F.col("window_start") / DAY).alias("day")).distinct().groupBy("actor").agg(F.count("*").alias("active_days"))
    out = by_file(chunks, file).groupBy("actor").agg(
        F.count("*").alias("files_count"), F.sum("chunks").alias("chunks"), F.sum("events").alias("total_events"), F.sum("denied").alias("total_denials"), F.max("targets").alias("unique_targets"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    ).join(days, "actor")
    c = F.col
    share = c("total_denials") / c("total_events")
    score = 40 * share + F.least(c("unique_targets"), F.lit(20)) + F.least(c("chunks"), F.lit(20)) + F.least(4 * c("active_days"), F.lit(20))
    said = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in x))
    factors = F.array_compact(F.array(
        F.when(share >= DENIALS, said(F.bround(share * 100, 0).cast("int"), "% of events denied")), F.when(c("unique_targets") >= TARGETS, said(c("unique_targets"), " targets in a window")),
        F.when(c("active_days") >= DAYS, said("active on ", c("active_days"), " days")), F.when(c("files_count") >= FILES, said("seen in ", c("files_count"), " files")),
    ))
    return out.withColumns({"risk_score": F.least(score, F.lit(100.0)), "risk_factors": factors}).withColumn("high_risk", F.col("risk_score") >= HIGH)


def cross_file_patterns(chunks: DataFrame, file: str = "file_id", least: int = 2) -> DataFrame:
    """Temporal patterns on a port that chunks of at least so many files show: files, actors, chunks and denials, and the first files.

    Summed by pattern, port, file and actor first, so that a pattern that most chunks show is dealt over files and actors.
    """
    rows = chunks.where("strategy = 'src_ip'").select("pattern", F.explode("ports").alias("port"), F.col(file).alias("file_id"), F.col("entity").alias("actor"), "denied")
    each = rows.groupBy("pattern", "port", "file_id", "actor").agg(F.count("*").alias("chunks"), F.sum("denied").alias("denied"))
    names = each.groupBy("pattern", "port", "actor").agg(F.lit(1).alias("one")).groupBy("pattern", "port").agg(F.sum("one").alias("actors"))
    files = each.groupBy("pattern", "port", "file_id").agg(F.sum("chunks").alias("chunks"), F.sum("denied").alias("denied"))
    shared = files.groupBy("pattern", "port").agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"), F.sum("denied").alias("denied"), F.min("file_id").alias("first_file"), F.max("file_id").alias("last_file"))
    return shared.where(F.col("files") >= least).join(names, ["pattern", "port"])
