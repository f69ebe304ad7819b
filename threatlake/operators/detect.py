"""Threats: matches grouped by source and rule, with samples of bounded size, and summaries over them."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlake.operators import rules

SEVERITIES = ["critical", "high", "medium", "low", "info"]
#: Evidence and event ids kept for a threat, and matches kept in all.
EVIDENCE, IDS, MATCHES = 5, 100, 5000
NO_NUMBER = -(1 << 63)


def severity_rank(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), c).cast("int") - 1, F.lit(5))


def all_matches(events: DataFrame, sites: rules.Sites = rules.Sites(), fixed: bool = True, keys: tuple = ()) -> DataFrame:
    """Signature, predicate and rate matches; phase 0 comes before phase 1."""
    one = rules.matches(events, sites=sites, fixed=fixed, keys=keys, repeated=True).withColumn("phase", F.lit(0))
    two = rules.rate_matches(events, keys).withColumn("phase", F.lit(1))
    return one.unionByName(two, allowMissingColumns=True)


def first_matches(found: DataFrame, limit: int = MATCHES) -> DataFrame:
    """The first matches in order of phase, event and rule name."""
    return found.orderBy("phase", "row_number", "rule_name").limit(limit)


def _first(phase: int) -> Column:
    return F.struct(F.lit(phase).alias("phase"), F.nullif(F.col(f"first{phase}"), F.lit(NO_NUMBER)).alias("row_number"))


def threats(found: DataFrame, keys: tuple = ()) -> DataFrame:
    """One row for each source and rule. Samples are cut by row numbers within the group, before anything is gathered.

    Matches are read three times, so they are kept on memory and disk; they are few beside the events.
    """
    by = [*keys, "src_ip", "rule_name"]
    found = found.select(*keys, "rule_name", "phase", "row_number", "event_id", "event_ts", "evidence", F.coalesce(F.nullif("src_ip", F.lit("")), F.lit("unknown")).alias("src_ip"))
    found = found.persist(StorageLevel.MEMORY_AND_DISK)
    # numbers only, so that groups are hashed: a struct as an aggregate would sort all matches; a null number comes first
    first = lambda phase: F.min(F.when(F.col("phase") == phase, F.coalesce(F.col("row_number").cast("bigint"), F.lit(NO_NUMBER))))
    groups = found.groupBy(*by).agg(F.count("*").alias("match_count"), F.min("event_ts").alias("first_seen"), F.max("event_ts").alias("last_seen"), F.count_if(F.col("phase") == 0).alias("n0"), first(0).alias("first0"), first(1).alias("first1"))
    groups = groups.withColumn("first_match", F.when(F.col("n0") > 0, _first(0)).otherwise(_first(1))).drop("n0", "first0", "first1")
    ids = found.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("row_number"))).where(F.col("k") <= IDS)
    ids = ids.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "event_id"))), lambda x: x["event_id"]).alias("event_ids"))
    said = found.groupBy(*by, "evidence").agg(F.min("row_number").alias("row_number"))
    said = said.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("row_number"))).where(F.col("k") <= EVIDENCE)
    said = said.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "evidence"))), lambda x: x["evidence"]).alias("sample_evidence"))
    return rules.describe(groups.join(said, by, "left").join(ids, by, "left"))


def ordered(found: DataFrame) -> DataFrame:
    """Most severe first, then most matches."""
    return found.orderBy(severity_rank(F.col("severity")), F.desc("match_count"), "first_match", "rule_name", "src_ip")


def ai_need(events: DataFrame, found: DataFrame, threat_groups: DataFrame) -> DataFrame:
    """One row: whether a closer look is needed, and why."""
    n = events.agg(F.count("*").alias("events"), F.count_if(F.col("http_status").between(400, 499)).alias("refused"))
    t = threat_groups.agg(F.count("*").alias("threats"), F.count_if(F.col("confidence") < 0.6).alias("weak"), F.coalesce(F.sum("match_count"), F.lit(0)).alias("matches"))
    both = n.crossJoin(t)  # one row each
    reasons = F.array_compact(F.array(
        F.when((F.col("threats") == 0) & (F.col("events") > 0) & (F.col("refused") / F.col("events") > 0.3), F.lit("many refused requests")),
        F.when(F.col("weak") > 0, F.concat(F.col("weak").cast("string"), F.lit(" low-confidence threats"))),
        F.when(F.col("matches") > 500, F.concat(F.col("matches").cast("string"), F.lit(" matches"))),
    ))
    return both.select("events", "threats", "matches", (F.size(reasons) > 0).alias("needs_review"), F.array_join(reasons, "; ").alias("reasons"))
