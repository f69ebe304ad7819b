"""What is known of each source on a day, merged batch by batch, and reports over it.

A batch is summed to one row for each day and source first (`parts`). `merge` adds these rows to the state: counters are
added, lists keep what was seen first up to their caps, and the score goes on from where it was. Merging batches one by
one gives what one pass over all of them in the same order gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlake.functions.text import filled
from threatlake.operators import detect, state

# The length that a timeline's evidence is cut to, and the score of a source of high risk.
EVIDENCE, HIGH = 100, 0.5
# End of the fixed values.
KEYS = ["day", "src_ip"]
ENTRY = "struct<at: timestamp, category: string, rule_name: string, evidence: string, batch: int>"
#: The state's columns; `batch` numbers the day's batches from 1.
SCHEMA = (
    "day date, src_ip string, batches int, requests bigint, statuses map<int, bigint>, auth_failures bigint, auth_successes bigint, unique_uris bigint, "
    f"first_seen timestamp, last_seen timestamp, signatures array<string>, categories array<string>, timeline array<{ENTRY}>, agents array<string>, "
    "rates array<struct<batch: int, requests: bigint>>, threat_score double"
)


def parts(events: DataFrame, threats: DataFrame, keys: tuple = ("day",)) -> DataFrame:
    """One row for each of `keys` and source; rows without a source are one row with a null source, for the number of events.

    A source with most rows is dealt over its paths, statuses and agents before it is summed. Threats of sources without
    an event are left out. Times are those of the first and the last row that has one.
    """
    by = [*keys, "src_ip"]
    e = events.withColumn("src_ip", F.nullif("src_ip", F.lit("")))
    at = F.when(F.col("event_ts").isNotNull(), F.struct("row_number", F.col("event_ts").cast("timestamp").alias("at")))
    paths = e.groupBy(*by, "uri_path").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    sums = paths.groupBy(*by).agg(F.sum("n").alias("requests"), F.count_if(filled(F.col("uri_path"))).alias("unique_uris"), F.min("first")["at"].alias("first_seen"), F.max("last")["at"].alias("last_seen"))
    status = F.nullif(F.col("http_status").cast("int"), F.lit(0))
    counts = e.where(status.isNotNull() & F.col("src_ip").isNotNull()).groupBy(*by, status.alias("s")).count()
    counts = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("s", "count"))).alias("statuses"))
    agents = e.where(filled(F.col("user_agent")) & F.col("src_ip").isNotNull()).groupBy(*by, "user_agent").agg(F.min("row_number").alias("at"))
    agents = agents.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("at", "user_agent"))).where(F.col("k") <= state.AGENTS)
    agents = agents.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "user_agent"))), lambda x: x["user_agent"]).alias("agents"))
    # at most as many entries as there are rules
    order = [detect.severity_rank(F.col("severity")).alias("rank"), (-F.col("match_count")).alias("k"), F.col("first_match"), F.col("rule_name")]
    said = F.substring(F.coalesce(F.get("sample_evidence", F.lit(0)), F.lit("")), 1, EVIDENCE)
    entry = F.struct(*order, "category", "severity", F.col("first_seen").cast("timestamp").alias("at"), said.alias("evidence"))
    found = threats.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("found"))
    found = found.withColumn("found", F.transform("found", lambda x: F.struct(x["at"].alias("at"), x["category"].alias("category"), x["rule_name"].alias("rule_name"), x["evidence"].alias("evidence"), x["severity"].alias("severity"))))
    out = sums
    for more in (counts, agents, found):
        out = out.join(more, by, "left")
    return out


def _increment(severity: Column) -> Column:
    return F.coalesce(*(F.when(severity == k, F.lit(v)) for k, v in state.INCREMENTS.items()), F.lit(0.05))


def merge(before: DataFrame, new: DataFrame, numbers: Column) -> DataFrame:
    """The state after a batch. before: SCHEMA; new: rows of parts() of one batch; numbers: the batch's number in the row's day.

    One join by day and source; everything else is a projection of its rows.
    """
    empty = lambda kind: F.array().cast(kind)
    a = before.select(*KEYS, F.struct(*(c for c in before.columns if c not in KEYS)).alias("a"))
    b = new.where(F.col("src_ip").isNotNull()).select(*KEYS, F.struct("requests", "statuses", "unique_uris", "first_seen", "last_seen", "agents", "found").alias("b"))
    rows = a.join(b, KEYS, "full").withColumn("number", numbers.cast("int"))
    got = F.col("b").isNotNull()
    total = lambda c: (F.coalesce(F.col(f"a.{c}"), F.lit(0)) + F.coalesce(F.col(f"b.{c}"), F.lit(0))).cast("bigint")
    old = lambda c, kind: F.coalesce(F.col(f"a.{c}"), empty(kind))
    none = F.create_map().cast("map<int, bigint>")
    here = F.coalesce("b.statuses", none)
    statuses = F.map_zip_with(F.coalesce("a.statuses", none), here, lambda k, x, y: (F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))).cast("bigint"))
    found = F.coalesce("b.found", empty("array<struct<at: timestamp, category: string, rule_name: string, evidence: string, severity: string>>"))
    start = F.struct(F.coalesce("a.threat_score", F.lit(0.0)).alias("score"), old("categories", "array<string>").alias("categories"))

    def add(s, x):
        seen = F.array_distinct(F.concat(s["categories"], F.array(x["category"])))
        more = _increment(x["severity"]) * F.when(F.size(seen) >= 3, 1.5).otherwise(1.0)
        return F.struct(F.least(F.lit(1.0), s["score"] + more).alias("score"), seen.alias("categories"))

    entries = F.transform(found, lambda x: F.struct(x["at"].alias("at"), x["category"].alias("category"), x["rule_name"].alias("rule_name"), x["evidence"].alias("evidence"), F.col("number").alias("batch")))
    rate = F.when(got, F.array(F.struct(F.col("number").alias("batch"), F.col("b.requests").alias("requests")))).otherwise(empty("array<struct<batch: int, requests: bigint>>"))
    rows = rows.withColumn("f", F.aggregate(found, start, add))
    status = lambda k: F.coalesce(F.try_element_at(here, F.lit(k)), F.lit(0))
    out = rows.select(
        *KEYS, (F.coalesce("a.batches", F.lit(0)) + got.cast("int")).cast("int").alias("batches"), total("requests").alias("requests"), statuses.alias("statuses"),
        (F.coalesce("a.auth_failures", F.lit(0)) + status(401)).cast("bigint").alias("auth_failures"), (F.coalesce("a.auth_successes", F.lit(0)) + status(200)).cast("bigint").alias("auth_successes"),
        total("unique_uris").alias("unique_uris"), F.least("a.first_seen", "b.first_seen").alias("first_seen"), F.greatest("a.last_seen", "b.last_seen").alias("last_seen"),
        F.array_distinct(F.concat(old("signatures", "array<string>"), F.transform(found, lambda x: x["rule_name"]))).alias("signatures"), F.col("f.categories").alias("categories"),
        F.slice(F.concat(old("timeline", f"array<{ENTRY}>"), entries), 1, state.TIMELINE).alias("timeline"),
        F.slice(F.array_distinct(F.concat(old("agents", "array<string>"), F.coalesce("b.agents", empty("array<string>")))), 1, state.AGENTS).alias("agents"),
        F.concat(old("rates", "array<struct<batch: int, requests: bigint>>"), rate).alias("rates"), F.col("f.score").alias("threat_score"),
    )
    return out.to(before.sparkSession.createDataFrame([], SCHEMA).schema)


def findings(actors: DataFrame) -> DataFrame:
    """The correlation rules that hold for each day and source."""
    plain = actors.withColumn("rates", F.transform("rates", lambda x: x["requests"]))
    return state.correlations(plain, keys=tuple(KEYS))


def high_risk(actors: DataFrame, least: float = HIGH) -> DataFrame:
    """Sources of at least this score, with their place on their day; the highest score comes first."""
    found = actors.where(F.col("threat_score") >= least).select(*KEYS, "threat_score", "categories")
    # few beside the day's sources; ranked within a day
    return found.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("threat_score"), "src_ip")))


def day_reports(actors: DataFrame, batches: DataFrame) -> DataFrame:
    """One row a day: batches, events, sources, attackers, sources of high risk, and maps by category and by hour. batches: day, number, events."""
    totals = batches.groupBy("day").agg(F.max("number").cast("int").alias("batches"), F.sum("events").alias("events"))
    attacks = F.size("signatures") > 0
    sums = actors.groupBy("day").agg(F.count("*").alias("sources"), F.count_if(attacks).alias("attackers"), F.count_if(F.col("threat_score") >= HIGH).alias("high_risk"))
    as_map = lambda df, k, name: df.groupBy("day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "n")))).alias(name))
    kinds = as_map(actors.select("day", F.explode("categories").alias("category")).groupBy("day", "category").agg(F.count("*").alias("n")), "category", "by_category")
    hour = F.date_format("x.at", "yyyy-MM-dd HH")
    hours = as_map(actors.select("day", F.explode("timeline").alias("x")).where("x.at is not null").groupBy("day", hour.alias("hour")).agg(F.count("*").alias("n")), "hour", "by_hour")
    return totals.join(sums, "day", "left").join(kinds, "day", "left").join(hours, "day", "left")
