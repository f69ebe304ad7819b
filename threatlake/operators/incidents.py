"""Incidents from threats and correlations, lists and statistics of them, rollups of chunks, and network look-ups."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.functions import net
from threatlake.operators import mitre

# The least confidence of a threat that becomes an incident, priorities in order and by severity, the first
# status, and the lengths that titles, evidence, briefs and raw lines are cut to.
LEAST, PRIORITIES, NEW = 0.7, ["critical", "high", "medium", "low", "informational"], "new"
PRIORITY_OF = {"critical": "critical", "high": "high", "medium": "medium", "low": "low", "info": "informational"}
TITLE, FINDING, TEXT, BRIEF = 60, 80, 300, 260
# End of the fixed values.


def indicator(corpus: Column) -> Column:
    """What kind of evidence a text tells of, by parts of its words, in this order; the text "null" if none."""
    t = F.lower(corpus)
    has = lambda *words: reduce(or_, (t.contains(w) for w in words))
    return (
        F.when(has("url", "uri", "path"), "url").when(has("referer", "referrer"), "referer").when(has("user agent", "user_agent"), "user_agent")
        .when(has("payload", "injection", "command"), "payload").when(has("ip", "scanner", "recon"), "source ip").otherwise("null")
    )


def second_address(text: Column) -> Column:
    """The second dotted quad in a text, of two or more."""
    return F.get(F.regexp_extract_all(text, F.lit(r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"), F.lit(0)), F.lit(1))


def score(confidence: Column) -> Column:
    """1 to 10; halves go to the even number."""
    return F.greatest(F.lit(1), F.least(F.lit(10), F.bround(F.coalesce(confidence, F.lit(0.0)) * 10, 0).cast("int")))


def _incidents(found: DataFrame, source: str, rule: str, title: Column, text: Column, evidence: Column, corpus: Column, raw: Column, action: Column) -> DataFrame:
    """text: what was found, in a sentence."""
    priority = F.coalesce(*(F.when(F.col("severity") == k, F.lit(v)) for k, v in PRIORITY_OF.items()), F.lit("medium"))
    mapped = mitre.map_findings(found, rule)
    return mapped.select(
        F.md5(F.concat_ws("|", F.lit(source), "src_ip", rule)).alias("incident_id"), F.lit(source).alias("source"), F.col(rule).alias("rule"), "category", "src_ip",
        title.alias("title"), priority.alias("priority"), F.lit(NEW).alias("status"), (priority != "informational").alias("suspicious"), "confidence", score(F.col("confidence")).alias("score"),
        F.substring(evidence, 1, TEXT).alias("evidence"), F.substring(raw, 1, TEXT).alias("raw_log"), second_address(evidence).alias("destination_ip"), indicator(corpus).alias("indicator"),
        F.substring(text, 1, BRIEF).alias("brief"), action.alias("action"), "technique_id", "technique", "tactic", *(c for c in ("first_seen", "last_seen", "match_count") if c in found.columns),
    )


def from_threats(threats: DataFrame) -> DataFrame:
    """An incident for each threat of enough confidence; its evidence is the first three samples."""
    actor, said = F.coalesce(F.nullif("src_ip", F.lit("")), F.lit("Unknown")), F.coalesce("sample_evidence", F.array().cast("array<string>"))
    evidence, text = F.array_join(F.slice(said, 1, 3), "; "), F.col("description")
    title = F.concat(F.lit("["), F.upper("category"), F.lit("] "), F.substring(text, 1, TITLE), F.lit(" from "), actor)
    action = F.concat(F.lit("Investigate "), F.col("category"), F.lit(" from "), actor)
    return _incidents(threats.where(F.col("confidence") >= LEAST), "deterministic", "rule_name", title, text, evidence, F.concat_ws(" ", "category", "rule_name", evidence), F.get(said, F.lit(0)), action)


def from_correlations(findings: DataFrame) -> DataFrame:
    """An incident for each finding; the finding's evidence is its description."""
    text = F.col("description")
    action = F.concat(F.lit("Investigate correlated activity from "), F.col("src_ip"))
    return _incidents(findings, "correlation", "correlation_rule", F.concat(F.lit("[CORRELATION] "), F.substring(text, 1, FINDING)), text, text, F.concat_ws(" ", text, "correlation_rule"), text, action)


def all_incidents(threats: DataFrame, findings: DataFrame) -> DataFrame:
    return from_threats(threats).unionByName(from_correlations(findings), allowMissingColumns=True)


def listed(incidents: DataFrame, order: str = "severity", limit: int | None = None, **equal: str) -> DataFrame:
    """Incidents with these column values; `severity` puts the worst and newest first, `reference` the least severe."""
    for k, v in equal.items():
        incidents = incidents.where(F.col(k) == v)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority")), F.lit(0))
    out = incidents.orderBy(rank if order == "severity" else F.desc(rank), F.desc("first_seen"), "incident_id")
    return out if limit is None else out.limit(limit)


def searched(incidents: DataFrame, title: str = "", tactic: str | None = None, source_ip: str | None = None) -> DataFrame:
    """Incidents whose title holds a text, whatever its case, of a tactic and a source."""
    out = incidents.where(F.lower("title").contains(title.lower()))
    for column, value in (("tactic", tactic), ("src_ip", source_ip)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def of_file(incidents: DataFrame, files: str, file_id: str) -> DataFrame:
    """Incidents that list a file among theirs (an array column)."""
    return incidents.where(F.array_contains(files, file_id))


def changed(incidents: DataFrame, changes: DataFrame) -> DataFrame:
    """Incidents after their latest changes. changes: incident_id, changed_at, and status or priority, null where unchanged.

    Changes are folded by id before they meet the incidents, so a rewrite reads each incident once. Of changes at one time
    the largest values count last. A timeline that is there is continued.
    """
    order = F.struct("changed_at", "status", "priority")
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("changed_at", c))).alias(f"_{c}") for c in ("status", "priority")]
    folded = changes.groupBy("incident_id").agg(*latest, F.array_sort(F.collect_list(order)).alias("_timeline"))
    out = incidents.join(folded, "incident_id", "left")
    before = ["timeline"] if "timeline" in incidents.columns else []
    none = F.array().cast(folded.schema["_timeline"].dataType)
    whole = F.concat(*(F.coalesce(c, none) for c in [*before, "_timeline"]))
    kept = F.when(F.coalesce("_timeline", *before).isNotNull(), whole)
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in ("status", "priority")} | {"timeline": kept}).drop("_status", "_priority", "_timeline")


def rows_as_json(incidents: DataFrame) -> DataFrame:
    """(incident_id, json): one JSON object for each incident, for stores that take documents."""
    return incidents.select("incident_id", F.to_json(F.struct(*sorted(incidents.columns))).alias("json"))


def stats(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("status", "priority").agg(F.count("*").alias("incidents"))


def per_day(incidents: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    return incidents.groupBy(F.date_format(F.from_utc_timestamp(F.col("first_seen").cast("timestamp"), zone), "dd/MM/yyyy").alias("day")).agg(F.count("*").alias("incidents"))


def top_tactics(incidents: DataFrame, k: int = 8) -> DataFrame:
    return incidents.where("tactic is not null").groupBy("tactic").agg(F.count("*").alias("incidents")).orderBy(F.desc("incidents"), "tactic").limit(k)


def rollup(chunks: DataFrame, day: int = 86_400_000_000, least: int = 1) -> DataFrame:
    """One row for each entity of the source strategy over all its chunks, with a score from 0 to 100."""
    out = chunks.where("strategy = 'src_ip'").groupBy("entity").agg(
        F.count("*").alias("chunks"), F.sum("events").alias("events"), F.sum("denied").alias("denied"), F.max("targets").alias("most_targets"),
        F.min("window_start").alias("first_seen"), F.max("window_end").alias("last_seen"), F.count_distinct(F.floor(F.col("window_start") / day)).alias("active_days"),
    )
    score = 40 * F.col("denied") / F.col("events") + F.least(F.col("most_targets"), F.lit(20)) + F.least(F.col("chunks"), F.lit(20)) + F.least(4 * F.col("active_days"), F.lit(20))
    return out.where(F.col("chunks") >= least).withColumn("risk_score", F.least(score, F.lit(100.0)))


def locate(addresses: DataFrame, networks: DataFrame, ip: str = "ip") -> DataFrame:
    """Adds the columns of the first network (by ord) that holds each external address. networks: ord, first, last, ...

    Only distinct addresses are joined, by the leading 16 bits, so it is an equality join and not a comparison of all pairs.
    """
    distinct = addresses.select(ip).distinct().withColumn("n", net.ip_number(F.col(ip))).where(F.col("n").isNotNull() & ~net.is_internal(F.col(ip)))
    wide = networks.withColumn("prefix", F.explode(F.sequence(F.shiftright("first", 16), F.shiftright("last", 16))))
    hits = distinct.withColumn("prefix", F.shiftright("n", 16)).join(wide, "prefix").where("n between first and last")
    found = hits.groupBy(ip).agg(F.min_by(F.struct(*(c for c in networks.columns)), "ord").alias("network")).select(ip, "network.*")
    return addresses.join(found.drop("ord", "first", "last"), ip, "left")
