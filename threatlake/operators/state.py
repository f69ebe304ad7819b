"""Per-source state over batches, the compounding score, and correlation rules over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.functions.text import filled
from threatlake.operators import detect

# Increments of the score, and the categories and tools of the correlation rules.
INCREMENTS = {"critical": 0.3, "high": 0.2, "medium": 0.1, "low": 0.05, "info": 0.02}
RECON = ["recon_scanner", "bot_automation"]
EXPLOIT = ["sql_injection", "cross_site_scripting", "os_command_injection", "path_traversal", "lfi", "local_file_inclusion", "rfi", "remote_code_execution", "server_side_template_injection", "cve_exploit"]
POST_EXPLOIT = ["sensitive_information_disclosure", "hardcoded_credentials", "hardcoded_credential_exposure", "arbitrary_file_read"]
SCANNERS = "sqlmap|nikto|nuclei|dirbuster|gobuster|wfuzz|ffuf|burp|nmap|acunetix|nessus"
TIMELINE, AGENTS = 200, 50
STAGES, LAST_STAGE = "recon \u2192 exploit", " \u2192 post-exploitation"
# End of the fixed values.


def batch_stats(events: DataFrame, batch: str = "batch") -> DataFrame:
    """One row for each source and batch; summed by path first, so that a source with most rows is dealt over its paths."""
    status = F.col("http_status")
    by_path = events.where(filled(F.col("src_ip"))).groupBy(batch, "src_ip", "uri_path").agg(
        F.count("*").alias("n"), F.count_if(status == 401).alias("n401"), F.count_if(status == 200).alias("n200"),
        F.min(F.struct("row_number", "event_ts")).alias("first"), F.max(F.struct("row_number", "event_ts")).alias("last"),
    )
    return by_path.groupBy(batch, "src_ip").agg(
        F.sum("n").alias("requests"), F.sum("n401").alias("auth_failures"), F.sum("n200").alias("auth_successes"),
        F.count_if(filled(F.col("uri_path"))).alias("unique_uris"), F.min("first")["event_ts"].alias("first_seen"), F.max("last")["event_ts"].alias("last_seen"),
    )


def status_histogram(events: DataFrame, keys: tuple = ("src_ip",)) -> DataFrame:
    """A map of statuses and how often each occurs, for each source; summed by status first."""
    counts = events.where(F.col("http_status").isNotNull()).groupBy(*keys, "http_status").count()
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("http_status", "count")))).alias("statuses"))


def scores(threats: DataFrame, batch: str = "batch") -> DataFrame:
    """(src_ip, categories, timeline, threat_score): a fold over a source's threats, by batch, then severity, then count."""
    rank = detect.severity_rank(F.col("severity"))
    entry = F.struct(batch, rank.alias("rank"), (-F.col("match_count")).alias("k"), "first_match", "rule_name", "category", "severity", F.col("first_seen").alias("at"))
    by = threats.groupBy("src_ip").agg(F.array_sort(F.collect_list(entry)).alias("entries"))  # a rule and batch each
    increment = lambda s: F.coalesce(*(F.when(s == k, F.lit(v)) for k, v in INCREMENTS.items()), F.lit(0.05))
    start = F.struct(F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("categories"))

    def add(a, x):
        seen = F.array_distinct(F.concat(a["categories"], F.array(x["category"])))
        more = increment(x["severity"]) * F.when(F.size(seen) >= 3, 1.5).otherwise(1.0)
        return F.struct(F.least(F.lit(1.0), a["score"] + more).alias("score"), seen.alias("categories"))

    out = by.withColumn("folded", F.aggregate("entries", start, add))
    return out.select("src_ip", F.col("folded.categories").alias("categories"), F.slice("entries", 1, TIMELINE).alias("timeline"), F.col("folded.score").alias("threat_score"))


def actors(events: DataFrame, threats: DataFrame, batch: str = "batch") -> DataFrame:
    """One row for each source: sums over batches, rates by batch, agents, categories, timeline and score."""
    stats = batch_stats(events, batch).groupBy("src_ip").agg(
        F.count("*").alias("batches"), F.sum("requests").alias("requests"), F.sum("auth_failures").alias("auth_failures"), F.sum("auth_successes").alias("auth_successes"),
        F.sum("unique_uris").alias("unique_uris"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.transform(F.array_sort(F.collect_list(F.struct(batch, "requests"))), lambda x: x["requests"]).alias("rates"),
    )
    from pyspark.sql import Window

    agents = events.where(filled(F.col("user_agent"))).groupBy("src_ip", "user_agent").agg(F.min(F.struct(batch, "row_number")).alias("at"))
    agents = agents.withColumn("k", F.row_number().over(Window.partitionBy("src_ip").orderBy("at"))).where(F.col("k") <= AGENTS)
    agents = agents.groupBy("src_ip").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "user_agent"))), lambda x: x["user_agent"]).alias("agents"))
    return stats.join(agents, "src_ip", "left").join(scores(threats, batch), "src_ip", "left")


def correlations(actors: DataFrame, keys: tuple = ("src_ip",)) -> DataFrame:
    """One row for each source (of `keys`) and correlation rule that holds, with its evidence as a map; a projection of the actors."""
    cats = F.coalesce("categories", F.array().cast("array<string>"))
    has = lambda of: F.arrays_overlap(cats, F.array(*map(F.lit, of)))
    n = F.size("rates")
    first, last = F.get("rates", n - 3), F.get("rates", n - 1)
    scanners = F.filter(F.coalesce("agents", F.array().cast("array<string>")), lambda a: F.lower(a).rlike(SCANNERS))
    night = F.size(F.filter(F.coalesce("timeline", F.slice("timeline", 1, 0)), lambda x: F.hour(x["at"]) < 6))
    listed = lambda x: F.array_join(x, ", ")
    stages = F.concat(F.lit(STAGES), F.when(has(POST_EXPLOIT), LAST_STAGE).otherwise(""))

    def found(rule, category, severity, confidence, when, parts, **evidence):
        text = F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
        pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]
        return F.when(when, F.struct(F.lit(rule).alias("correlation_rule"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), text.alias("description"), F.create_map(*pairs).alias("evidence")))

    c = F.col
    return actors.select(*keys, F.inline(F.array_compact(F.array(
        found("low_slow_brute_force", "broken_authentication", "high", 0.85, c("auth_failures") >= 50, ("Low-and-slow brute force: ", c("auth_failures"), " auth failures across ", c("batches"), " batches"), auth_failures=c("auth_failures"), batches=c("batches")),
        found("distributed_recon", "recon_scanner", "high", 0.8, (c("unique_uris") >= 200) & (c("batches") >= 2), ("Distributed recon: ", c("unique_uris"), " unique URIs across ", c("batches"), " batches"), unique_uris=c("unique_uris")),
        found("multi_vector_attacker", "multi_vector_attack", "critical", 0.9, F.size(cats) >= 3, ("Multi-vector: ", F.size(cats), " attack types (", listed(F.slice(cats, 1, 5)), ")"), categories=listed(cats)),
        found("kill_chain_progression", "kill_chain", "critical", 0.9, has(RECON) & has(EXPLOIT), ("Kill-chain: ", stages), stages=stages, categories=listed(cats)),
        found("scanner_persistence", "recon_scanner", "high", 0.9, (F.size(scanners) > 0) & (c("batches") >= 3), ("Scanner persists across ", c("batches"), " batches"), scanner_uas=listed(F.slice(scanners, 1, 3))),
        found("rate_acceleration", "rate_limiting", "medium", 0.7, (n >= 3) & (last >= 2 * first) & (last > 50), ("Rate acceleration: ", first, " \u2192 ", last, " requests across last 3 batches"), rates=listed(F.slice("rates", F.greatest(n - 2, F.lit(1)), F.lit(3)).cast("array<string>"))),
        found("off_hours_anomaly", "suspicious_timing", "medium", 0.6, night >= 5, (night, " attack events during off-hours (00:00-06:00)"), off_hours_count=night),
        found("data_exfiltration_pattern", "data_exfiltration", "high", 0.6, (F.size(cats) > 0) & (c("auth_successes") > 100) & (c("requests") > 200) & (c("auth_successes") / c("requests") > 0.5) & (c("threat_score") > 0.3), ("Potential data exfil: attacker with ", c("auth_successes"), " successful requests"), success_count=c("auth_successes"), threat_score=F.round("threat_score", 9)),
    ))))


def new_findings(findings: DataFrame, reported: DataFrame) -> DataFrame:
    """Findings that weren't reported before."""
    return findings.join(reported, ["src_ip", "correlation_rule"], "left_anti")


def day_summary(actors: DataFrame) -> DataFrame:
    return actors.agg(
        F.count("*").alias("actors"), F.sum("requests").alias("requests"), F.count_if(F.size(F.coalesce("categories", F.array().cast("array<string>"))) > 0).alias("active"),
        F.count_if(F.col("threat_score") >= 0.5).alias("high_risk"),
    )


def category_breakdown(actors: DataFrame) -> DataFrame:
    return actors.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("actors"))


def hourly_timeline(actors: DataFrame) -> DataFrame:
    return actors.select(F.explode("timeline").alias("x")).groupBy(F.date_format("x.at", "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("entries"))
