"""The registered queries over the driver tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.functions import net, text
from threatlake.operators import chunks, detect, incidents, mitre, normalize, rules, state, summaries
from threatlake.plans.adapter import events
from threatlake.plans import across, analyses, days, oracle, parsed

__all__ = ["oracle_sql", "queries"]


def _matches(family: str, spark: SparkSession, sf: str) -> DataFrame:
    return rules.matches(events(spark, sf), [family]).select("event_id", "src_ip", "rule_name", "matched_field", "evidence")


def _threats(spark: SparkSession, sf: str) -> DataFrame:
    return detect.threats(detect.all_matches(events(spark, sf)))


def _batch_threats(spark: SparkSession, sf: str) -> DataFrame:
    return detect.threats(detect.all_matches(events(spark, sf), keys=("batch",)), ("batch",))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.profiles(chunks.indexed(events(spark, sf)))


def _shown(c: DataFrame) -> DataFrame:
    return c.withColumns({"ports": F.array_join("ports", ","), "failure_rate": F.round("failure_rate", 9), "per_minute": F.round("per_minute", 6)})


def _actors(spark: SparkSession, sf: str) -> DataFrame:
    return state.actors(events(spark, sf), _batch_threats(spark, sf))


def _incidents(spark: SparkSession, sf: str) -> DataFrame:
    return incidents.from_threats(_threats(spark, sf))


def threat_groups(spark: SparkSession, sf: str) -> DataFrame:
    t = detect.ordered(_threats(spark, sf))
    return t.select("src_ip", "rule_name", "category", "family", "severity", "confidence", "match_count", "first_seen", "last_seen", F.array_join("sample_evidence", " || ").alias("sample_evidence"), F.size("event_ids").cast("long").alias("n_ids"))


def ai_need(spark: SparkSession, sf: str) -> DataFrame:
    found = detect.all_matches(events(spark, sf))
    return detect.ai_need(events(spark, sf), found, detect.threats(found))


def chunk_risk_topk(spark: SparkSession, sf: str) -> DataFrame:
    top = chunks.riskiest(chunks.risk(chunks.suspicious(_chunks(spark, sf))))
    return top.select("strategy", "entity", "window_start", "events", F.round("risk", 6).alias("risk"))


def chunk_risk_covered(spark: SparkSession, sf: str) -> DataFrame:
    c = summaries.scored(chunks.risk(chunks.suspicious(_chunks(spark, sf)), chunks.covered_sources(_threats(spark, sf))))
    return c.select("strategy", "entity", "window_start", F.round("risk", 6).alias("risk"), "anomaly_score", F.array_join("red_flags", "; ").alias("red_flags"))


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.indexed(events(spark, sf))


def chunk_summaries(spark: SparkSession, sf: str) -> DataFrame:
    c = summaries.full(_chunks(spark, sf))
    return c.select(*summaries.KEYS, "time_window", F.array_join("port_descriptions", ",").alias("port_descriptions"), "simple_pattern", "bytes_text", "narrative", F.array_join("recommendations", "; ").alias("recommendations"))


def chunk_context(spark: SparkSession, sf: str) -> DataFrame:
    c = summaries.context(_windows(spark, sf)).drop("bytes_received")
    return c.withColumns({k: F.array_join(k, ",") for k in ("actor_sources", "dst_ips", "dst_hosts", "port_categories")})


def http_analysis(spark: SparkSession, sf: str) -> DataFrame:
    c = summaries.http_analysis(_windows(spark, sf))
    statuses = F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return c.select(*summaries.KEYS, statuses.alias("statuses"), *(F.array_join(k, ",").alias(k) for k in ("methods", "agents", "indicators")), F.array_join("suspicious_uris", " ").alias("suspicious_uris"))


def incidents_list(spark: SparkSession, sf: str) -> DataFrame:
    found = incidents.listed(_incidents(spark, sf))
    return found.select("src_ip", "rule", "source", "status", "priority", "title", "evidence", "raw_log", "destination_ip", "indicator", "score", "match_count")


def anchored_windows_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey", F.expr("unix_seconds(cast(o_orderdate as timestamp)) div 86400").alias("day"), F.lit(90).cast("bigint").alias("width"))
    return chunks.anchored_windows(o, ["o_custkey"], "day", "width").groupBy("o_custkey", "window_start").agg(F.count("*").alias("orders"))


def normalize_events(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    raw = e.select("row_number", F.col("event_ts").cast("string").alias("timestamp"), "src_ip", "dst_ip", F.col("dst_port").cast("string").alias("dst_port"), F.lower("action").alias("action"), F.lit("6").alias("protocol"), F.concat_ws("?", "uri_path", "uri_query").alias("uri"), F.lower("http_method").alias("method"), F.col("http_status").cast("string").alias("status"), "user_agent", "referrer", "username", F.col("bytes_sent").cast("string").alias("bytes_sent"))
    return normalize.normalize(raw)


def technique_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return mitre.suggest(_chunks(spark, sf))


def geo_range_join(spark: SparkSession, sf: str) -> DataFrame:
    networks = spark.createDataFrame([(i, *net.cidr(n), c) for i, (n, c) in enumerate([("45.33.0.0/16", "AA"), ("52.10.0.0/16", "BB"), ("91.0.0.0/8", "CC"), ("91.20.0.0/16", "DD")])], "ord int, first bigint, last bigint, country string")
    return incidents.locate(events(spark, sf).select("src_ip"), networks, "src_ip").groupBy("src_ip", "country").agg(F.count("*").alias("events"))


def technique_context(spark: SparkSession, sf: str) -> DataFrame:
    """Every technique with its relatives, and how many threats of the events map to it."""
    found = mitre.map_findings(_threats(spark, sf)).groupBy("technique_id").agg(F.count("*").alias("threats"))
    return mitre.technique_context(spark).join(found, "technique_id", "left").withColumn("threats", F.coalesce("threats", F.lit(0)))


def page_xss_scan(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", F.col("html").rlike(r"(?i)<\s*script[^>]*>").alias("script"), F.col("html").rlike(r"(?i)javascript\s*:").alias("script_url"), F.size(F.regexp_extract_all("html", F.lit(r"(?i)<\s*(?:img|svg|iframe|object|embed)\s"), F.lit(0))).cast("long").alias("embeds"))


def doc_pattern_scan(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    quads = F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"), F.lit(0))
    return d.select("doc_id", F.size(quads).cast("long").alias("quads"), F.col("text").rlike("AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|AIza[0-9A-Za-z_-]{35}").alias("secret"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable] = {f"rule_matches_{f}": partial(_matches, f) for f in rules.FAMILIES}
    return out | {
        "rate_rules": lambda s, d: rules.rate_matches(events(s, d)).select("src_ip", "rule_name", "matched_field", "evidence", "event_id", "uri"),
        "threat_groups": threat_groups,
        "threats_by_category": lambda s, d: _threats(s, d).groupBy("category").agg(F.count("*").alias("threats"), F.array_join(F.array_sort(F.collect_set("src_ip")), ",").alias("sources")),
        "threats_by_severity": lambda s, d: _threats(s, d).groupBy("severity").agg(F.count("*").alias("threats"), F.sum("match_count").alias("matches")),
        "attacker_ips": lambda s, d: _threats(s, d).select("src_ip").distinct(),
        "ai_need": ai_need,
        "mitre_mapping": lambda s, d: mitre.map_findings(_threats(s, d)).select("src_ip", "rule_name", "technique_id", "mitre_confidence", "technique", "tactic"),
        "top_tactics": lambda s, d: incidents.top_tactics(_incidents(s, d)),
        "incident_stats": lambda s, d: incidents.stats(_incidents(s, d)),
        "incidents_per_day": lambda s, d: incidents.per_day(_incidents(s, d)),
        "incidents_all": lambda s, d: incidents.stats(incidents.all_incidents(_threats(s, d), state.correlations(_actors(s, d)))),
        "incidents_list": incidents_list,
        "correlation_incidents": lambda s, d: incidents.from_correlations(state.correlations(_actors(s, d))).select("src_ip", "rule", "status", "priority", "title", "indicator", "action"),
        "red_flags": lambda s, d: summaries.scored(_chunks(s, d)).where("size(red_flags) > 0").select(*summaries.KEYS, F.array_join("red_flags", "; ").alias("red_flags")),
        "anomaly_score": lambda s, d: summaries.scored(_chunks(s, d)).select(*summaries.KEYS, "anomaly_score", F.array_join("reasons", "; ").alias("reasons")),
        "chunk_summaries": chunk_summaries,
        "chunk_context": chunk_context,
        "http_analysis": http_analysis,
        "status_histogram": lambda s, d: state.status_histogram(events(s, d)).select("src_ip", F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",").alias("statuses")),
        "technique_context": technique_context,
        "technique_suggestions": technique_suggestions,
        "chunks_multi_index": lambda s, d: _shown(_chunks(s, d)),
        "suspicious_chunks": lambda s, d: _shown(chunks.suspicious(_chunks(s, d))),
        "temporal_patterns": lambda s, d: _chunks(s, d).groupBy("strategy", "pattern").agg(F.count("*").alias("chunks")),
        "chunk_risk_topk": chunk_risk_topk,
        "chunk_risk_covered": chunk_risk_covered,
        "anchored_windows_orders": anchored_windows_orders,
        "actor_batch_stats": lambda s, d: state.batch_stats(events(s, d)).withColumn("batch", F.col("batch").cast("string")),
        "actor_totals": lambda s, d: _actors(s, d).select("src_ip", "batches", "requests", "auth_failures", "auth_successes", "unique_uris", "first_seen", "last_seen", F.array_join(F.transform("rates", lambda x: x.cast("string")), ",").alias("rates")),
        "threat_scores": lambda s, d: _actors(s, d).select("src_ip", F.array_join("categories", ",").alias("categories"), F.round("threat_score", 9).alias("threat_score")),
        "correlations": lambda s, d: state.correlations(_actors(s, d)).drop("evidence"),
        "day_summary": lambda s, d: state.day_summary(_actors(s, d)),
        "category_breakdown": lambda s, d: state.category_breakdown(_actors(s, d)),
        "hourly_timeline": lambda s, d: state.hourly_timeline(_actors(s, d)),
        "internal_external_split": lambda s, d: chunks.internal_external(events(s, d)),
        "normalize_events": normalize_events,
        "page_hosts": lambda s, d: s.read.parquet(f"{d}/pages.parquet").groupBy(text.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages")),
        "page_xss_scan": page_xss_scan,
        "doc_pattern_scan": doc_pattern_scan,
        "dedup_by_hash": lambda s, d: s.read.parquet(f"{d}/documents.parquet").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")),
        "rollup_actors": lambda s, d: incidents.rollup(_chunks(s, d)).withColumn("risk_score", F.round("risk_score", 6)),
        "geo_range_join": geo_range_join,
    } | days.queries() | across.queries() | parsed.queries() | analyses.queries()


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql() | days.oracle_sql() | across.oracle_sql() | parsed.oracle_sql() | analyses.oracle_sql()
