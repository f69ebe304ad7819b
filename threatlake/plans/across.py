"""Queries over overlapping windows, caches, reports, sketches and files, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.operators import chunks, lookups, normalize, rollups, strides
from threatlake.plans import oracle
from threatlake.plans.adapter import EV, events
from threatlake.sources.raw_store import FileTable, RawStore
from threatlake.sources.workspace import new_folder


def overlapping_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return strides.overlapping(events(spark, sf))


def cache_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """Two events of three ask for the result of their request; the third stores one."""
    e = events(spark, sf).select(
        F.col("row_number").alias("event_id"), F.sha2(F.concat_ws("?", "uri_path", "uri_query"), 256).alias("content"), F.concat(F.lit("m"), F.col("row_number") % 2).alias("model"),
        F.expr("unix_micros(cast(event_ts as timestamp))").alias("at"),
    )
    asked, stored = e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0").withColumnRenamed("event_id", "entry_id")
    out = lookups.newest(asked, stored, ["content", "model"])
    return out.select("event_id", F.col("entry_id").cast("string").alias("entry_id"), F.col("entry_id").isNotNull().alias("hit"))


def file_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as files, orders as reports that name them in one way or another."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    o = spark.read.parquet(f"{sf}/orders.parquet")
    files = c.select(F.concat(F.lit("F"), F.col("c_custkey"), F.lit("x ")).alias("file_id"), F.concat("c_name", F.lit(".csv")).alias("filename"), F.when(F.col("c_custkey") % 50 == 0, "Processed").otherwise("uploaded").alias("status"))
    k, who = F.col("o_orderkey") % 40, F.col("o_custkey")
    padded = F.lpad(who.cast("string"), 9, "0")
    reports = o.select(
        F.when(k == 0, F.concat(F.lit("f"), who, F.lit("x"))).alias("file_id"),
        F.when(k == 1, F.concat(F.lit("Report of CUSTOMER#"), padded, F.lit(" (orders)"))).when(k == 2, F.concat(F.lit("report-F"), who, F.lit("X-2"))).otherwise(F.concat(F.lit("report "), "o_orderpriority")).alias("report_name"),
        F.when(k == 3, F.concat(F.lit("/out/f"), who, F.lit("x/report.md"))).otherwise("/out/report.md").alias("report_path"),
    )
    return lookups.has_report(files, reports).select("file_id", "status", "ready")


def approx_unique_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct paths of each source and day from hourly sketches, beside the exact number and whether they are within 5 % (or 1)."""
    e = events(spark, sf)
    day = F.to_date("hour").alias("day")
    found = strides.merged(strides.sketched(e, ["src_ip"], "uri_path"), ["src_ip", day])
    exact = e.where("uri_path <> ''").select("src_ip", F.to_date("event_ts").alias("day"), "uri_path").distinct().groupBy("src_ip", "day").agg(F.count("*").alias("exact"))
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(0.05 * F.col("exact"), F.lit(1.0))
    return exact.join(found, ["src_ip", "day"], "left").select("src_ip", F.col("day").cast("string").alias("day"), "exact", F.coalesce(near, F.lit(False)).alias("near"))


def _chunks_of_files(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks, with the quarter of an hour that they begin in as their file."""
    c = chunks.profiles(chunks.indexed(events(spark, sf)))
    return c.withColumn("file_id", F.concat(F.lit("quarter-"), F.expr("window_start div 900000000")))


def rollup_files(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.actors(_chunks_of_files(spark, sf)).withColumns({"risk_score": F.round("risk_score", 6), "risk_factors": F.array_join("risk_factors", "; ")})


def cross_file_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.cross_file_patterns(_chunks_of_files(spark, sf))


def raw_store(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as raw files of seven days; half of them are put twice."""
    p = spark.read.parquet(f"{sf}/pages.parquet")
    day = F.expr("timestamp'2024-01-01 12:00:00' + make_interval(0, 0, 0, cast(page_id % 7 as int))")
    rows = p.select(F.col("page_id").cast("string").alias("file_id"), F.concat(F.lit("page "), F.col("page_id"), F.lit(".html")).alias("name"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"), day.alias("uploaded_at"))
    store = RawStore(spark, new_folder(spark, "raw"))
    store.put(rows)
    store.put(rows.where("cast(file_id as bigint) % 2 = 0"))
    out = store.verify(store.listed())
    return out.select("file_id", "name", "bytes", "sha256", F.col("day").cast("string").alias("day"), "intact")


def file_table(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as files; orders change their status and counts in two batches, in order of their keys."""
    table = FileTable(spark, new_folder(spark, "table"))
    c = spark.read.parquet(f"{sf}/customer.parquet")
    table.upsert(c.select(F.concat(F.lit("f"), "c_custkey").alias("file_id"), F.col("c_name").alias("filename"), F.lit("uploaded").alias("status")))
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat(F.lit("f"), "o_custkey").alias("file_id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderkey")).alias("events_created"), F.col("o_orderkey").alias("step"))
    for k in range(2):
        table.upsert(o.where(F.col("step") % 2 == k), order="step")
    return table.rows().select("file_id", "filename", "status", F.col("events_created").cast("string").alias("events_created"))


def _urls(spark: SparkSession, sf: str) -> DataFrame:
    """The events' requests as URLs, some of them with addresses in brackets."""
    e, k = events(spark, sf), F.col("row_number") % 23
    host = F.when(k == 3, "http://[::1").when(k == 5, "//x]").when(k == 7, "http://[2001:db8::1]:80").when(k == 9, "http://[xyz]").when(k == 11, "https://u@[v1.a]").when(k == 13, "http://[1.2.3.4]").when(k == 15, "http://[fe80::1%eth0]").otherwise("")
    return e.select("row_number", "src_ip", F.concat(host, "uri_path").alias("uri"))


def normalize_errors(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.checked(_urls(spark, sf))[1]


def normalize_counts(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.counts(_urls(spark, sf)).withColumn("success_rate", F.round("success_rate", 9))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (overlapping_chunks, cache_lookups, file_reports, approx_unique_targets, rollup_files, cross_file_patterns, raw_store, file_table, normalize_errors, normalize_counts)}


def oracle_sql() -> dict[str, str]:
    files = f"{oracle.CHUNKS}, of AS (SELECT *, 'quarter-' || CAST(window_start // 900000000 AS VARCHAR) AS file_id FROM chunks WHERE strategy = 'src_ip')"
    urls = """u AS (
  SELECT row_number, CASE row_number % 23 WHEN 3 THEN 'http://[::1' WHEN 5 THEN '//x]' WHEN 9 THEN 'http://[xyz]' WHEN 13 THEN 'http://[1.2.3.4]' END AS bad, uri_path FROM ev)"""
    return {
        "normalize_errors": f"WITH {EV}, {urls} SELECT row_number, 'url' AS kind, substr(bad || uri_path, 1, 200) AS value FROM u WHERE bad IS NOT NULL",
        "normalize_counts": f"WITH {EV}, {urls} SELECT count(*) AS rows, count(bad) AS errors, count(*) - count(bad) AS normalized, round((count(*) - count(bad)) / count(*), 9) AS success_rate FROM u",
        "overlapping_chunks": f"""WITH {EV}, copied AS (
  SELECT *, unnest(range(CAST(ceil((t_us - 900000000 + 1) / 600000000) AS BIGINT), t_us // 600000000 + 1)) * 600000000 AS window_start FROM ev WHERE src_ip <> ''
) SELECT src_ip AS entity, window_start, count(*) AS events, count(*) FILTER (action = 'DENY') AS denied, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent, min(t_us) AS first_seen, max(t_us) AS last_seen,
  count(DISTINCT dst_ip) AS targets FROM copied GROUP BY ALL""",
        "cache_lookups": f"""WITH {EV}, e AS (
  SELECT row_number AS event_id, sha256(concat_ws('?', uri_path, uri_query)) AS content, 'm' || (row_number % 2) AS model, epoch_us(event_ts) AS at_us FROM ev
) SELECT event_id, CAST(max(entry_id) AS VARCHAR) AS entry_id, max(entry_id) IS NOT NULL AS hit FROM (
  SELECT q.event_id, CASE WHEN s.at_us = max(s.at_us) OVER (PARTITION BY q.event_id) THEN s.event_id END AS entry_id FROM (SELECT * FROM e WHERE event_id % 3 <> 0) q
  LEFT JOIN (SELECT * FROM e WHERE event_id % 3 = 0) s ON q.content = s.content AND q.model = s.model AND s.at_us <= q.at_us AND q.at_us - s.at_us < 86400000000
) GROUP BY event_id""",
        "file_reports": """WITH files AS (
  SELECT 'F' || c_custkey || 'x ' AS file_id, lower('f' || c_custkey || 'x') AS id, lower(c_name) AS stem, CASE WHEN c_custkey % 50 = 0 THEN 'Processed' ELSE 'uploaded' END AS status FROM customer
), reports AS (
  SELECT DISTINCT CASE WHEN o_orderkey % 40 = 0 THEN 'f' || o_custkey || 'x' END AS id, CASE WHEN o_orderkey % 40 = 3 THEN '/out/f' || o_custkey || 'x/report.md' ELSE '/out/report.md' END AS path,
    lower(CASE o_orderkey % 40 WHEN 1 THEN 'Report of CUSTOMER#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || ' (orders)' WHEN 2 THEN 'report-F' || o_custkey || 'X-2' ELSE 'report ' || o_orderpriority END) AS name
  FROM orders
) SELECT file_id, status, lower(status) = 'processed' OR EXISTS (FROM reports r WHERE r.id = f.id OR contains(r.name, f.id) OR contains(r.path, f.id) OR contains(r.name, f.stem)) AS ready FROM files f""",
        "approx_unique_targets": f"WITH {EV} SELECT src_ip, CAST(batch AS VARCHAR) AS day, count(DISTINCT uri_path) AS exact, true AS near FROM ev WHERE uri_path <> '' GROUP BY ALL",
        "rollup_files": f"""{files}, r AS (
  SELECT entity AS actor, count(DISTINCT file_id) AS files_count, count(*) AS chunks, CAST(sum(events) AS BIGINT) AS total_events, CAST(sum(denied) AS BIGINT) AS total_denials, max(targets) AS unique_targets,
    min(window_start) AS first_seen, max(window_end) AS last_seen, count(DISTINCT window_start // 86400000000) AS active_days FROM of GROUP BY entity
), s AS (SELECT *, least(40 * total_denials / total_events + least(unique_targets, 20) + least(chunks, 20) + least(4 * active_days, 20), 100) AS score FROM r)
SELECT * EXCLUDE (score), round(score, 6) AS risk_score, score >= 70 AS high_risk, concat_ws('; ', CASE WHEN total_denials / total_events >= 0.3 THEN CAST(round_even(100 * total_denials / total_events, 0) AS INT) || '% of events denied' END,
  CASE WHEN unique_targets >= 10 THEN unique_targets || ' targets in a window' END, CASE WHEN active_days >= 3 THEN 'active on ' || active_days || ' days' END,
  CASE WHEN files_count >= 3 THEN 'seen in ' || files_count || ' files' END) AS risk_factors FROM s""",
        "cross_file_patterns": f"""{files}, p AS (SELECT pattern, unnest(ports) AS port, file_id, entity, denied FROM of)
SELECT pattern, port, count(DISTINCT file_id) AS files, count(DISTINCT entity) AS actors, count(*) AS chunks, CAST(sum(denied) AS BIGINT) AS denied, min(file_id) AS first_file, max(file_id) AS last_file
FROM p GROUP BY pattern, port HAVING count(DISTINCT file_id) >= 2""",
        "raw_store": """SELECT CAST(page_id AS VARCHAR) AS file_id, 'page_' || page_id || '.html' AS name, strlen(coalesce(html, '')) AS bytes, sha256(coalesce(html, '')) AS sha256,
  '2024-01-0' || (1 + page_id % 7) AS day, true AS intact FROM pages""",
        "file_table": """WITH o AS (
  SELECT o_custkey, o_orderstatus, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderkey END AS n, o_orderkey % 2 * 1000000000000 + o_orderkey AS step FROM orders
), last AS (SELECT 'f' || o_custkey AS file_id, arg_max(o_orderstatus, step) AS status, arg_max(n, step) FILTER (n IS NOT NULL) AS n FROM o GROUP BY 1
) SELECT coalesce(l.file_id, 'f' || c_custkey) AS file_id, c_name AS filename, coalesce(l.status, 'uploaded') AS status, CAST(l.n AS VARCHAR) AS events_created
  FROM customer FULL JOIN last l ON l.file_id = 'f' || c_custkey""",
    }
