"""Queries over log files in several formats: the events are written as files, found out, parsed and normalized; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.operators import normalize
from threatlake.plans.adapter import EV, events
from threatlake.sources import files
from threatlake.sources.workspace import new_folder

SITE = "shop.example.net"


def _delimited(rows: DataFrame, sep: str = ",") -> DataFrame:
    """rows as a written delimited file, read by the parser that is most confident of it."""
    path = new_folder(rows.sparkSession, "delimited")
    rows.write.csv(path, sep=sep, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.parse(rows.sparkSession, path)


def _url(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.replace(F.concat_ws("?", "uri_path", "uri_query"), F.lit("#"), F.lit("%23")))


def parsed_waf(spark: SparkSession, sf: str) -> DataFrame:
    """Events as rows of a web application firewall, errors with a threat type; what has no field of its own is in the map."""
    e = events(spark, sf)
    bad = F.col("http_status") >= 400
    rows = e.select(
        F.when(F.col("action") == "ALLOW", "REQUEST_ALLOWED").otherwise("BLOCK").alias("Action"), F.date_format("event_ts", "d MMM yyyy, h:mm a").alias("CNAMTime"), F.col("src_ip").alias("SrcIP"), F.col("dst_ip").alias("DstIP"),
        F.col("dst_port").alias("DstPort"), F.lower("http_method").alias("Method"), F.col("http_status").alias("ReturnCode"), _url(f"https://{SITE}").alias("URL"), F.nullif("user_agent", F.lit("")).alias("UserAgent"),
        F.when(bad, "HIGH").otherwise("LOW").alias("SeverityLevel"), F.when(bad, F.concat(F.lit("Status "), "http_status")).alias("ThreatType"), F.col("uri_path").alias("Indicator"), F.col("dst_host").alias("DeviceName"),
        F.lit(SITE).alias("Domain"), F.col("row_number").alias("Event"),
    )
    out = normalize.normalize(_delimited(rows))
    kept = ("event_ts", "src_ip", "dst_ip", "dst_port", "dst_host", "action", "protocol", "http_method", "http_status", "uri_path", "uri_query", "user_agent", "severity", "original_message")
    vendor = lambda k: F.try_element_at("vendor", F.lit(k))
    return out.select(vendor("event").cast("bigint").alias("event"), *kept, vendor("threat_type").alias("threat_type"), vendor("device_name").alias("device_name"))


def parsed_firewall(spark: SparkSession, sf: str) -> DataFrame:
    """Events as rows of a firewall with zones and sessions, summed by rule and severity."""
    rows = events(spark, sf).select(
        F.col("event_ts").cast("string").alias("Time"), F.col("src_ip").alias("Source"), F.col("dst_ip").alias("Destination"), F.col("dst_port").alias("dport"), F.when(F.col("action") == "ALLOW", "permit").otherwise("drop").alias("Disposition"),
        F.concat(F.lit("rule-"), F.col("dst_port")).alias("rule"), F.when(F.col("row_number") % 3 == 0, "dmz").alias("zone_src"), F.when(F.col("row_number") % 2 == 0, "high").otherwise("low").alias("Priority"),
        F.concat(F.lit("s"), F.col("row_number") % 100).alias("conn_id"), F.col("username").alias("user"), F.lit("web").alias("Service"),
    )
    out = normalize.normalize(_delimited(rows, ";"))
    vendor = lambda k: F.try_element_at("vendor", F.lit(k))
    return out.groupBy("application", "severity", "action", vendor("rule").alias("rule"), vendor("zone_src").alias("zone")).agg(
        F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("src_ip").alias("sources"), F.count_distinct("username").alias("users"), F.max("event_ts").alias("last_seen"), F.min("original_message").alias("message"),
    )


def parsed_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as network flows, summed by source and protocol."""
    k = F.col("row_number")
    rows = events(spark, sf).select("src_ip", "dst_ip", F.col("dst_port").alias("dport"), F.lit("6").alias("proto"), F.col("bytes_sent").alias("bytes"), (k % 50 + 1).alias("packets"), (k % 1000).alias("duration"))
    out = normalize.normalize(_delimited(rows, "\t"))
    packets = normalize.safe_int(F.try_element_at("vendor", F.lit("packets")))
    return out.groupBy("src_ip", "protocol", "dst_port").agg(F.count("*").alias("flows"), F.sum("bytes_sent").alias("bytes"), F.sum(packets).alias("packets"), F.sum("duration_ms").alias("duration_ms"), F.max("duration_ms").alias("longest"))


def parsed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as access lines in three forms, one of which gives the source first; each tenth line is none."""
    e, k = events(spark, sf), F.col("row_number")
    day, uri = F.date_format("event_ts", "dd/MMM/yyyy:HH:mm:ss"), F.replace(_url(""), F.lit(" "), F.lit("%20"))
    user, bytes_sent = F.coalesce("username", F.lit("-")), F.col("bytes_sent")
    agent = F.concat(F.lit(' "'), "referrer", F.lit('" "'), "user_agent", F.lit('"'))
    line = lambda *xs: F.concat(F.lit("<150>Jan 1 00:00:00 web httpd[7]: "), *(x if isinstance(x, Column) else F.lit(x) for x in xs))
    src, dst, method, status = (F.col(c) for c in ("src_ip", "dst_ip", "http_method", "http_status"))
    text = (
        F.when(k % 10 == 9, line("no request of ", src)).when(k % 3 == 0, line(src, " ", dst, " 443 ", SITE, " - ", user, " [", day, ' +0000] "', method, " ", uri, ' HTTP/1.1" ', status, " ", bytes_sent, " 17", agent))
        .when(k % 3 == 1, line(dst, " ", src, ", 10.9.9.9, 10.9.9.8 - ", user, " ", SITE, " ", day, ' +0000] "', method, " ", uri, ' HTTP/1.1" ', status, " ", bytes_sent, " 500", agent))
        .otherwise(line(dst, " ", src, " ", user, " ", SITE, " ", day, '] "', method, " ", uri, '" ', status, " ", bytes_sent))
    )
    path = new_folder(spark, "lines")
    e.select(text.alias("value")).write.text(path)
    out = normalize.normalize(files.parse(spark, path))
    kept = ("src_ip", "dst_ip", "dst_host", "http_method", "http_status", "uri_path", "uri_query", "username", "bytes_sent", "referrer", "user_agent")
    form = F.try_element_at("vendor", F.lit("form"))
    return out.select(F.when(form.isNotNull(), F.col("event_ts")).alias("event_ts"), *kept, form.alias("form"), F.try_element_at("vendor", F.lit("response_time")).alias("response_time"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (parsed_waf, parsed_firewall, parsed_flows, parsed_lines)}


def oracle_sql() -> dict[str, str]:
    port = "CASE dst_port WHEN 22 THEN 'SSH' WHEN 80 THEN 'HTTP' WHEN 443 THEN 'HTTPS' WHEN 53 THEN 'DNS' WHEN 3389 THEN 'RDP' ELSE 'OTHER' END"
    return {
        "parsed_waf": f"""WITH {EV}, e AS (
  SELECT *, CASE WHEN http_status >= 400 THEN 'Status ' || http_status END AS threat_type FROM ev
) SELECT row_number AS event, date_trunc('minute', event_ts) AS event_ts, src_ip, dst_ip, CAST(dst_port AS BIGINT) AS dst_port, '{SITE}' AS dst_host, action, {port} AS protocol, http_method, http_status,
  replace(uri_path, '#', '%23') AS uri_path, replace(uri_query, '#', '%23') AS uri_query, nullif(user_agent, '') AS user_agent, CASE WHEN http_status >= 400 THEN 'HIGH' ELSE 'LOW' END AS severity,
  concat_ws(' ', 'threat_type=' || threat_type, 'indicator=' || uri_path, 'device_name=' || dst_host, 'event=' || row_number) AS original_message, threat_type, dst_host AS device_name FROM e""",
        "parsed_firewall": f"""WITH {EV}, e AS (
  SELECT *, CASE WHEN row_number % 3 = 0 THEN 'dmz' END AS zone, CASE WHEN row_number % 2 = 0 THEN 'high' ELSE 'low' END AS severity FROM ev
) SELECT 'web' AS application, severity, action, 'rule-' || dst_port AS rule, zone, count(*) AS events, count(DISTINCT row_number % 100) AS sessions, count(DISTINCT src_ip) AS sources,
  count(DISTINCT username) AS users, max(event_ts) AS last_seen, concat_ws(' ', 'rule=rule-' || dst_port, 'zone_src=' || zone) AS message FROM e GROUP BY severity, action, dst_port, zone""",
        "parsed_flows": f"""WITH {EV} SELECT src_ip, 'TCP' AS protocol, CAST(dst_port AS BIGINT) AS dst_port, count(*) AS flows, CAST(sum(bytes_sent) AS BIGINT) AS bytes, CAST(sum(row_number % 50 + 1) AS BIGINT) AS packets,
  CAST(sum(row_number % 1000) AS BIGINT) AS duration_ms, max(row_number % 1000) AS longest FROM ev GROUP BY src_ip, dst_port""",
        "parsed_lines": f"""WITH {EV}, e AS (
  SELECT *, row_number % 3 AS k, replace(replace(uri_path, '#', '%23'), ' ', '%20') AS path, replace(replace(uri_query, '#', '%23'), ' ', '%20') AS query FROM ev WHERE row_number % 10 <> 9
), f AS (
  SELECT date_trunc('second', event_ts) AS event_ts, src_ip, dst_ip, '{SITE}' AS dst_host, http_method, http_status, path AS uri_path, query AS uri_query, username, bytes_sent,
    CASE WHEN k < 2 THEN nullif(referrer, '-') END AS referrer, CASE WHEN k < 2 THEN nullif(user_agent, '') END AS user_agent, list_extract(['standard', 'extended', 'flexible'], CAST(k AS INT) + 1) AS form,
    list_extract(['17', '500', NULL], CAST(k AS INT) + 1) AS response_time FROM e
) SELECT * FROM f UNION ALL SELECT NULL, '-', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ev WHERE row_number % 10 = 9""",
    }
