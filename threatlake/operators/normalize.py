"""Parsed rows to normalized events, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.functions import net, text

# Synonyms of actions, protocol names and numbers, ports that tell a protocol.
ALLOW = ["ALLOW", "ALLOWED", "PERMIT", "ACCEPT", "PASS", "REQUEST_ALLOWED"]
DENY = ["DENY", "DENIED", "BLOCK", "BLOCKED", "DROP", "DROPPED", "REJECT", "REJECTED"]
PROTOCOLS = {"TCP": "TCP", "UDP": "UDP", "ICMP": "ICMP", "HTTP": "HTTP", "HTTPS": "HTTPS", "SSH": "SSH", "DNS": "DNS", "RDP": "RDP", "6": "TCP", "17": "UDP", "1": "ICMP"}
PORTS = {22: "SSH", 80: "HTTP", 443: "HTTPS", 53: "DNS", 3389: "RDP"}
# End of the fixed values.


def action(raw: Column) -> Column:
    a = F.upper(F.trim(raw))
    return F.when(a.isin(*ALLOW), "ALLOW").when(a.isin(*DENY), "DENY").otherwise("UNKNOWN")


def protocol(raw: Column, port: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in PROTOCOLS.items() for x in kv))
    ports = F.create_map(*(F.lit(x) for kv in PORTS.items() for x in kv))
    return F.coalesce(F.element_at(names, F.coalesce(F.upper(F.trim(raw)), F.lit(""))), F.element_at(ports, F.coalesce(port.cast("int"), F.lit(-1))), F.lit("OTHER"))


def safe_int(raw: Column) -> Column:
    """Truncated number of a text; null for blanks, dashes, and what isn't finite."""
    x = F.trim(raw.cast("string")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < 9e15), x.cast("bigint"))


def _zoned(raw: Column) -> Column:
    """A date or time of day without a zone gets UTC."""
    t = F.trim(raw)
    return F.when(t.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.concat(t, F.lit("T00:00:00Z"))).when(t.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[T ][0-9:.]+$"), F.concat(t, F.lit("Z"))).otherwise(t)


KEPT = ["severity", "session_id", "application", "content_type", "row_hash"]


def _with_vendor(parsed: DataFrame) -> DataFrame:
    """parsed with what the map `vendor` holds where a field is null or empty; as it is without a map."""
    if "vendor" not in parsed.columns:
        return parsed
    own = lambda n: F.nullif(n, F.lit("")) if n in parsed.columns else F.lit(None).cast("string")
    other = lambda key: F.nullif(F.try_element_at("vendor", F.lit(key)), F.lit(""))
    pairs = F.filter(F.map_entries("vendor"), lambda e: F.coalesce(F.trim(e["value"]) != "", F.lit(False)))
    joined = F.substring(F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"])), " "), 1, 2000)
    filled = {n: F.coalesce(own(n), other(key)) for n, key in (("uri", "url"), ("user_agent", "user_agent"), ("referrer", "referrer"), ("content_type", "content_type"))}
    return parsed.withColumns(filled | {"original_message": F.coalesce(own("original_message"), F.nullif(joined, F.lit("")))})


def normalize(parsed: DataFrame, ingest_ts: str = "1970-01-01 00:00:00") -> DataFrame:
    """parsed: row_number, timestamp, src_ip, dst_ip, src_port, dst_port, action, protocol, uri, method, status, user_agent,
    referrer, username, bytes_sent, all strings but the first; absent columns count as null. Where there is a map `vendor`,
    it stands in for url, user_agent, referrer, content_type and the message (its entries as `key=value`); what the rows have
    of severity, session_id, application, content_type, duration_ms, row_hash and vendor is kept."""
    parsed = _with_vendor(parsed)
    c = lambda n: F.col(n) if n in parsed.columns else F.lit(None).cast("string")
    # what is used more than once has its own projection, so that it is computed once
    rows = parsed.withColumns({
        "_src": F.coalesce(net.normalize_ip(c("src_ip")), F.lit("-")), "_dst": net.normalize_ip(c("dst_ip")), "_port": safe_int(c("dst_port")),
        "_path": text.uri_path(c("uri")), "_query": F.coalesce(F.nullif(c("uri_query"), F.lit("")), text.uri_query(c("uri"))),
    })
    # a time without a zone is UTC, whatever the session's zone
    rows = rows.withColumns({"_dst": F.nullif("_dst", "_src"), "_src_number": net.ip_number(F.col("_src"))}).withColumn("_dst_number", net.ip_number(F.col("_dst")))
    src, dst, port, path, query = (F.col(f"_{n}") for n in ("src", "dst", "port", "path", "query"))
    at = F.coalesce(F.try_to_timestamp(_zoned(c("timestamp"))), *(F.try_to_timestamp(t, F.lit(f)) for t, f in ((c("timestamp"), "dd/MMM/yyyy:HH:mm:ss Z"), (F.concat(c("timestamp"), F.lit(" +0000")), "d MMM yyyy, h:mm a Z"))), F.to_timestamp(F.lit(f"{ingest_ts}Z")))
    message = F.coalesce(F.nullif(c("original_message"), F.lit("")), F.concat_ws("", F.upper(c("method")), F.lit(" "), path, F.when(query.isNotNull(), F.concat(F.lit("?"), query))))
    internal = lambda n: net.in_networks(F.col(f"_{n}_number"), net.INTERNAL)
    return rows.select(
        "row_number", F.md5(F.concat_ws("|", F.col("row_number").cast("string"), c("timestamp"), c("src_ip"), c("uri"))).alias("event_id"), F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")).alias("event_ts"), src.alias("src_ip"), safe_int(c("src_port")).alias("src_port"),
        dst.alias("dst_ip"), c("dst_host").alias("dst_host"), port.alias("dst_port"), action(c("action")).alias("action"), protocol(c("protocol"), port).alias("protocol"), F.nullif(c("username"), F.lit("")).alias("username"),
        safe_int(c("bytes_sent")).alias("bytes_sent"), safe_int(c("bytes_received")).alias("bytes_received"), safe_int(c("response_size")).alias("response_size"), internal("src").alias("is_internal_src"), F.when(dst.isNotNull(), internal("dst")).alias("is_internal_dst"),
        F.upper(c("method")).alias("http_method"), safe_int(c("status")).cast("int").alias("http_status"), path.alias("uri_path"), query.alias("uri_query"), c("user_agent").alias("user_agent"), c("referrer").alias("referrer"), F.substring(message, 1, 2000).alias("original_message"),
        *(F.nullif(n, F.lit("")).alias(n) for n in KEPT if n in parsed.columns), *(safe_int(c(n)).alias(n) for n in ["duration_ms"] if n in parsed.columns), *(n for n in ["vendor"] if n in parsed.columns),
    )


def _uri(parsed: DataFrame) -> Column:
    own = F.col("uri") if "uri" in parsed.columns else F.lit(None).cast("string")
    return F.coalesce(F.nullif(own, F.lit("")), F.try_element_at("vendor", F.lit("url"))) if "vendor" in parsed.columns else own


def failure(parsed: DataFrame) -> Column:
    """Why a parsed row can't be normalized, as a struct of kind and value; null for rows that can.

    The kind `url` is an address in brackets that isn't closed, or is none. Dates, numbers and
    addresses that can't be read are no failures: they get the time of intake, null, or `-`.
    """
    uri = F.regexp_replace(F.trim(_uri(parsed)), "[\t\r\n]", "")
    bare = ~uri.contains("?") & uri.contains("=") & ~uri.startswith("/") & ~uri.contains("://")
    authority = F.regexp_extract(uri, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)

    def wrong(a: Column) -> Column:
        inside = F.regexp_extract(a, r"\[([^\]]*)", 1)
        address = F.when(inside.startswith("v"), inside.rlike(r"^v[0-9a-fA-F]+\..+$")).otherwise(net.canonical_v6(inside).isNotNull() & ~inside.rlike(r"%.*%|%$|\["))
        return (a.contains("[") | a.contains("]")) & ~(a.contains("]") & address)

    bad = F.coalesce(~bare & F.get(F.transform(F.array(authority), wrong), F.lit(0)), F.lit(False))
    return F.when(bad, F.struct(F.lit("url").alias("kind"), F.substring(uri, 1, 200).alias("value")))


def checked(parsed: DataFrame, ingest_ts: str = "1970-01-01 00:00:00") -> tuple[DataFrame, DataFrame]:
    """(normalized events of the rows that can be normalized, (row_number, kind, value) of the others)."""
    rows = parsed.withColumn("_failure", failure(parsed))
    failed = rows.where("_failure is not null").select("row_number", "_failure.kind", "_failure.value")
    return normalize(rows.where("_failure is null").drop("_failure"), ingest_ts), failed


def counts(parsed: DataFrame) -> DataFrame:
    """One row: rows, errors, normalized, and the share of rows that were (1 without rows)."""
    out = parsed.select(failure(parsed).alias("f")).agg(F.count("*").alias("rows"), F.count("f").alias("errors"))
    n = F.col("rows") - F.col("errors")
    return out.select("rows", "errors", n.alias("normalized"), F.when(F.col("rows") > 0, n / F.col("rows")).otherwise(1.0).alias("success_rate"))


def success_rate(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("rows"), (F.count_if(F.col("src_ip") != "-") / F.count("*")).alias("success_rate"))
