"""What a chunk is about: its actor, targets and environment, scores with reasons, flags, texts, and field analyses."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlake.functions import net

KEYS = ["strategy", "entity", "window_start"]

# Services by port (for categories, and for descriptions), hints of environments in host names, phrases of
# attacks in paths, top-level domains, attachment endings, and the limits of lists.
CATEGORIES = {
    22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 80: "HTTP", 443: "HTTPS", 445: "SMB", 3389: "RDP", 3306: "MySQL", 5432: "PostgreSQL", 1433: "MSSQL", 27017: "MongoDB", 6379: "Redis",
    5672: "AMQP", 8080: "HTTP-Alt", 8443: "HTTPS-Alt",
}
SERVICES = {
    20: "FTP-Data", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 67: "DHCP", 68: "DHCP", 80: "HTTP", 110: "POP3", 123: "NTP", 143: "IMAP", 161: "SNMP", 389: "LDAP", 443: "HTTPS",
    445: "SMB", 465: "SMTPS", 514: "Syslog", 587: "SMTP-Submission", 636: "LDAPS", 993: "IMAPS", 995: "POP3S", 1433: "MSSQL", 1521: "Oracle", 2049: "NFS", 3306: "MySQL", 3389: "RDP", 5432: "PostgreSQL",
    5672: "AMQP", 5900: "VNC", 6379: "Redis", 8080: "HTTP-Proxy", 8443: "HTTPS-Alt", 27017: "MongoDB",
}
ENVIRONMENTS = {"prod": "PROD", "stag": "STAGING", "dev": "DEV", "test": "TEST"}
PHRASES = {
    "SQL injection pattern": ["union select", "' or '1'='1", "'; drop table", "exec(", "xp_cmdshell", "information_schema"],
    "XSS pattern": ["<script>", "javascript:", "onerror=", "onload=", "<iframe", "<embed", "eval("],
    "Path traversal": ["../", "..\\", "%2e%2e", "....//", "..\\..\\"],
}
ODD_DOMAINS = [".tk", ".ml", ".ga", ".cf", ".top", ".xyz", ".work"]
RISKY_FILES = [".exe", ".scr", ".bat", ".vbs", ".js"]
LISTED, URIS, AGENTS, AGENT_LENGTH, SESSIONS = 20, 10, 5, 100, 50
# End of the fixed values.


def _of(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def _listed(values: Column, n: int = LISTED) -> Column:
    return F.slice(F.array_sort(values), 1, n)


def environment(host: Column) -> Column:
    """By the first hint that a host name holds."""
    return F.coalesce(*(F.when(F.lower(host).contains(k), F.lit(v)) for k, v in ENVIRONMENTS.items()))


def context(windows: DataFrame) -> DataFrame:
    """One row for each chunk: actor, targets, environment (of the first event whose host tells it) and byte sums."""
    at, host, user = F.struct("t_us", "row_number"), F.nullif("dst_host", F.lit("")), F.nullif("username", F.lit(""))
    inside, env = net.is_internal(F.col("src_ip")), environment(host)
    port = F.when(F.col("dst_port") != 0, F.col("dst_port"))
    received = F.col("bytes_received") if "bytes_received" in windows.columns else F.lit(0)
    out = windows.groupBy(*KEYS).agg(
        F.collect_set(user).alias("users"), F.collect_set(F.nullif("src_ip", F.lit(""))).alias("sources"), F.min_by(inside, at).alias("first_inside"), F.bool_and(inside).alias("all_inside"),
        F.collect_set(F.nullif("dst_ip", F.lit(""))).alias("ips"), F.collect_set(host).alias("hosts"), F.array_sort(F.collect_set(port)).alias("ports"),
        F.min_by(env, F.when(env.isNotNull(), at)).alias("environment"), F.sum(F.coalesce(received, F.lit(0))).alias("bytes_received"),
    )
    s = F.col("strategy")
    return out.select(
        *KEYS, F.when(s == "user", F.col("entity")).when((s == "src_ip") & (F.size("users") == 1), F.get("users", F.lit(0))).alias("actor_user"),
        F.when(s != "src_ip", _listed(F.col("sources"))).alias("actor_sources"), F.when(s == "src_ip", F.col("first_inside")).when(s == "dst_host", F.coalesce("all_inside", F.lit(True))).alias("actor_internal"),
        _listed(F.col("ips")).alias("dst_ips"), _listed(F.col("hosts")).alias("dst_hosts"), F.size("ips").alias("unique_ips"), F.size("hosts").alias("unique_hosts"), F.size("ports").alias("unique_ports"),
        F.array_sort(F.array_distinct(F.array_compact(F.transform(F.slice("ports", 1, 10), lambda p: _of(CATEGORIES, p))))).alias("port_categories"), "environment", "bytes_received",
    )


def described(port: Column) -> Column:
    kind = F.coalesce(_of(SERVICES, port), F.when(port < 1024, "Well-known").when(port < 49152, "Registered").otherwise("Ephemeral"))
    return F.concat(kind, F.lit(" ("), port.cast("string"), F.lit(")"))


def human_bytes(n: Column) -> Column:
    """1,023 as bytes, else in the largest of KB, MB and GB, with one decimal; halves go to the even digit."""
    scaled = lambda k, unit: F.format_string(f"%.1f {unit}", F.bround(n / float(1 << k), 1))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, scaled(10, "KB")).when(n < 1 << 30, scaled(20, "MB")).otherwise(scaled(30, "GB"))


def simple_pattern(per_minute: Column) -> Column:
    return F.when(per_minute > 10, "bursty").when(per_minute < 0.5, "random").otherwise("steady")


def _percent(x: Column) -> Column:
    return F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%"))


def _said(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def scored(chunks: DataFrame) -> DataFrame:
    """Adds anomaly_score, reasons, red_flags, narrative, observations and recommendations. auth_failures, if there, counts."""
    c = F.col
    auth = c("auth_failures") if "auth_failures" in chunks.columns else F.lit(0)
    won = c("auth_successes") if "auth_successes" in chunks.columns else F.lit(0)
    rate, targets, n = c("failure_rate"), c("targets"), c("events")
    steps = [
        (rate > 0.7, 30, _said("High failure rate: ", _percent(rate))), (auth > 10, 25, _said("Multiple auth failures: ", auth)),
        (targets > 5, 20, _said("Scanning behavior: ", targets, " targets")), (n > 100, 15, _said("High activity volume: ", n, " events")),
    ]
    total = reduce(lambda a, x: a + F.when(x[0], x[1]).otherwise(0), steps, F.lit(0))
    flags = [
        F.when(auth > 10, _said("High auth failures: ", auth)), F.when(rate > 0.5, _said("High failure rate: ", _percent(rate))), F.when(targets > 5, _said("Multiple targets: ", targets, " hosts")),
        F.when(F.coalesce(F.arrays_overlap("ports", F.array(F.lit(22), F.lit(3389))), F.lit(False)) & (c("denied") > 5), F.lit("Blocked remote access attempts")),
    ]
    out = chunks.withColumns({"anomaly_score": F.least(total, F.lit(100)), "reasons": F.array_compact(F.array(*(F.when(w, t) for w, _, t in steps))), "red_flags": F.array_compact(F.array(*flags))})
    seen = [
        F.when(auth > 0, _said("Authentication: ", auth, " failures, ", won, " successes")), F.when(targets > 1, _said("Targeted ", targets, " different hosts")),
        F.when(rate > 0.5, _said("High denial rate: ", _percent(rate))),
    ]
    a = c("anomaly_score")
    advice = F.array_compact(F.array(
        F.when(a > 70, F.lit("Immediate investigation recommended")).when(a > 40, F.lit("Monitor for escalation")), F.when(auth > 10, F.lit("Consider temporary account lock")),
        F.when(targets > 10, F.lit("Possible reconnaissance - review firewall rules")),
    ))
    actor = F.when(c("strategy") == "dst_host", F.lit("Unknown")).otherwise(c("entity"))
    story = _said(actor, " engaged in ", n, " events targeting ", targets, " target(s) with ", simple_pattern(c("per_minute")), " pattern (anomaly score: ", a, ")")
    return out.withColumns({"narrative": story, "observations": F.array_compact(F.array(*seen)), "recommendations": F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("Continue monitoring")))})


def full(chunks: DataFrame) -> DataFrame:
    """scored(), with the time as text, the duration, and described ports."""
    clock = lambda t: F.date_format(F.timestamp_micros(F.col(t)), "HH:mm")
    return scored(chunks).withColumns({
        "time_window": F.concat(clock("window_start"), F.lit("\u2013"), clock("window_end"), F.lit(" UTC")), "duration_minutes": (F.col("window_end") - F.col("window_start")) / 60e6,
        "simple_pattern": simple_pattern(F.col("per_minute")), "port_descriptions": F.transform(F.slice("ports", 1, 15), described), "bytes_text": human_bytes(F.col("bytes_sent")),
    })


def phrases(path: Column) -> Column:
    """An array of `kind: phrase`, the first phrase of each kind that a path holds; traversal minds the case."""
    low = F.lower(path)
    found = (F.coalesce(*(F.when((path if kind == "Path traversal" else low).contains(p), F.lit(f"{kind}: {p}")) for p in ps)) for kind, ps in PHRASES.items())
    return F.array_compact(F.array(*found))


def http_analysis(windows: DataFrame) -> DataFrame:
    """One row for each chunk: methods, a histogram of statuses, suspicious paths in order, agents and attack phrases.

    The windows are read once. An event is a few pairs of kind and value, which are counted by chunk, kind and value; so a
    chunk with most rows is dealt over its values. Lists are cut by row numbers before anything is gathered. Suspicious
    paths keep their place in time, and stand once for each phrase that they hold.
    """
    pair = lambda kind, value, place=None: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), (F.lit(None) if place is None else place).cast("struct<t: bigint, row: bigint, at: int>").alias("place"))
    odd = lambda x, i: pair("uri", F.col("uri_path"), F.struct("t_us", F.col("row_number").cast("bigint"), i))
    pairs = F.concat(
        F.array_compact(F.array(
            F.when(F.col("http_method") != "", pair("method", F.col("http_method"))), F.when(F.col("http_status") != 0, pair("status", F.col("http_status"))),
            F.when(F.col("agent") != "", pair("agent", F.col("agent"))), pair("event", F.lit("")),
        )),
        F.transform("found", odd), F.transform("found", lambda x: pair("indicator", x)),
    )
    w = windows.select(*KEYS, "t_us", "row_number", "http_method", "http_status", "uri_path", F.substring("user_agent", 1, AGENT_LENGTH).alias("agent"), phrases(F.coalesce("uri_path", F.lit(""))).alias("found"))
    # a path that stands twice at one place in time and rows is one row that repeats: each counts
    counts = w.select(*KEYS, F.inline(pairs)).groupBy(*KEYS, "kind", "value", "place").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*KEYS, "kind").orderBy("place", "value")
    most = F.when(F.col("kind") == "agent", AGENTS).when(F.col("kind") == "uri", URIS)
    kept = counts.withColumn("k", F.row_number().over(order)).where(most.isNull() | (F.col("k") <= most))
    of = lambda kind, item: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, item)))
    by = kept.groupBy(*KEYS).agg(
        of("method", F.col("value")).alias("methods"), of("status", F.struct(F.col("value").cast("int").alias("key"), F.col("n").alias("value"))).alias("statuses"),
        of("uri", F.struct("k", "value", "n")).alias("uris"), of("indicator", F.col("value")).alias("indicators"), of("agent", F.col("value")).alias("agents"),
    )
    some = lambda c, x=None: F.when(F.size(c) > 0, F.col(c) if x is None else x)
    uris = F.slice(F.flatten(F.transform("uris", lambda u: F.array_repeat(u["value"], u["n"].cast("int")))), 1, URIS)
    return by.select(*KEYS, some("methods").alias("methods"), some("statuses", F.map_from_entries("statuses")).alias("statuses"), some("uris", uris).alias("suspicious_uris"), some("indicators").alias("indicators"), some("agents").alias("agents"))


def dns_analysis(rows: DataFrame, key: str, query: str) -> DataFrame:
    """One row for each key: queries under odd top-level domains or with a label of over 20 characters, and queries of over 100."""
    q = F.col(query)
    odd = reduce(or_, (q.endswith(d) for d in ODD_DOMAINS)) | F.exists(F.split(q, r"\."), lambda x: F.char_length(x) > 20)
    named = rows.where(q != "").select(key, q.alias("q"), odd.alias("odd"), (F.char_length(q) > 100).alias("long")).groupBy(key, "q", "odd", "long").count()
    return named.groupBy(key).agg(F.count("*").alias("queries"), F.count_if("odd").alias("suspicious"), F.sum(F.when(F.col("long"), F.col("count")).otherwise(0)).alias("tunneling"))


def mail_analysis(rows: DataFrame, key: str, sender: str, attachments: str) -> DataFrame:
    """One row for each key: senders, and attachments whose names end like programs."""
    risky = F.filter(F.coalesce(attachments, F.array().cast("array<string>")), lambda a: reduce(or_, (a.endswith(e) for e in RISKY_FILES)))
    return rows.groupBy(key).agg(F.count_distinct(F.nullif(sender, F.lit(""))).alias("senders"), F.sum(F.size(risky)).alias("suspicious_attachments"))


def session_analysis(rows: DataFrame, key: str, session: str) -> DataFrame:
    """One row for each key: its sessions, and whether they are too many for one entity."""
    out = rows.groupBy(key).agg(F.count_distinct(F.nullif(session, F.lit(""))).alias("sessions"))
    return out.withColumn("excessive", F.col("sessions") > SESSIONS)


def severity_histogram(rows: DataFrame, key: str, severity: str) -> DataFrame:
    counts = rows.where(F.col(severity).isNotNull()).groupBy(key, severity).count()
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(severity, "count")))).alias("severities"))
