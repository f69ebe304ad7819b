"""Parsers as data: what a format's columns are called, how sure it is of a file, and the patterns of its lines.

Every parser gives the same columns: row_number, the fields it knows as strings, `vendor` (a map of all other columns that
hold something, in their order), original_message (lines only) and row_hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that a field goes by, in all formats and in single ones; words that tell a format; lines of access logs.
ALIASES = {
    "timestamp": ["timestamp", "time", "datetime", "date", "event_time"], "src_ip": ["src_ip", "src", "source_ip", "source", "srcip"], "dst_ip": ["dst_ip", "dst", "destination_ip", "dest_ip", "destination", "dstip"],
    "src_port": ["src_port", "sport", "source_port"], "dst_port": ["dst_port", "dport", "destination_port", "dest_port"], "action": ["action", "status_action", "verdict", "disposition"],
    "protocol": ["protocol", "proto"], "username": ["username", "user", "user_name"], "bytes_sent": ["bytes_sent", "bytes", "bytes_out", "sent_bytes"], "bytes_received": ["bytes_received", "bytes_in"],
    "uri": ["uri", "url", "request_uri", "uri_path"], "method": ["method", "http_method", "request_method"], "status": ["status", "http_status", "response_code", "status_code"],
    "user_agent": ["user_agent", "useragent", "ua"], "referrer": ["referrer", "referer"], "dst_host": ["dst_host", "host", "hostname"],
}
DETAILS = {"severity": ["severity", "level", "priority", "criticality"], "session_id": ["session_id", "session", "conn_id", "connection_id"], "application": ["application", "app", "service"]}
WAF = {
    "timestamp": ["cnamtime", "timestamp", "time"], "src_port": ["srcport", "src_port"], "dst_port": ["dstport", "dst_port"], "status": ["returncode", "status"], "dst_host": ["domain", "host"],
    "severity": ["severitylevel", "severity"], "session_id": ["sessionid", "session_id"], "content_type": ["contenttype", "content_type"],
}
WAF_VENDOR = {"threattype": "threat_type", "devicename": "device_name"}
ENHANCED = {
    "src_ip": ["src_ip", "source_ip", "src", "source_address"], "dst_ip": ["dst_ip", "dest_ip", "dst", "destination_ip"], "src_port": ["src_port", "source_port", "sport"], "dst_port": ["dst_port", "dest_port", "dport", "port"],
    "protocol": ["protocol", "proto", "ip_protocol"], "action": ["action", "disposition", "verdict", "result"], "method": ["http_method", "method", "request_method"], "status": ["http_status", "status_code", "response_code"],
    "uri": ["uri", "url", "path", "request_uri"], "user_agent": ["user_agent", "useragent", "ua"], "username": ["username", "user", "principal"],
}
FLOW, POLICIES = {"bytes", "packets", "duration"}, ("rule", "zone", "policy")
# End of the fixed values.

_IP, _DAY = "([0-9A-Fa-f.:-]+)", r"\[?([0-9]{1,2}/[A-Za-z]{3}/[0-9]{4}:[0-9:]{8}(?: [+-][0-9]{4})?)\]?"
_REQUEST = r'"([A-Z]+) (\S+)(?: [^"]*)?" ([0-9]{3}) (\S+)(?: +([0-9.-]+))?(?: +"([^"]*)")?(?: +"([^"]*)")?'


@dataclass(frozen=True)
class Line:
    """A form of access lines: its part before the day, the fields of its groups, and which address comes first."""

    name: str
    head: str
    fields: tuple[str, ...]
    order: str


#: In the order in which they are tried; the last takes lines with any number of words between the addresses and the host.
LINES = (
    Line("standard", rf"{_IP} +{_IP} +([0-9]+|-) +(\S+) +\S+ +(\S+)", ("first", "second", "port", "dst_host", "username"), "src_first"),
    Line("extended", rf"{_IP} +{_IP}(?: *, *[0-9A-Fa-f.:-]+)* +\S+ +(\S+) +(\S+)", ("first", "second", "username", "dst_host"), "dst_first"),
    Line("flexible", rf"{_IP} +{_IP} +(\S+) +(\S+)", ("first", "second", "username", "dst_host"), "dst_first"),
    Line("loose", rf"{_IP}[ ,]+{_IP}(?:[ ,]+\S+)*? +(\S+) +\S+ +\S+", ("first", "second", "dst_host"), "src_first"),
)
TAIL = ("timestamp", "method", "uri", "status", "bytes_sent", "response_time", "referrer", "user_agent")
FIELDS = [*ALIASES, "severity", "session_id", "application", "content_type", "duration_ms"]


@dataclass(frozen=True)
class Parser:
    """score gets (field to column, lower-case column names, up to five rows) and says how sure the parser is, from 0 to 1;
    aliases stand in for the common ones of their fields; vendor names columns of the map."""

    name: str
    score: Callable[[dict[str, str], set[str], list[dict]], float]
    aliases: dict[str, list[str]] = field(default_factory=dict)
    vendor: dict[str, str] = field(default_factory=dict)
    lines: bool = False


def _access_line(_found: dict, names: set[str], sample: list[dict]) -> float:
    line = str(sample[0].get("logevent") or "") if sample and len(names) <= 2 else ""
    return 0.9 if "HTTP/" in line or "httpd[" in line else 0.0


def _both(found: dict) -> bool:
    return {"src_ip", "dst_ip"} <= found.keys()


GENERIC = Parser("generic", lambda found, names, sample: min(0.45, 0.11 * len(found.keys() & ALIASES.keys())), DETAILS)
SYSLOG = Parser("syslog_apache", _access_line, lines=True)
WEB_WAF = Parser("web_waf", lambda found, names, sample: (0.8 if names & {"url", "uri", "threat_type", "threattype"} else 0.65) if {"srcip", "dstip"} <= names else 0.0, DETAILS | WAF, WAF_VENDOR)
FIREWALL = Parser("firewall", lambda found, names, sample: 0.5 + 0.3 * _both(found) if "action" in found and any(n.startswith(POLICIES) for n in names) else 0.0, DETAILS)
NETWORK_FLOW = Parser("network_flow", lambda found, names, sample: 0.2 * len(names & FLOW) if _both(found) else 0.0, DETAILS | {"duration_ms": ["duration_ms", "duration"]})
#: Isn't registered by itself, as it would take every file with two addresses and an action from the others.
ENHANCED_FIREWALL = Parser("enhanced_firewall", lambda found, names, sample: min(0.3 * len(found.keys() & {"src_ip", "dst_ip", "action"}), 1.0), DETAILS | ENHANCED)

REGISTRY: dict[str, Parser] = {p.name: p for p in (GENERIC, SYSLOG, WEB_WAF, FIREWALL, NETWORK_FLOW)}


def register(parser: Parser) -> None:
    """Adds a parser, or puts it in the place of the one of its name."""
    REGISTRY[parser.name] = parser


def resolve(columns: list[str], aliases: dict[str, list[str]] = ALIASES) -> dict[str, str]:
    """Field to column, by the first alias that is there, whatever the case."""
    known: dict[str, str] = {}
    for c in columns:
        known.setdefault(c.strip().lower(), c)
    first = {f: next((known[a] for a in names if a in known), None) for f, names in aliases.items()}
    return {f: c for f, c in first.items() if c is not None}


def detect(columns: list[str], sample: list[dict]) -> tuple[str, float]:
    """(name, confidence) of the most confident parser; `generic` where none is confident."""
    names = {c.strip().lower() for c in columns}
    scores = {p.name: p.score(resolve(columns, ALIASES | p.aliases), names, sample) for p in REGISTRY.values()}
    best = max(scores, key=lambda n: (scores[n], n == "generic"))
    return (best, scores[best]) if scores[best] > 0 else ("generic", 0.0)


def row_hash(columns: list[str]) -> Column:
    """A digest of a row's named values, whatever the order of columns."""
    value = lambda c: F.col(f"`{c.replace('`', '``')}`").cast("string")
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.concat(F.lit(c + "\x1e"), F.coalesce(value(c), F.lit("\x00"))) for c in sorted(columns))), 256), 1, 16)


def vendor_key(column: str, parser: Parser) -> str:
    """A column's key in the map: as the parser names it, else in small letters with an underline where words begin."""
    plain = column.strip()
    if plain.lower() in parser.vendor:
        return parser.vendor[plain.lower()]
    return "".join(f"_{c}" if i and c.isupper() and plain[i - 1].islower() else c for i, c in enumerate(plain)).lower()


def parse_delimited(rows: DataFrame, parser: Parser = GENERIC) -> DataFrame:
    """Fields by alias, all other columns that hold something in the map; of columns with one key the first counts.
    Nulls and blank texts are null fields and aren't in the map."""
    columns = [c for c in rows.columns if c != "row_number"]
    found = resolve(columns, ALIASES | parser.aliases)
    text = lambda c: F.col(f"`{c.replace('`', '``')}`").cast("string")
    others: dict[str, str] = {}
    for c in columns:
        if c not in found.values():
            others.setdefault(vendor_key(c, parser), c)
    entries = [F.struct(F.lit(k).alias("key"), text(c).alias("value")) for k, c in others.items()]
    vendor = F.map_from_entries(F.filter(F.array(*entries), lambda e: F.coalesce(F.trim(e["value"]) != "", F.lit(False)))) if entries else F.lit(None).cast("map<string,string>")
    fields = [(F.when(F.trim(text(found[f])) != "", text(found[f])) if f in found else F.lit(None).cast("string")).alias(f) for f in FIELDS]
    return rows.select("row_number", *fields, vendor.alias("vendor"), row_hash(columns).alias("row_hash"))


def parse_lines(rows: DataFrame, order: str | None = None) -> DataFrame:
    """Fields of access lines, by the first form that fits; a line that fits none keeps its message and has null fields.
    order (src_first or dst_first) overrides the form's own order of addresses. A day without a zone is UTC. The map holds
    the form's name, and the port and response time of the line."""
    # each form is one replacement that puts its fields in a row, so a line is matched once for each form that is tried
    columns = ("first", "second", "port", "dst_host", "username", *TAIL)
    out = rows.withColumn("_line", F.translate("logevent", "\x1e\x1f", "  ")).withColumn("_found", F.lit("").cast("string"))
    for line in LINES:
        at = {name: i + 1 for i, name in enumerate((*line.fields, *TAIL))}
        row = "\x1f".join(["\x1e" + line.name, *(f"${at[c]}" if c in at else "" for c in columns)])
        tried = F.regexp_replace("_line", rf"(?s)^(?:.*?\]: *)?{line.head} +{_DAY} +{_REQUEST}.*$", row)
        out = out.withColumn("_found", F.when(F.col("_found").startswith("\x1e"), F.col("_found")).otherwise(tried))
    out = out.withColumn("_part", F.when(F.col("_found").startswith("\x1e"), F.split("_found", "\x1f")))
    part = {c: F.when(~F.get("_part", F.lit(i + 1)).isin("", "-"), F.get("_part", F.lit(i + 1))) for i, c in enumerate(columns)}
    form = F.substring(F.get("_part", F.lit(0)), 2, 20)
    first = F.lit(order == "src_first") if order else form.isin(*(x.name for x in LINES if x.order == "src_first"))
    day = F.when(part["timestamp"].contains(" "), part["timestamp"]).otherwise(F.concat(part["timestamp"], F.lit(" +0000")))
    part |= {"timestamp": day, "src_ip": F.when(first, part["first"]).otherwise(part["second"]), "dst_ip": F.when(first, part["second"]).otherwise(part["first"])}
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("form", form), ("port", part["port"]), ("response_time", part["response_time"]))))
    fields = [part.get(f, F.lit(None).cast("string")).alias(f) for f in FIELDS]
    return out.select("row_number", *fields, F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("vendor"), F.col("logevent").alias("original_message"), row_hash(["logevent"]).alias("row_hash"))


def parse_rows(rows: DataFrame, parser: str | None = None, order: str | None = None) -> DataFrame:
    """Raw rows (row_number and one string column a field) by the named parser, or by the one that is most confident."""
    columns = [c for c in rows.columns if c != "row_number"]
    if parser is None:
        parser = detect(columns, [{k.lower(): v for k, v in r.asDict().items()} for r in rows.select(*(f"`{c.replace('`', '``')}`" for c in columns)).limit(5).collect()])[0]
    chosen = ENHANCED_FIREWALL if parser == ENHANCED_FIREWALL.name and parser not in REGISTRY else REGISTRY[parser]
    return parse_lines(rows, order) if chosen.lines else parse_delimited(rows, chosen)
