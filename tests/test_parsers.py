import duckdb
import pytest
from pyspark.sql import functions as F

from threatlake.operators import normalize
from threatlake.plans import parsed
from threatlake.sources import files, parsers

LINE = (
    "<150>Jan 28 08:59:59 servernameabc httpd[12345]: 10.10.10.10 203.0.113.99 443 abc.example.net - - [28/Jan/2026:08:59:59 +0530] "
    '"GET /page.html HTTP/1.1" 200 5120 17 "https://abc.example.com/" "Mozilla/5.0 (Windows NT 10.0)"'
)
EXTENDED = (
    "<134>Mar 27 10:15:30 webserver01 httpd[1234]: 192.168.1.100 10.0.0.1, 192.168.1.1, 10.0.0.2 - user123 example.com "
    '27/Mar/2026:10:15:30 +0000] "GET /api/users HTTP/1.1" 200 1024 500 "https://example.com/login" "Mozilla/5.0"'
)
FLEXIBLE = '<134>Mar 27 10:15:30 web01 httpd[123]: 1.1.1.1 2.2.2.2 user1 domain.com 27/Mar/2026:10:15:30] "GET /test" 200 100'
WAF = {
    "Action": "REQUEST_ALLOWED", "CNAMTime": "18 Aug 2025, 10:21 PM", "SrcIP": "155.94.173.117", "DstIP": "10.40.54.110", "DstPort": "443", "Method": "POST", "ReturnCode": "200",
    "URL": "/lucee/admin/imgProcess.cfm", "UserAgent": "Mozilla/5.0", "SeverityLevel": "HIGH", "ThreatType": "WebShell", "Indicator": "imgProcess.cfm", "DeviceName": "srv01", "Domain": "gess.example.net",
}


def frame(spark, *rows):
    """Raw rows of dictionaries."""
    names = list(rows[0])
    return spark.createDataFrame([(i + 1, *(r[n] for n in names)) for i, r in enumerate(rows)], "row_number long, " + ", ".join(f"`{n}` string" for n in names))


@pytest.mark.parametrize(("columns", "sample", "name", "least", "most"), [
    (["timestamp", "src_ip", "dst_ip", "action", "port"], [{"src_ip": "10.0.0.1"}], "generic", 0.1, 0.45), (["src_ip", "dst_ip", "action", "rule", "zone_src", "zone_dst"], [{"action": "DENY"}], "firewall", 0.5, 1),
    (["src_ip", "dst_ip", "bytes", "packets", "duration"], [{"bytes": "1024"}], "network_flow", 0.4, 1), (["unknown_col1", "unknown_col2"], [{"unknown_col1": "value"}], "generic", 0, 0),
    (["logevent"], [{"logevent": LINE}], "syslog_apache", 0.7, 1), (["SrcIP", "DstIP", "Action", "ThreatType", "SeverityLevel"], [], "web_waf", 0.65, 1), (list(WAF), [WAF], "web_waf", 0.65, 1),
    (["logevent"], [], "generic", 0, 0), ([], [], "generic", 0, 0), (["logevent", "src", "dst"], [{"logevent": LINE}], "generic", 0.1, 0.45),
])
def test_detect(columns, sample, name, least, most):
    got, sure = parsers.detect(columns, sample)
    assert got == name and least <= sure <= most


def test_registry():
    assert parsers.WEB_WAF.score({}, {"action", "method", "useragent"}, []) == 0 == parsers.SYSLOG.score({}, {"timestamp", "src_ip", "dst_ip"}, [{"timestamp": "x"}])
    columns = ["src", "dst", "action"]
    assert parsers.detect(columns, [])[0] == "generic"
    parsers.register(parsers.ENHANCED_FIREWALL)
    try:
        name, sure = parsers.detect(columns, [])
        assert name == "enhanced_firewall" and abs(sure - 0.9) < 1e-9
    finally:
        del parsers.REGISTRY["enhanced_firewall"]


def test_generic_rows(spark):
    got = parsers.parse_rows(frame(spark, {"timestamp": "2024-01-15 14:30:00", "src_ip": "192.168.1.100", "dst_ip": "10.0.0.50", "dst_port": "443", "action": "ALLOW", "protocol": "TCP"}))
    r = normalize.normalize(got).first()
    assert (r.src_ip, r.dst_ip, r.dst_port, r.action, r.protocol, str(r.event_ts)) == ("192.168.1.100", "10.0.0.50", 443, "ALLOW", "TCP", "2024-01-15 14:30:00")
    r = parsers.parse_rows(frame(spark, {"src_ip": "192.168.1.100"})).first()
    assert r.src_ip == "192.168.1.100" and r.dst_ip is None and r.timestamp is None and not r.vendor
    rows = parsers.parse_rows(frame(spark, *({"src_ip": f"192.168.1.{i}", "dst_ip": "10.0.0.1"} for i in range(5)))).collect()
    assert len(rows) == 5 and len({r.row_hash for r in rows}) == 5


def test_waf_rows(spark):
    blank = dict.fromkeys(WAF) | {"SrcIP": " ", "ThreatType": "  "}
    redirect = blank | {"Action": "BLOCK", "SrcIP": "155.94.173.117", "DstIP": "10.40.54.110", "Method": "GET", "ReturnCode": "302", "URL": "https://target.example/login?next=https://evil.example"}
    parsed = parsers.parse_rows(frame(spark, WAF, redirect, blank)).orderBy("row_number")
    a, b, c = normalize.normalize(parsed).orderBy("row_number").collect()
    assert parsed.first().vendor == {"threat_type": "WebShell", "indicator": "imgProcess.cfm", "device_name": "srv01"}
    assert (a.src_ip, a.dst_ip, a.dst_port, a.action, a.http_method, a.http_status, a.uri_path, a.severity, a.dst_host) == ("155.94.173.117", "10.40.54.110", 443, "ALLOW", "POST", 200, "/lucee/admin/imgProcess.cfm", "HIGH", "gess.example.net")
    assert str(a.event_ts) == "2025-08-18 22:21:00" and a.original_message == "threat_type=WebShell indicator=imgProcess.cfm device_name=srv01"
    assert (b.action, b.http_status, b.uri_path, b.uri_query) == ("DENY", 302, "/login", "next=https://evil.example")
    assert (c.src_ip, c.dst_ip, c.uri_path, c.vendor) == ("-", None, None, {})


def test_line_forms(spark):
    lines = [LINE, EXTENDED, FLEXIBLE, "not a valid log line at all", "", None, '<1>Jan 1 h httpd[1]: 10.52.149.178 - - - - [24/Mar/2026:12:00:56 +0530] "GET /x HTTP/1.1" 400 226 "-" "-"']
    parsed = parsers.parse_lines(frame(spark, *({"logevent": x} for x in lines)))
    a, b, c, bad, empty, null, short = normalize.normalize(parsed).orderBy("row_number").collect()
    assert (a.src_ip, a.dst_ip, a.http_method, a.http_status, a.uri_path, a.referrer, a.user_agent) == ("10.10.10.10", "203.0.113.99", "GET", 200, "/page.html", "https://abc.example.com/", "Mozilla/5.0 (Windows NT 10.0)")
    assert str(a.event_ts) == "2026-01-28 03:29:59" and a.vendor == {"form": "standard", "port": "443", "response_time": "17"} and a.username is None
    assert (b.src_ip, b.dst_ip, b.username, b.dst_host, b.uri_path, b.bytes_sent, b.user_agent, b.vendor["form"]) == ("10.0.0.1", "192.168.1.100", "user123", "example.com", "/api/users", 1024, "Mozilla/5.0", "extended")
    assert (c.src_ip, c.dst_ip, c.username, c.dst_host, c.uri_path, c.http_status, str(c.event_ts), c.vendor["form"]) == ("2.2.2.2", "1.1.1.1", "user1", "domain.com", "/test", 200, "2026-03-27 10:15:30", "flexible")
    assert bad.src_ip == "-" and bad.original_message == lines[3] and bad.vendor == {} and empty.src_ip == null.src_ip == "-"
    assert short.dst_ip == "10.52.149.178" and short.http_status == 400
    turned = parsers.parse_lines(frame(spark, {"logevent": LINE}), "dst_first").first()
    assert (turned.src_ip, turned.dst_ip) == ("203.0.113.99", "10.10.10.10")


def test_firewalls_and_flows(spark):
    wall = frame(spark, {"src_ip": "1.2.3.4", "dst_ip": "10.0.0.1", "action": "DROP", "rule": "block_all", "zone_src": "out", "severity": "high", "session": "s1", "app": "ssh", "weird.name": "x"})
    parsed = parsers.parse_rows(wall)
    r = normalize.normalize(parsed).first()
    assert (r.action, r.severity, r.session_id, r.application, r.vendor) == ("DENY", "high", "s1", "ssh", {"rule": "block_all", "zone_src": "out", "weird.name": "x"})
    r = normalize.normalize(parsers.parse_rows(frame(spark, {"principal": "eve", "path": "/x", "port": "22", "result": "permit", "source_address": "1.2.3.4"}), "enhanced_firewall")).first()
    assert (r.username, r.uri_path, r.dst_port, r.action, r.src_ip) == ("eve", "/x", 22, "ALLOW", "1.2.3.4")
    r = normalize.normalize(parsers.parse_rows(frame(spark, {"src_ip": "1.2.3.4", "dst_ip": "10.0.0.1", "bytes": "1024", "packets": "3", "duration": "15"}))).first()
    assert (r.bytes_sent, r.duration_ms, r.vendor) == (1024, 15, {"packets": "3"})
    for x, y in (("ALLOW", "ALLOW"), ("PERMIT", "ALLOW"), ("DENY", "DENY"), ("DROP", "DENY"), ("BLOCK", "DENY")):
        assert spark.range(1).select(normalize.action(F.lit(x))).first()[0] == y


def test_vendor_stands_in(spark):
    # maps keep the order of their entries in SQL, not on the way from Python
    rows = spark.sql("""SELECT * FROM VALUES (1L, NULL, '', map('url', '/a?b=1', 'user_agent', 'x/1', 'content_type', 'text/html', 'empty', ' ')),
      (2L, '/own', 'own/1', map('url', '/a', 'long', repeat('y', 3000))), (3L, NULL, NULL, NULL) AS t(row_number, uri, user_agent, vendor)""")
    a, b, c = normalize.normalize(rows).orderBy("row_number").collect()
    assert (a.uri_path, a.uri_query, a.user_agent, a.content_type, a.original_message) == ("/a", "b=1", "x/1", "text/html", "url=/a?b=1 user_agent=x/1 content_type=text/html")
    assert (b.uri_path, b.user_agent, len(b.original_message)) == ("/own", "own/1", 2000) and c.uri_path is None
    bad = rows.select("row_number", F.create_map(F.lit("url"), F.lit("http://[::1/x")).alias("vendor"))
    assert normalize.checked(bad)[1].count() == 3


def test_file_follows_detection(spark, tmp_path):
    path = str(tmp_path / "waf.csv")
    with open(path, "w") as f:
        f.write(",".join(WAF) + "\n" + "\n".join(",".join(f'"{v}"' for v in WAF.values()) for _ in range(3)) + "\n")
    got = files.parse(spark, path).collect()
    assert [r.row_number for r in got] == [2, 3, 4] and {r.vendor["threat_type"] for r in got} == {"WebShell"}


def test_row_numbers_and_splits(spark, tmp_path):
    """Rows are numbered without gaps over the splits of a file, which isn't read by one task without need."""
    path = str(tmp_path / "big.csv")
    with open(path, "w") as f:
        f.write("src_ip,note\n" + "".join(f'10.0.{i // 250}.{i % 250},"a, b {i}"\n' for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = files.read_rows(spark, path)[1]
        assert rows.select(F.spark_partition_id()).distinct().count() > 3
        assert [(r.row_number, r.note) for r in rows.orderBy("row_number").collect()] == [(i + 2, f"a, b {i}") for i in range(20000)]
        with open(path, "a") as f:
            f.write('10.9.9.9,"two\nlines"\n')
        last = files.read_rows(spark, path)[1].orderBy(F.desc("row_number")).first()
        assert (last.row_number, last.note) == (20002, "two\nlines")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("name", ["parsed_waf", "parsed_firewall", "parsed_flows", "parsed_lines"])
def test_sql(spark, sf, name):
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{sf}/events.parquet'")
    mine, other = parsed.queries()[name](spark, sf), c.sql(parsed.oracle_sql()[name])
    names = sorted(mine.columns)
    assert names == sorted(other.columns)
    assert sorted(repr([str(r[n]) for n in names]) for r in mine.collect()) == sorted(repr([str(r[other.columns.index(n)]) for n in names]) for r in other.fetchall())
