import datetime

import pytest

from pyspark.sql import functions as F

from threatlake.functions import net
from threatlake.operators import incidents, normalize, summaries
from threatlake.sources import files


def chunk(**more):
    base = {"strategy": "src_ip", "entity": "1.2.3.4", "window_start": 0, "window_end": 600_000_000, "events": 120, "denied": 100, "targets": 12, "failure_rate": 0.835, "per_minute": 12.0, "pattern": "bursty", "ports": [22, 1024, 60000], "bytes_sent": 1536}
    return base | more


def frame(spark, *rows):
    kind = "strategy string, entity string, window_start long, window_end long, events long, denied long, targets int, failure_rate double, per_minute double, pattern string, ports array<int>, bytes_sent long, auth_failures long, auth_successes long"
    return spark.createDataFrame([tuple(({"auth_failures": 0, "auth_successes": 0} | r)[k.split()[0]] for k in kind.split(", ")) for r in rows], kind)


def test_scores_flags_and_texts(spark):
    hot, quiet = summaries.full(frame(spark, chunk(auth_failures=11, auth_successes=2), chunk(events=5, denied=0, targets=1, failure_rate=0.0, per_minute=0.1, ports=[], bytes_sent=5 << 30))).collect()
    assert hot.anomaly_score == 90 and hot.reasons == ["High failure rate: 84%", "Multiple auth failures: 11", "Scanning behavior: 12 targets", "High activity volume: 120 events"]
    assert hot.red_flags == ["High auth failures: 11", "High failure rate: 84%", "Multiple targets: 12 hosts", "Blocked remote access attempts"]
    assert hot.time_window == "00:00\u201300:10 UTC" and hot.duration_minutes == 10 and hot.port_descriptions == ["SSH (22)", "Registered (1024)", "Ephemeral (60000)"] and hot.bytes_text == "1.5 KB"
    assert hot.recommendations == ["Immediate investigation recommended", "Consider temporary account lock", "Possible reconnaissance - review firewall rules"]
    assert hot.observations == ["Authentication: 11 failures, 2 successes", "Targeted 12 different hosts", "High denial rate: 84%"] and "bursty pattern (anomaly score: 90)" in hot.narrative
    assert (quiet.anomaly_score, quiet.red_flags, quiet.recommendations, quiet.simple_pattern, quiet.bytes_text) == (0, [], ["Continue monitoring"], "random", "5.0 GB")


def test_context_and_http(spark):
    rows = [("src_ip", "9.9.9.9", 0, 2, 2, "9.9.9.9", "amy", "10.0.0.1", "Stage-Prod", 22, "GET", 200, "/a/../b?x", "agent"), ("src_ip", "9.9.9.9", 0, 1, 1, "9.9.9.9", None, "10.0.0.2", None, 0, "POST", 404, "/q union select", ""), ("src_ip", "9.9.9.9", 0, 3, 3, "9.9.9.9", "", None, "dev", 80, "GET", 404, None, "x" * 200)]
    w = spark.createDataFrame(rows, "strategy string, entity string, window_start long, t_us long, row_number long, src_ip string, username string, dst_ip string, dst_host string, dst_port int, http_method string, http_status int, uri_path string, user_agent string")
    c = summaries.context(w).first()
    assert (c.actor_user, c.actor_sources, c.actor_internal, c.environment, c.unique_ports, c.port_categories) == ("amy", None, False, "PROD", 2, ["HTTP", "SSH"])
    h = summaries.http_analysis(w).first()
    assert h.statuses == {200: 1, 404: 2} and h.methods == ["GET", "POST"] and h.suspicious_uris == ["/q union select", "/a/../b?x"] and h.agents == ["agent", "x" * 100]
    assert h.indicators == ["Path traversal: ../", "SQL injection pattern: union select"]
    assert summaries.http_analysis(w.where("false")).count() == 0


def test_names_mail_and_sessions(spark):
    d = spark.createDataFrame([("a", "x.tk"), ("a", "x.tk"), ("a", "b" * 21 + ".org"), ("a", "ok.org"), ("b", ("y" * 19 + ".") * 6 + "org"), ("b", None)], "k string, q string")
    assert sorted(map(tuple, summaries.dns_analysis(d, "k", "q").collect())) == [("a", 3, 2, 0), ("b", 1, 0, 1)]
    m = spark.createDataFrame([("a", "s@x", ["a.exe", "b.txt"]), ("a", "", None)], "k string, s string, f array<string>")
    assert [tuple(r) for r in summaries.mail_analysis(m, "k", "s", "f").collect()] == [("a", 1, 1)]
    s = spark.range(60).select(F.lit("a").alias("k"), F.col("id").cast("string").alias("s"))
    assert [tuple(r) for r in summaries.session_analysis(s, "k", "s").collect()] == [("a", 60, True)]


def test_indicator_ladder_and_addresses(spark):
    texts = ["bad URL", "a referrer", "user agent x", "command", "scanner", "none of it", "from 1.2.3.4 to 5.6.7.8 and 9.9.9.9", "1.2.3.4"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", incidents.indicator(F.col("t")), incidents.second_address(F.col("t"))).collect()
    assert [r[1] for r in got] == ["url", "referer", "user_agent", "payload", "source ip", "null", "null", "null"]
    assert [r[2] for r in got[-2:]] == ["5.6.7.8", None]


def test_changes(spark):
    i = spark.createDataFrame([("a", "new", "high"), ("b", "new", "low")], "incident_id string, status string, priority string")
    c = spark.createDataFrame([("a", 1, "triaged", None), ("a", 3, None, "low"), ("a", 2, "closed", None)], "incident_id string, changed_at int, status string, priority string")
    got = {r.incident_id: r for r in incidents.changed(i, c).collect()}
    assert (got["a"].status, got["a"].priority, len(got["a"].timeline)) == ("closed", "low", 3) and (got["b"].status, got["b"].priority, got["b"].timeline) == ("new", "low", None)


def test_changes_of_one_time_and_a_second_call(spark):
    i = spark.createDataFrame([("a", "new", "high"), ("b", "new", "low")], "incident_id string, status string, priority string")
    c = spark.createDataFrame([("a", 1, "closed", None), ("a", 1, "triaged", None), ("a", 1, "new", "low")], "incident_id string, changed_at int, status string, priority string")
    once = incidents.changed(i, c)
    assert [r.status for r in once.where("incident_id = 'a'").collect()] == ["triaged"]
    twice = {r.incident_id: r for r in incidents.changed(once, spark.createDataFrame([("a", 2, "closed", None), ("b", 5, None, "high")], c.schema)).collect()}
    assert (twice["a"].status, len(twice["a"].timeline), twice["b"].priority, len(twice["b"].timeline)) == ("closed", 4, "high", 1)


def test_byte_sizes_round_half_to_even(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 272_640, 273_152, 272_691, 1 << 20, 5 << 30)], "n long").select(summaries.human_bytes(F.col("n"))).collect()
    assert [r[0] for r in got] == ["0 B", "1023 B", "1.0 KB", "266.2 KB", "266.8 KB", "266.3 KB", "1.0 MB", "5.0 GB"]


def test_addresses_as_the_library_writes_them(spark):
    import ipaddress
    import random

    r = random.Random(6)
    parts = ["0", "00", "0000", "1", "db8", "ffff", "2001", "abcd", "0a0B", "12345", "g", "", "1.2.3.4", "255.255.255.255", "1.2.3.256"]
    raw = [":".join(r.choice(parts[:9] if r.random() < 0.8 else parts) for _ in range(r.choice([3, 7, 8, 8, 8, 9]))) for _ in range(3000)]
    for _ in range(4000):
        x, y = ([r.choice(parts[:9]) for _ in range(r.randint(0, 5))] for _ in range(2))
        raw.append(":".join(x) + "::" + ":".join(y) + (":1.2.3.4" if y and r.random() < 0.2 else ""))
    raw += ["::", "::1", "1::", "::ffff:0:0", "::ffff:1.2.3.4", "::FFFF:102:304", "0:0:0:0:0:ffff:1.2.3.4", "64:ff9b::1.2.3.4", "[2001:db8::1]", "fe80::1%eth0", "1::2::3", ":::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "12:34:56", " ::1 ", "::1.2.3.4", "::ffff:01.2.3.4"]

    def want(x):
        try:
            a = ipaddress.IPv6Address(x.strip().strip("[]").partition("%")[0])
        except ValueError:
            return None
        return str(a.ipv4_mapped or a)

    got = spark.createDataFrame([(x,) for x in raw], "x string").select("x", net.canonical_v6(F.col("x")).alias("y")).collect()
    wrong = [(g.x, g.y, want(g.x)) for g in got if g.y != want(g.x)]
    assert not wrong, wrong[:5]
    plan = spark.createDataFrame([("1.2.3.4",)], "x string").select(net.normalize_ip(F.col("x")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_addresses(spark):
    raw = ["10:21:33", "::::", "2001:DB8::0:1", "::ffff:1.2.3.4", "[fe80::1%eth0]", "2606:4700::1111", "::1", "x 5.6.7.8 y", None, "-"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "x string").select(net.normalize_ip(F.col("x"))).collect()]
    assert got == [None, None, "2001:db8::1", "1.2.3.4", "fe80::1", "2606:4700::1111", "::1", "5.6.7.8", None, None]
    classes = spark.createDataFrame([(x,) for x in ("2606:4700::1111", "fd00::1", "8.8.8.8", "-")], "x string").select(net.is_private(F.col("x")), net.is_global(F.col("x"))).collect()
    assert [tuple(r) for r in classes] == [(False, True), (True, False), (False, True), (False, False)]


def test_times_do_not_depend_on_the_session(spark):
    rows = [(1, "2024-03-10T10:00:00+05:30"), (2, "2024-03-10 10:00:00"), (3, "10/Mar/2024:10:00:00 +0100"), (4, "2024-03-10")]
    want = [datetime.datetime(2024, 3, 10, 4, 30), datetime.datetime(2024, 3, 10, 10), datetime.datetime(2024, 3, 10, 9), datetime.datetime(2024, 3, 10)]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.createDataFrame(rows, "row_number long, timestamp string").withColumn("src_ip", F.lit("1.2.3.4"))
            assert [r.event_ts for r in normalize.normalize(df).orderBy("row_number").collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_quotes_line_breaks_and_encodings(spark, tmp_path):
    text = 'src_ip,uri,user\r\n1.2.3.4,"/a?q=""x"", y",amy\r\n5.6.7.8,"two\nlines",bj\u00f6rn\r\n'
    for name, code in (("a.csv", "utf-8"), ("b.csv", "latin-1"), ("c.csv", "utf-8-sig"), ("d.csv", "utf-16")):
        (tmp_path / name).write_bytes(text.encode(code))
        got = [(r.src_ip, r.uri, r.username) for r in files.parse(spark, str(tmp_path / name)).orderBy("row_number").collect()]
        assert got == [("1.2.3.4", '/a?q="x", y', "amy"), ("5.6.7.8", "two\nlines", "bj\u00f6rn")], name


def test_validator(spark, tmp_path):
    def found(name, text):
        (tmp_path / name).write_bytes(text.encode("latin-1"))
        return files.validate(spark, str(tmp_path / name))

    good = found("a.csv", 'src,port\n1.2.3.4,22\n"x\ny",23\n')
    assert (good["rows"], good["columns"], good["delimiter"], good["encoding"], good["has_header"], good["errors"], good["warnings"]) == (2, 2, ",", "UTF-8", True, [], [])
    odd = found("b.txt", "a;;c\n1;2;3\n1;2\n1;2;3;4\n\xe9;2;3\n")
    assert odd["warnings"] == ["not a .csv file", "blank headers at [1]", "2 rows of another width: [3, 4]"] and odd["encoding"] == "ISO-8859-1" and odd["rows"] == 4
    assert found("c.csv", "")["errors"] == ["empty"] and found("d.csv", "one\n")["errors"] == ["a header and a row are needed"]
    assert not files.is_header(["1", "a"], ["2", "b"]) and not files.is_header(["a", "b"], ["c", "d"]) and files.is_header(["a", " "], ["c", "1,000"])
    listed = files.catalogue(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: (r.valid, r.sha256 is not None) for r in listed.collect()} == {"a.csv": (True, True), "b.txt": (True, True), "d.csv": (True, True)}
    assert files.storage_stats(listed).first().files == 3


def test_rows_that_cannot_be_normalized_are_kept_apart(spark):
    import random
    from urllib.parse import urlsplit

    from threatlake.operators import normalize

    r = random.Random(9)
    hosts = ["[::1]", "[::1", "::1]", "[v1.x]", "[v]", "[1.2.3.4]", "a", "[fe80::1%eth0]", "[fe80::1%]", "", "[]", "[xyz]", "[2001:DB8::1]", "b]["]
    uris = [r.choice(["http:", "", "x+y:", "ht tp:"]) + r.choice(["//", "//", "/", ""]) + r.choice(["", "", "u@", "u:p@", "[u]@"]) + r.choice(["", "", "a"]) + r.choice(hosts) + r.choice(["", ":80", "x", ":"]) + r.choice(["", "/p[1]?q=1", "?a=]", "#["]) for _ in range(1500)]
    uris += [None, "", "  ", "a=[b", "/x?a=[", "q=//[::1"]

    def fails(u):
        u = (u or "").strip()
        if not u or ("?" not in u and "=" in u and not u.startswith("/") and "://" not in u):
            return False
        try:
            urlsplit(u)
            return False
        except ValueError:
            return True

    p = spark.createDataFrame([(k, u, "1.2.3.4") for k, u in enumerate(uris)], "row_number long, uri string, src_ip string")
    events, failed = normalize.checked(p)
    bad = {x.row_number for x in failed.collect()}
    wrong = [(k, u) for k, u in enumerate(uris) if fails(u) != (k in bad)]
    assert not wrong, wrong[:6]
    assert 100 < len(bad) < len(uris) and {x.row_number for x in events.select("row_number").collect()} == set(range(len(uris))) - bad
    c = normalize.counts(p).first()
    assert (c.rows, c.errors, c.normalized) == (len(uris), len(bad), len(uris) - len(bad)) and c.success_rate == pytest.approx(c.normalized / c.rows)
    assert normalize.counts(p.where("false")).first().success_rate == 1.0
