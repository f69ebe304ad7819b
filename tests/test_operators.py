import random

import duckdb
import pytest
from pyspark.sql import functions as F

from threatlake.operators import chunks, detect, incidents, normalize, state
from threatlake.plans import catalog
from threatlake.sources import files
from threatlake.streaming import watch


def test_anchored_windows(spark):
    r = random.Random(1)
    rows = [(k, r.randint(0, 300), 15) for k in "abc" for _ in range(80)] + [("d", 0, 15), ("d", 15, 15), ("d", 16, 15), ("d", 32, 15)]
    got = {(x.k, x.t): x.window_start for x in chunks.anchored_windows(spark.createDataFrame(rows, "k string, t long, w long"), ["k"], "t", "w").collect()}
    for k in "abcd":
        start = None
        for t in sorted({t for e, t, _ in rows if e == k}):
            start = t if start is None or t > start + 15 else start
            assert got[k, t] == start


def pattern(x):
    """The class of intervals, by the published rules."""
    n = len(x)
    mean = lambda a: sum(a) / len(a) if a else 0
    if n < 2:
        return "random"
    if sum(i < 5 for i in x) > n * 0.7:
        a, b = mean(x[: n // 2]), mean(x[n // 2 :])
        return "bursty_then_idle" if a < b * 0.5 else "idle_then_bursty" if b < a * 0.5 else "bursty"
    m = mean(x)
    if (mean([(i - m) ** 2 for i in x]) ** 0.5 / m if m > 0 else 0) < 0.5:
        return "steady"
    median = sorted(x)[n // 2]
    if n >= 5 and sum(abs(i - median) < median * 0.3 for i in x) > n * 0.6:
        return "periodic"
    if n >= 4:
        a, b = mean(x[: n // 3]), mean(x[-(-(-n // 3)) :])
        if b < a * 0.5:
            return "escalating"
        if a < b * 0.5:
            return "declining"
    return "random"


def test_temporal_pattern(spark):
    r = random.Random(2)
    rows = [[r.choice([0.5, 1.0, 4.9, 5.0, 8.0, 30.0, 100.0]) for _ in range(r.randint(0, 9))] for _ in range(400)] + [[10.0] * 6, [100.0, 50.0, 20.0, 5.0, 6.0], [1.0] * 8 + [4.0] * 8]
    got = spark.createDataFrame([(x,) for x in rows], "x array<double>").select("x", chunks.temporal_pattern(F.col("x")).alias("p")).collect()
    assert [r.p for r in got] == [pattern(r.x) for r in got]


def test_score_fold(spark):
    rows = [("a", 1, s, c, 5, (0, i), f"r{i}", None) for i, (s, c) in enumerate([("high", "x"), ("critical", "y"), ("medium", "z"), ("high", "x")])]
    df = spark.createDataFrame(rows, "src_ip string, batch int, severity string, category string, match_count long, first_match struct<phase: int, row_number: long>, rule_name string, first_seen timestamp_ntz")
    got = state.scores(df, "batch").first()
    assert got.categories == ["y", "x", "z"] and abs(got.threat_score - (0.3 + 0.2 + 0.2 + 0.1 * 1.5)) < 1e-9


@pytest.mark.parametrize(("change", "rule", "holds"), [
    ({"auth_failures": 50}, "low_slow_brute_force", True), ({"auth_failures": 49}, "low_slow_brute_force", False), ({"unique_uris": 200, "batches": 2}, "distributed_recon", True), ({"unique_uris": 200, "batches": 1}, "distributed_recon", False),
    ({"categories": ["a", "b", "c"]}, "multi_vector_attacker", True), ({"categories": ["a", "b"]}, "multi_vector_attacker", False), ({"categories": ["recon_scanner", "rfi"]}, "kill_chain_progression", True),
    ({"agents": ["SQLMap/1"], "batches": 3}, "scanner_persistence", True), ({"agents": ["SQLMap/1"], "batches": 2}, "scanner_persistence", False), ({"rates": [9, 30, 1, 60]}, "rate_acceleration", True), ({"rates": [30, 1, 50]}, "rate_acceleration", False),
])
def test_correlations(spark, change, rule, holds):
    row = {"src_ip": "a", "batches": 1, "requests": 10, "auth_failures": 0, "auth_successes": 0, "unique_uris": 0, "rates": [1], "agents": [], "categories": [], "timeline": [], "threat_score": 0.0} | change
    kind = "src_ip string, batches long, requests long, auth_failures long, auth_successes long, unique_uris long, rates array<long>, agents array<string>, categories array<string>, timeline array<struct<at: timestamp_ntz>>, threat_score double"
    found = {r.correlation_rule for r in state.correlations(spark.createDataFrame([tuple(row.values())], kind)).collect()}
    assert (rule in found) == holds


def test_incidents_and_networks(spark, sf):
    threats = catalog._threats(spark, sf)
    made = incidents.from_threats(threats)
    assert made.count() == threats.where("confidence >= 0.7").count() == made.select("incident_id").distinct().count()
    assert [r.priority for r in incidents.listed(made, limit=3).collect()] == ["critical"] * 3
    nets = spark.createDataFrame([(1, 16777216, 33554431, "x"), (0, 16777216, 16777471, "y")], "ord int, first bigint, last bigint, country string")
    got = incidents.locate(spark.createDataFrame([("1.0.0.9",), ("1.2.0.0",), ("10.0.0.1",), ("-",)], "ip string"), nets).collect()
    assert {r.ip: r.country for r in got} == {"1.0.0.9": "y", "1.2.0.0": "x", "10.0.0.1": None, "-": None}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp;src;dst;dport;action;rule\n2024-01-02 03:04:05;1.2.3.4;10.0.0.1;22;drop;r1\n2024-01-02 03:04:06;-;10.0.0.1;443.9;permit;r2\n")
    got = normalize.normalize(files.parse(spark, str(tmp_path / "a.csv"))).orderBy("row_number").collect()
    assert [(r.src_ip, r.dst_port, r.action, r.is_internal_dst) for r in got] == [("1.2.3.4", 22, "DENY", True), ("-", 443, "ALLOW", True)] and str(got[0].event_ts) == "2024-01-02 03:04:05"
    line = '<134>Jan 5 10:00:00 web httpd[12]: 10.1.1.1 9.9.9.9 443 shop.example - - [05/Jan/2024:10:00:00 +0530] "GET /a?x=1 HTTP/1.1" 404 120 33 "-" "curl/8"'
    (tmp_path / "b.csv").write_text(line + "\n<1>broken httpd[1]: line\n")
    got = normalize.normalize(files.parse(spark, str(tmp_path / "b.csv"), "dst_first")).orderBy("row_number").collect()
    assert (got[0].src_ip, got[0].dst_ip, got[0].http_status, got[0].uri_path, got[0].uri_query, str(got[0].event_ts), got[0].user_agent) == ("9.9.9.9", "10.1.1.1", 404, "/a", "x=1", "2024-01-05 04:30:00", "curl/8")
    assert got[1].src_ip == "-" and "broken" in got[1].original_message
    assert files.detect(["timestamp", "src", "dst", "action", "rule"], [])[0] == "firewall" and files.detect(["logevent"], [{"logevent": line}])[0] == "syslog_apache" and files.detect(["x"], [])[0] == "generic"
    assert files.delimiter(["a|b|c"]) == "|" and files.encoding(b"\xff\xfea\x00") == "UTF-16LE" and files.catalogue(spark, str(tmp_path), "*.csv").count() == 2


def test_stream_equals_batch(spark, sf, tmp_path):
    from threatlake.plans.adapter import adapt

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    watch.watch(spark, str(tmp_path / "in"), events.schema, watch.store_matches(str(tmp_path / "out"), adapt), str(tmp_path / "checkpoint")).awaitTermination()
    key = ["row_number", "rule_name", "evidence"]
    got = spark.read.parquet(str(tmp_path / "out")).where("phase = 0").select(*key).collect()
    assert sorted(got) == sorted(detect.all_matches(adapt(events)).where("phase = 0").select(*key).collect()) and got


@pytest.mark.parametrize("name", ["rule_matches_cve_exploit", "rate_rules", "chunks_multi_index", "actor_totals", "geo_range_join", "technique_context", "page_hosts", "dedup_by_hash"])
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("events", "pages", "documents", "orders"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    mine, other = catalog.queries()[name](spark, sf), c.sql(catalog.oracle_sql()[name])
    assert sorted(mine.columns) == sorted(other.columns)
    rows = lambda xs, names: sorted(repr([str(x[names.index(n)]) for n in sorted(names)]) for x in xs)
    assert rows(mine.collect(), mine.columns) == rows(other.fetchall(), other.columns)
