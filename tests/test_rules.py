import re

import pytest
from pyspark.sql import functions as F

from threatlake.functions import net, text
from threatlake.operators import rules

COLUMNS = "row_number long, event_id string, event_ts timestamp_ntz, src_ip string, uri_path string, uri_query string, original_message string, user_agent string, referrer string, http_method string, http_status int, username string, bytes_sent long, response_size long"


def event(i, path="/", query=None, message=None, agent=None, referrer=None, method="GET", status=200, ip="8.8.8.8", user=None, size=None):
    return (i, str(i), None, ip, path, query, message, agent, referrer, method, status, user, size, None)


def test_counts():
    assert (len(rules.RULES), len(rules.CODED), len(rules.RATES), sum(len(r.patterns) for r in rules.RULES)) == (41, 6, 10, 163)
    assert len({r.category for r in rules.EVERY.values()}) == 37


def test_signatures_equal_python(spark):
    probes = ["/a?x=' or 1=1", "UNION ALL SELECT", "<script>", "{{7*7}}", "${jndi:ldap://x", "../../etc/passwd", "a&b=1&c=2&b=3", "?b=1&b=2", "/api/v1/users/12/", "/.git/HEAD", "Googlebot/2.1", "Googlebot 2.1", "sqlmap", "É" + "<SCRIPT a>", "select sleep(5)", "/wp-admin", "%{x#_memberAccess", "() { x; };", "/cgi-bin/a.pl", "su root", "x=php://input", "", "plain", "O:4:\"", "/backup.zip", "/old~", "cmd=sudo x", "page = http://a"]
    df = spark.createDataFrame([event(i, p, p, p, p, p) for i, p in enumerate(probes)], COLUMNS)
    got = {(r.row_number, r.rule_name): r.matched_field for r in rules.matches(df).collect()}
    for i, p in enumerate(probes):
        for r in rules.RULES:
            hit = bool(p) and any(re.search(x, p, re.I) for x in r.patterns)
            assert got.get((i, r.name)) == (r.fields[0] if hit else None), (p, r.name)


def test_gates_and_predicates(spark):
    rows = [
        event(1, "/x", "q=<script>", status=404), event(2, "/x", "q=<script>", status=None), event(3, "/admin/x", status=200), event(4, "/admin/x", status=300), event(5, status=500, size=5001), event(6, status=500, size=5000),
        event(7, "/export/a", size=100001), event(8, "/export/a", size=100000), event(9, "/go", "next=https%3A%2F%2Fevil.example%2Fx"), event(10, "/go", "next=http://127.0.0.1/x"), event(11, "/go", "next=//evil.example"),
        event(12, method="POST", referrer="https://evil.example/a"), event(13, method="POST", referrer="https://a.corp.example/a"), event(14, "/x", "token=1", method="POST", referrer="https://evil.example/a"), event(15, "/go", "next=http://10.1.1.1/"),
    ]
    got = {(r.row_number, r.rule_name) for r in rules.matches(spark.createDataFrame(rows, COLUMNS)).collect()}
    for rule, yes, no in (("xss", [2], [1]), ("broken_function_auth", [3], [4]), ("error_detail_disclosure", [5], [6]), ("data_exfiltration_pattern", [7], [8]), ("open_redirect", [9, 11], [10, 15]), ("csrf_indicator", [12], [13, 14])):
        assert all((i, rule) in got for i in yes) and not any((i, rule) in got for i in no), rule


@pytest.mark.parametrize(("n", "rule", "make"), [
    (10, "brute_force_login", lambda i: event(i, status=401)), (20, "credential_stuffing", lambda i: event(i, status=401)), (8, "authentication_failures", lambda i: event(i, "/login", status=403)),
    (50, "rapid_404_generation", lambda i: event(i, f"/p{i}", status=404)), (200, "content_scraping", lambda i: event(i, f"/p{i}")), (500, "http_flood", lambda i: event(i)),
    (100, "slowloris_suspected", lambda i: event(i, f"/p{i}", status=302)), (300, "api_rate_abuse", lambda i: event(i, "/api/x")), (30, "resource_exhaustion", lambda i: event(i, "/search/a")),
])
def test_rate_thresholds(spark, n, rule, make):
    for k, want in ((n, 1), (n - 1, 0)):
        found = [r for r in rules.rate_matches(spark.createDataFrame([make(i) for i in range(k)], COLUMNS)).collect() if r.rule_name == rule]
        assert len(found) == want and all(r.row_number == k - 1 for r in found)


def test_addresses_and_text(spark):
    ips = [("10.0.0.1", True, False), ("8.8.8.8", False, True), ("100.64.0.1", False, False), ("203.0.113.5", True, False), ("-", False, False), ("192.0.0.9", False, True), ("224.0.0.1", False, True), ("010.0.0.1", False, False)]
    rows = spark.createDataFrame([(a,) for a, _, _ in ips], "ip string").select("ip", net.is_private(F.col("ip")), net.is_global(F.col("ip"))).collect()
    assert [tuple(r) for r in rows] == ips
    raw = {" 1.2.3.4 ": "1.2.3.4", "::ffff:1.2.3.4": "1.2.3.4", "-": None, "host 9.8.7.6:80": "9.8.7.6", "300.1.1.1": None, "2001:DB8::1": "2001:db8::1"}
    got = spark.createDataFrame([(k,) for k in raw], "ip string").select("ip", net.normalize_ip(F.col("ip"))).collect()
    assert dict(map(tuple, got)) == raw
    urls = {"/a/b?x=1#f": ("/a/b", "x=1"), "http://h/p?q": ("/p", "q"), "a=b": (None, "a=b"), "/{<^>}?a b": ("/{<^>}", "a b")}
    got = spark.createDataFrame([(k,) for k in urls], "u string").select("u", text.uri_path(F.col("u")), text.uri_query(F.col("u"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == urls
    got = spark.createDataFrame([("a%20b+c%zz",)], "u string").select(text.unquote(F.col("u")), text.host(F.lit("https://u:p@A.b:8/x")), text.percent(F.lit(0.125))).first()
    assert tuple(got) == ("a b+c%zz", "a.b", "12%")


def test_tokens_and_redirects_behind_literals(spark):
    """Literals spare the expressions on ASCII text only; what they find is what the expressions alone find."""
    none = "eyJhbGciOiJub25lIn0.eyJzdWIiOiJhIn0.x"
    probes = [f"token={none}", f"é {none}", none.upper(), "eyj", "GET token=eyJab.cd.ef", "next=https://evil.example/a", "é&NEXT = https://evil.example/a", "a=1&redirect=//evil.example", "ſ&dest=//evil.example", "urls=//evil.example", "goto//x"]
    df = spark.createDataFrame([event(i, "/x", p) for i, p in enumerate(probes)], COLUMNS)
    got = {(r.row_number, r.rule_name) for r in rules.matches(df).collect()}
    jwt, redirect = re.compile(rules.JWT, re.I), re.compile(rules.REDIRECTS, re.I)
    for i, p in enumerate(probes):
        assert ((i, "jwt_manipulation") in got) == bool(jwt.search(p)), p
        found = redirect.search(p)
        assert ((i, "open_redirect") in got) == bool(found and found[1].startswith(("//", "https://evil"))), p


def test_rules_are_evaluated_once_and_rows_dealt(spark):
    from threatlake.plans import adapter

    # without the outer form Spark puts a filter on the array of hits below the generator
    plan = rules.matches(spark.createDataFrame([event(1)], COLUMNS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("prototype_pollution") <= 2 and "Filter (size(" not in plan
    one = spark.range(1000).coalesce(1)
    parts = [len(p) for p in adapter.dealt(one, 50).rdd.glom().collect()]
    assert len(parts) == 20 and max(parts) <= 60 and sum(parts) == 1000


def test_frequent_requests_are_tested_once(spark):
    long = "/x?q=<script>" + "y" * rules.LENGTH
    texts = [("/item", "id=1 UNION SELECT 1", None), ("/item", None, "id=1 UNION SELECT 1"), ("/x", "q=<script>", "eyJa.b."), ("/go", "next=https://evil.example/x", ""), (None, None, None), ("/é", "q=<SCRIPT>", ""), (long, "", ""), ("/admin/x", "", "")]
    rows = [event(100 * k + i, p, q, m, method="POST" if i % 2 else "GET", referrer="https://evil.example/a", status=[200, 404, None, 500][i // 2 % 4], size=200000 if i % 3 else None) for k, (p, q, m) in enumerate(texts) for i in range(8 * rules.REPEATED)]
    rows += [event(5000 + i, f"/only/{i}", "q=<script>") for i in range(20)]
    df = spark.createDataFrame(rows, COLUMNS)
    got, want = ([tuple(r) for r in rules.matches(df, repeated=repeated).collect()] for repeated in (True, False))
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 1000
    ready = df.withColumn("_not_refused", F.col("http_status").isNull() | F.col("http_status").between(200, 399))
    often = rules.frequent(ready, F.array_compact(F.array(*map(rules.signature, rules.RULES)))).collect()
    assert len(often) == (len(texts) - 1) * 4 and all(r.uri_path is None or len(r.uri_path) < 20 and "/only/" not in r.uri_path for r in often)
