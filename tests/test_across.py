import random

import pytest

from threatlake.operators import lookups, rollups, strides

EVENT = "src_ip string, dst_ip string, t_us long, action string, bytes_sent long, window_start string"
MIN = 60_000_000


@pytest.mark.parametrize("minutes,overlap", [(15, 5), (15, 0), (15, 10), (7, 3)])
def test_overlapping_windows_by_copies(spark, minutes, overlap):
    r = random.Random(minutes)
    rows = [(f"10.0.0.{k % 3}", f"t{r.randint(0, 5)}", r.randint(-40 * MIN, 60 * MIN), r.choice(["DENY", "ALLOW", None]), r.choice([None, 5, 7]), "x") for k in range(200)]
    rows += [("10.0.0.0", "", 0, "DENY", 1, "x"), ("10.0.0.0", None, (minutes - overlap) * MIN, "DENY", 1, "x"), ("", "t", 0, "DENY", 1, "x"), (None, "t", 0, "DENY", 1, "x"), ("10.0.0.1", "t", None, "DENY", 1, "x")]
    want: dict = {}
    for ip, to, t, action, sent, _ in rows:
        if not ip or t is None:
            continue
        stride = (minutes - overlap) * MIN
        for k in range(-200, 200):
            if k * stride <= t < k * stride + minutes * MIN:
                w = want.setdefault((ip, k * stride), [0, 0, 0, set()])
                w[0] += 1
                w[1] += action == "DENY"
                w[2] += sent or 0
                w[3].update([to] if to else [])
    got = strides.overlapping(spark.createDataFrame(rows, EVENT), minutes, overlap).collect()
    assert {(g.entity, g.window_start): [g.events, g.denied, g.bytes_sent, g.targets] for g in got} == {k: [*v[:3], len(v[3])] for k, v in want.items()}
    with pytest.raises(ValueError):
        strides.overlapping(spark.createDataFrame(rows, EVENT), 5, 5)
    assert strides.overlapping(spark.createDataFrame([], EVENT)).count() == 0


def test_sketches_merged_over_hours_and_days(spark):
    n = 40_000
    df = spark.range(n).selectExpr("id % 3 as k", "concat('v', id % 9000) as v", "timestamp_micros(1704067200000000 + id * 6000000) as event_ts")
    parts = strides.sketched(df, ["k"], "v")
    assert parts.count() > 3 * 24  # one an hour
    by_key = {r.k: r.estimate for r in strides.merged(parts, ["k"]).collect()}
    assert all(abs(v - 3000) <= 0.05 * 3000 for v in by_key.values()) and len(by_key) == 3
    assert abs(strides.merged(parts, []).first().estimate - 9000) <= 0.05 * 9000
    again = strides.merged(parts.union(parts), ["k"]).collect()
    assert all(abs(r.estimate - 3000) <= 0.05 * 3000 for r in again)  # repeated parts count once
    assert strides.sketched(spark.createDataFrame([("a", None, None)], "k string, v string, event_ts timestamp"), ["k"], "v").count() == 0


def test_cache_by_age(spark):
    h = 3_600_000_000
    r = random.Random(5)
    stored = [("a", "m", t := r.randint(0, 90 * h), k) for k in range(60)] + [("b", "m", 5 * h, 100), ("b", "m", 5 * h, 101), (None, "m", 0, 102), ("c", "m", 0, 103)]
    asked = [(k, r.choice(["a", "b", "d"]), r.choice(["m", "m", "n"]), r.randint(0, 120 * h), None) for k in range(300)]
    asked += [(400, "c", "m", 24 * h, None), (401, "c", "m", 24 * h - 1, None), (402, "b", "m", 5 * h, None), (403, None, "m", 5, None), (404, "c", "n", 1, None), (405, "c", "m", None, None)]
    asked += [asked[0]] * 2
    want = []
    for i, c, m, t, _ in asked:
        hits = [(x[2], x[3]) for x in stored if None not in (c, t) and x[:2] == (c, m) and x[2] <= t and t - x[2] < 24 * h]
        want.append((i, max(hits)[1] if hits else None, max(hits)[0] if hits else None))
    q = spark.createDataFrame(asked, "i int, content string, model string, at long, note string")
    e = spark.createDataFrame(stored, "content string, model string, at long, entry_id long")
    got = lookups.newest(q, e, ["content", "model"]).select("i", "entry_id", "entry_at").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert all(r.entry_id is None for r in lookups.newest(q, e.limit(0), ["content", "model"]).collect())


def test_content_key_ignores_volatile_columns(spark):
    df = spark.createDataFrame([(1, "x", "a", "2024"), (2, "x", "a", "2025"), (3, "x", None, "2024")], "chunk_id int, b string, a string, created_at string")
    a, b, c = (r[0] for r in df.select(lookups.content_key(df.columns)).collect())
    assert a == b != c and df.select("created_at", "a", "b").select(lookups.content_key(["b", "a"])).first()[0] == a


def test_contained_equals_brute_force(spark):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abé日") for _ in range(n))
    needles = [word(r.randint(0, 6)) for _ in range(120)] + [None, "", "a", "%", "_b", "aaaa"]
    texts = [word(r.randint(0, 14)) for _ in range(60)] + [None, "", "100%_b", "aaaaa"]
    got = lookups.contained(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sorted(r.needle for r in got.collect()) == sorted({n for n in needles if n and any(t and n in t for t in texts)})
    assert lookups.contained(spark.createDataFrame([], "needle string"), spark.createDataFrame([("a",)], "text string")).count() == 0


def test_reports_of_files(spark):
    files = [("ID1", "one.log", "uploaded"), ("id2 ", "two.csv", "uploaded"), ("id3", "Three.Part.csv", "x"), ("id4", "four.log", " PROCESSED"), ("id5", "five.log", None), (None, None, None), ("id6", ".csv", "x")]
    reports = [("id1", None, None), (None, "about ID2", None), (None, "THREE.PART summary", None), (None, None, "/r/id5.md"), ("", "", "")]
    out = lookups.has_report(spark.createDataFrame(files, "file_id string, filename string, status string"), spark.createDataFrame(reports, "file_id string, report_name string, report_path string"))
    assert {r.file_id: r.ready for r in out.collect()} == {"ID1": True, "id2 ": True, "id3": True, "id4": True, "id5": True, None: False, "id6": False}


def test_rollup_over_files(spark):
    kind = "strategy string, entity string, file_id string, window_start long, window_end long, events long, denied long, targets int, ports array<int>, pattern string"
    day = rollups.DAY
    rows = [("src_ip", "a", f"f{k}", k * day, k * day + 5, 10, 9, 12, [22, 80], "steady") for k in range(4)] + [("src_ip", "a", "f0", 7, 9, 10, 9, 3, [22], "steady"), ("src_ip", "b", "f0", 1, 2, 5, 0, 1, [443], "bursty"), ("user", "u", "f9", 0, 1, 1, 1, 1, [22], "steady")]
    c = spark.createDataFrame(rows, kind)
    a = {r.actor: r for r in rollups.actors(c).collect()}
    assert (a["a"].files_count, a["a"].chunks, a["a"].active_days, a["a"].total_events, a["a"].unique_targets) == (4, 5, 4, 50, 12)
    assert a["a"].risk_score == pytest.approx(36 + 12 + 5 + 16) and not a["a"].high_risk
    assert a["a"].risk_factors == ["90% of events denied", "12 targets in a window", "active on 4 days", "seen in 4 files"] and a["b"].risk_factors == []
    p = {(r.pattern, r.port): (r.files, r.actors, r.chunks, r.denied, r.first_file, r.last_file) for r in rollups.cross_file_patterns(c).collect()}
    assert p == {("steady", 22): (4, 1, 5, 45, "f0", "f3"), ("steady", 80): (4, 1, 4, 36, "f0", "f3")}
