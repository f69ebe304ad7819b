import datetime

import pytest
from pyspark.sql import functions as F

from threatlake.operators import day_state, detect, state
from threatlake.plans import adapter
from threatlake.sources.state_store import DayStateStore

EVENT = "row_number long, event_ts timestamp, src_ip string, uri_path string, http_status int, user_agent string, batch string"
THREAT = "day date, batch string, src_ip string, rule_name string, category string, severity string, match_count long, first_match struct<phase: int, row_number: long>, first_seen timestamp, sample_evidence array<string>"
D1, D2 = datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)


def at(day, hour):
    return datetime.datetime.combine(day, datetime.time(hour))


def replayed(events, threats, batches):
    """The store's rules, one event and threat at a time."""
    actors, count = {}, {}
    for b in batches:
        rows = [e for e in events if e[6] == b]
        for day in sorted({e[1].date() for e in rows}):
            count[day] = n = count.get(day, 0) + 1
            mine = [e for e in rows if e[1].date() == day and e[2]]
            for ip in dict.fromkeys(e[2] for e in mine):
                a = actors.setdefault((day, ip), dict(batches=0, requests=0, statuses={}, uris=0, first=None, last=None, rules=[], cats=[], timeline=[], agents=[], rates=[], score=0.0))
                own = [e for e in mine if e[2] == ip]
                a["batches"] += 1
                a["requests"] += len(own)
                a["first"] = min(x for x in (a["first"], own[0][1]) if x)
                a["last"] = max(x for x in (a["last"], own[-1][1]) if x)
                for e in own:
                    if e[4]:
                        a["statuses"][e[4]] = a["statuses"].get(e[4], 0) + 1
                    if e[5] and e[5] not in a["agents"] and len(a["agents"]) < 50:
                        a["agents"].append(e[5])
                a["uris"] += len({e[3] for e in own if e[3]})
                a["rates"].append((n, len(own)))
            found = [t for t in threats if t[1] == b and t[0] == day]
            for t in sorted(found, key=lambda t: (detect.SEVERITIES.index(t[5]), -t[6], t[7], t[3])):
                a = actors.get((day, t[2]))
                if not a:
                    continue
                if t[3] not in a["rules"]:
                    a["rules"].append(t[3])
                if t[4] not in a["cats"]:
                    a["cats"].append(t[4])
                if len(a["timeline"]) < 200:
                    a["timeline"].append((t[8], t[4], t[3], (t[9] or [""])[0][:100], n))
                a["score"] = min(1.0, a["score"] + state.INCREMENTS[t[5]] * (1.5 if len(a["cats"]) >= 3 else 1.0))
    return actors


def shown(actors):
    return {
        (r.day, r.src_ip): dict(batches=r.batches, requests=r.requests, statuses=r.statuses, uris=r.unique_uris, first=r.first_seen, last=r.last_seen, rules=r.signatures, cats=r.categories,
                                timeline=[tuple(x) for x in r.timeline], agents=r.agents, rates=[tuple(x) for x in r.rates], score=pytest.approx(r.threat_score))
        for r in actors.collect()
    }


@pytest.fixture(scope="module")
def data(spark):
    events, threats = [], []
    ips = ["1.1.1.1", "2.2.2.2", "", None]
    for k in range(600):
        day = D2 if k % 5 == 4 else D1
        events.append((k, at(day, k // 26 % 24), ips[k % 7 % 4], f"/p{k % 83}" if k % 9 else None, [200, 401, 0, 404, None][k % 5 if k % 3 else 1], f"agent {k % 61}" if k % 4 else None, f"b{k // 200}"))
    names = [(f"r{i}", f"c{i % 4}", detect.SEVERITIES[i % 5]) for i in range(9)]
    for b in range(3):
        for day in (D1, D2):
            for ip in ("1.1.1.1", "2.2.2.2", "9.9.9.9"):
                for i, (rule, cat, sev) in enumerate(names):
                    if (i + b) % (2 if ip == "1.1.1.1" else 3) == 0:
                        threats.append((day, f"b{b}", ip, rule, cat, sev, 5 + i % 2, (0, i), at(day, i), [f"said {i} " * 20] if i % 2 else None))
    e = spark.createDataFrame(events, EVENT).withColumn("day", F.to_date("event_ts"))
    return events, threats, e, spark.createDataFrame(threats, THREAT)


def part(data, b):
    _, _, e, t = data
    return day_state.parts(e.where(F.col("batch") == b), t.where(F.col("batch") == b))


def test_merged_one_by_one_equals_replay(spark, data, tmp_path):
    store = DayStateStore(spark, str(tmp_path / "s"))
    for k in range(3):
        assert store.update(f"b{k}", part(data, f"b{k}"))
    want = replayed(data[0], data[1], ["b0", "b1", "b2"])
    assert shown(store.actors()) == want
    assert shown(store.actors([D2])) == {k: v for k, v in want.items() if k[0] == D2}
    # a repeated batch changes nothing, whatever it holds now
    assert not store.update("b1", part(data, "b2"))
    assert shown(store.actors()) == want and store.commits().count() == 6
    got = {(r.day, r.number): r.events for r in store.commits().collect()}
    assert sum(got.values()) == 600 and set(got) == {(d, n) for d in (D1, D2) for n in (1, 2, 3)}


def test_broken_off_before_commit(spark, data, tmp_path):
    """A batch whose commit never came is merged once when it is written again."""
    store = DayStateStore(spark, str(tmp_path / "s"))
    store.update("b0", part(data, "b0"))
    whole = day_state.merge(store.actors(), part(data, "b1"), F.lit(2))
    whole.write.partitionBy("day").parquet(f"{store.path}/actors/batch=b1")  # what a lost driver leaves
    assert shown(store.actors()) == replayed(data[0], data[1], ["b0"])
    store.update("b1", part(data, "b1"))
    assert shown(store.actors()) == replayed(data[0], data[1], ["b0", "b1"])


def test_days_expire_and_late_rows_go_to_their_day(spark, tmp_path):
    rows = lambda *xs: spark.createDataFrame([(k, at(d, 1), "1.1.1.1", "/", 200, "a", "") for k, d in enumerate(xs)], EVENT).withColumn("day", F.to_date("event_ts"))
    none = spark.createDataFrame([], THREAT)
    days = [D1 + datetime.timedelta(k) for k in range(5)]
    store = DayStateStore(spark, str(tmp_path / "s"), days=2)
    for name, xs in (("a", days[:1]), ("b", [days[1], days[0]]), ("c", [days[2], days[1]]), ("d", [days[0], days[2]])):
        store.update(name, day_state.parts(rows(*xs), none))
    got = {r.day: (r.batches, r.requests) for r in store.actors().collect()}
    assert got == {days[1]: (2, 2), days[2]: (2, 2)}
    assert {(r.batch, r.day, r.expired) for r in store.commits().collect() if r.expired} == {("d", days[0], 1)}


def test_empty_batches(spark, tmp_path):
    store = DayStateStore(spark, str(tmp_path / "s"))
    none = spark.createDataFrame([], EVENT).withColumn("day", F.to_date("event_ts"))
    assert store.update("a", day_state.parts(none, spark.createDataFrame([], THREAT))) and not store.update("a", day_state.parts(none, spark.createDataFrame([], THREAT)))
    assert store.actors().count() == 0 and store.findings().count() == 0


def test_findings_are_new_once(spark, data, tmp_path):
    store = DayStateStore(spark, str(tmp_path / "s"))
    seen = {}
    for k in range(3):
        store.update(f"b{k}", part(data, f"b{k}"))
        for r in day_state.findings(store.actors()).collect():
            seen.setdefault((r.day, r.src_ip, r.correlation_rule), k + 1)
    got = store.findings().collect()
    assert {(r.day, r.src_ip, r.correlation_rule): r.number for r in got} == seen and len(got) == len(seen) > 0


def test_reports(spark, data, tmp_path):
    store = DayStateStore(spark, str(tmp_path / "s"))
    for k in range(3):
        store.update(f"b{k}", part(data, f"b{k}"))
    want = replayed(data[0], data[1], ["b0", "b1", "b2"])
    for r in day_state.day_reports(store.actors(), store.commits()).collect():
        mine = [a for (d, _), a in want.items() if d == r.day]
        assert (r.batches, r.sources, r.attackers, r.high_risk) == (3, len(mine), sum(bool(a["rules"]) for a in mine), sum(a["score"] >= 0.5 for a in mine))
        assert r.by_category == {c: sum(c in a["cats"] for a in mine) for c in {c for a in mine for c in a["cats"]}}
        assert sum(r.by_hour.values()) == sum(len(a["timeline"]) for a in mine)
    places = [(r.day, r.place) for r in day_state.high_risk(store.actors()).collect()]
    assert sorted(places)[0][1] == 1
