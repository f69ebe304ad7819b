import duckdb
import pytest

from threatlake.operators import outputs
from threatlake.plans import analyses

SCHEMA = """analysis_id string, chunk_id string, file_id string, created_at long, src_ip string, window_start long, window_end long, hosts array<string>,
  behavioral struct<interpretation: string, is_suspicious: boolean, confidence: double, key_indicators: array<string>>, intent struct<suspected_intent: string, kill_chain_stage: string, confidence: double>,
  mitre struct<technique_id: string, technique_name: string, tactic: string, confidence: double>, triage struct<priority: string, risk_reason: string, recommended_action: string, executive_summary: string, confidence: double>"""
NAMES = ["analysis_id", "chunk_id", "file_id", "created_at", "src_ip", "window_start", "window_end", "hosts", "behavioral", "intent", "mitre", "triage"]


def rows(spark, *given):
    return spark.createDataFrame([tuple(g.get(n) for n in NAMES) for g in given], SCHEMA)


def test_confidence_and_priority(spark):
    got = outputs.from_outputs(rows(
        spark, {"analysis_id": "a", "src_ip": "1.1.1.1", "behavioral": ("odd " * 40, True, 0.9, None), "mitre": ("T1", "Scan", "Recon", 0.8)}, {"analysis_id": "b", "behavioral": ("calm", False, 0.65, []), "intent": ("", None, None)},
        {"analysis_id": "c", "triage": ("CRITICAL", "r", "act", "s", 0.1)}, {"analysis_id": "d", "triage": ("odd", None, None, None, None)}, {"analysis_id": "e"},
    )).orderBy("analysis_id").collect()
    assert [(round(r.confidence, 3), r.priority, r.suspicious, r.score) for r in got] == [(0.85, "high", True, 8), (0.65, "medium", False, 6), (0.1, "critical", True, 1), (0.0, "medium", True, 1), (0.0, "low", True, 1)]
    assert got[0].title == ("odd " * 40)[:50] + " from 1.1.1.1" and got[0].attack == "Scan" and len(got[0].brief) == 160 and got[0].description.endswith("MITRE mapping: Scan (T1)")
    assert got[1].title == "Behavioral anomaly detected from Unknown actor" and got[1].attack == got[1].title and got[2].description == "Risk: r" and got[4].action == "Investigate and validate findings."


def test_file_summary(spark):
    many = [{"analysis_id": f"a{i:02}", "file_id": "f", "created_at": 1, "behavioral": (f"said {i:02}" + "x" * 300, i % 2 == 0, 0.5, [f"k{i:02}", f"k{i:02}", None, "fourth"]), "intent": (f"intent {i % 7}", f"stage {i % 2}", 0.5), "mitre": ("T", "n", "tactic", 0.5), "triage": ("low", "", f"act {i}", "" if i else "first", 0.5)} for i in range(20)]
    f, g = outputs.file_summary(rows(spark, *many, {"analysis_id": "z", "file_id": "g"})).orderBy("file_id").collect()
    assert (f.chunks, f.avg_confidence, f.behavioral, f.suspicious, f.stages, f.tactics, f.priorities) == (20, 0.5, 20, 10, ["stage 0", "stage 1"], ["tactic"], ["low"])
    assert f.key_indicators == [f"k{i:02}" for i in range(10)] and f.intents == [f"intent {i}" for i in range(5)] and len(f.actions) == 5 and len(f.techniques) == 10
    assert [x[:7] for x in f.interpretations] == ["said 00", "said 01", "said 02"] and {len(x) for x in f.interpretations} == {200} and f.summaries == ["first"]
    assert (g.chunks, g.avg_confidence, g.behavioral, g.key_indicators, g.techniques) == (1, 0.0, 0, [], [])
    assert outputs.file_summary(rows(spark).limit(0)).count() == 0


def test_merged(spark):
    given = [{"analysis_id": str(i), "chunk_id": str(i), "file_id": f"f{i % 3}", "src_ip": "a", "window_start": 9 - i // 2, "window_end": 20 + i, "hosts": [f"h{i:02}", "", None, "h00"], "triage": (p, "", f"act {i}", "", 0.5)} for i, p in enumerate(["low", "critical", "informational", "high"])]
    given += [{"analysis_id": "x", "src_ip": "b", "window_start": 1, "window_end": 2, "mitre": ("T1", "n", "Recon", 0.4)}, {"analysis_id": "y", "src_ip": "b", "window_start": 5, "window_end": 6, "behavioral": ("url seen", True, 0.8, [])}, {"analysis_id": "n", "window_start": 1}]
    table = rows(spark, *given)
    a, b = outputs.merged(table).orderBy("src_ip").collect()
    assert (a.priority, a.activities, a.files, a.hosts, a.action, a.first_seen, a.last_seen) == ("critical", 4, 3, ["h00", "h01", "h02", "h03"], "act 2", 8, 21)
    assert (b.priority, b.technique_id, b.tactic, b.primary_tactic, b.brief, b.last_seen, b.title) == ("high", "T1", "Recon", "Recon", b.title, 6, "Multi-event incident: 2 related activities") and abs(b.confidence - 0.6) < 1e-9
    told = {(r.analysis_id, r.description) for r in outputs.members(table).where("actor = 'b'").collect()}
    assert told == {("x", "Activity detected"), ("y", "url seen")}
    assert {r.incident_id for r in outputs.members(table).collect()} == {a.incident_id, b.incident_id}


@pytest.mark.parametrize("name", list(analyses.queries()))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{sf}/events.parquet'")
    mine, other = analyses.queries()[name](spark, sf), c.sql(analyses.oracle_sql()[name])
    names = sorted(mine.columns)
    assert names == sorted(other.columns)
    assert sorted(repr([str(r[n]) for n in names]) for r in mine.collect()) == sorted(repr([str(r[other.columns.index(n)]) for n in names]) for r in other.fetchall())
