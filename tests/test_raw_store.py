import datetime
import hashlib

import pytest

from threatlake.sources import files
from threatlake.sources.raw_store import FileTable, RawStore, StoreConflict

KIND = "file_id string, name string, content binary, uploaded_at timestamp"
T1, T2 = datetime.datetime(2024, 3, 1, 23, 59), datetime.datetime(2024, 3, 2)


def test_put_again_conflict_and_verify(spark, tmp_path):
    s = RawStore(spark, str(tmp_path))
    frame = lambda *rows: spark.createDataFrame(rows, KIND)
    assert s.listed().count() == 0 and s.stats().first().files == 0
    a, b = ("a", "bad name/ü.csv", b"one", T1), ("b", "b.csv", b"", T2)
    got = {r.file_id: r for r in s.put(frame(a, b, b)).collect()}
    assert got["a"].name == "bad_name__.csv" and got["a"].sha256 == hashlib.sha256(b"one").hexdigest() and got["b"].bytes == 0
    s.put(frame(a))  # the same content changes nothing
    assert s.listed().count() == 2 and s.stats().first().bytes == 3
    with pytest.raises(StoreConflict, match="a_bad_name__.csv"):
        s.put(frame(("a", "bad name/ü.csv", b"two", T1), ("c", "c.csv", b"three", T1)))
    assert s.listed().count() == 2  # nothing of that call
    with pytest.raises(StoreConflict):
        s.put(frame(("d", "d", b"1", T1), ("d", "d", b"2", T1)))
    assert [r.file_id for r in s.listed("2024-03-01").collect()] == ["a"]
    assert bytes(s.content(["a"]).first().content) == b"one"
    want = spark.createDataFrame([("a", hashlib.sha256(b"one").hexdigest()), ("b", "0" * 64), ("x", "0" * 64)], "file_id string, sha256 string")
    assert {r.file_id: r.intact for r in s.verify(want).collect()} == {"a": True, "b": False, "x": False}


def test_one_day_reads_one_folder_and_no_content(spark, tmp_path):
    s = RawStore(spark, str(tmp_path))
    s.put(spark.createDataFrame([("a", "a", b"one", T1), ("b", "b", b"two", T2)], KIND))
    plan = s.listed("2024-03-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "content" not in plan.split("ReadSchema")[1]


def test_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a.csv", "b.csv", "c.txt"):
        (tmp_path / "in" / n).write_bytes(n.encode() * 3)
    s = RawStore(spark, str(tmp_path / "store"))
    assert sorted(r.name for r in s.put_folder(str(tmp_path / "in"), "*.csv").collect()) == ["a.csv", "b.csv"]
    s.put_folder(str(tmp_path / "in"), "*.csv")
    assert s.listed().count() == 2


def test_file_table(spark, tmp_path):
    t = FileTable(spark, str(tmp_path))
    assert t.listed().count() == 0
    rows = [(f"f{k}", f"{k}.csv", datetime.datetime(2024, 1, 1 + k)) for k in range(3)]
    t.upsert(spark.createDataFrame(rows, "file_id string, filename string, uploaded_at timestamp"))
    assert [(r.file_id, r.status) for r in t.listed().collect()] == [("f2", "uploaded"), ("f1", "uploaded"), ("f0", "uploaded")]
    t.set_status("f1", "failed")
    t.set_status("nobody", "failed")
    counts = "file_id string, processed_at timestamp, events_created long, chunks_created long, suspicious_chunks long, ai_analyses long, incidents_created long"
    t.processed(spark.createDataFrame([("f0", T1, 10, 4, 2, 1, 0), ("nobody", T1, 1, 1, 1, 1, 1)], counts))
    by = {r.file_id: r for r in t.rows().collect()}
    assert set(by) == {"f0", "f1", "f2"} and (by["f1"].status, by["f1"].filename) == ("failed", "1.csv")
    assert (by["f0"].status, by["f0"].events_created, by["f0"].processed_at, by["f0"].uploaded_at) == ("processed", 10, T1, datetime.datetime(2024, 1, 1))
    assert [r.file_id for r in t.listed("processed").collect()] == ["f0"] and t.listed(limit=1).first().file_id == "f2"
    steps = [("f2", "validating", 1, None), ("f2", "failed", 3, "web"), ("f2", "parsing", 2, "cli"), ("f2", None, 4, None)]
    t.upsert(spark.createDataFrame(steps, "file_id string, status string, step int, source string"), order="step")
    assert [(r.status, r.source) for r in t.rows().where("file_id = 'f2'").collect()] == [("failed", "web")]
    t.upsert(spark.createDataFrame([], "file_id string, status string"))
    assert t.rows().count() == 3 and len(t._versions()) == 2


def test_encoding_by_the_whole_content(spark, tmp_path):
    lines = ["name,port"] + [f"host{k},{k}" for k in range(300)] + ["köln,1"]
    for charset, name in (("latin-1", "ISO-8859-1"), ("utf-8", "UTF-8"), ("utf-8-sig", "UTF-8")):
        path = tmp_path / f"{charset}.csv"
        path.write_bytes("\n".join(lines).encode(charset))
        assert files.encoding_of(spark, str(path)) == name == files.encoding(path.read_bytes())
        assert files.read_rows(spark, str(path))[1].where("name = 'köln'").count() == 1
    (tmp_path / "empty.csv").write_bytes(b"")
    assert files.encoding_of(spark, str(tmp_path / "empty.csv")) == "UTF-8"
