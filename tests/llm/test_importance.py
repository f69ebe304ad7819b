import hashlib
import math
import re
import zlib

from threatlake.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
SCHEMA = "doc_id long, text string, weight string, buckets int"


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def brute(docs, target, percent, least):
    def features(text):
        w = WORD(lowered(text or ""))
        return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, (x for _, x in docs)), (t, target)):
        for x in texts:
            for f in features(x):
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + 10000.0) / ((a + 1.0) * (sum(t) + 10000.0)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(WORD(lowered(text or "")))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def found(spark, docs, target, percent=30, least=3):
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    to = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.resample(rows, to, percent, least).select("doc_id", "n_features", "weight", "score", "rank").collect()
    return sorted((tuple(r) for r in out), key=repr)


def test_equals_brute_force(spark):
    docs = [(k, " ".join(f"w{(k * j) % 11}{'É' if j % 3 else 'X'}" for j in range(k % 9))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "  .,; \t"), (103, "ÄÉİ Ⅷ ² ñandú ABC abc"), (104, "a-b_c\x7fd\x00e 1st"), (None, "one two three four"), (None, None)]
    docs += [(105, "the same text again")] * 7 + [(106, "İSTANBUL ΑΣ Σ ǅ 漢字 é́ A")]
    assert found(spark, docs, ["w1x w2x", "the same", None, "", "漢字 é"]) == brute(docs, ["w1x w2x", "the same", None, "", "漢字 é"], 30, 3)


def test_empty_tables(spark):
    assert found(spark, [], ["a"]) == []
    docs = [(k, f"alpha beta gamma {k}") for k in range(10)]
    assert found(spark, docs, []) == brute(docs, [], 30, 3)


def test_very_long_text(spark):
    docs = [(1, "Lorem ipsum dolor " * 60_000), (2, "x" * 500_000), (3, "a b c d")]
    assert found(spark, docs, ["lorem ipsum"]) == brute(docs, ["lorem ipsum"], 30, 3)


def test_all_rows_equal_are_ranked_once_each(spark):
    rows = spark.createDataFrame([(7, "one two three")] * 400, "doc_id long, text string").repartition(8)
    out = importance.resample(rows, rows.select("text").limit(1), 50, 3).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 201)) and len(out) == 400


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5000).selectExpr("id", "id % 17 as score")
    rows = rows.selectExpr("id", "cast(30 as long) as n_words", "cast(1 as long) as n_features", "score as weight", "score")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = importance.drawn(rows, 10, 20).where("rank is not null").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = sorted(((-(k % 17), k) for k in range(5000)))[:500]
    assert [(r["id"]) for r in sorted(out, key=lambda r: r["rank"])] == [k for _, k in want]
    assert sorted(r["rank"] for r in out) == list(range(1, 501))
