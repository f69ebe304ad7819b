import random

import pytest

from threatlake.operators import chunks


def windowed(rows):
    """(key, time) to window start, one entity after the other."""
    out = {}
    for key in {k for k, _, _ in rows}:
        width = next(w for k, _, w in rows if k == key)
        start = None
        for t in sorted({t for k, t, _ in rows if k == key}):
            if start is None or t > start + width:
                start = t
            out[key, t] = start
    return out


@pytest.mark.parametrize("long", [100_000, 3])
@pytest.mark.parametrize("spread", [40, 400, 6000])
def test_equals_one_after_the_other(spark, monkeypatch, long, spread):
    """Dense, mixed and sparse times; times below zero, ties, equal distances; with `long` 3 nearly all by pointers."""
    monkeypatch.setattr(chunks, "LONG", long)
    monkeypatch.setattr(chunks, "PART", 4)
    r = random.Random(spread)
    rows = [(f"e{k % 4}", r.randint(-spread, spread), 10 + k % 4) for k in range(300)]
    rows += [("even", 5 * k, 10) for k in range(60)] + [("even", 5 * k, 10) for k in range(0, 60, 7)]  # a time at start + width is in
    rows += [("one", 7, 10), ("two", 7, 10), ("two", 18, 10)]
    df = spark.createDataFrame([(i, k, t, w, "x") for i, (k, t, w) in enumerate(rows)], "i int, k string, t long, w long, width string")
    got = {r.i: r.window_start for r in chunks.anchored_windows(df, ["k"], "t", "w").collect()}
    want = windowed(rows)
    assert got == {i: want[k, t] for i, (k, t, _) in enumerate(rows)}


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1, 5), ("a", None, 5), ("a", 3, 5)], "k string, t long, w long")
    assert [tuple(r) for r in chunks.anchored_windows(df, ["k"], "t", "w").collect()] == [("a", 3, 5, 3)]
    assert chunks.anchored_windows(df.limit(0), ["k"], "t", "w").count() == 0
