import hashlib
import random

from threatlake.llm import fingerprints as P


def phrases(t):
    """LZ78 by its definition."""
    known, out, at = {""}, set(), 0
    while at < len(t):
        n = 1
        while t[at : at + n] in known and at + n <= len(t):
            if at + n == len(t):
                return out
            n += 1
        known.add(t[at : at + n])
        out.add(t[at : at + n])
        at += n
    return out


def test_parse():
    r = random.Random(1)
    for _ in range(50):
        t = "".join(r.choice("abé😀 ") for _ in range(r.randint(0, 400)))
        p = P.Parse().extend(t)
        assert len(p.hashes) - 1 == len(phrases(t)) == len(set(p.hashes)) - 1
        cut = r.randint(0, len(t))
        q = P.Parse().extend(t[:cut])
        assert q.copy().extend(t[cut:]).hashes == p.hashes
    assert P.fingerprint(None) == P.fingerprint("") and len(P.fingerprint("abc")) == 4 * P.SLOTS


def test_likeness_follows_phrases():
    r = random.Random(2)
    word = lambda: "".join(r.choice("etaoins") for _ in range(r.randint(2, 7)))
    words = [word() for _ in range(300)]
    text = lambda: " ".join(r.choice(words) for _ in range(400))
    for _ in range(10):
        a, b = text(), text()
        c = a[:1000] + b[:800]
        for x, y in ((a, b), (a, c), (a, a)):
            px, py = phrases(x), phrases(y)
            got = P.likeness(P.Parse().extend(x).signature(), P.Parse().extend(y).signature())
            assert abs(got - len(px & py) / len(px | py)) < 0.25


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, u = t or "", u or ""
        e = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        f, g, h = P.fingerprint(t), P.fingerprint(e), P.fingerprint(u)
        same = lambda a, b: sum(a[k : k + 4] == b[k : k + 4] for k in range(0, len(a), 4)) / P.SLOTS
        out.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, same(f, g), same(f, h)))
    return sorted(out)


def test_query(spark, sf):
    r = random.Random(3)
    rows = [(i * 7, "".join(r.choice("ab é") for _ in range(r.randint(0, 60)))) for i in range(200)] + [(7, "zz"), (7, None), (None, "last"), (5000, "x" * 3000)]
    for some in (rows, rows[:1], rows[:2], []):
        df = spark.createDataFrame(some, "doc_id long, text string").selectExpr("*", "1 as part", "'y' as head").repartition(3)
        got = sorted((str(x[0]), *x[1:]) for x in P.edited_fingerprints(df).collect())
        assert got == (expected(some) if some else [])
    assert P.op6_document_fingerprints(spark, sf).count() == 200
