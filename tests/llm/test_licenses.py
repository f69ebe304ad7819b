import random

from threatlake.llm import licenses as L


def test_alignment():
    assert L.align([1, 2, 3, 4], [1, 2, 3, 4]) == [(i, i) for i in range(4)]
    assert L.align([1, 2, 3, 4], [9, 1, 9, 3, 2, 4]) in ([(0, 1), (1, 4), (3, 5)], [(0, 1), (2, 3), (3, 5)])
    assert L.align([], [1]) == [] == L.align([1], [])
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randint(0, 8) for _ in range(r.randint(0, 12))] for _ in range(2))
        found = L.align(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(x < u and y < v for (x, y), (u, v) in zip(found, found[1:], strict=False))


def test_scan(spark):
    mit, apache = L.TEMPLATES["MIT"], L.TEMPLATES["Apache-2.0-header"]
    noise = " ".join(f"w{i} the of" for i in range(5000))
    cut = " ".join(w for i, w in enumerate(mit.upper().split()) if i % 8)
    rows = [(1, noise + "\n * " + mit.replace(" ", "\n# ") + "\n" + noise + " " + apache + " " + mit), (2, cut), (3, None), (4, ""), (5, noise), (5, noise), (6, " ".join(mit.split()[:60])), (7, "x Licensed under CC BY-NC 4.0.\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as licenses", "2 as name")
    got = {}
    for x in L.license_scan(df).collect():
        got[x.doc_id] = {y.name: y for y in x.licenses}
    assert got[1]["MIT"].coverage == 1 and got[1]["Apache-2.0-header"].coverage == 1 and "BSD-2-Clause" not in got[1]
    assert 0.8 <= got[2]["MIT"].coverage < 0.9 and not (got[3] or got[4] or got[5]) and "MIT" not in got[6]
    assert (got[7]["CC-BY-NC-4.0"].start, got[7]["CC-BY-NC-4.0"].end) == (1, 6)
    assert L.license_scan(df.where("false")).count() == 0


def test_query(spark, sf):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    notices = {n: t for n, t in L.TEMPLATES.items() if len(t.split()) < 13}
    got = {x.doc_id: x for x in L.op5_license_scan(spark, sf).collect()}
    assert got.keys() == texts.keys() and any(x.n_licenses for x in got.values())
    for i, t in texts.items():
        assert all(n in got[i].licenses for n, x in notices.items() if f"\n{x}" in t) and (got[i].n_licenses > 0) == (got[i].licenses != "")


def test_licenses_like_others():
    s = L.Scanner(L.TEMPLATES, 0.8)
    found = lambda t: [x[0] for x in s.scan(t)]
    assert all(found(f"x {t} y") == [n] for n, t in L.TEMPLATES.items())
    assert found("Released under the BSD License.") == ["BSD-notice"] and found("Licensed under CC BY 4.0.") == ["CC-BY-4.0-notice"]
    assert found("Licensed under the Mozilla License, Version 2.0.") == [] and found("Released under the XYZ License.") == []
    assert found(L.TEMPLATES["GPL-3.0-header"].replace("version 3", "version 9")) == []
    assert found("Licensed under the Apache License 2.0") == ["Apache-2.0-notice"] and found("Released under the terms of the MIT License") == ["MIT-notice"]
    both = found(f"{L.TEMPLATES['Apache-2.0-header']} and then {'x ' * 20} {L.TEMPLATES['Apache-2.0-notice']}")
    assert sorted(both) == ["Apache-2.0-header", "Apache-2.0-notice"]
    words = L.TEMPLATES["ISC"].split()
    assert found(" ".join(f"{w} # *" for w in ["z"] * 25 + words)) == ["ISC"]
