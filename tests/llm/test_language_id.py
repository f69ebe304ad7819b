import numpy as np

from threatlake.llm import language_id as L


def test_tables_equal_the_network():
    r = np.random.default_rng(0)
    n = L.Network(["x", "y"])
    x = r.integers(0, 256, (70, L.WINDOW)).astype(np.uint8)
    assert np.allclose(n.forward(x)[2], n.log_probabilities(x, *n.tables()), atol=1e-4)


def test_gradient():
    r = np.random.default_rng(1)
    n = L.Network(["x", "y", "z"])
    x, y = r.integers(0, 256, (5, 20)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    g = n.gradient(x, y)
    loss = lambda: -n.forward(x)[2][np.arange(5), y].mean()
    for k in n.p:
        at = tuple(r.integers(0, s) for s in n.p[k].shape) if k != "embed" else (int(x[0, 3]), 2)
        n.p[k][at] += 1e-6
        up = loss()
        n.p[k][at] -= 2e-6
        assert abs((up - loss()) / 2e-6 - g[k][at]) < 1e-4
        n.p[k][at] += 1e-6


def test_held_out(spark, sf):
    rows = L.op10_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", None), (4, "the and of " * 5000, "en"), (4, "der und die", "de"), (None, "der die das und", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'c' as score", "1 as lang_pred")
    got = sorted((str(r.doc_id), r.lang_pred) for r in L.languages(df, L.fit(df)).collect())
    assert got[:3] == [("1", "und"), ("2", "und"), ("3", "und")] and all(x in ("en", "de") for _, x in got[3:])
    none = L.fit(df.where("false"))
    assert {r.lang_pred for r in L.languages(df, none).collect()} == {"und"} and L.languages(df.where("false"), none).count() == 0


def test_numbers_are_no_letters(spark):
    texts = ["²", "12 ½", "Ⅷ ①", "_ 5 ٣", "ª", "日", "ﬁ"]
    n = L.Network(["en", "de"])
    assert [x == "und" for x, _ in n.predict(texts, n.tables())] == [True, True, True, True, False, False, False]
