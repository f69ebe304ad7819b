import numpy as np

from threatlake.llm import near_vectors as N


def brute(ids, x, least=0.9):
    ok = np.array([v is not None and len(v) > 0 and all(y is not None and np.isfinite(y) for y in v) and any(v) for v in x])
    n, links, comp = len(x), [0] * len(x), list(range(len(x)))
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(x[i]) == len(x[j]):
                a, b = np.array(x[i], float), np.array(x[j], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                    links[i] += 1
                    p, q = sorted((comp[i], comp[j]))
                    comp = [p if c == q else c for c in comp]
    return [(i, k, ids[c]) for i, k, c in zip(ids, links, comp, strict=True)]


def data(n=1500, dim=24, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    x[n // 2 :] = x[r.integers(0, n // 8, n - n // 2)] + r.normal(scale=0.18, size=(n - n // 2, dim))
    x[10:20] = x[9] * np.arange(1, 11)[:, None]
    return x.astype(np.float32).tolist()


def test_recall_and_precision(spark):
    x = data()
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, m int")
    got = {r.vec_id: r for r in N.near_vectors(df).collect()}
    want = brute(list(range(len(x))), x) if len(x) <= 200 else None
    u = np.array(x, float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    true = near.sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert want is None and (found <= true).all() and found.sum() >= 0.97 * true.sum() > 1000


def test_edges(spark):
    x = [[1.0, 0.0], [2.0, 0.0], [2.0, 0.0], None, [], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, None], [1.0], [1.0, 0.45], [0.6, 0.8], [1e30, 1e29]]
    ids = list(range(100, 100 + len(x)))
    df = spark.createDataFrame(list(zip(ids, x, strict=True)), "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in N.near_vectors(df).collect()) == brute(ids, x)
    assert N.near_vectors(df.where("false")).count() == 0
    out = N.op4_embedding_near_dedup(spark, "/root/testdata/sf0.001")
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"] and out.count() == 500


def test_tight_group_is_not_copied(spark, monkeypatch):
    r = np.random.default_rng(8)
    centre = r.normal(size=24)
    x = np.concatenate([centre / np.linalg.norm(centre) + r.normal(scale=0.1 / np.sqrt(24), size=(900, 24)), r.normal(size=(300, 24))])
    written, write = [], N.table
    monkeypatch.setattr(N, "table", lambda df, name: (out := write(df, name), written.append((name, out.count())))[0])
    monkeypatch.setattr(N, "ROWS", 200)
    monkeypatch.setattr(N, "CUT", 150)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {y.vec_id: (y.n_links, y.component_id) for y in N.near_vectors(df).collect()}
    assert max(n for name, n in written if name == "placed") == len(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert true[:900].min() > 800 and all(got[i] == (true[i], 0) for i in range(900)) and all(got[i][0] <= true[i] for i in range(900, 1200))


def test_rounds_and_shuffled_descent(spark, monkeypatch):
    """Several rounds with small leaves, and trees too large to broadcast."""
    x, u = data(), np.array(data(), float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    true = (u @ u.T >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>").repartition(3)
    for spread in (N.SPREAD, 0):
        monkeypatch.setattr(N, "LEAF", 16)
        monkeypatch.setattr(N, "LEVELS", 2)
        monkeypatch.setattr(N, "SPREAD", spread)
        got = {r.vec_id: r.n_links for r in N.near_vectors(df).collect()}
        found = np.array([got[i] for i in range(len(x))])
        assert (found <= true).all() and found.sum() >= 0.9 * true.sum()


def test_equal_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (None, [1.0, 0.0]), (3, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rep", "'x' as leaves")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in N.near_vectors(df).collect())
    assert got == [("1", 1, "1"), ("1", 1, "1"), ("2", 1, "1"), ("3", 1, "1"), ("None", 0, "None")]


def test_tie_at_the_threshold(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.5, 0.5]), (4, [0.59, -0.81])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in N.near_vectors(df, least=0.6).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 0}
