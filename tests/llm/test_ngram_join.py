import random
import re

import pytest

from threatlake.llm import ngram_join as J


def brute(rows, words=5, percent=80):
    """The contract by comparing all pairs."""
    def shingle_set(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = {i: shingle_set(t) for i, t in rows}
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def texts(seed, n=150):
    """Copies, near copies of every distance, shared passages, short and empty texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    bases = [[r.choice(vocabulary) for _ in range(r.randint(20, 120))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(r.choice(bases[: 3 if i % 3 else 12]))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4, 6])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        if i % 11 == 0:
            w = w[:10] + passage
        out.append((i, " ".join(w)))
    return [*out, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a B"), (n + 4, "A b"), (n + 5, "one two three four five"), (n + 6, "a b c\x1cd É")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as rep", "2 as component_id")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()}
    assert got == brute(rows)


def test_edges(spark):
    kind = "doc_id long, text string"
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (9, None)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.jaccard_components(spark.createDataFrame(rows, kind)).collect())
    assert got == [("1", 2, "1"), ("1", 2, "1"), ("7", 2, "1"), ("9", 0, "9"), ("None", 2, "1")]
    assert J.jaccard_components(spark.createDataFrame([], kind)).count() == 0


def components(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.jaccard_components(df, **more).collect())


def test_equal_ids_of_different_texts(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (1, "a b c d e f")]
    assert components(spark, rows) == [("1", 2, "1"), ("1", 2, "1"), ("1", 2, "1"), ("2", 2, "1")]


def test_tie_at_the_threshold(spark):
    """8 of 10 shingles shared is linked, 7 of 10 is not."""
    w = [f"w{i}" for i in range(14)]
    nine, eight = " ".join(w[:13]), " ".join([*w[:12], "x"])  # 9 shingles each, 8 shared of 10
    other = " ".join([*w[:11], "y", "z"])  # 7 shared of 11
    assert components(spark, [(5, nine), (6, eight), (7, other)]) == [("5", 9, "5"), ("6", 9, "5"), ("7", 9, "7")]


def test_long_text_and_common_shingle(spark):
    """A very long text, and a shingle that all documents of many clusters share."""
    r = random.Random(4)
    passage = "one two three four five"
    rows = [(0, " ".join(f"w{r.randrange(5000)}" for _ in range(60_000)))]
    for c in range(40):
        base = [f"c{c}x{k}" for k in range(30 + c)]
        for k in range(5):
            v = list(base)
            if k:
                v[-k] = f"v{k}"
            rows.append((1 + 5 * c + k, f"{passage} " + " ".join(v)))
    got = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows[1:])
    assert got.pop(0) == 0 and got == {i: c for i, (_, c) in want.items()}


def cut_copies(n, seed=5):
    """Near copies of a text that isn't there itself: each lacks other passages, so all share many shingles and few pairs link."""
    r = random.Random(seed)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(3):
            at = r.randrange(len(w) - 10)
            w[at : at + r.randint(2, 8)] = [f"v{r.randrange(40)}"] if i % 2 else []
        rows.append((i, " ".join(w)))
    return rows


def test_pairs_of_cut_copies(spark, monkeypatch):
    """A group of which few pairs link makes rows for those that may, not for the product of its members."""
    made, bounds = [], J.bounds

    def counted(pairs, sizes):
        made.append(pairs.count())
        return bounds(pairs, sizes)

    monkeypatch.setattr(J, "bounds", counted)
    monkeypatch.setattr(J, "MEMBERS", 50, raising=False)
    rows = cut_copies(300)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert sum(made) < 10 * len(rows)
