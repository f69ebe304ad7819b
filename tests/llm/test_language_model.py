import math
import random
import re
from collections import Counter

import numpy as np

from threatlake.llm import language_model as L


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def corpus(n, seed=1):
    r = random.Random(seed)
    words = [[f"{k}{i}" for i in range(60)] for k in "ab"]
    return [(i, " ".join(r.choice(words[i % 2]) if r.random() < 0.95 else f"x{r.random()}" for _ in range(r.randint(0, 60)))) for i in range(n)]


def test_base_and_model(spark):
    rows = [*corpus(3600), (10000, None), (10000, None), (10001, ""), (None, "A0 never-seen"), (10002, "Ünï\x1ccode a1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1L as n", "'x' as token", "2 as score")
    train = docs.where("doc_id < 900 or doc_id >= 1100 and doc_id < 9999")
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in L.score(docs, train).collect())
    c = Counter(t for i, x in rows if i is not None and (i < 900 or 1100 <= i < 9999) for t in tokens(x))
    n = sum(c.values())
    want = sorted((str(i), len(t := tokens(x)), sum(w in c for w in t), n, sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in t)) for i, x in rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want])
    held = [(g[4], g[5]) for g in got if g[0] != "None" and 900 <= int(g[0]) < 1100]
    assert sum(m for _, m in held) > sum(b for b, _ in held) + 100  # the history tells which half of the words comes next


def test_probabilities_add_up():
    r = np.random.default_rng(0)
    vocabulary = [f"w{i}".encode() for i in range(3000)]
    m = L.Model(r.normal(size=L._AT[-1]).astype(np.float32), vocabulary)
    h = np.array([L.START] * 3 + [5, 2500, -1])
    total = 0.0
    for ids in (np.arange(m.modelled), np.array([m.modelled])):  # every modelled word, then the tail's share
        flat = np.concatenate([np.append(h, i) for i in ids])
        total += np.exp(m.log_probabilities(flat, np.arange(len(ids)) * 7 + 6)).sum()
    assert abs(total - 1) < 1e-4


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.score(docs, docs).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert L.score(one, docs).first()[1:] == (3, 0, 0, 0.0, 0.0)


def test_modelled_words_and_third_word_back():
    r = np.random.default_rng(1)
    m = L.Model(r.normal(size=L._AT[-1]).astype(np.float32), [f"w{i}".encode() for i in range(3000)])
    assert m.modelled == 31 * 64
    p = [m.log_probabilities(np.array([third, 5, 7, 1500]), np.array([3]))[0] for third in (L.START, 1, 2)]
    assert len(set(p)) == 3  # word 1,500 depends on the history, also on the word three back
