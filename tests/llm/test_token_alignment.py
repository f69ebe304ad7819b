import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pyarrow as pa
import pytest

from threatlake.llm import token_alignment as T

FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PARTS = ["a", "th", "e", "ing", " ", " ", "  ", "\n", " \n", "\t", "é", "日本", "😀", "▁", "<s>", "<|endoftext|>", "'s", "12", "3", "..", " ", "　", "\x1c", " ", "\r\n", "é", "Ⅷ", "\x00", "﻿", "A", "$$"]


@pytest.fixture(scope="module")
def tokens():
    return T.Tokens(*FILES)


def by_definition(tokens, text):
    """Ids, groups and links of a text encoded as a whole."""
    a, b = (tokens.a.encode(" " + text, add_special_tokens=False).ids, tokens.b.encode(text)) if text else ([], [])
    pieces = [[tokens.a_bytes[i] for i in a], [tokens.b_bytes[i] for i in b]]
    if not text or any(b"".join(p) != (" " + text).encode() for p in pieces):
        return [], [], [], [], 0
    ends = []
    for p in pieces:
        ends.append([])
        for x in p:
            ends[-1].append(len(x) + (ends[-1][-1] if ends[-1] else 0))
    groups, links, start = [], [], 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        mine = [[i for i, e in zip(ids, at, strict=True) if start < e <= cut] for ids, at in zip((a, b), ends, strict=True)]
        groups.append("|".join(",".join(map(str, m)) for m in mine))
        links.append((mine[0][-1], mine[1][-1]))
        start = cut
    overlaps = sum(1 for e, x in zip(ends[0], pieces[0], strict=True) for f, y in zip(ends[1], pieces[1], strict=True) if e - len(x) < f and f - len(y) < e)
    return a, b, groups, links, overlaps


def rows_by_definition(tokens, texts):
    found = [by_definition(tokens, t) for t in texts]
    count = Counter(x for f in found for x in f[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (len(a), len(b), len(g), len(k), o, sum(count[x] == best[x[1]] for x in k), sum(count[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for a, b, g, k, o in found
    ]


def test_chunks_are_encoded_as_in_the_whole_text(tokens):
    r = random.Random(3)
    texts = ["", " ", "  ", "a ", " a", "a\n b", *("".join(r.choice(PARTS) for _ in range(r.randint(1, 14))) for _ in range(1500))]
    want = rows_by_definition(tokens, texts)
    x = T.Aligner(tokens)
    got = [c.to_pylist() for c in x.documents(pa.array(texts, pa.string()))]
    assert [(g[:5], g[7]) for g in zip(*got, strict=True)] == [(w[:5], w[7]) for w in want]


def test_bound_of_pairs(tokens):
    assert tokens.most_pairs() == 324_302
    assert all(x for x in tokens.a_bytes) and all(x for x in tokens.b_bytes)


def test_operator(spark, tokens, monkeypatch):
    monkeypatch.setattr(T, "TOGETHER", 40)
    monkeypatch.setattr(T, "KEPT", 60)
    texts = ["the thing in the other thing", "the thing in the other thing", None, "", "x▁y", "<|endoftext|> </s> Straße", "unalignable ﬁ 日本語 text", "supercalifragilistic expialidocious", "  double  spaces \n and lines ", "the"]
    rows = [(k, t, 7, "z") for k, t in enumerate(texts)] + [(None, "the end", 7, "z"), (3, "the end", 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, groups_sha256 string").repartition(3)
    out = T.alignments(docs, T.pair_counts(docs, FILES), FILES).collect()
    want = rows_by_definition(tokens, [r[1] for r in rows])
    assert sorted(map(repr, map(tuple, out))) == sorted(repr((r[0], *w)) for r, w in zip(rows, want, strict=True))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert T.alignments(none, T.pair_counts(none, FILES), FILES).count() == 0


def test_very_long_texts(spark, tokens):
    texts = ["many words in one text " * 30_000, "x1" * 60_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in T.alignments(docs, T.pair_counts(docs, FILES), FILES).collect()}
    for k, t in enumerate(texts):
        a, b = tokens.a.encode(" " + t, add_special_tokens=False).ids, tokens.b.encode(t)
        assert (out[k].n_a, out[k].n_b) == (len(a), len(b)) and out[k].n_links == out[k].n_groups > 1000


def test_query(spark, sf, tokens):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[x] for x in (*T.SUMS, "groups_sha256")) for r in T.op12_token_alignment(spark, sf).collect()}
    quick = lambda t: len(t or "") < 4000  # noqa: E731  the definition's overlaps are quadratic
    count = Counter(x for d in docs for x in links_only(tokens, d.text))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    for d in docs:
        links = links_only(tokens, d.text)
        assert got[d.doc_id][5:7] == (sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links))
        if quick(d.text):
            a, b, g, k, o = by_definition(tokens, d.text)
            assert got[d.doc_id][:5] == (len(a), len(b), len(g), len(k), o) and got[d.doc_id][7] == (hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")


def links_only(tokens, text):
    if not text:
        return []
    at = []
    for ids, size in ((tokens.a.encode(" " + text, add_special_tokens=False).ids, tokens.a_size), (tokens.b.encode(text), tokens.b_size)):
        at.append(dict(zip(size[ids].cumsum().tolist(), ids, strict=True)))
    return [(i, at[1][e]) for e, i in at[0].items() if e in at[1]]
