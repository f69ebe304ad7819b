from collections import Counter
from math import prod

import public_tokenizers
import pytest

from threatlake.llm import piece_sampling as S

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("text", ["", " ", "a", "  two  spaces ", "▁ mark▁▁", "line\n\nend \r\n\tx", "日本語😀 é\x00", "the then thereof " * 300, "x" * 5000, "<s> <0x41> </s>"])
def test_lossless(text):
    s = S.sampler(PATH, 1.0)
    for seed in range(5):
        ids = s.encode(text, seed)
        assert s.decode(ids) == text and ids == s.encode(text, seed)


def test_shares():
    """Each segmentation of a word is drawn as often as its weight says."""
    s, word = S.sampler(PATH, 1.0), "there"

    def all_of(t):
        return [[]] if not t else [[s.weight[t[:k]], *x] for k in range(1, len(t) + 1) if t[:k] in s.weight for x in all_of(t[k:])]

    weights = {tuple(p[0] for p in x): prod(p[1] for p in x) for x in all_of(word)}
    total, n = sum(weights.values()), 20_000
    seen = Counter(tuple(s.encode(word, i)) for i in range(n))
    assert set(seen) <= set(weights) and len(weights) > 5
    for k, w in weights.items():
        assert abs(seen[k] / n - w / total) < 0.015


def test_operator(spark, sf):
    rows = [(1, "some words of text"), (2, None), (3, ""), (3, "again"), (3, "again"), (None, "no key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids")
    one, other = (sorted((str(r.doc_id), r.ids) for r in S.sample_pieces(d, PATH).collect()) for d in (df, df.repartition(4)))
    assert one == other
    back = S.decode_pieces(S.sample_pieces(df, PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert S.sample_pieces(df.where("false"), PATH).count() == 0
    got = S.op9_sentencepiece(spark, sf).collect()
    assert len(got) == 200 and all(r.lossless for r in got)
