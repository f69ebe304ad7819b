import public_tokenizers
import pytest

from threatlake.llm import token_counts as T

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "a", "  two  spaces ", "line\n\nend \n x", "Erge ente ieein enlichachkeit, die chenkeitü.", "<s>a<unk></s>▁b ▁",
    "日本語テキスト😀🇫🇷 mixé", "\t\ttabs\r\n", "thththththththeeeeee" * 3, "\x00\x01 x", "https://a.b/c?d=e&f=1234567 (x) [y]", "    " * 9 + "deep",
]


@pytest.mark.parametrize("text", TEXTS)
def test_every_prefix(text):
    import itertools

    c = T.counter(PATH)
    got = [x - 256 if x > 127 else x for x in c.prefix_steps(text)]
    assert list(itertools.accumulate(got)) == [len(c.sp.encode(text[:i])) for i in range(1, len(text) + 1)]


def test_operator(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (3, ""), (None, "x")]
    out = T.prefix_token_counts(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens"), PATH)
    sp = T.counter(PATH).sp
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out.collect()) == sorted((str(i), len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows)
    keep = {r.doc_id: r.keep_chars for r in T.fits_budget(out, 1).collect()}
    assert keep[1] == max(i for i in range(12) if len(sp.encode("hello world"[:i])) <= 1) and keep[2] == 0
    assert T.prefix_token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query(spark, sf):
    sp = T.counter(PATH).sp
    got = {r.doc_id: r for r in T.op1_token_counts(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens) == (len(r.text.encode()), len(sp.encode(r.text)))


def test_heads_and_endings_share_work():
    c, plain = T.PrefixCounter(PATH), T.PrefixCounter(PATH)
    words = ["▁intern", "▁international", "▁interne", "▁inter", "▁int", "日本語テキスト", "▁日本語テ", "日本語テ", "▁😀😀😀😀😀x", "▁😀😀😀😀y"]
    for w in words:  # the later ones begin from states that were kept
        plain.heads.clear()
        assert c.steps(w) == plain.steps(w)
    kept = {k: [x[:] for x in v] for k, v in c.heads.items()}
    assert "▁inte" in kept and all(len(k) == T.HEAD for k in kept)
    [c.steps(w) for w in reversed(words)]
    assert {k: [*v] for k, v in c.heads.items()} == kept
    assert sum(len({*v}) for v in c.ends.values()) < len(c.pieces) and {p for p in c.pieces if len(p) in c.ends[p[-3:]]} == c.pieces
