import re

import corpus_pipeline as C
from test_ngram_join import brute

from threatlake.llm import pii


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    at, names = docs, [n for n, _ in C.STAGES]
    assert names == ["language_id", "ngram_join", "pii", "packing"]
    for name, stage in C.STAGES[:3]:
        at = stage(spark, at, sf)
        assert at.columns == docs.columns
        now = {r.doc_id: r.text for r in at.collect()}
        if name == "language_id":
            assert all(i in now for i, t in before.items() if t and any(c.isalpha() for c in t))
        if name == "ngram_join":
            assert now.keys() == {i for i, (_, c) in brute(sorted(before.items())).items() if i == c}
        if name == "pii":
            assert not any(pii.base_spans(t) for t in now.values()) and now.keys() == before.keys()
            assert all(now[i] == t for i, t in before.items() if not pii.base_spans(t) and not re.search(pii.KEY, t))
        before = now
    assert {r.doc_id for r in C.run(spark, sf).select("doc_id").distinct().collect()} == before.keys()


def test_clashing_columns_equal_ids_and_long_texts(spark):
    """Columns named as predictions keep their values; an id with two texts is two documents; a long text goes through."""
    rows = [(1, "one two three four five six seven", 0.25, "kept"), (1, "other words that are not the same at all here", 0.5, "kept"), (2, "one two three four five six seven", 1.0, "gone"), (3, "some long text of words " * 20_000, 2.0, "kept")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), x, y) for i, t, x, y in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string")
    at = docs
    for _, stage in C.STAGES[:3]:
        at = stage(spark, at, "")
        assert at.columns == docs.columns
    assert sorted((r.doc_id, r.score, r.lang_pred) for r in at.collect()) == [(1, 0.25, "kept"), (1, 0.5, "kept"), (3, 2.0, "kept")]
    packed = C.pack(spark, at, "").collect()
    assert {r.doc_id for r in packed} == {1, 3} and all(r.length <= 2048 for r in packed)


def test_edges(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    text = "one two three four five six seven"
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (None, text, None, None, None), (3, None, "en", "s", 0), (4, "12 !!", "en", None, 5), (5, "mail me a@b.org now", "en", "s", 3)]
    docs = spark.createDataFrame(rows, kind)
    for some, want in ((docs, ["1", "5", "None"]), (docs.where("false"), [])):
        at = some
        for _, stage in C.STAGES[:3]:
            at = stage(spark, at, "")
        assert sorted(str(r.doc_id) for r in at.collect()) == want
        assert sorted(str(r.doc_id) for r in C.pack(spark, at, "").collect()) == want
