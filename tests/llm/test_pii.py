import hashlib
import random
import re

from threatlake.llm import pii as P

RE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def contract(t):
    out = []
    for k, r in RE.items():
        for m in re.finditer(r, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and P.luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if ok:
                out.append((k, *m.span()))
    return out


def test_base_equals_the_expressions():
    r = random.Random(5)
    for _ in range(20_000):
        t = "".join(r.choice(["a", "b", "1", "2", "0", ".", "@", "-", " ", "+", "(", ")", "é", "_", "\n", "4111111111111111", "1.2.3.4", "x@y.z", "300", "@@", "٣"]) for _ in range(r.randint(0, 24)))
        assert P.base_spans(t) == contract(t), t
    long = "1" * 200_000 + "." + "a" * 200_000 + "@" + "9." * 100_000
    assert P.base_spans(long)[0][0] == "email"


def test_contexts_are_whole_words():
    assert P.contexts("one Two 1.2.3.4 three four", 8, 15) == ["L two", "LL one two", "R three"]
    long = "w" * 41
    assert P.contexts(f"one {long} 1.2.3.4 {long}", 46, 53) == [] and P.contexts(f"{long} two 1.2.3.4 x", 46, 53) == ["L two", "R x"]
    assert P.contexts("1.2.3.4", 0, 7) == [] and P.contexts("a" * 500 + " bb 1.2.3.4 " + "c" * 500, 504, 511) == ["L bb"]
    assert P.contexts("a" * 40 + " " + "b" * 40 + " 1.2.3.4 " + "c" * 40, 82, 89) == ["L " + "b" * 40, "LL " + "a" * 40 + " " + "b" * 40, "R " + "c" * 40]


def test_bootstrap_discovers(spark):
    r = random.Random(6)
    rows = [(i, f"Some words here, member-login: u{r.random()}@mail.org and then more words about the {i} weather") for i in range(40)]
    rows += [(100 + i, f"member-login: QX{i}-77{i}Z and the weather") for i in range(8)] + [(200, "the number is QQ12-8888 today"), (201, None), (201, None), (None, "a@b.c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as h", "'x' as spans")
    got = {}
    for x in P.personal_data(df).collect():
        got.setdefault(x.doc_id, []).append(x)
    for i, t in rows:
        t = t or ""
        x = got[i][0]
        base = contract(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert x.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and x.n_email == sum(k == "email" for k, _, _ in base)
        m = re.search(r"QX\S+", t)
        assert x.spans == (f"other:{m.start()}:{m.end()}" if m else text)
    assert len(got[201]) == 2
    new = {x.doc_id: x.text for x in P.masked(df).collect()}
    assert new[103] == "member-login: [OTHER] and the weather" and new[None] == "[EMAIL]" and new[201] is None and new[200] == rows[48][1]
    assert P.personal_data(df.where("false")).count() == 0 and P.masked(df.where("false")).columns == df.columns


def test_keys_need_a_pattern(spark):
    """Keys are found where a context holds mostly keys, and left alone elsewhere."""
    r = random.Random(7)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'Some text {i} about it. token = "{key()}" and so on') for i in range(30)] + [(100 + i, f"the sum of{i} was {key()} here{i}") for i in range(3)] + [(200, "token of thanks 12345")]
    got = {x.doc_id: x for x in P.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows[:30]:
        at = t.index('"') + 1
        assert got[i].spans == f"other:{at}:{at + 40}" and got[i].n_other == 1 and got[i].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(got[i].n_other == 0 and got[i].spans == "" for i in (100, 101, 102, 200))


def test_query(spark, sf):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = P.op7_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for x in got:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in contract(texts[x.doc_id]))
        assert x.spans.startswith(base) and x.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_more_patterns_than_a_slice(spark, monkeypatch):
    rows = [(100 * k + i, f"the {i} key{k}: u{k}x{i}@mail.org") for k in range(12) for i in range(30)] + [(5000 + k, f"one key{k}: QX{k}-77Z") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda: {(x.doc_id, x.spans) for x in P.personal_data(df).collect()}
    whole = found()
    assert sum("other" in s for _, s in whole) == 12
    monkeypatch.setattr(P, "PATTERNS", 3)
    assert found() == whole
