"""Operator 7: personal data by patterns and by bootstrapped contexts.

The base finds e-mail addresses, IP addresses, payment cards and phone numbers by their form. These, and long hexadecimal
keys, are the seeds of a bootstrap (keys are no base spans; as spans they need a pattern like any other token): the words
beside them are contexts, and contexts of at least `SEEDS` different seeds become patterns. All
texts are read, once for each slice of `PATTERNS` patterns, for how often each pattern's words occur, and which identifier-like tokens without a base span stand in
a pattern. On this graph of patterns and instances Spark iterates: a pattern is as good as the share of its occurrences
that hold good instances, an instance is as good as its patterns together. Tokens in patterns of at least `CONFIDENCE`
become spans of the kind `other`; base spans are never changed. Candidates are tokens of 5 to 80 characters with an ASCII
digit; words of more than 40 characters are no contexts.

Null texts count as empty. Rows with equal ids and texts have equal results; an empty table gives an empty one; columns
other than the key and the text are ignored. Scanning is linear in the length of a text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.llm.common import read, table

KINDS = ("email", "ip", "card", "phone")
#: Seeds that a context needs, patterns that are broadcast at once (more take more scans), rounds, and the confidence that discovers.
SEEDS, PATTERNS, ROUNDS, CONFIDENCE = 5, 1 << 16, 3, 0.6
LONGEST = 40

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_ip = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").finditer
_card = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
#: A long key of digits and small letters up to f.
KEY = r"(?<![0-9A-Za-z])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,80}(?![0-9A-Za-z])"
_keys = re.compile(KEY).finditer
_digits = re.compile(r"[0-9]+").finditer


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind and start."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:  # every match holds exactly one "@", with the local part that runs up to it
        start = at
        while start > end and text[start - 1] in _local:
            start -= 1
        m = _domain(text, at) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for m in _ip(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _card(text):
        if m.end() - m.start() >= 13:
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _phone(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns that a span stands in: the word before, the two before, the word after; only whole words of at most LONGEST.

    What adjoins the span without a space, such as quotes, belongs to it here.
    """
    x, y = start, end
    while x and x > start - LONGEST and not text[x - 1].isspace():
        x -= 1
    while y < len(text) and y < end + LONGEST and not text[y].isspace():
        y += 1
    if (x and not text[x - 1].isspace()) or (y < len(text) and not text[y].isspace()):
        return []
    start, end = x, y
    x, y = max(0, start - 2 * LONGEST - 2), end + LONGEST + 1
    left, right = text[x:start].lower().split(), text[end:y].lower().split()
    if left and x and not text[x - 1].isspace() and not text[x].isspace():
        left = left[1:]  # cut by the window
    if len(right) == 1 and y < len(text) and not text[y - 1].isspace() and not text[y].isspace():
        right = []
    left, right = left[-2:], right[:1]
    if left and len(left[-1]) > LONGEST:
        left = []
    out = [f"L {left[-1]}"] if left else []
    if len(left) == 2 and len(left[0]) <= LONGEST:
        out.append(f"LL {left[0]} {left[1]}")
    return out + [f"R {w}" for w in right if len(w) <= LONGEST]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, h, text): rows are told apart by id and text."""
    return docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text")).select("id", F.xxhash64("id", "text").alias("h"), "text")


def _base(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, shas, spans, seeds = [], [], [], []
            for t in b.column(2).to_pylist():
                found = base_spans(t)
                counts.append(Counter(k for k, _, _ in found))
                spans.append(joined(found))
                shas.append(hashlib.sha256(spans[-1].encode()).hexdigest())
                seeds.append([{"pattern": p, "instance": t[x:y].lower()} for x, y in [*((x, y) for _, x, y in found), *(m.span() for m in _keys(t))] for p in contexts(t, x, y)])
            n = [pa.array([c[k] for c in counts], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *n, pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(seeds, pa.list_(pa.struct([("pattern", pa.string()), ("instance", pa.string())])))], names)

    names = ["id", "h", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "seeds"]
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, h long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, base string, seeds array<struct<pattern: string, instance: string>>")


def _patterns(seeds: DataFrame) -> Iterator[list[str]]:
    """All contexts of enough different seeds, in slices of about PATTERNS."""
    support = table(seeds.distinct().groupBy("pattern").count().where(F.col("count") >= SEEDS), "support")
    slices = -(-support.count() // PATTERNS)
    for k in range(slices):
        found = [r["pattern"] for r in support.where(F.pmod(F.xxhash64("pattern"), F.lit(slices)) == k).select("pattern").toLocalIterator()]
        if found:
            yield found


def _scan(rows: DataFrame, patterns: list[str]) -> DataFrame:
    """Rows with n: how often a task saw a pattern's words; rows with an id: identifier-like tokens in a pattern."""
    shared = rows.sparkSession.sparkContext.broadcast(patterns)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(shared.value)
        one = {p.split(" ", 1)[1] for p in known if not p.startswith("LL ")}
        two = {tuple(p.split(" ")[1:]) for p in known if p.startswith("LL ")}
        last = {w for _, w in two}
        seen: Counter = Counter()
        pairs: Counter = Counter()
        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            ids, hs, found = [], [], []
            for i, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = t.lower().split()
                seen.update(filter(one.__contains__, words))
                if two:
                    pairs.update((x, y) for x, y in zip(words, words[1:], strict=False) if y in last and (x, y) in two)
                spans, end = None, -1
                for m in _digits(t):
                    if m.start() < end:
                        continue
                    x, end = m.start(), m.end()
                    while x and not t[x - 1].isspace():
                        x -= 1
                    while end < len(t) and not t[end].isspace():
                        end += 1
                    y = end
                    while x < y and not t[x].isalnum():
                        x += 1
                    while y > x and not t[y - 1].isalnum():
                        y -= 1
                    if not 5 <= y - x <= 2 * LONGEST:
                        continue
                    inside = [p for p in contexts(t, x, y) if p in known]
                    if inside:
                        spans = base_spans(t) if spans is None else spans
                        if not any(a < y and x < e for _, a, e in spans):
                            for p in inside:
                                ids.append(i)
                                hs.append(h)
                                found.append((p, t[x:y].lower(), x, y))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(hs, pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)), pa.array([None] * len(found), pa.int64())], names)
        totals = [(p, seen[p.split(" ", 1)[1]] if not p.startswith("LL ") else pairs[tuple(p.split(" ")[1:])]) for p in shared.value]
        totals = [(p, n) for p, n in totals if n]
        if totals and id_type is not None:
            none = lambda k: pa.nulls(len(totals), k)
            yield pa.RecordBatch.from_arrays([none(id_type), none(pa.int64()), pa.array([p for p, _ in totals]), none(pa.string()), none(pa.int32()), none(pa.int32()), pa.array([n for _, n in totals], pa.int64())], names)

    names = ["id", "h", "pattern", "instance", "start", "end", "n"]
    return rows.mapInArrow(run, f"id {kind}, h long, pattern string, instance string, start int, end int, n long")


def _confident(seeds: DataFrame, scan: DataFrame) -> DataFrame:
    """(pattern, score) after the rounds of scoring patterns and instances by each other."""
    totals = scan.where("n is not null").groupBy("pattern").agg(F.sum("n").alias("total"))
    patterns = table(totals.join(seeds.groupBy("pattern").agg(F.count("*").alias("seeds")), "pattern"), "patterns")
    # keys count as seeds already
    edges = table(scan.where(F.col("n").isNull() & ~F.col("instance").rlike(KEY)).groupBy("pattern", "instance").agg(F.count("*").alias("times")), "edges")
    score = patterns.select("pattern", (F.col("seeds") / (F.greatest("total", "seeds") + 2)).alias("score"))
    for _ in range(ROUNDS):
        instances = edges.join(score, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("good"))
        gains = edges.join(instances, "instance").groupBy("pattern").agg(F.sum(F.col("times") * F.col("good")).alias("gain"))
        all_good = F.col("seeds") + F.coalesce("gain", F.lit(0.0))
        score = table(patterns.join(gains, "pattern", "left").select("pattern", (all_good / (F.greatest(F.col("total"), all_good) + 2)).alias("score")), "score")
    return score.where(F.col("score") >= CONFIDENCE)


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, n_<kind>, n_other, base_sha256, spans) of every row; h tells texts of equal ids apart."""
    rows = _keyed(docs, key, text)
    base = table(_base(rows), "base")
    seeds = base.select(F.inline("seeds"))
    scan = None
    for patterns in _patterns(seeds):
        part = table(_scan(rows, patterns), "scan")
        scan = part if scan is None else scan.union(part)
    out = base.drop("seeds")
    if scan is not None:
        more = scan.where("n is null").join(_confident(seeds, scan), "pattern").select("id", "h", "start", "end").distinct()
        more = more.groupBy("id", "h").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda x: F.concat(F.lit("other:"), x["start"], F.lit(":"), x["end"])), ",").alias("more"))
        more = more.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "more", F.size(F.split("more", ",")).cast("long").alias("n_other"))
        out = out.join(more, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").drop("_id", "_h")
        out = out.withColumn("spans", F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "more"))
    else:
        out = out.withColumns({"spans": F.col("base"), "n_other": F.lit(0).cast("long")})
    return out.select(F.col("id").alias(key), "h", *(f"n_{k}" for k in KINDS), F.coalesce("n_other", F.lit(0).cast("long")).alias("n_other"), "base_sha256", "spans")


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, with `[KIND]` for every span of personal data in the text; of overlapping spans the whole range goes as the first."""
    spans = personal_data(docs, key, text).where("spans != ''").select(F.col(key).alias("_id"), F.col("h").alias("_h"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_h"])
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for t, found in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                parts, end = [], 0
                for x, y, k in sorted((int(x), int(y), k) for k, x, y in (s.split(":") for s in (found or "").split(",") if s)):
                    if x >= end:
                        parts += [t[end:x], f"[{k.upper()}]"]
                    end = max(end, y)
                new.append("".join([*parts, t[end:]]) if parts else t)
            columns = b.columns[: len(names)]
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    h = F.xxhash64(F.col(key), F.coalesce(text, F.lit("")))
    both = docs.withColumn("_h2", h).join(spans, (F.col("_h2") == F.col("_h")) & F.col(key).eqNullSafe(F.col("_id")), "left").select(*names, "_spans")
    return both.mapInArrow(run, docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data, with the number of all its spans."""
    found = personal_data(read(spark, sf_dir, "documents")).drop("h")
    return found.withColumn("n_spans", sum((F.col(f"n_{k}") for k in (*KINDS, "other")), F.lit(0).cast("long")))
