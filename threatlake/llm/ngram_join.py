"""Operator 3: exact Jaccard join of documents on word shingles, by vertical partitioning.

All shingles stand in one global order, rarest first: by a table of hashed document frequencies, of fixed size, summed
over the whole corpus, then by hash. A document's set is kept in that order, and the order is cut into fragments of
equal mass. Two sets as similar as the threshold share a shingle of both prefixes (the rarest n - ceil(t n) + 1), which
gives candidates. A sketch of each set (how many of its shingles fall in each of n/4 to n/2 buckets, a byte each) bounds
the overlap of a pair from above, so pairs that can't reach the threshold are told without their sets. The overlap of
every other candidate pair is counted within each fragment on its own, and the partial counts are summed per pair, which
gives the exact similarity.

Documents of equal sets are one class from the start. A prefix shingle that more than `SMALL` classes share doesn't
pair them all: one of them is the pivot, every other is counted against it, and those in the pivot's component need no
more. The rest are grouped again. What is still in different components after that is compared in blocks, and a pair is
only made where sizes, the places of first shared shingles, the distances to the pivot, or their bounds (|d(x) - d(y)| <=
1 - t, the triangle inequality of the Jaccard distance), and both sketches allow a link. So no link between components is
lost, and pairs of near copies that are too far apart cost a comparison of sketches, not a row.

Null texts and texts without words have an empty set and link with nothing. Texts of fewer words than a shingle have
one shingle, the whole sequence. Rows with equal ids count as documents of their own, each with the component of its own
text; rows without an id keep a null id, have the component of their text and are no one's component. A similarity of
exactly the threshold links. An empty table gives an empty result; columns other than the key and the text are ignored.
A class is known by a number given to it when the table of classes is written, a row by its id and its text's hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.llm.common import blocks, bounded, components, drop, read, sum_arrays, table

#: Buckets of the hashed document frequencies (4 MB), and fragments of the global order.
BUCKETS, FRAGMENTS = 1 << 20, 4
#: Fragments that are counted in one step.
TOGETHER = 2
#: Classes that share a prefix shingle and are paired at once; more get a pivot. Rounds of pivots. Members of a block.
SMALL, ROUNDS, MEMBERS = 3, 2, 512
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, sorted."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(w) - words + 1
    s = np.zeros(n, np.uint64)
    for k in range(words):
        s = (s ^ h[k : k + n]) * _ODD[k % len(_ODD)]
        s ^= s >> np.uint64(29)
    return np.unique(s)


def frequencies(docs: DataFrame, words: int, text: str = "text") -> np.ndarray:
    """Documents of each bucket of shingle hashes; summed over all rows, of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            found = [shingles(t, words) >> np.uint64(44) for t in b.column(0).to_pylist()]
            if found:
                total += np.bincount(np.concatenate(found).astype(np.int64), minlength=BUCKETS)
        yield from blocks(total)

    return sum_arrays(docs.select(text).mapInArrow(count, "task long, block int, payload binary"), np.int64, BUCKETS)


def order(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each bucket in the global order, fragment of each bucket): fragments hold equal shares of all shingles."""
    by = np.argsort(freq, kind="stable")
    rank = np.empty(BUCKETS, np.int32)
    rank[by] = np.arange(BUCKETS, dtype=np.int32)
    mass = np.cumsum(freq[by]).astype(float)
    part = np.empty(BUCKETS, np.int8)
    part[by] = np.minimum(FRAGMENTS - 1, (mass * FRAGMENTS / max(1.0, mass[-1])).astype(np.int8))
    return rank, part


def _ordered(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return s[np.lexsort((s, rank[(s >> np.uint64(44)).astype(np.int64)]))]


def sketch(s: np.ndarray) -> bytes:
    """How many of a set's hashes fall in each of 2^k buckets of their highest bits; empty where a byte can't hold a count."""
    bits = max(0, len(s).bit_length() - 2)
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) if bits else np.array([len(s)])
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def most_shared(a: bytes, b: bytes, na: int, nb: int) -> int:
    """A bound of the overlap of two sets, by their sketches and sizes; the coarser sketch decides."""
    if not a or not b:
        return min(na, nb)
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b))
    n = min(len(x), len(y))
    return int(np.minimum(x.reshape(n, -1).sum(1), y.reshape(n, -1).sum(1)).sum())


def bounds(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b, na, nb, most) of pairs (a, b): the sizes of both sets, and the most shingles they can share. sizes: rep, n, sketch."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, sa, sb = (batch.column(c) for c in ("a", "b", "na", "nb", "sa", "sb"))
            most = [most_shared(*x) for x in zip(sa.to_pylist(), sb.to_pylist(), na.to_pylist(), nb.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([a, b, na, nb, pa.array(most, pa.int64())], ["a", "b", "na", "nb", "most"])

    both = pairs.select("a", "b").join(sizes.toDF("a", "na", "sa"), "a").join(sizes.toDF("b", "nb", "sb"), "b")
    return both.mapInArrow(bound, "a long, b long, na int, nb int, most long")


def prefixes(rows: DataFrame, shared, words: int, percent: int) -> DataFrame:
    """(id, h, n, set_hash, prefix, sketch): the size and digest of each row's set, its rarest shingles in global order, its sketch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rank, _ = shared.value
        for b in batches:
            n, digest, prefix, seen = [], [], [], []
            for t in b.column(2).to_pylist():
                s = shingles(t, words)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                seen.append(sketch(s))
                prefix.append(_ordered(s, rank)[: len(s) + 1 + (-percent * len(s)) // 100 if len(s) else 0].view(np.int64))
            sizes = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            flat = np.concatenate(prefix) if prefix else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)), pa.array(seen, pa.binary())], ["id", "h", "n", "set_hash", "prefix", "sketch"])

    return rows.mapInArrow(cut, f"id {rows.schema['id'].dataType.simpleString()}, h long, n long, set_hash binary, prefix array<long>, sketch binary")


def fragments(texts: DataFrame, shared, words: int) -> DataFrame:
    """(rep, fragment, part): the shingles of each class within each fragment of the global order, from (rep, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, part = shared.value
        for b in batches:
            ids, frags, parts = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(t, words)
                p = part[(s >> np.uint64(44)).astype(np.int64)]
                for f in np.unique(p).tolist():
                    ids.append(i)
                    frags.append(f)
                    parts.append(s[p == f].view(np.int64))
            sizes = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(frags, pa.int32()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], ["rep", "fragment", "part"])

    return texts.mapInArrow(cut, "rep long, fragment int, part array<long>")


def overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b, shared): overlaps counted for some fragments at a time, summed per pair; pairs without one are left out.

    Each step moves and writes its own fragments only, so that what is on disk at once doesn't hold whole sets of both sides.
    """
    partial = []
    n = pairs.count()
    a, b = (bounded(pairs.select(F.col(k).alias("rep")).distinct(), n) for k in "ab")
    for f in range(0, FRAGMENTS, TOGETHER):
        some = parts.where(F.col("fragment").between(f, f + TOGETHER - 1))
        left = some.join(a, "rep", "left_semi").select(F.col("rep").alias("a"), "fragment", F.col("part").alias("pa"))
        right = some.join(b, "rep", "left_semi").select(F.col("rep").alias("b"), "fragment", F.col("part").alias("pb"))
        both = pairs.select("a", "b").join(left, "a").join(right, ["b", "fragment"])
        partial.append(table(both.select("a", "b", F.size(F.array_intersect("pa", "pb")).alias("partial")), "partial"))
    return reduce(DataFrame.union, partial).groupBy("a", "b").agg(F.sum("partial").alias("shared"))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row of docs."""
    found = classified(docs, words, percent, key, text)
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def classified(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h, n, component_id, root) of every row: its text's xxhash64 (0 for null), and a number that its component alone has."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"), F.col(text).alias("text"))
    shared = spark.sparkContext.broadcast(order(frequencies(docs, words)))
    full = table(prefixes(docs, shared, words, percent), "prefixes")
    first = full.where("n > 0").groupBy("set_hash").agg(F.min(F.struct(F.col("id").isNull(), "id", "h")).alias("f"), F.min_by(F.struct(F.col("n").cast("int").alias("n"), "prefix", "sketch"), F.struct(F.col("id").isNull(), "id", "h")).alias("s"))
    # the number holds once the table is written
    prefixed = table(first.select(F.monotonically_increasing_id().alias("rep"), "set_hash", F.col("f.id").alias("id"), F.col("f.h").alias("h"), "s.n", "s.prefix", "s.sketch"), "prefixed")
    sets, classes = table(full.drop("prefix", "sketch"), "sets"), table(prefixed.drop("prefix"), "classes")
    drop(full)

    rows = prefixed.select("rep", "n", F.posexplode("prefix").alias("at", "shingle"))
    lists = rows.groupBy("shingle").agg(F.count("*").cast("int").alias("m")).where("m > 1")
    posted = table(rows.join(lists, "shingle"), "posted")
    drop(prefixed)
    few = posted.where(F.col("m") <= SMALL).select("shingle", "rep", "n", "at")
    a, b = few.toDF("shingle", "a", "na", "ia"), few.toDF("shingle", "b", "nb", "ib")
    # sizes and positions must allow the similarity; of a similar pair's first common shingle they do
    fits = f"a < b and 100 * least(na, nb) >= {percent} * greatest(na, nb) and (100 + {percent}) * (1 + least(na - ia, nb - ib) - 1) >= {percent} * (na + nb)"
    pairs = a.join(b, "shingle").where(fits).select("a", "b").distinct()
    # the pivot is the class with the largest share of common shingles in its prefix, and of these the largest: the least edited or cut of near copies
    hot = posted.where(F.col("m") > SMALL)
    share = F.count("*") / (F.first("n") + 1 - F.ceil(F.first("n") * percent / 100))
    hot = hot.join(hot.groupBy("rep").agg(share.alias("s")), "rep")
    pivots = hot.groupBy("shingle").agg(F.max(F.struct("s", "n", "rep"))["rep"].alias("g"))
    # i: the first place of any shingle that put x into the group; what x shares with a member begins there or later
    groups = table(hot.join(pivots, "shingle").groupBy("g", F.col("rep").alias("x")).agg(F.first("n").alias("n"), F.min("at").alias("i"), F.first("s").alias("s")), "groups")
    pairs = table(pairs.union(groups.where("g != x").select(F.least("g", "x"), F.greatest("g", "x"))).distinct(), "pairs")
    drop(posted)

    def counted(pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, linked, low, high) of all these pairs, with bounds of the Jaccard distance, which are equal where it was counted."""
        bound = table(bounds(pairs, classes.select("rep", "n", "sketch")), "bound")
        may = bound.where(f"100 * most >= {percent} * (na + nb - most)")
        wanted = may.select(F.col("a").alias("rep")).union(may.select("b")).distinct()
        wanted = table(classes.join(wanted, "rep").select("rep", "id", "h"), "wanted")
        same = docs.id.eqNullSafe(wanted.id) & (docs.h == wanted.h)
        parts = table(fragments(docs.join(bounded(wanted, wanted.count()), same).select("rep", "text").dropDuplicates(["rep"]), shared, words), "parts", ("fragment",))
        exact = may.select("a", "b").join(overlaps(may, parts), ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"))
        distance = lambda c: 1 - F.col(c) / (F.col("na") + F.col("nb") - F.col(c))
        linked = F.coalesce(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared")), F.lit(False))
        out = bound.join(exact, ["a", "b"], "left").select("a", "b", linked.alias("linked"), F.coalesce(distance("shared"), distance("most")).alias("low"), F.coalesce(distance("shared"), F.lit(1.0)).alias("high"))
        out = table(out, name)
        drop(bound, wanted, parts)
        return out

    ids = classes.select(F.col("rep").alias("id"))
    seen = counted(pairs, "counted")
    drop(pairs)
    links = seen.where("linked").select("a", "b")
    comp = table(components(ids, links, "classes-cc"), "comp")
    levels = []
    for turn in range(ROUNDS):
        split = groups.join(comp.toDF("x", "cx"), "x").join(comp.toDF("g", "cg"), "g").withColumn("outer", F.col("cx") != F.col("cg"))
        split = table(split.select("g", "x", "n", "i", "s", "outer"), "split")
        drop(groups)
        rest = split.where("outer")
        if rest.isEmpty():
            drop(split)
            break
        levels.append(split)
        if turn == ROUNDS - 1:
            break
        heads = rest.groupBy("g").agg(F.max(F.struct("s", "n", "x"))["x"].alias("head"))
        groups = table(rest.join(heads, "g").groupBy(F.col("head").alias("g"), "x").agg(F.first("n").alias("n"), F.min("i").alias("i"), F.first("s").alias("s")), "groups")
        stars = groups.where("g != x").select(F.least("g", "x").alias("a"), F.greatest("g", "x").alias("b"))
        todo = table(stars.distinct().join(seen.select("a", "b"), ["a", "b"], "left_anti"), "todo")
        late = counted(todo, "counted")
        drop(todo)
        seen = seen.union(late)
        links = seen.where("linked").select("a", "b")
        if not late.where("linked").isEmpty():
            before, comp = comp, table(components(ids, links, "classes-cc"), "comp")
            drop(before)
    if levels:
        known = seen.select(F.col("a").alias("g"), F.col("b").alias("x"), "low", "high").union(seen.select("b", "a", "low", "high"))
        members = reduce(DataFrame.union, (x.select(F.lit(k).alias("level"), "g", "x", "n", "i", "outer", F.lit(k == ROUNDS - 1).alias("last")) for k, x in enumerate(levels)))
        at = F.col("g") == F.col("x")
        members = members.join(known, ["g", "x"], "left").join(classes.select(F.col("rep").alias("x"), "sketch"), "x").join(comp.toDF("x", "c"), "x").select(
            "level", "g", "x", "n", "i", "outer", "last", "c", "sketch", F.when(at, 0.0).otherwise(F.coalesce("low", F.lit(0.0))).alias("low"), F.when(at, 0.0).otherwise(F.coalesce("high", F.lit(1.0))).alias("high"), _band("n", percent).alias("band")
        )
        members = table(members, "members")
        todo = table(across(members, percent).distinct().join(seen.select("a", "b"), ["a", "b"], "left_anti"), "todo")
        late = counted(todo, "counted")
        drop(members, todo, *levels)
        if not late.where("linked").isEmpty():
            before, comp = comp, table(components(ids, seen.union(late).where("linked").select("a", "b"), "classes-cc"), "comp")
            drop(before)
    of_class = classes.select("set_hash", "rep", "id").join(comp.toDF("rep", "root"), "rep")
    named = of_class.groupBy("root").agg(F.min("id").alias("component_id"))  # a null id is no one's component
    of_class = of_class.join(named, "root").select("set_hash", "component_id", "root")
    alone = sets.where("n = 0").select("id", "h", "n", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return sets.where("n > 0").join(of_class, "set_hash").select("id", "h", "n", "component_id", "root").union(alone)


def _band(n: str, percent: int) -> Column:
    """Sizes as near as the threshold asks are in the same band or in adjacent ones."""
    return F.floor(F.log(F.col(n)) / math.log(100 / percent) + 1e-9).cast("int") if percent < 100 else F.col(n).cast("int")


def across(members: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: pairs of a group's members that may link; every pair but those of one component and, but in the last level, of two outer or two inner ones.

    Both sides of a group are cut into blocks of about MEMBERS, and a task compares a pair of blocks at a time.
    """
    key = ["level", "g", "band"]
    outer = members.where("outer")
    inner = members.where("last or not outer").withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)))
    cut = lambda c: F.ceil(F.count("*") / MEMBERS).cast("int").alias(c)
    cuts = outer.groupBy(key).agg(cut("p")).join(inner.groupBy(key).agg(cut("q")), key)
    block = lambda n: F.pmod(F.xxhash64("x"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = outer.join(cuts, key).withColumn("bx", block("p")).withColumn("by", each("q"))
    right = inner.join(cuts, key).withColumn("by", block("q")).withColumn("bx", each("p"))
    key, shown = [*key, "bx", "by"], ["x", "n", "i", "outer", "c", "low", "high", "sketch"]

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = [], []
        if x.num_rows and y.num_rows:
            (x, sx), (y, sy) = (({c: t.column(c).to_numpy() for c in shown[:-1]}, t.column("sketch").to_pylist()) for t in (x, y))
            for u, v in near(x, y, percent):
                most = most_shared_rows(sx, sy, x["n"], y["n"], u, v)
                fit = 100 * most >= percent * (x["n"][u] + y["n"][v] - most)
                a.append(x["x"][u[fit]])
                b.append(y["x"][v[fit]])
        a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    right = right.select(*key, *shown).toDF(*(f"r_{c}" for c in key), *shown)
    left = left.select(*key, *shown).toDF(*key, *shown)
    return left.groupBy(key).cogroup(right.groupBy([f"r_{c}" for c in key])).applyInArrow(compare, "a long, b long")


def near(x: dict[str, np.ndarray], y: dict[str, np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in x and y whose components differ, and whose sizes, first places and bounds of the distances to a common pivot allow a link; a hair of room for rounding."""
    size, place = y["n"].astype(np.int64), y["i"].astype(np.int64)
    for k in range(len(x["x"])):
        n = int(x["n"][k])
        fit = (x["c"][k] != y["c"]) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size))
        fit &= (100 + percent) * np.minimum(n - int(x["i"][k]), size - place) >= percent * (n + size)
        fit &= np.maximum(x["low"][k] - y["high"], y["low"] - x["high"][k]) <= (100 - percent) / 100 + 1e-9
        fit &= ~y["outer"] | (x["x"][k] < y["x"])  # two outer ones meet twice
        if fit.any():
            v = np.flatnonzero(fit)
            yield np.full(len(v), k), v


def most_shared_rows(a: list[bytes], b: list[bytes], na: np.ndarray, nb: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """most_shared of the sketch a[k] with each of b[v], for u that holds k alone."""
    out, k = np.minimum(na[u], nb[v]).astype(np.int64), int(u[0])
    lengths = np.array([len(b[j]) for j in v])
    for n in np.unique(lengths[lengths > 0]) if a[k] else ():
        of = np.flatnonzero(lengths == n)
        y = np.frombuffer(b"".join(b[j] for j in v[of]), np.uint8).reshape(len(of), n).astype(np.int64)
        x, m = np.frombuffer(a[k], np.uint8).astype(np.int64), min(len(a[k]), n)
        out[of] = np.minimum(x.reshape(m, -1).sum(1), y.reshape(len(of), m, -1).sum(2)).sum(1)
    return out


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, on five-word shingles and a similarity of 0.8."""
    return jaccard_components(read(spark, sf_dir, "documents"))


#: Every link by brute force; the components by the smallest reachable id.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id != b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.b) AS component_id FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
