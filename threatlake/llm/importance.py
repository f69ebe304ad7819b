"""Operator 11: importance resampling towards a target text, by hashed n-gram features.

A-Z are lower-cased; words are `WORD` runs of whole texts, features all runs of 1 to 3 consecutive words joined by one
space, repeats counted, and a feature's bucket is the crc32 of its UTF-8 bytes modulo BUCKETS. The gain of a bucket
tells how much likelier it is in the target than in the documents, in thousandths of a natural logarithm, rounded down.

Nothing leaves the JVM. Higher-order functions make a document's array of buckets, which is written once; its weight is an aggregate over
element_at of a literal array of BUCKETS gains, so scoring explodes and joins nothing. Only totals by bucket are
shuffled for the gains, BUCKETS rows of a task at most; the same bound holds for what the driver reads. The draw sorts
narrow rows (key, numbers) by ranges and adds each range's offset, so no range holds all rows, and rows that repeat a
score and key are told apart by their place, which spreads them.

Null texts have no words, no features and weight 0, as have texts without words. A null key counts as an empty text in
the hash; it comes last among equal scores. Rows that repeat a key are all ranked on their own. An empty target or an
empty table has no counts, which the added ones allow for. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.llm.common import drop, read, table

BUCKETS = 10_000
#: What stands between words: all of ASCII but digits and letters, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A character beyond ASCII that may have a lower case.
CASED = r"[^\x00-\x7F\p{Ll}\p{Lo}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    t = F.coalesce(F.col(text), F.lit(""))
    # lower() changes A-Z only where the rest of a text is ASCII or has no upper case, and is much faster
    low = F.when(t.rlike(CASED), F.translate(t, UPPER, LOWER)).otherwise(F.lower(t))
    return F.array_remove(F.split(low, BETWEEN, -1), "")


def bucketed(rows: DataFrame, keep: tuple = (), text: str = "text") -> DataFrame:
    """`keep`, n_words and buckets: an item for each feature, with buckets from 1 to BUCKETS, as element_at counts."""
    n = F.size("w")
    joined = lambda a, b: F.concat(a, F.lit(" "), b)
    first = lambda a, k: F.slice(a, F.lit(1), F.greatest(n - k, F.lit(0)))
    after = lambda a, k: F.slice(a, F.lit(k + 1), F.greatest(n - k, F.lit(0)))
    # a step at a time, so that no array is computed again within a lambda
    runs = rows.select(*keep, words(text).alias("w"))
    runs = runs.select(*keep, "w", F.zip_with(first("w", 1), after("w", 1), joined).alias("w2"))
    runs = runs.select(*keep, n.cast("long").alias("n_words"), F.concat("w", "w2", F.zip_with(first("w2", 2), after("w", 2), joined)).alias("f"))
    bucket = lambda x: (F.crc32(x.cast("binary")) % F.lit(BUCKETS).cast("long") + F.lit(1).cast("long")).cast("int")
    return runs.select(*keep, "n_words", F.transform("f", bucket).alias("buckets"))


def bucket_counts(rows: DataFrame) -> list[int]:
    """How often each bucket occurs in rows of bucketed(), BUCKETS numbers."""
    out = [0] * BUCKETS
    # the inner explode would filter by the array's size first, and compute the array for that
    counts = rows.select(F.explode_outer("buckets").alias("b")).where("b is not null").groupBy("b").count()
    for b, n in counts.collect():  # at most BUCKETS rows
        out[b - 1] = n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the source, in doubles."""
    s_all, t_all = float(sum(source) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source, target, strict=True)]


def literal(numbers: list[int]) -> Column:
    """An array that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def scored(rows: DataFrame, gain: list[int], seed: int = 42) -> DataFrame:
    """(id, n_words, n_features, weight, score) of rows of bucketed(); score is the weight and a Gumbel value of the seed and the id."""
    each = literal(gain)
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(each, b))
    out = rows.select("id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return out.withColumn("score", F.col("weight") + gumbel)


def drawn(scores: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds rank: 1, 2, ... by score, ties to the smaller key, for floor(percent/100) of the rows of at least so many words; else null."""
    narrow = table(scores.withColumn("u", F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= least_words
    draws = percent * narrow.where(able).count() // 100
    order = [F.desc(able), F.desc("score"), F.asc_nulls_last("id"), F.asc("u")]
    placed = narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = table(placed, "placed")
    drop(narrow)
    # the id's upper bits number the range, the lower 33 the row in it
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row a range
    offsets, total = [], 0
    for p, n in sizes:
        offsets += [total] * (p + 1 - len(offsets))  # ranges without rows have no number
        total += n
    place = F.element_at(literal(offsets or [0]), part.cast("int") + 1) + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("rank", F.when(able & (place <= draws), place)).drop("u", "at")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row of docs; rank says what is drawn, and in which order."""
    # read twice, for the counts and for the weights
    rows = table(bucketed(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), ("id",)), "buckets")
    gain = gains(bucket_counts(rows), bucket_counts(bucketed(target, text=text)))
    out = drawn(scored(rows, gain, seed), percent, least_words).withColumnRenamed("id", key)
    drop(rows)
    return out


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's features, weight, score and rank, towards the benchmark's texts."""
    found = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: The crc is built from its polynomial, half a byte at a time.
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), target AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), runs AS (
  SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM docs
  UNION ALL
  SELECT NULL, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) FROM target
), features AS (
  SELECT r, f, count(*) AS n FROM runs GROUP BY ALL
), step(i, c) AS (  -- the crc of each half byte, by the polynomial
  SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], range(4)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FROM range(16) t(i)
), steps AS (
  SELECT list(c ORDER BY i) AS l FROM step
), crc AS (
  SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(2 * strlen(f)), lambda i: CAST(instr('0123456789ABCDEF', substr(hex(encode(f)), i + 2 - 2 * (i % 2), 1)) - 1 AS BIGINT))),
    lambda c, x: xor(list_extract(l, CAST(xor(c, x) & 15 AS INT) + 1), c >> 4)), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT f FROM features), steps
), totals AS (
  SELECT b, CAST(coalesce(sum(n) FILTER (r IS NOT NULL), 0) AS BIGINT) AS s, CAST(coalesce(sum(n) FILTER (r IS NULL), 0) AS BIGINT) AS t FROM features JOIN crc USING (f) GROUP BY b
), gain AS (
  SELECT b, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM totals) + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM totals) + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM totals
), weights AS (
  SELECT r, sum(n * g) AS weight FROM features JOIN crc USING (f) JOIN gain USING (b) WHERE r IS NOT NULL GROUP BY r
), scores AS (
  SELECT r, doc_id, len(w) AS words, CAST(len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (r)
), places AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, r) AS place FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * (SELECT count(*) FROM scores WHERE words >= 20) // 100 THEN place END AS rank FROM places
"""
