"""Operator 6: document fingerprints by Lempel-Ziv phrases.

A text is parsed into LZ78 phrases (the longest phrase known so far and one more character), which fill the dictionary
that a compressor would build. The set of phrase hashes is summarized by minima: one hash of each phrase deals it to one
of `SLOTS` slots, each of which keeps its smallest hash; empty slots borrow from the next. Texts that compress alike
share phrases, so the share of equal slots estimates the Jaccard similarity of their dictionaries.

The registered query also fingerprints each document with its last third replaced by the start of the next document in
descending order of id. The documents are dealt by ranges of the id and sorted, so each has its successor at hand but
the last of a range; those wait for a second, small step with the first documents of the ranges. The parse of what a
document and its edited text have in common is done once.

Null texts count as empty; empty texts have no phrases and equal only each other. Rows with equal ids stand in order of
their text; rows without an id stand last. A single row is its own successor. An empty table gives an empty result, and
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatlake.llm.common import read, table

SLOTS = 64
_MASK, _MUL, _ADD = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


class Parse:
    """An LZ78 parse that can be continued; `hashes` has one entry for each phrase, after the empty one."""

    __slots__ = ("children", "hashes", "node")

    def __init__(self):
        self.children: dict[int, int] = {}
        self.hashes = [0x2545F4914F6CDD1D]
        self.node = 0

    def copy(self) -> Parse:
        other = Parse.__new__(Parse)
        other.children, other.hashes, other.node = self.children.copy(), self.hashes.copy(), self.node
        return other

    def extend(self, text: str) -> Parse:
        children, hashes, node = self.children, self.hashes, self.node
        get = children.get
        for c in np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).tolist():
            child = get(node + c)
            if child is None:
                children[node + c] = len(hashes) << 21  # code points have 21 bits
                h = ((hashes[node >> 21] ^ c) * _MUL + _ADD) & _MASK
                hashes.append(h ^ (h >> 29))
                node = 0
            else:
                node = child
        self.node = node
        return self

    def signature(self) -> np.ndarray:
        """SLOTS 16-bit minima."""
        if len(self.hashes) == 1:
            return np.zeros(SLOTS, np.uint16)
        h = np.array(self.hashes[1:], np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_MUL)
        h.sort()
        at = np.searchsorted(h >> np.uint64(58), np.arange(SLOTS, dtype=np.uint64))
        low = h[np.minimum(at, len(h) - 1)]
        full = (at < len(h)) & ((low >> np.uint64(58)) == np.arange(SLOTS))
        where = np.flatnonzero(full)
        donor = where[np.searchsorted(where, np.arange(SLOTS)) % len(where)]  # itself, or the next that isn't empty
        return ((low[donor] * np.uint64(_ADD)) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)


def fingerprint(text: str | None) -> str:
    return Parse().extend(text or "").signature().astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.string())], [key, "fingerprint"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint string")


_FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compare(whole: Parse, text: str, cut: int, shared: Parse, after: str, following: np.ndarray) -> tuple:
    """The fields of a text, given its parse, the parse up to `cut` and its successor's text and signature."""
    start = after[: len(text) - cut]
    mine, edited = whole.signature(), shared.extend(start).signature()
    digest = hashlib.sha256((text[:cut] + start).encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), digest, mine.astype(">u2").tobytes().hex(), edited.astype(">u2").tobytes().hex(), likeness(mine, edited), likeness(mine, following)


def _parsed(text: str) -> tuple[Parse, int, Parse]:
    cut = len(text) - len(text) // 3
    shared = Parse().extend(text[:cut])
    return shared.copy().extend(text[cut:]), cut, shared


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    names = ["id", *(x.split()[0] for x in _FIELDS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, head, last = TaskContext.get().partitionId(), None, None

        def rows(ids, found, part=None, tail=None):
            n = len(ids)
            fields = [pa.array([x[k] for x in found] if found else [None] * n, t) for k, t in enumerate(_KINDS)]
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *fields, pa.array([part] * n, pa.int64()), *(pa.array([x] * n, pa.string()) for x in (tail or (None, None)))], [*names, "part", "tail", "head"])

        for b in batches:
            id_type = b.schema.field(0).type
            ids, found = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parsed = _parsed(t)
                if head is None:
                    head = t
                if last is not None:
                    j, u, (whole, cut, shared) = last
                    ids.append(j)
                    found.append(_compare(whole, u, cut, shared, t, parsed[0].signature()))
                last = (i, t, parsed)
            if ids:
                yield rows(ids, found)
        if last is not None:
            yield rows([last[0]], [], part, (last[1], head))

    dealt = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("id").desc_nulls_last())
    first = table(dealt.sortWithinPartitions(F.col("id").desc_nulls_last(), "text").mapInArrow(run, f"id {kind}, {_FIELDS}, part long, tail string, head string"), "fingerprints")

    # one row for each range: its successor's first document, and after the last the first
    ends = first.where("part is not null").select("id", "part", "tail", "head")
    order = ends.select("part").withColumn("k", F.row_number().over(Window.orderBy("part")))
    n = order.count()
    ends = ends.join(order, "part")
    heads = ends.select(F.pmod(F.col("k") - 2, F.lit(max(1, n))).alias("at"), F.col("head").alias("after"))
    waiting = ends.select("id", "tail", (F.col("k") - 1).alias("at")).join(heads, "at").select("id", "tail", "after")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t, after in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                whole, cut, shared = _parsed(t)
                found.append(_compare(whole, t, cut, shared, after, Parse().extend(after).signature()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in found], t) for k, t in enumerate(_KINDS))], names)

    out = first.where("part is null").drop("part", "tail", "head").union(waiting.mapInArrow(finish, f"id {kind}, {_FIELDS}"))
    return out.withColumnRenamed("id", key)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and the likenesses."""
    return edited_fingerprints(read(spark, sf_dir, "documents"))
