"""Operator 8: packing documents into sequences of a fixed number of tokens.

A histogram of piece lengths, at most one entry for each possible length, is all that the driver sees. Over it stands
the configuration linear program (a configuration is a multiset of lengths that fits a sequence; cover every length's
count with as few as possible). Multiplicative weights solve it: lengths that are covered least weigh most, a knapsack
dynamic program finds the configuration of the largest weight, and it gets a share of the sequences. The shares are
rounded down to whole copies, and the rest of the histogram is packed best fit, longest first, many equal pieces at a
time. A configuration that is used n times takes n consecutive sequence numbers; each of its slots takes the next n
pieces of its length. Pieces are numbered within their length by buckets, so a length that a third of the rows have
is still dealt over many tasks.

A null or empty text is the one token that ends a document. Only documents longer than a sequence are cut; their
first piece may be shorter, and the others fill sequences of their own. Repeated rows are packed each on its own, an
empty table gives an empty result, and columns other than the key and the text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatlake.llm.common import read, table

#: Buckets by which pieces of one length are numbered; the table of their sizes has (capacity + 1) x BUCKETS numbers.
BUCKETS = 256
#: Steps of the multiplicative weights, and how strongly uncovered lengths gain weight.
STEPS, RATE = 300, 8.0
CACHE_CHUNKS, CACHE_LENGTH = 250_000, 64


class Encoder:
    """Token ids of whole texts by a byte-level BPE of tokenizers, with a bounded cache of chunks.

    Such a tokenizer cuts a text where a character that is not white space meets one that is, so what lies between such
    joints can be encoded on its own. Texts with other white space than spaces, tabs and line ends, or with the string
    of an added token, are encoded whole.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join(["[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]", *added])).search
        self.chunks = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+").findall
        # a character of a byte-level token stands for one byte
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, without added special tokens."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.whole(text):
            return self.ids(text)
        chunks, new, old = self.chunks(text), self.new, self.old
        missing, alone = [], []
        for c in set(chunks).difference(new):
            if c in old:
                new[c] = old[c]
            else:
                # chunks that begin with white space and end without can stand side by side
                (missing if c[0] in " \t\n\r" and c[-1] not in " \t\n\r" else alone).append(c)
        if missing:
            ids = np.array(self.tokenizer.encode("".join(missing), add_special_tokens=False).ids, "<u4")
            # tokens and chunks meet at the same bytes
            ends = np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in missing])
            cuts = (4 * np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="right")).tolist()
            data = ids.tobytes()
            for c, x, y in zip(missing, [0, *cuts], cuts, strict=False):
                new[c] = data[x:y]
        for c in alone:
            new[c] = self.ids(c)
        out = b"".join(map(new.__getitem__, chunks))
        for c in [*missing, *alone]:
            if len(c) > CACHE_LENGTH:
                del new[c]
        if len(new) >= CACHE_CHUNKS:
            self.old, self.new = new, {}
        return out


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32): each document's ids and the end id, cut to at most `capacity`."""
    names = [key, "piece", "start", "length", "ids_crc32"]
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_file)
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = memoryview(e.encode(t) + end)
                n = len(ids) // 4
                at = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                for k, (x, y) in enumerate(zip(at, at[1:], strict=False)):
                    for column, v in zip(rows, (i, k, x, y - x, zlib.crc32(ids[4 * x : 4 * y])), strict=True):
                        column.append(v)
            keys = b.column(0).take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])], names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.coalesce(text, F.lit("")).alias("text")).mapInArrow(cut, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def best_configuration(profit: np.ndarray, capacity: int) -> list[int]:
    """Knapsack: the lengths, each as often as wanted, of the largest summed profit that fit. profit[0] is unused."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = profit[1 : c + 1] + best[c - 1 :: -1]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], pick[c] = gain[k], k + 1
        else:
            best[c] = best[c - 1]
    out, c = [], capacity
    while c > 0:
        if pick[c]:
            out.append(int(pick[c]))
            c -= int(pick[c])
        else:
            c -= 1
    return out


def solution(left: np.ndarray, capacity: int) -> dict[tuple[int, ...], float]:
    """Configurations and how often each is used in the linear program's solution."""
    there = left > 0
    need = np.maximum(left, 1).astype(float)
    total = float((left * np.arange(capacity + 1)).sum()) / capacity
    share, covered, x = total / STEPS, np.zeros(capacity + 1), {}
    for _ in range(STEPS):
        weight = np.where(there, np.exp(-RATE * (covered - covered[there].min())), 0.0)
        config = best_configuration(weight / need, capacity)
        a = np.bincount(config, minlength=capacity + 1)
        # no configuration is taken more often than its scarcest length allows
        step = min(share, float((need[a > 0] / a[a > 0]).min()))
        covered += a * step / need
        x[tuple(sorted(config, reverse=True))] = x.get(tuple(sorted(config, reverse=True)), 0.0) + step
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """left[l] pieces of each length l, longest first, each into the fullest bin that has room; bins of equal room and equal contents are kept as one entry."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            space = next((s for s in range(length, capacity) if room.get(s)), None)
            held, m = room[space].pop() if space is not None else ((), n)
            # a new bin takes as many equal pieces as fit only when there are so many left
            if m > n:
                room[space].append((held, m - n))
                m = n
            elif space is None:
                per = min(capacity // length, n)
                m = n // per
                held = (length,) * (per - 1)
            n -= m * (1 if held == () or held[-1] != length or space is not None else len(held) + 1)
            held = (*held, length)
            room.setdefault(capacity - sum(held), []).append((held, m))
    return [(list(held), m) for s in room.values() for held, m in s]


#: A rounding takes the configurations that are filled to this share of the capacity at least.
FILLS = (0.995, 0.97, 0.9, 0.0)


def rounded(left: np.ndarray, capacity: int, x: dict[tuple[int, ...], float], fill: float) -> list[tuple[list[int], int]]:
    """The solution rounded down, fullest use first, and best fit for what is left over."""
    left, used = left.copy(), []
    for config, v in sorted(x.items(), key=lambda z: (-z[1], z[0])):
        a = np.bincount(config, minlength=capacity + 1)
        n = min(int(v), int((left[a > 0] // a[a > 0]).min()))
        if n and sum(config) >= capacity * fill:
            used.append((list(config), n))
            left -= a * n
    return used + best_fit(left, capacity)


def solve(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Configurations and how often each is used; together they hold counts[l] pieces of each length l, no more.

    Rounding down leaves pieces over, which fit better beside pieces of loosely filled configurations than among
    themselves; so the solution is rounded with all its configurations and with the fuller ones only, and the rounding
    with the fewest sequences counts.
    """
    left = counts.astype(np.int64).copy()
    used: list[tuple[list[int], int]] = []
    if left[capacity]:
        used.append(([capacity], int(left[capacity])))
        left[capacity] = 0
    if not left.any():
        return used
    x = solution(left, capacity)
    return used + min((rounded(left, capacity, x, fill) for fill in FILLS), key=lambda plan: sum(n for _, n in plan))


def pack(cut: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces(); `cut` is read twice, so it should be a written table."""
    order = [key, "piece", "start", "ids_crc32"]
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64(key, "piece", "start", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    sizes = np.zeros((capacity + 1, BUCKETS), np.int64)
    for r in dealt.groupBy("length", "bucket").count().toLocalIterator():  # (capacity + 1) x BUCKETS rows at most
        sizes[r["length"], r["bucket"]] = r["count"]
    before = sizes.cumsum(axis=1) - sizes
    taken, sequence = np.zeros(capacity + 1, np.int64), 0
    slots: list[tuple[int, int, int, int]] = []
    for config, n in solve(sizes.sum(axis=1), capacity):
        at = 0
        for length in config:
            slots.append((length, int(taken[length]), sequence, at))
            taken[length] += n
            at += length
        sequence += n
    slots.sort()
    first = np.array([(length << 44) + lo for length, lo, _, _ in slots], np.int64)
    low, base, offset = (np.array([s[k] for s in slots], np.int64) for k in (1, 2, 3))
    shared = cut.sparkSession.sparkContext.broadcast((before, first, low, base, offset))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first, low, base, offset = shared.value
        for b in batches:
            length, bucket, rank = (b.column(k).to_numpy() for k in ("length", "bucket", "rank"))
            rank = before[length, bucket] + rank - 1
            k = np.searchsorted(first, (length << 44) + rank, side="right") - 1
            columns = [b.column(c) for c in (key, "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(base[k] + rank - low[k]), pa.array(offset[k])], [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)).cast("long"))
    kind = cut.schema[key].dataType.simpleString()
    return ranked.mapInArrow(place, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 2048 tokens and their places."""
    return pack_documents(read(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    import public_tokenizers

    return pack(table(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity, 0), "pieces"), capacity)
