"""Operator 2: scoring texts by a hashed maximum-entropy language model.

P(word | history) = P(class | history) * P(word | class, history): a softmax over classes of words of similar
frequency, then one over the words of the class. Both are linear in features of the history (the last word, the last
two together, and the words two and three back as skip features), hashed to rows of two weight tables of fixed size.
The last class is the tail: words beyond the modelled ones, drawn by their smoothed training counts, with one share for
all unknown words. So the probabilities of all known words and the unknown one add up to 1, as in the base score.

Training passes over all training documents: in each round every task runs AdaGrad steps over mini-batches of its
rows from the shared weights; the changes of each row of weights are added up over the tasks in steps and averaged over
the tasks that touched it. Only those sums, of fixed size, reach the driver. Word counts are exact over all training
documents; the most frequent words, KNOWN at most, are broadcast, and occurrences of the rest meet their counts in a join.

Null and empty texts are the one end token. Repeated rows are each scored; rows without an id count as having the empty
text as their key. An empty training set leaves the uniform share of unknown words. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.llm.common import blocks, read, remainder, sum_arrays, table

CLASSES, CLASS_WORDS = 32, 64
CLASS_ROWS = WORD_ROWS = 1 << 14
#: Most words that are broadcast with their counts, and their longest; both bound the broadcast.
KNOWN, LONGEST = 1 << 18, 64
FLUSH, ROUNDS, MINIBATCH, TRAIN_BATCH, RATE = 400_000, 2, 8192, 4096, 0.35
START, UNKNOWN = -2, -1
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Where each part of the model lies in one flat array: biases, weights, and how many tasks touched each row.
_SIZES = [CLASSES, CLASS_ROWS * CLASSES, CLASSES * CLASS_WORDS, WORD_ROWS * CLASS_WORDS, CLASS_ROWS, WORD_ROWS, 1]
_AT = np.cumsum([0, *_SIZES])


def words(text: str | None) -> list[bytes]:
    """The text's words, A-Z in lower case; without the end."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) over all rows; the end is the empty token."""

    def flush(c: Counter) -> Iterator[pa.RecordBatch]:
        keys, n = list(c), list(c.values())
        for i in range(0, len(keys), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 20_000], pa.binary()), pa.array(n[i : i + 20_000], pa.int64())], ["token", "n"])
        c.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                c.update(words(t))
            c[b""] += b.num_rows
            if len(c) > FLUSH:
                yield from flush(c)
        yield from flush(c)

    return docs.select(text).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The words above the lowest count that at most KNOWN words reach, most frequent first."""
    short = counts.where(F.octet_length("token") <= LONGEST)
    step = F.floor(F.log2("n") * 8)
    total, least = 0, None
    for r in sorted(short.groupBy(step.alias("step")).count().collect(), reverse=True):  # some hundred rows at most
        total += r["count"]
        if total > KNOWN:
            break
        least = r["step"]
    if least is None:
        return [], np.zeros(0, np.int64)
    found = sorted(((-r["n"], bytes(r["token"])) for r in short.where(step >= least).toLocalIterator()))
    return [t for _, t in found], np.array([-n for n, _ in found], np.int64)


class Ids(dict):
    """Ids of words; words that aren't in it are unknown."""

    def __missing__(self, word):
        return UNKNOWN


class Model:
    """The weights and the vocabulary, as a worker uses them."""

    def __init__(self, flat: np.ndarray, vocabulary: list[bytes]):
        part = [flat[a:b] for a, b in zip(_AT, _AT[1:], strict=False)]
        self.class_bias, self.word_bias = part[0], part[2].reshape(CLASSES, CLASS_WORDS)
        self.class_rows, self.word_rows = part[1].reshape(CLASS_ROWS, CLASSES), part[3].reshape(WORD_ROWS, CLASS_WORDS)
        self.ids = Ids({w: i for i, w in enumerate(vocabulary)} | {None: START})
        self.modelled = min(len(vocabulary), (CLASSES - 1) * CLASS_WORDS)
        self.class_mask = np.zeros(CLASSES, np.float32)
        self.class_mask[-(-self.modelled // CLASS_WORDS) : CLASSES - 1] = -1e9
        self.word_mask = np.where(np.arange(CLASSES * CLASS_WORDS).reshape(CLASSES, CLASS_WORDS) < self.modelled, 0, -1e9).astype(np.float32)

    def encode(self, texts: list) -> tuple[np.ndarray, list, np.ndarray]:
        """(ids of all texts, each after three starts and with its end; the same as words; where each text begins)."""
        flat, at = [], []
        for t in texts:
            flat += (None, None, None)
            at.append(len(flat))
            flat += words(t)
            flat.append(b"")
        return np.fromiter(map(self.ids.__getitem__, flat), np.int64, len(flat)), flat, np.array(at, np.int64)

    @staticmethod
    def features(flat: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Hashes of the history at each place: a row for each feature."""
        a, b, c = ((flat[where - k] + 3).astype(np.uint64) for k in (1, 2, 3))
        keys = (a, b + (a << np.uint64(24)), b, c)
        out = np.empty((len(keys), len(where)), np.uint64)
        for j, k in enumerate(keys):
            x = (k + np.uint64(j + 1)) * _MIX[j]
            x ^= x >> np.uint64(31)
            out[j] = x * _MIX[4]
        return out

    def targets(self, ids: np.ndarray) -> np.ndarray:
        return np.where((ids >= 0) & (ids < self.modelled), ids // CLASS_WORDS, CLASSES - 1)

    @staticmethod
    def rows(h: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
        if classes is not None:
            h = (h ^ (classes.astype(np.uint64) * _MIX[1])) * _MIX[2]
        return (h >> np.uint64(50)).astype(np.uint16)

    def softmax(self, bias: np.ndarray, weights: np.ndarray, rows: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, log probability of the target) at each place; bias is one row or a row for each place."""
        x = np.take(weights, rows[0], axis=0)
        x += bias
        for r in rows[1:]:
            x += np.take(weights, r, axis=0)
        x -= x.max(axis=1, keepdims=True)
        at = x[np.arange(len(target)), target]
        np.exp(x, out=x)
        z = x.sum(axis=1)
        x /= z[:, None]
        return x, at - np.log(z)

    def log_probabilities(self, flat: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Natural logarithms; of words in the tail only the class's."""
        out = np.empty(len(where))
        for i in range(0, len(where), MINIBATCH):
            w = where[i : i + MINIBATCH]
            h, target = self.features(flat, w), self.targets(flat[w])
            out[i : i + MINIBATCH] = self.softmax(self.class_bias + self.class_mask, self.class_rows, self.rows(h), target)[1]
            inside = np.flatnonzero(target < CLASSES - 1)
            if len(inside):
                c = target[inside]
                slot = flat[w][inside] % CLASS_WORDS
                out[i + inside] += self.softmax((self.word_bias + self.word_mask)[c], self.word_rows, self.rows(h[:, inside], c), slot)[1]
        return out

    def train(self, flat: np.ndarray, where: np.ndarray, state: dict) -> None:
        for i in range(0, len(where), TRAIN_BATCH):
            w = where[i : i + TRAIN_BATCH]
            h, target = self.features(flat, w), self.targets(flat[w])
            rows = self.rows(h)
            g, _ = self.softmax(self.class_bias + self.class_mask, self.class_rows, rows, target)
            g[np.arange(len(w)), target] -= 1
            step(self.class_bias[None, :], np.zeros(1, np.int64), g.sum(axis=0, keepdims=True), state["cb"])
            scatter(self.class_rows, rows, g, state["c"])
            inside = np.flatnonzero(target < CLASSES - 1)
            if len(inside):
                c = target[inside]
                slot = flat[w][inside] % CLASS_WORDS
                rows = self.rows(h[:, inside], c)
                g, _ = self.softmax((self.word_bias + self.word_mask)[c], self.word_rows, rows, slot)
                g[np.arange(len(inside)), slot] -= 1
                scatter(self.word_bias, [c.astype(np.uint16)], g, state["wb"])
                scatter(self.word_rows, rows, g, state["w"])


def step(weights: np.ndarray, rows: np.ndarray, g: np.ndarray, seen: np.ndarray) -> None:
    s = seen[rows] + np.einsum("ij,ij->i", g, g)
    seen[rows] = s
    g *= (-RATE / np.sqrt(s + 1))[:, None]
    g += weights[rows]
    weights[rows] = g


def scatter(weights: np.ndarray, rows, g: np.ndarray, seen: np.ndarray) -> None:
    """One AdaGrad step for each row of weights that occurs in rows, by the sum of its gradients."""
    for r in rows:
        by = np.argsort(r, kind="stable")
        r = r[by]
        last = np.flatnonzero(np.concatenate((r[1:] != r[:-1], [True])))
        total = np.cumsum(g[by], axis=0)[last]
        total[1:] -= total[:-1].copy()
        step(weights, r[last].astype(np.int64), total, seen)


_models: dict = {}


def _model(shared) -> Model:
    """The worker's model for this broadcast; an older one is dropped."""
    if _models.get("of") != shared.value[2]:
        _models.update(of=shared.value[2], model=Model(shared.value[0], shared.value[1]))
    return _models["model"]


def fit(docs: DataFrame, vocabulary: list[bytes], counts: np.ndarray, total: int, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """The model's weights, from all rows. The biases start at the logarithms of the counts, all else at zero."""
    sc = docs.sparkSession.sparkContext
    flat = np.zeros(_AT[-1], np.float32)
    if not vocabulary:
        return flat
    inside = np.zeros((CLASSES, CLASS_WORDS))
    n = min(len(counts), (CLASSES - 1) * CLASS_WORDS)
    inside.ravel()[:n] = counts[:n]
    sums = inside.sum(axis=1)
    sums[-1] = total - sums.sum()
    flat[: _AT[1]] = np.log((sums + 1) / (total + CLASSES))
    flat[_AT[2] : _AT[3]] = np.log((inside + 1) / (inside + 1).sum(axis=1, keepdims=True)).ravel()
    for turn in range(ROUNDS):
        shared = sc.broadcast((flat, vocabulary, uuid.uuid4().hex))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            before = shared.value[0]
            own, ids = before.copy(), _model(shared).ids
            m = Model(own, [])
            m.__dict__.update({k: v for k, v in _model(shared).__dict__.items() if k in ("ids", "modelled", "class_mask", "word_mask")})
            m.ids = ids
            state = {"cb": np.zeros(1, np.float32), "c": np.zeros(CLASS_ROWS, np.float32), "wb": np.zeros(CLASSES, np.float32), "w": np.zeros(WORD_ROWS, np.float32)}
            for b in batches:
                f, _, _ = m.encode(b.column(0).to_pylist())
                m.train(f, np.flatnonzero(f != START), state)
            change = own - before
            change[_AT[4] : _AT[5]], change[_AT[5] : _AT[6]] = state["c"] > 0, state["w"] > 0
            change[_AT[6]] = float(state["cb"][0] > 0)
            yield from blocks(change)

        mine = docs.where(F.pmod(F.xxhash64(key, text), F.lit(ROUNDS)) == turn).select(text)
        total = sum_arrays(mine.mapInArrow(learn, "task long, block int, payload binary"), np.float32, len(flat))
        tasks = max(1.0, float(total[_AT[6]]))
        flat = flat.copy()
        flat[: _AT[1]] += total[: _AT[1]] / tasks
        flat[_AT[2] : _AT[3]] += total[_AT[2] : _AT[3]] / tasks
        for k, width in ((1, CLASSES), (3, CLASS_WORDS)):
            touched = np.maximum(1, total[_AT[3 + (k + 1) // 2] : _AT[4 + (k + 1) // 2]])
            flat[_AT[k] : _AT[k + 1]] += (total[_AT[k] : _AT[k + 1]].reshape(-1, width) / touched[:, None]).ravel()
        shared.unpersist()
    flat[_AT[4] :] = 0
    return flat


def score(docs: DataFrame, train: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row of docs; learned from train."""
    counts = table(word_counts(train, text), "counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    vocabulary, c = frequent(counts)
    modelled = min(len(c), (CLASSES - 1) * CLASS_WORDS)
    base_all, tail_all = math.log10(n + v + 1), math.log10(n - int(c[:modelled].sum()) + v - modelled + 1)
    shared = docs.sparkSession.sparkContext.broadcast((fit(train, vocabulary, c, n, key, text), vocabulary, uuid.uuid4().hex))
    log_c = docs.sparkSession.sparkContext.broadcast(np.log10(np.append(c, 0) + 1.0))  # the last is an unknown word's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, lc, row = _model(shared), log_c.value, TaskContext.get().partitionId() << 36
        for b in batches:
            if not b.num_rows:
                continue
            flat, said, at = m.encode(b.column(1).to_pylist())
            where, unknown = np.flatnonzero(flat != START), np.flatnonzero(flat == UNKNOWN)
            rare = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(unknown, at), len(unknown)).astype(np.int32)), pa.array([said[i] for i in unknown.tolist()], pa.binary()))
            ids, first = flat[where], at - 3 * np.arange(1, len(at) + 1)
            tail = (ids < 0) | (ids >= modelled)
            p = m.log_probabilities(flat, where) / math.log(10) if len(lc) > 1 else np.zeros(len(where))
            p += np.where(tail, lc[ids] - tail_all, 0.0)
            added = lambda x, first=first: np.add.reduceat(x, first)
            columns = [np.arange(row, row + b.num_rows), added(np.ones(len(ids), np.int64)), added((ids >= 0).astype(np.int64)), added(lc[ids] - base_all), added(p)]
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns), rare], names)

    names = ["id", "row", "n_tokens", "n_known", "base", "model", "rare"]
    kind = docs.schema[key].dataType.simpleString()
    found = table(docs.select(F.col(key).alias("id"), text).mapInArrow(run, f"id {kind}, row long, n_tokens long, n_known long, base double, model double, rare array<binary>"), "scored")
    rare = found.select("row", F.explode("rare").alias("token")).groupBy("row", "token").agg(F.count("*").alias("times"))
    more = rare.join(counts, "token").groupBy("row").agg(F.sum("times").alias("k"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("gain"))
    gain = F.coalesce("gain", F.lit(0.0))
    return found.drop("rare").join(more, "row", "left").select(
        F.col("id").alias(key), "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + gain).alias("base_score"), (F.col("model") + gain).alias("score")
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base and model scores; remainder 2 of 7 is held out of the training."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, docs.where(remainder("doc_id", 7) != 2))
    return out.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
