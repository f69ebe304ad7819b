"""Operator 13: secrets by patterns and by a character convolutional network over candidates in their context.

The base finds assignments to names such as `password`, access keys and long hexadecimal strings by their form. Every
other candidate, a run of letters, digits and `+/_.-` with up to two `=` behind it, of at least SHORTEST characters and
with a digit, is scored by a network that reads its characters and CONTEXT characters on both sides; a candidate longer
than BODY is read in several windows. The network is trained in numpy on labelled findings: candidates that lie in a base
span carry its kind, all others are `none`. So that it knows secrets by their form and not only by the base's own
keywords, each finding is also shown in the surroundings of another candidate. All different windows of all documents
count. They are dealt by their hashes into groups of about GROUP windows; in each of the passes every group trains the
network on its own windows from where the last pass ended, and the mean of the groups, by their windows, is where the
next pass begins. So a pass is one Spark job, and a group of bounded size is all that a task holds.

A quarter of the windows, by their hashes, is held out. There a temperature is fitted that makes the network's
probabilities match what is found, by the sum of the losses of all held-out windows. A kind's threshold, a multiple of
1 / BINS, must find RECALL of its held-out findings; of these thresholds the one that is right most often counts, and of
equals the lowest. For that all held-out windows are counted by kind and bin. A kind that finds less, or is right in less than PRECISION of the held-out cases
above its threshold, adds nothing. What the
network finds is of kind `other`; base spans stay as they are.

Null texts count as empty. Equal texts have equal results; an empty table, or one without base spans, gives base results
only; a null key stays null; columns other than the key and the text are ignored. Scanning is linear in a text's length,
and the whole text is scanned. Candidates without an ASCII digit aren't scored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.llm.common import blocks, drop, read, sum_arrays, table
from threatlake.llm.language_id import EPOCHS, RATE, Network

KINDS = ("assign", "access", "hex")
CLASSES = ["none", *KINDS]
#: Shortest candidate, characters of a candidate in a window, and of its surroundings on each side.
SHORTEST, BODY, CONTEXT = 8, 48, 24
WIDTH = BODY + 2 * CONTEXT
#: Windows of a group, about; bins of a probability; temperatures that are tried.
GROUP, BINS = 6000, 8192
TEMPERATURES = np.geomspace(0.25, 16, 49)
#: Share of held-out findings that a threshold keeps, and share of right ones among all above it that a kind needs.
RECALL, PRECISION = 0.95, 0.8

_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE).finditer
_access = re.compile("AKIA[A-Z0-9]+").finditer
_hex = re.compile("[0-9a-f]{32,}").finditer
_digits = re.compile("[0-9]+").finditer
_body = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-")
_names = ("passw", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), by start and kind."""
    out = []
    low = text.lower()
    if any(x in low for x in _names):
        out += [(m.start(), 0, m.end()) for m in _assign(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _access(text) if m.end() - m.start() >= 16]
    # runs of fewer than 32 are dropped, so the pattern may as well ask for them
    out += [(m.start(), 2, m.end()) for m in _hex(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of every candidate, by start."""
    out, end = [], 0
    for m in _digits(text):
        if m.start() < end:
            continue
        x, end = m.start(), m.end()
        while x and text[x - 1] in _body:
            x -= 1
        while end < len(text) and text[end] in _body:
            end += 1
        y = end
        while x < y and text[x] in "._-/+":
            x += 1
        while y > x and text[y - 1] in "._-":
            y -= 1
        if y == end:
            while y < end + 2 and text[y : y + 1] == "=":
                y += 1
        if y - x >= SHORTEST:
            out.append((x, y))
    return out


def labels(found: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """The class of each candidate: the first kind, in their order, of the base spans that it overlaps, or 0."""
    out, first = [], 0
    for x, y in found:
        while first < len(base) and base[first][2] <= x:
            first += 1
        kinds = []
        k = first
        while k < len(base) and base[k][0] < y:
            if base[k][2] > x:
                kinds.append(base[k][1])
            k += 1
        out.append(min(kinds) + 1 if kinds else 0)
    return out


def _codes(s: str, mark: int) -> np.ndarray:
    """A byte for each character: ASCII's own with the mark added, 1 for the rest."""
    x = np.frombuffer(s.encode("ascii", "replace"), np.uint8)
    beyond = np.fromiter((c > "\x7f" for c in s), bool, len(s)) if not s.isascii() else None
    return (x if beyond is None else np.where(beyond, 1, x)) + np.uint8(mark)


def windows(text: str, x: int, y: int) -> np.ndarray:
    """Rows of WIDTH codes: what is before the candidate, BODY of its characters (marked), what is behind it."""
    left, right = _codes(text[max(0, x - CONTEXT) : x], 0), _codes(text[y : y + CONTEXT], 0)
    body = _codes(text[x:y], 128)
    out = np.zeros((-(-len(body) // BODY), WIDTH), np.uint8)
    out[:, CONTEXT - len(left) : CONTEXT] = left
    for row, i in zip(out, range(0, len(body), BODY), strict=True):
        part = body[i : i + BODY]
        row[CONTEXT : CONTEXT + len(part)] = part
        row[CONTEXT + len(part) : CONTEXT + len(part) + len(right)] = right
    return out


def moved(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Each window's candidate in the surroundings of another window."""
    out = np.zeros_like(x)
    out[:, :CONTEXT] = to[:, :CONTEXT]
    for row, mine, other in zip(out, x, to, strict=True):
        a, b = mine[CONTEXT:], other[CONTEXT:]
        a = a[: int((a >= 128).sum())]
        b = b[int((b >= 128).sum()) :][:CONTEXT]
        row[CONTEXT : CONTEXT + len(a)] = a
        row[CONTEXT + len(a) : CONTEXT + len(a) + len(b)] = b
    return out


def calibrated_probabilities(logp: np.ndarray, temperature: float) -> np.ndarray:
    z = logp / temperature
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


@dataclass
class Detector:
    network: Network
    temperature: float
    #: The least probability of each kind; above 1 for kinds that add nothing.
    thresholds: list[float]

    def probabilities(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each class, for candidates whose windows begin at `first` of x: the windows' mean log probabilities, calibrated."""
        logp = np.concatenate([self.network.forward(x[i : i + 256])[2] for i in range(0, len(x), 256)])
        n = np.diff(np.append(first, len(x)))
        return calibrated_probabilities(np.add.reduceat(logp, first, axis=0) / n[:, None], self.temperature)

    def secret(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        p = self.probabilities(x, first)
        return ((p[:, 1:] >= np.array(self.thresholds)) & (p[:, 1:] >= p[:, :1])).any(axis=1)


def losses(logp: np.ndarray, y: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The loss at each temperature, summed over windows of classes y; counts: how many windows each class has in all."""
    n = len(CLASSES)
    # a class of m windows aims at (m+1)/(m+2), so that windows without a fault don't ask for a temperature of 0
    off = 1 / (counts[y] + 2)
    aim = np.repeat(off[:, None] / (n - 1), n, axis=1)
    aim[np.arange(len(y)), y] = 1 - off

    def loss(t: float) -> float:
        z = logp / t
        z = z - z.max(axis=1, keepdims=True)
        return float(-(aim * (z - np.log(np.exp(z).sum(axis=1, keepdims=True)))).sum())

    return np.array([loss(t) for t in TEMPERATURES])


def tallies(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By kind and bin of the kind's probability, of windows where it is no less than that of `none`: all, findings, and the kind's own."""
    out = np.zeros((len(KINDS), 3, BINS), np.int64)
    for k in range(1, len(CLASSES)):
        wins = p[:, k] >= p[:, 0]
        at = np.minimum((p[:, k] * BINS).astype(np.int64), BINS - 1)
        for i, which in enumerate((wins, wins & (y > 0), wins & (y == k))):
            out[k - 1, i] = np.bincount(at[which], minlength=BINS)
    return out


def thresholds(tallied: np.ndarray, counts: np.ndarray) -> list[float]:
    out = []
    above = np.cumsum(tallied[:, :, ::-1], axis=2)[:, :, ::-1]
    for k in range(1, len(CLASSES)):
        every, right, mine = above[k - 1]
        best = (PRECISION, -2.0)
        if mine[0] and mine[0] >= RECALL * counts[k]:
            # from the lowest that could be asked for up to the highest that keeps RECALL
            highest = int(np.flatnonzero(mine >= np.ceil(RECALL * counts[k]))[-1])
            for b in range(BINS // 2, max(highest, BINS // 2) + 1):
                if every[b]:  # one kind's finding above another's threshold is a finding still
                    best = max(best, (right[b] / every[b], -b / BINS))
        out.append(-best[1])
    return out


def calibrated(network: Network, x: np.ndarray, y: np.ndarray) -> Detector:
    """The temperature and thresholds of held-out windows x of classes y."""
    counts = np.bincount(y, minlength=len(CLASSES))
    d = Detector(network, float(TEMPERATURES[losses(network.forward(x)[2], y, counts).argmin()]), [])
    d.thresholds = thresholds(tallies(d.probabilities(x, np.arange(len(x))), y), counts)
    return d


def shown(group: pa.Table, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a group and their classes, each finding once more in the surroundings of another candidate."""
    rows = sorted(zip(group.column("window").to_pylist(), group.column("kind").to_pylist(), strict=True))
    x, y = np.stack([np.frombuffer(w, np.uint8) for w, _ in rows]), np.array([k for _, k in rows])
    some, others = np.flatnonzero(y > 0), np.flatnonzero(y == 0)
    if not len(some) or not len(others):
        return x, y
    r = np.random.default_rng(seed)
    return np.concatenate([x, moved(x[some], x[r.choice(others, len(some))])]), np.concatenate([y, y[some]])


def _flat(network: Network, state: dict) -> np.ndarray:
    return np.concatenate([a.ravel() for of in (network.p, state["m"], state["v"]) for _, a in sorted(of.items())] + [np.array([float(state["t"])])])


def _unflat(flat: np.ndarray) -> tuple[Network, dict]:
    network, at = Network(CLASSES), 0
    state = network.start()
    for of in (network.p, state["m"], state["v"]):
        for k, a in sorted(of.items()):
            of[k] = flat[at : at + a.size].reshape(a.shape).copy()
            at += a.size
    state["t"] = float(flat[at])
    return network, state


def _learning(epoch: int, shared):
    """A group's part of a pass: its weights times its number of windows, and that number."""

    def learn(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        g = key[0].as_py()
        network, state = _unflat(shared.value)
        x, y = shown(group, 5 + g)
        network.pass_over(x, y, state, RATE * (1 - epoch / EPOCHS), np.random.default_rng((11, epoch, g)))
        return pa.Table.from_batches(blocks(np.append(_flat(network, state), 1.0) * len(x)))

    return learn


def trained(groups: DataFrame) -> Network:
    """The network after EPOCHS passes over all windows. groups: g, kind, window."""
    network = Network(CLASSES)
    flat = _flat(network, network.start())
    for epoch in range(EPOCHS):
        shared = groups.sparkSession.sparkContext.broadcast(flat)
        total = sum_arrays(groups.groupBy("g").applyInArrow(_learning(epoch, shared), "task long, block int, payload binary"), np.float64, len(flat) + 1)
        flat = total[:-1] / total[-1]
        shared.unpersist()
    return _unflat(flat)[0]


def measured(groups: DataFrame, network: Network) -> Detector:
    """The network with its temperature and thresholds by all held-out windows. groups: g, kind, window."""
    shared = groups.sparkSession.sparkContext.broadcast(network)

    def score(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        x, y = shown(group, 6 + key[0].as_py())
        logp = np.concatenate([shared.value.forward(x[i : i + 256])[2] for i in range(0, len(x), 256)])
        return pa.table({"kind": pa.array(y, pa.int32()), "logp": pa.array([r.tobytes() for r in logp], pa.binary())})

    held = table(groups.groupBy("g").applyInArrow(score, "kind int, logp binary"), "held")
    counts = np.zeros(len(CLASSES), np.int64)
    for r in held.groupBy("kind").count().collect():  # a row a class
        counts[r["kind"]] = r["count"]

    def summed(of, n: int, dtype) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n, dtype)
            for b in batches:
                if b.num_rows:
                    total += of(np.frombuffer(b"".join(b.column(1).to_pylist())).reshape(b.num_rows, -1), b.column(0).to_numpy()).ravel()
            yield from blocks(total)

        return sum_arrays(held.mapInArrow(run, "task long, block int, payload binary"), dtype, n)

    d = Detector(network, float(TEMPERATURES[summed(lambda z, y: losses(z, y, counts), len(TEMPERATURES), np.float64).argmin()]), [])
    tallied = summed(lambda z, y: tallies(calibrated_probabilities(z, d.temperature), y), len(KINDS) * 3 * BINS, np.int64)
    d.thresholds = thresholds(tallied.reshape(len(KINDS), 3, BINS), counts)
    drop(held)
    return d


def fit(docs: DataFrame, text: str = "text") -> Detector | None:
    """A detector fitted on all the documents' base spans and other candidates; none if there are no spans or no others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, rows = [], []
            for t in b.column(0).to_pylist():
                found = candidates(t)
                for (x, y), k in zip(found, labels(found, base_spans(t)) if found else [], strict=True):
                    w = windows(t, x, y)
                    kinds += [k] * len(w)
                    rows += [r.tobytes() for r in w]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(rows, pa.binary())], ["kind", "window"])

    seen = docs.select(F.coalesce(text, F.lit("")).alias("text")).mapInArrow(run, "kind int, window binary").distinct()
    seen = table(seen.withColumn("h", F.xxhash64("window")), "windows")
    held = F.pmod("h", F.lit(4)) == 3
    counts = seen.groupBy((F.col("kind") > 0).alias("found")).agg(F.count_if(held).alias("held"), F.count_if(~held).alias("learned")).collect()
    n_held, n_learned = sum(r["held"] for r in counts), sum(r["learned"] for r in counts)
    if len(counts) < 2 or not n_held or not n_learned:
        drop(seen)
        return None

    def dealt(which: Column, n: int) -> DataFrame:
        """The windows in their groups; a number that is asked for keeps Spark from putting many groups into one task, as they are small but take long."""
        k = -(-n // GROUP)
        return seen.where(which).select(F.pmod(F.floor(F.col("h") / 4), F.lit(k)).cast("int").alias("g"), "kind", "window").repartition(k, "g")

    d = measured(dealt(held, n_held), trained(dealt(~held, n_learned)))
    drop(seen)
    return d


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame, detector: Detector | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_<kind>, n_other, base_sha256, spans) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(detector)
    names = [key, *(f"n_{k}" for k in KINDS), "n_other", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = shared.value
        for b in batches:
            counts, shas, every, ask, rows = [], [], [], [], []
            for n, t in enumerate(b.column(1).to_pylist()):
                base = base_spans(t)
                counts.append(Counter(k for _, k, _ in base))
                every.append([(a, KINDS[k], e) for a, k, e in base])
                shas.append(hashlib.sha256(joined(every[-1]).encode()).hexdigest())
                if detector:
                    found = candidates(t)
                    for (x, y), k in zip(found, labels(found, base), strict=True):
                        if not k:
                            ask.append((n, x, y))
                            rows.append(windows(t, x, y))
            if rows:
                first = np.cumsum([0, *(len(w) for w in rows[:-1])])
                for k in np.flatnonzero(detector.secret(np.concatenate(rows), first)).tolist():
                    n, x, y = ask[k]
                    every[n].append((x, "other", y))
            more = [sum(k == "other" for _, k, _ in s) for s in every]
            order = lambda s: (s[0], (*KINDS, "other").index(s[1]), s[2])
            columns = [*([c[k] for c in counts] for k in range(len(KINDS))), more]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(shas, pa.string()), pa.array([joined(sorted(s, key=order)) for s in every], pa.string())], names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {', '.join(f'{n} long' for n in names[1:-2])}, base_sha256 string, spans string"
    return docs.select(key, F.coalesce(text, F.lit("")).alias("text")).mapInArrow(run, schema)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    docs = read(spark, sf_dir, "documents")
    return secrets(docs, fit(docs))
