"""Operator 10: language identification by a byte convolutional network.

A text's UTF-8 bytes (A-Z in lower case) are cut into windows of `WINDOW` bytes, all of them. Within a window, filters
of several widths run over embedded bytes, each keeps its largest value, and a softmax gives the languages. A text's
prediction is the mean of its windows' log probabilities, weighted by their letters. The network is trained in numpy
with Adam on windows of a bounded sample of the labelled texts (SAMPLE, the smallest hashes of the key). For inference
the first layers are folded into tables of byte pairs, so a filter costs one look-up and some additions at each byte.

A text that is null or has no letter is `und` with score 0, and so is everything when nothing is labelled. Repeated
rows give repeated results; an empty table gives an empty one; columns other than the key, text and label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.llm.common import read, remainder

#: Bytes of a window, embedding size, filter widths and filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 8
#: Most labelled texts that the network is fitted on, windows of each, and passes over them.
SAMPLE, PER_TEXT, EPOCHS, BATCH, RATE = 2400, 2, 6, 64, 0.01
_letter = regex.compile(r"\p{L}").search  # not `²`, `½` or `Ⅷ`, which are numbers
_is_letter = np.zeros(256, bool)
_is_letter[ord("a") : ord("z") + 1] = _is_letter[0x80:] = True


def windows(data: bytes) -> np.ndarray:
    """All bytes in rows of WINDOW, the last filled up with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages = languages
        n = FILTERS * len(WIDTHS)
        self.p = {"embed": r.normal(0, 0.5, (256, EMBED)), "bias": np.zeros(n), "out": r.normal(0, 0.3, (n, len(languages))), "out_bias": np.zeros(len(languages))}
        self.p |= {f"w{w}": r.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS}

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pooled values before the rectifier, where each was found, log probabilities) of windows x."""
        p, best, at = self.p, [], []
        for w in WIDTHS:
            by_byte = np.einsum("be,wef->bwf", p["embed"], p[f"w{w}"])
            n = x.shape[1] - w + 1
            y = sum(by_byte[x[:, k : k + n], k] for k in range(w))
            at.append(y.argmax(axis=1))
            best.append(np.take_along_axis(y, at[-1][:, None, :], axis=1)[:, 0])
        pooled, at = np.concatenate(best, axis=1) + p["bias"], np.concatenate(at, axis=1)
        z = np.maximum(pooled, 0) @ p["out"] + p["out_bias"]
        z -= z.max(axis=1, keepdims=True)
        return pooled, at, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict:
        p = self.p
        pooled, at, logp = self.forward(x)
        d = np.exp(logp)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"out": np.maximum(pooled, 0).T @ d, "out_bias": d.sum(axis=0)}
        h = (d @ p["out"].T) * (pooled > 0)
        g["bias"], g["embed"] = h.sum(axis=0), np.zeros_like(p["embed"])
        for i, w in enumerate(WIDTHS):
            mine = slice(i * FILTERS, (i + 1) * FILTERS)
            b = x[np.arange(len(x))[:, None, None], at[:, mine, None] + np.arange(w)]  # window, filter, place
            g[f"w{w}"] = np.einsum("bf,bfwe->wef", h[:, mine], p["embed"][b])
            np.add.at(g["embed"], b, np.einsum("bf,wef->bfwe", h[:, mine], p[f"w{w}"]))
        return g

    def start(self) -> dict:
        """The moments of Adam and its number of steps, before the first."""
        return {"m": {k: np.zeros_like(v) for k, v in self.p.items()}, "v": {k: np.zeros_like(v) for k, v in self.p.items()}, "t": 0}

    def pass_over(self, x: np.ndarray, y: np.ndarray, state: dict, rate: float, r: np.random.Generator) -> None:
        """Adam's steps over all windows once, in random order."""
        m, v = state["m"], state["v"]
        for rows in np.array_split(r.permutation(len(x)), max(1, len(x) // BATCH)):
            state["t"] += 1
            t = state["t"]
            for k, g in self.gradient(x[rows], y[rows]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
        r, state = np.random.default_rng(seed), self.start()
        for epoch in range(EPOCHS):
            self.pass_over(x, y, state, RATE * (1 - epoch / EPOCHS), r)
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """By byte pairs: widths 2, the first two of 3, the first and the last two of 4; by bytes: the last of 3."""
        e = self.p["embed"]
        two = lambda w, k: ((e @ self.p[w][k])[:, None] + (e @ self.p[w][k + 1])[None]).reshape(1 << 16, FILTERS)
        pairs = np.concatenate([two("w2", 0), two("w3", 0), two("w4", 0), two("w4", 2)], axis=1)
        return pairs.astype(np.float32), (e @ self.p["w3"][2]).astype(np.float32)

    def log_probabilities(self, x: np.ndarray, pairs: np.ndarray, last: np.ndarray) -> np.ndarray:
        """forward()'s for many windows; the places are the first axis, so that the maxima run over whole rows."""
        out, f, n = [], FILTERS, WINDOW
        for i in range(0, len(x), 64):
            b = np.ascontiguousarray(x[i : i + 64].T)
            y = np.take(pairs, (b[:-1].astype(np.uint16) << 8) | b[1:], axis=0)
            three = y[: n - 2, :, f : 2 * f] + np.take(last, b[2:], axis=0)
            four = y[: n - 3, :, 2 * f : 3 * f] + y[2:, :, 3 * f :]
            pooled = np.concatenate([y[:, :, :f].max(axis=0), three.max(axis=0), four.max(axis=0)], axis=1) + self.p["bias"]
            z = np.maximum(pooled, 0) @ self.p["out"] + self.p["out_bias"]
            z -= z.max(axis=1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out)

    def predict(self, texts: list, tables: tuple[np.ndarray, np.ndarray]) -> list[tuple[str, float]]:
        has = [t is not None and bool(self.languages) and _letter(t) is not None for t in texts]
        cut = [windows(t.encode("utf-8", "surrogatepass").lower()) for t, ok in zip(texts, has, strict=True) if ok]
        if not cut:
            return [("und", 0.0)] * len(texts)
        x = np.concatenate(cut)
        first = np.cumsum([0, *(len(c) for c in cut[:-1])])
        weight = _is_letter[x].sum(axis=1)
        weighted = np.add.reduceat(self.log_probabilities(x, *tables) * weight[:, None], first, axis=0) / np.maximum(1, np.add.reduceat(weight, first))[:, None]
        p = np.exp(weighted)
        p /= p.sum(axis=1, keepdims=True)
        found = iter(zip(p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True))
        return [(self.languages[(best := next(found))[0]], best[1]) if ok else ("und", 0.0) for ok in has]


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network:
    """A network fitted on SAMPLE texts at most, those with the smallest hashes of the key; of each, windows spread over the whole."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    languages = sorted(r[0] for r in rows.select(lang).distinct().collect())
    h = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / (1 << 30)
    share = min(1.0, 4 * SAMPLE / max(1, rows.count()))
    near = F.expr(f"substring({text}, cast(pmod(xxhash64({key}, 1), greatest(1, length({text}) - 1024)) as int) + 1, 1024)")
    sample = rows.where(h <= share).orderBy(h, key).limit(SAMPLE).select(F.col(lang).alias("lang"), near.alias("text")).collect()
    x, y = [], []
    for r in sample:
        if _letter(r["text"]):
            cut = windows(r["text"].encode().lower())
            for w in cut[:: max(1, len(cut) // PER_TEXT)][:PER_TEXT]:
                x.append(w)
                y.append(languages.index(r["lang"]))
    network = Network(languages)
    return network.fit(np.array(x), np.array(y)) if x else Network([])


def languages(docs: DataFrame, network: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast((network, network.tables()))
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, tables = shared.value
        for b in batches:
            found = network.predict(b.column(at).to_pylist(), tables)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], [*names, "lang_pred", "score"])

    mine = docs.select(*names)
    return mine.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mine.schema) + ", lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    """The documents that may be learned from."""
    return docs.where(remainder("doc_id", 4) != 2)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; remainder 2 of 4 is held out of the training."""
    docs = read(spark, sf_dir, "documents")
    network = fit(training_rows(docs.select("doc_id", "text", "lang")))
    out = languages(docs.select("doc_id", "text"), network)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
