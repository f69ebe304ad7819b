"""Operator 9: sampled SentencePiece encodings and lossless decoding.

A text is segmented by forward filtering and backward sampling over the lattice of all pieces that fit: the forward pass
sums, at each place, the weights of all segmentations up to it; the backward pass draws the last piece by its share, then
the one before, and so on. A piece of rank r weighs (r + 1) ** -theta. A draw is a hash of the row's key, the chunk's
number in the text and the place, so a row's encoding doesn't depend on batches, partitions or retries. Pieces never run
from a word into the following space, so the lattice falls apart into chunks. The distinct chunks of a block of texts
share one lattice, kept as arrays: both passes take a step for all of them at once. A block has at most `BLOCK` chunks,
and a long text runs over many.

Nothing is normalized: spaces are the model's space mark, characters without a piece (the mark itself, line ends) are
byte pieces; so decoding gives back every text exactly. Null texts count as empty and have no pieces; a null key is the
seed of the text "null". Repeated rows give repeated results; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.llm.common import read

MARK = "▁"
#: Chunks that are sampled together.
BLOCK = 400_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Sampler:
    def __init__(self, model_file: str, theta: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.weight, self.out, self.byte = {}, [b""] * n, [-1] * 256
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[1:-1], 16)] = i
                self.out[i] = bytes([int(p[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.weight[p] = (i, (1.0 - sp.get_score(i)) ** -theta)
                self.out[i] = p.replace(MARK, " ").encode()
        if any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in self.weight):
            raise ValueError("pieces must stop at spaces and line ends")
        self.chunks = re.compile(" *[^ \n]+| +|\n+").findall
        self._trie()

    def _trie(self) -> None:
        """Edges of the trie of all pieces as sorted keys (node, character) and the nodes they lead to; node 0 is the root."""
        nodes, self.piece, self.log_weight = {"": 0}, [-1], [0.0]
        edges = {}
        for p, (i, w) in self.weight.items():
            p = p.replace(MARK, " ")
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    self.piece.append(-1)
                    self.log_weight.append(0.0)
                    edges[nodes[p[: k - 1]] << 21 | ord(p[k - 1])] = nodes[p[:k]]
            self.piece[nodes[p]], self.log_weight[nodes[p]] = i, np.log(w)
        self.piece, self.log_weight = np.array(self.piece, np.int32), np.array(self.log_weight)
        self.keys = np.array(sorted(edges), np.int64)
        self.next = np.array([edges[k] for k in self.keys.tolist()], np.int32)
        self.inner = np.zeros(len(nodes), bool)
        self.inner[self.keys >> 21] = True
        self.first = np.zeros(0x110000, np.int32)
        top = self.keys < (1 << 21)
        self.first[self.keys[top]] = self.next[top]

    def lattice(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """(end node of each chunk, its length, first edge into each node, start and piece of each edge, running sum of shares).

        A node stands before each character of the chunks, which line ends part; edges are ordered by the node they
        lead to. A piece below 0 stands for a character that is spelt in bytes.
        """
        length = np.fromiter(map(len, chunks), np.int64, len(chunks))
        code = np.frombuffer(("\n".join(chunks) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(length + 1) - length - 1
        depth = np.arange(len(code)) - np.repeat(begin, length + 1)
        at = np.arange(len(code))
        node, parts, k = self.first[code], [], 1
        while True:  # all pieces from every place, a character at a time
            alive = np.flatnonzero(node)
            if not len(alive):
                break
            at, node = at[alive], node[alive]
            whole = np.flatnonzero(self.piece[node] >= 0)
            parts.append((at[whole], at[whole] + k, self.piece[node[whole]], self.log_weight[node[whole]]))
            inner = np.flatnonzero(self.inner[node])
            at, node = at[inner], node[inner]
            key = node.astype(np.int64) << 21 | code[at + k]  # a line end follows every chunk, and no piece goes on with it
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            node = np.where(self.keys[found] == key, self.next[found], 0)
            k += 1
        into = np.zeros(len(code), bool)
        into[begin] = True
        for p in parts:
            into[p[1]] = True
        alone = np.flatnonzero(~into)  # the character before has no piece that ends here
        parts.append((alone - 1, alone, -1 - code[alone - 1], np.zeros(len(alone))))
        start, end, piece, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.argsort(end, kind="stable")
        start, end, piece, weight = start[by], end[by], piece[by], weight[by]
        first = np.searchsorted(end, np.arange(len(code) + 1))
        # forward: all nodes of a depth at once
        total, order = np.zeros(len(code)), np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, int(length.max(initial=0)) + 2))
        for x, y in zip(cuts, cuts[1:], strict=False):
            nodes = order[x:y]
            n = first[nodes + 1] - first[nodes]
            head = np.cumsum(n) - n
            e = np.repeat(first[nodes] - head, n) + np.arange(int(n.sum()))
            v = total[start[e]] + weight[e]
            most = np.maximum.reduceat(v, head)
            total[nodes] = most + np.log(np.add.reduceat(np.exp(v - np.repeat(most, n)), head))
        share = np.cumsum(np.exp(total[start] + weight - total[end]))
        return begin + length, length, first, start, piece, share

    def _sample(self, chunks: list[str], seed: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all chunks in order, how many each has); seed and number in its text of each chunk."""
        distinct = list(dict.fromkeys(chunks))
        which = np.fromiter(map(dict(zip(distinct, range(len(distinct)), strict=True)).__getitem__, chunks), np.int64, len(chunks))
        end, length, first, start, piece, share = self.lattice(distinct)
        spread = int(np.diff(first).max(initial=1) - 1).bit_length()
        node, active = end[which], np.arange(len(which))
        origin = node - length[which]
        key = (seed.astype(np.uint64) + _A) * _B ^ number.astype(np.uint64) * _A
        key = (key ^ key >> np.uint64(29)) * _C
        n, steps = np.zeros(len(which), np.int64), []
        while len(active):
            at = node[active]
            low, high = first[at], first[at + 1]
            x = (key[active] ^ (at - origin[active]).astype(np.uint64) * _C) * _B
            x = (x ^ x >> np.uint64(31)) * _A
            u = (x >> np.uint64(11)).astype(np.float64) * 2.0**-53
            below = np.where(low > 0, share[low - 1], 0.0)
            u = below + u * (share[high - 1] - below)
            e, last = low.copy(), high - 1
            for _ in range(spread):  # the first edge with a larger running sum, or the last one
                middle = (e + last) >> 1
                less = (share[middle] <= u) & (e < last)
                e, last = np.where(less, middle + 1, e), np.where(less, last, middle)
            steps.append((active, piece[e]))
            n[active] += 1
            node[active] = start[e]
            active = active[start[e] != origin[active]]
        out, last = np.empty(int(n.sum()), np.int64), np.cumsum(n) - 1
        for k, (a, p) in enumerate(steps):
            out[last[a] - k] = p
        return out, n

    def encode_all(self, texts: list[str], seeds: list[int]) -> list[np.ndarray]:
        """The pieces of each text, as little-endian unsigned 32-bit numbers."""
        chunks, counts, made = [], [], []
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if chunks:
                number = np.concatenate([np.arange(x, x + c) for _, x, c in counts])
                parts.append(self._sample(chunks, np.repeat(np.array([s for s, _, _ in counts], np.int64), [c for _, _, c in counts]), number))
            chunks.clear()
            counts.clear()

        for t, s in zip(texts, seeds, strict=True):
            c = self.chunks(t)
            made.append(len(c))
            for x in range(0, len(c), BLOCK):
                chunks += c[x : x + BLOCK]
                counts.append((s, x, len(c[x : x + BLOCK])))
                if len(chunks) >= BLOCK:
                    flush()
        flush()
        pieces, n = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
        ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum(made)].tolist() if made else []
        single = np.flatnonzero((pieces < 0) & (pieces >= -128))
        pieces[single] = np.array(self.byte[:128], np.int64)[-1 - pieces[single]]
        return [self._spelt(pieces[x:y]) for x, y in zip([0, *ends], ends, strict=False)]

    def _spelt(self, pieces: np.ndarray) -> np.ndarray:
        """With byte pieces in place of characters."""
        if len(pieces) and pieces.min() < 0:
            spell = {p: [self.byte[b] for b in chr(-1 - p).encode("utf-8", "surrogatepass")] for p in np.unique(pieces[pieces < 0]).tolist()}
            pieces = np.array([i for p in pieces.tolist() for i in ((p,) if p >= 0 else spell[p])], np.int64)
        return pieces.astype("<u4")

    def encode(self, text: str, seed: int) -> list[int]:
        return self.encode_all([text], [seed])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        out = self.out
        return b"".join([out[i] for i in ids]).decode("utf-8", "surrogatepass")


_samplers: dict = {}


def sampler(model_file: str, theta: float) -> Sampler:
    if (model_file, theta) not in _samplers:
        _samplers[model_file, theta] = Sampler(model_file, theta)
    return _samplers[model_file, theta]


def seed_of(key) -> int:
    return zlib.crc32(("null" if key is None else str(key)).encode())


def _mapped(df: DataFrame, columns: list, schema: str, names: list[str], each) -> DataFrame:
    """each(batch) gives the columns after the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *each(b)], names)

    return df.select(*columns).mapInArrow(run, schema)


def sample_pieces(docs: DataFrame, model_file: str, theta: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): a sampled encoding of every row."""

    def each(b):
        ids = sampler(model_file, theta).encode_all(b.column(1).to_pylist(), [seed_of(k) for k in b.column(0).to_pylist()])
        return [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]

    return _mapped(docs, [key, F.coalesce(text, F.lit("")).alias("text")], f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>", [key, "ids"], each)


def decode_pieces(encoded: DataFrame, model_file: str, theta: float = 1.0, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the texts that were encoded; null ids give a null text."""

    def each(b):
        s = sampler(model_file, theta)
        return [pa.array([None if x is None else s.decode(x) for x in b.column(1).to_pylist()], pa.string())]

    return _mapped(encoded, [key, ids], f"`{key}` {encoded.schema[key].dataType.simpleString()}, text string", [key, "text"], each)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids) and whether decoding gives the text back, of every document."""
    import public_tokenizers

    file = public_tokenizers.path("piece_bpe_32k.model")

    def each(b):
        s, texts, n, crc, same = sampler(file, 1.0), b.column(1).to_pylist(), [], [], []
        for t, ids in zip(texts, s.encode_all(texts, [seed_of(k) for k in b.column(0).to_pylist()]), strict=True):
            n.append(len(ids))
            crc.append(zlib.crc32(ids.tobytes()))
            same.append(s.decode(ids.tolist()) == t)
        return [pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)]

    docs = read(spark, sf_dir, "documents")
    return _mapped(docs, ["doc_id", F.coalesce("text", F.lit("")).alias("text")], "doc_id long, n_pieces long, ids_crc32 long, lossless boolean", ["doc_id", "n_pieces", "ids_crc32", "lossless"], each)
