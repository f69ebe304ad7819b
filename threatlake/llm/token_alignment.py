"""Operator 12: alignment of two tokenizers over whole texts, by interval tables in DuckDB.

A is a byte-level BPE over a space and the text, B a SentencePiece model over the text, which puts that space in front
itself; neither gets special tokens. Byte offsets where tokens of both end are cuts, and what lies between two cuts is a
group. An ASOF join of the two interval tables finds the cuts, window sums number the groups, and a range join within
each group finds the tokens that overlap; those that end together are links. Each Arrow partition does this in its own
DuckDB and counts its links by pair of ids; Spark merges these partial counts. A second pass gives each document the sums
over its links.

Both tokenizers always break between a character that is no white space and a following space, and what is left and
right of such a joint is encoded alike on its own: the pre-tokens of A end there, and no piece of B holds such a joint
(checked when the model is loaded). So a worker encodes and aligns each distinct chunk between joints once, and a
document is a list of chunks. A document with a chunk whose token bytes differ from the text is aligned as one chunk.

The table of pair counts is broadcast. Its size does not grow with the documents: two tokens that end together are a
token and one of its byte suffixes, so there are at most as many pairs as the two vocabularies have such suffixes
(324,302 for the two of the query).

Null and empty texts, and texts whose tokens' bytes differ from the space and the text, have no tokens: zeros and an
empty digest. Repeated rows give repeated results and count each time; a null key stays null; an empty table gives an
empty one; columns other than the key and the text are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.llm.common import read

#: Bytes of texts that are worked on together (at least one text), characters of chunks that a worker keeps, and chunks encoded as one text.
TOGETHER, KEPT, BLOCK = 6_000_000, 10_000_000, 256
#: How byte-level tokenizers of this kind cut a text before they merge (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Up to here all Unicode versions agree on what letters, numbers and white space are.
_settled = re.compile("[\x00-\u024f]*").fullmatch
_joint = re.compile(r"(?<=\S)(?= )").split
#: White space in front of a space: only then a space is no joint.
_DOUBLE = [c + " " for c in map(chr, range(0x3001)) if c.isspace()]


def chunks(text: str) -> list[str]:
    """The text between joints, each chunk without the space it begins with."""
    if any(x in text for x in _DOUBLE) or text.startswith(" "):
        return [c[1:] for c in _joint(" " + text)]
    return text.split(" ")


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens:
    """Both tokenizers and the bytes of each of their tokens."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.fast = self._fast(a_file)
        self.b = sp = sentencepiece.SentencePieceProcessor(model_file=b_file)
        byte = byte_level()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for t, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any(re.search("[^▁]▁", p) for i, p in enumerate(pieces) if not sp.is_control(i)):
            raise ValueError("the chunks need pieces that stop at spaces")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = np.array([*map(len, self.a_bytes)]), np.array([*map(len, self.b_bytes)])

    def _fast(self, a_file: str):
        """A quicker encoder of the same merges: where ids are in the order of the merges, the lowest id merges first."""
        import json

        import tiktoken

        with open(a_file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        cut = spec["pre_tokenizer"]
        byte = byte_level()
        if spec["normalizer"] or cut["type"] != "ByteLevel" or not cut["use_regex"] or any(vocab["".join(m)] != 256 + i for i, m in enumerate(merges)):
            return None
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def a_ids(self, text: str) -> list[int]:
        """The ids of A."""
        if self.fast and _settled(text):
            return self.fast.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def most_pairs(self) -> int:
        """How many pairs of tokens there are of which one's bytes end with the other's."""
        tails = lambda xs: [x[k:] for x in xs for k in range(len(x))]
        count = lambda xs: dict(zip(*np.unique(np.array(xs, object), return_counts=True), strict=True))
        a, b = count(self.a_bytes), count(self.b_bytes)
        return int(sum(b.get(t, 0) for t in tails(self.a_bytes)) + sum(a.get(x[k:], 0) for x in self.b_bytes for k in range(1, len(x))))

    def encode(self, found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(good, ids of A, their number by chunk, ids of B, their number by chunk) of chunks; good are those whose bytes are right, and only these have ids.

        Chunks that don't end in white space are encoded BLOCK at a time as one text, as the joints between them allow.
        """
        solid: tuple[list, list] = [], []
        groups = []
        for k, c in enumerate(found):
            if c and not c[-1].isspace():
                solid[_settled(c) is None].append(k)
            else:
                groups.append([k])
        groups += [x[i : i + BLOCK] for x in solid for i in range(0, len(x), BLOCK)]
        out, good = [], []
        while groups:
            group = groups.pop()
            text = " ".join(map(found.__getitem__, group))
            want = (" " + text).encode("utf-8", "surrogatepass")
            ids = self.a_ids(" " + text), self.b.encode(text)
            if b"".join(map(self.a_bytes.__getitem__, ids[0])) == want == b"".join(map(self.b_bytes.__getitem__, ids[1])):
                ends = np.cumsum([len(found[k].encode("utf-8", "surrogatepass")) + 1 for k in group])
                counts = []
                for x, size in zip(ids, (self.a_size, self.b_size), strict=True):
                    last = np.searchsorted(np.cumsum(size[x]), ends, side="right")
                    counts.append(np.diff(last, prepend=0))
                out.append((ids, counts))
                good += group
            elif len(group) > 1:
                groups += [[k] for k in group] if len(group) <= 16 else [group[i::16] for i in range(16)]
        flat = lambda i: np.fromiter(chain.from_iterable(x[i] for x, _ in out), np.int32)
        number = lambda i: np.concatenate([n[i] for _, n in out]) if out else np.zeros(0, np.int64)
        return np.array(good, np.int32), flat(0), number(0), flat(1), number(1)


#: Interval tables a and b of aligned chunks (k: number, c: chunk, id, s, e: bytes from the first chunk's first on) to `grouped_a`, `grouped_b`.
GROUPS = """
CREATE OR REPLACE TEMP TABLE grouped_{0} AS
SELECT k, c, id, s, e, CAST(sum(cut) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) - cut AS g
FROM (SELECT x.*, CAST(x.e = y.e AS INT) AS cut FROM {0} x ASOF JOIN {1} y ON x.e <= y.e)
"""
OVERLAPS = """
CREATE OR REPLACE TEMP TABLE overlap AS
SELECT x.c, x.g, x.id AS a, y.id AS b, x.e = y.e AS linked FROM grouped_a x JOIN grouped_b y ON x.g = y.g AND x.s < y.e AND y.s < x.e
"""
LINKS = "INSERT INTO link SELECT c, a, b, count(*) FROM overlap WHERE linked GROUP BY ALL"
#: Sums over a chunk's links and overlaps.
CHUNKS = """
SELECT c, count(*) AS n_overlaps, count(*) FILTER (linked) AS n_links, count(*) FILTER (linked AND best) AS n_best, CAST(coalesce(sum(n) FILTER (linked), 0) AS BIGINT) AS count_sum
FROM overlap LEFT JOIN pair USING (a, b) GROUP BY c ORDER BY c
"""
COUNTS = "SELECT a, b, CAST(sum(link.n * used.n) AS BIGINT) AS n FROM used JOIN link USING (c) GROUP BY a, b"
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_best", "count_sum")


class Aligner:
    """A worker's chunks and their alignments, in a DuckDB of its own."""

    def __init__(self, tokens: Tokens, pairs: pa.Table | None = None):
        import duckdb

        self.tokens = tokens
        ids = [str(i) for i in range(max(len(tokens.a_bytes), len(tokens.b_bytes)))]
        self.decimal = [np.array([i + x for i in ids], object) for x in (",", "|", ";")]
        self.db = db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        db.execute("CREATE TABLE pair(a INT, b INT, n BIGINT, best BOOLEAN)")
        if pairs is not None:
            db.register("given", pairs)
            db.execute("INSERT INTO pair SELECT a, b, n, n = max(n) OVER (PARTITION BY b) FROM given")
            db.unregister("given")
        self.clear()

    def clear(self) -> None:
        """Forgets all chunks."""
        self.number: dict[str, int] = {}
        self.bad: set[int] = set()
        self.size, self.used = 0, np.zeros(0, np.int64)
        self.sums, self.groups = np.zeros((0, len(SUMS)), np.int64), []
        self.db.execute("CREATE OR REPLACE TABLE link(c INT, a INT, b INT, n BIGINT)")

    def learn(self, new: list[str]) -> None:
        """Aligns chunks that weren't seen before."""
        first, t = len(self.number), self.tokens
        self.number.update(zip(new, range(first, first + len(new)), strict=True))
        self.size += sum(map(len, new))
        good, *ids = t.encode(new)
        self.bad.update(first + k for k in set(range(len(new))).difference(good.tolist()))
        sums, groups = np.zeros((len(new), len(SUMS)), np.int64), [""] * len(new)
        if len(good):
            for name, flat, n, size in (("a", *ids[:2], t.a_size), ("b", *ids[2:], t.b_size)):
                end = np.cumsum(size[flat])
                self.db.register(name, pa.table({"k": np.arange(len(flat)), "c": np.repeat(good + first, n), "id": flat, "s": end - size[flat], "e": end}))
            for sql in (GROUPS.format("a", "b"), GROUPS.format("b", "a"), OVERLAPS, LINKS):
                self.db.execute(sql)
            got = self.db.sql(CHUNKS).to_arrow_table()
            at = got.column("c").to_numpy() - first
            for i, x in enumerate(SUMS[3:]):
                sums[at, i + 3] = got.column(x).to_numpy()
            in_group = [self.db.sql(f"SELECT g FROM grouped_{x} ORDER BY k").to_arrow_table().column(0).to_numpy() for x in "ab"]
            self.spell(good, ids, in_group, sums, groups)
        self.sums = np.concatenate([self.sums, sums])
        self.groups += groups

    def spell(self, good: np.ndarray, ids: list[np.ndarray], in_group: list[np.ndarray], sums: np.ndarray, groups: list[str]) -> None:
        """Numbers of tokens and groups, and the groups as text, a1,a2|b1;a3|b2,b3, of each chunk."""
        (a, n_a, b, n_b), (ga, gb) = ids, in_group
        last = lambda g: np.append(g[1:] != g[:-1], True)
        # a group's tokens of A come before its tokens of B
        parts = np.empty(len(a) + len(b), object)
        at_a = np.arange(len(a)) + np.searchsorted(gb, ga, side="left")
        at_b = np.arange(len(b)) + np.searchsorted(ga, gb, side="right")
        parts[at_a] = np.where(last(ga), self.decimal[1][a], self.decimal[0][a])
        parts[at_b] = np.where(last(gb), self.decimal[2][b], self.decimal[0][b])
        parts, end = parts.tolist(), np.cumsum(n_a + n_b).tolist()
        for k, x, y in zip(good.tolist(), [0, *end], end):
            groups[k] = "".join(parts[x:y])[:-1]
        sums[good, 0], sums[good, 1] = n_a, n_b
        sums[good, 2] = np.diff(np.append(ga, ga[-1] + 1)[np.append(0, np.cumsum(n_a))])

    def numbered(self, flat: pa.Array) -> np.ndarray:
        """The numbers of chunks."""
        found = flat.dictionary_encode()
        distinct = found.dictionary.to_pylist()
        new = [c for c in distinct if c not in self.number]
        if new:
            self.learn(new)
        return np.fromiter(map(self.number.__getitem__, distinct), np.int32, len(distinct))[found.indices.to_numpy()]

    def place(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(chunks of all texts, their number in each text) of whole texts.

        A text with a chunk that can't be aligned is one chunk, and has no tokens if that can't be either.
        """
        plain = texts.to_pylist()
        odd = [k for k, t in enumerate(plain) if t and (t[0] == " " or any(x in t for x in _DOUBLE))]
        lists = pc.split_pattern(texts, " ")
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        n[[k for k, t in enumerate(plain) if not t]] = 0
        if odd or (n == 0).any():
            n[odd] = 0
            mine = [chunks(plain[k]) for k in odd]
            regular = lists.filter(pa.array(n > 0)).flatten()
            found = self.numbered(pa.concat_arrays([regular, pa.array([c for x in mine for c in x], regular.type)]))
            each = np.split(found, np.cumsum([*n[n > 0], *map(len, mine)])[:-1]) if len(found) else []
            order = {k: i for i, k in enumerate([*np.flatnonzero(n > 0).tolist(), *odd])}
            parts = [each[order[k]] if k in order else found[:0] for k in range(len(n))]
        else:
            found = self.numbered(lists.flatten())
            parts = np.split(found, np.cumsum(n)[:-1])
        if self.bad:
            bad = np.fromiter(self.bad, np.int32, len(self.bad))
            for k in [k for k, x in enumerate(parts) if np.isin(x, bad).any()]:
                whole = self.numbered(pa.array([plain[k]], pa.string()))
                parts[k] = whole[:0] if int(whole[0]) in self.bad else whole
        return np.concatenate(parts), np.array([*map(len, parts)])

    def count(self, texts: pa.Array) -> None:
        """Adds the texts' chunks to those used."""
        found, _ = self.place(texts)
        used = np.bincount(found, minlength=len(self.number))
        used[: len(self.used)] += self.used
        self.used = used

    def counted(self) -> pa.Table:
        """(a, b, n) of all links of the chunks used."""
        at = np.flatnonzero(self.used)
        self.db.register("used", pa.table({"c": at.astype(np.int32), "n": self.used[at]}))
        out = self.db.sql(COUNTS).to_arrow_table()
        self.used[:] = 0
        return out

    def documents(self, texts: pa.Array) -> list[pa.Array]:
        """SUMS and groups_sha256 of each text."""
        found, n = self.place(texts)
        end = np.cumsum(n)
        total = np.zeros((len(n), len(SUMS)), np.int64)
        if len(found):
            some = n > 0
            total[some] = np.add.reduceat(self.sums[found], (end - n)[some], axis=0)
        spelled = list(map(self.groups.__getitem__, found.tolist()))
        digest = lambda x, y: hashlib.sha256(";".join(spelled[x:y]).encode()).hexdigest() if x < y else ""
        sha = [digest(x, y) for x, y in zip((end - n).tolist(), end.tolist(), strict=True)]
        return [*(pa.array(c) for c in total.T), pa.array(sha, pa.string())]


def together(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of texts of about TOGETHER bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, before + TOGETHER, side="right")))
        yield texts.slice(first, last - first)
        first = last


#: A worker has one aligner at a time, for the pass it works on.
_current: dict[tuple, Aligner] = {}


def aligner(files: tuple[str, str], version: str, pairs=None) -> Aligner:
    if (files, version) not in _current:
        tokens = next((x.tokens for (f, _), x in _current.items() if f == files), None) or Tokens(*files)
        _current.clear()
        _current[files, version] = Aligner(tokens, pairs() if pairs else None)
    return _current[files, version]


def pair_counts(docs: DataFrame, files: tuple[str, str], text: str = "text") -> DataFrame:
    """(a, b, n): how many links of all documents have the ids a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = aligner(files, "counts")
        x.used[:] = 0  # what a task that ended early left
        for b in batches:
            for part in together(b.column(0)):
                x.count(part)
                if x.size > KEPT:
                    yield from x.counted().to_batches()
                    x.clear()
        yield from x.counted().to_batches()

    return docs.select(text).mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def alignments(docs: DataFrame, pairs: DataFrame, files: tuple[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, SUMS, groups_sha256) of every row; pairs are those of pair_counts over the corpus."""
    # bounded by the vocabularies, see above
    t = pairs.select("a", "b", "n").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    shared = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    version = uuid.uuid4().hex
    names = [key, *SUMS, "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = aligner(files, version, lambda: pa.ipc.open_stream(shared.value).read_all())
        for b in batches:
            at = 0
            for part in together(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), *x.documents(part)], names)
                at += len(part)
                if x.size > KEPT:
                    x.clear()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {', '.join(f'{x} long' for x in SUMS)}, groups_sha256 string")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, groups and links, and how common its links' pairs are in all documents."""
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    docs = read(spark, sf_dir, "documents")
    out = alignments(docs, pair_counts(docs, files), files)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
