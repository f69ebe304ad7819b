"""Operator 1: exact token counts at every prefix of a text.

The tokenizer is a SentencePiece BPE model. A BPE encoding has one last piece for each prefix: the only piece that ends
there and that the encoding of what precedes it can be followed by without a merge across the joint. So

    count[i] = count[i - len(last[i])] + 1

is a dynamic program over prefixes, with a memo of which two pieces can stand side by side. No piece of these models
runs from a word into the following space, nor over a character that no piece has, so the program restarts at each
such joint, and the counts of a repeated chunk come from a bounded cache. The result holds for each text the change of
the count at every code point, from which any truncation or budget question is answered without encoding again.

Null texts count as empty, an empty text has no tokens. Repeated rows give repeated results; an empty table gives an
empty one; columns other than the key and the text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.llm.common import read

#: Chunks kept by a worker in each of two generations, and the longest kept one: together about 150 MB.
CACHE_CHUNKS, CACHE_LENGTH = 250_000, 64
#: Characters at a chunk's begin after which the program's state is kept, and most kept states (about 25 MB).
HEAD, HEADS = 5, 40_000
SPACE = "▁"


class PrefixCounter:
    """The dynamic program and its caches, for one SentencePiece BPE model."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        self.pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not special(i)}
        if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces):
            raise ValueError("the program needs pieces that stop at spaces and line ends")
        # lengths of the pieces that end in three characters (those of shorter pieces: in all they have), longest first
        ends: dict[str, set[int]] = {}
        for p in self.pieces:
            ends.setdefault(p[-3:], set()).add(len(p))
        self.ends = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.ok: dict[tuple[str, str], bool] = {}
        self.heads: dict[str, tuple[list, list, list]] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+").findall

    def side_by_side(self, a: str, b: str) -> bool:
        """Whether the model leaves the pieces a and b unmerged when they adjoin."""
        found = self.ok.get((a, b))
        if found is None:
            if len(self.ok) >= 1_000_000:
                self.ok.clear()
            # a line end in front keeps the model's own leading space away from the pieces
            found = self.ok[a, b] = self.sp.encode("\n" + a + b, out_type=str)[2:] == [a, b]
        return found

    def steps(self, chunk: str) -> bytes:
        """The change of the count at each character of a chunk, as signed bytes."""
        pieces, ends, known, side = self.pieces, self.ends, self.ok.get, self.side_by_side
        found = self.heads.get(chunk[:HEAD])
        count, last, steps = map(list.copy, found) if found else ([0], [""], [])
        n = count[-1]
        for i in range(len(count), len(chunk) + 1):
            before = n
            for k in (3, 2, 1):  # pieces of three characters and more, then shorter ones
                for size in ends.get(chunk[i - k : i], ()) if k <= i else ():
                    if size > i:
                        continue
                    j = i - size
                    p = chunk[j:i]
                    if p in pieces:
                        a = last[j]
                        ok = not a or known((a, p))
                        if ok is None:
                            ok = side(a, p)
                        if ok:
                            break
                else:
                    continue
                n = count[j] + 1
                break
            else:  # a character without a piece: its bytes are tokens, and nothing merges with them
                n += len(chunk[i - 1].encode())
                p = ""
            count.append(n)
            last.append(p)
            steps.append((n - before) & 255)
            if i == HEAD:
                if len(self.heads) >= HEADS:
                    self.heads.clear()
                self.heads[chunk[:HEAD]] = count[:], last[:], steps[:]
        return bytes(steps)

    def prefix_steps(self, text: str) -> bytes:
        """The change of the token count at each code point of the text; their running sum is the count."""
        if not text:
            return b""
        new, old, out = self.new, self.old, []
        for c in self.chunks(SPACE + text.replace(" ", SPACE)):
            s = new.get(c)
            if s is None:
                s = old.get(c)
                if s is None:
                    s = self.steps(c)
                if len(c) <= CACHE_LENGTH:
                    new[c] = s
                    if len(new) >= CACHE_CHUNKS:
                        self.old, self.new = new, {}
                        new, old = self.new, self.old
            out.append(s)
        steps = bytearray(b"".join(out))
        steps[1] = (steps[0] + steps[1]) % 256  # the model's own leading space counts with the first character
        return bytes(steps[1:])


_counters: dict[str, PrefixCounter] = {}


def counter(model_file: str) -> PrefixCounter:
    if model_file not in _counters:
        _counters[model_file] = PrefixCounter(model_file)
    return _counters[model_file]


def prefix_token_counts(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, prefix_steps): the text's UTF-8 bytes and tokens, and the count's change at each code point as int8."""
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias("text"))
    names = [key, "n_bytes", "n_tokens", "prefix_steps"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_file)
        for b in batches:
            steps = [c.prefix_steps(t) for t in b.column(1).to_pylist()]
            n = [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps]
            size = pc.cast(pc.binary_length(b.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64()), pa.array(steps, pa.binary())], names)

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, prefix_steps binary")


def fits_budget(counts: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """(key, keep_chars): the longest prefix, in code points, of at most so many tokens; from prefix_token_counts alone."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for s in b.column(1).to_pylist():
                within = np.flatnonzero(np.cumsum(np.frombuffer(s, np.int8), dtype=np.int64) <= budget)
                keep.append(int(within[-1]) + 1 if len(within) else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keep, pa.int64())], [key, "keep_chars"])

    kind = counts.schema[key].dataType.simpleString()
    return counts.select(key, "prefix_steps").mapInArrow(fit, f"`{key}` {kind}, keep_chars long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    import public_tokenizers

    counts = prefix_token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
