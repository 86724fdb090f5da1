"""Byte-level BPE: encoding by a priority queue of merges, decoding by vocabulary strings."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How text is cut before the merges, as the vocabulary file's byte-level scheme defines it.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded pieces that a worker remembers; beyond that it starts anew.
REMEMBERED = 300_000


def _letters() -> dict[int, str]:
    """The letter that stands for each byte in the file: itself if it is printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Bpe:
    """A vocabulary file's merges and strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _letters()
        self.start = [vocab[letters[b]] for b in range(256)]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.merges = {(vocab[x], vocab[y]): (rank, vocab[x + y]) for rank, (x, y) in enumerate(pairs)}
        byte = {c: b for b, c in letters.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: bytes(byte[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in special.items()}
        self.special = {s: np.array([i], dtype="<u4").tobytes() for s, i in special.items()}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, bytes] = {}

    def merged(self, symbols: list[int]) -> list[int]:
        """Merge neighbours until none can be, lowest rank first and the leftmost among equals.

        The symbols are a doubly linked list, the merges that are possible a priority queue. A merge changes
        its neighbours' pairs; their old entries stay in the queue and are skipped when they
        come up, since the symbols at their place no longer make their pair."""
        n, merges = len(symbols), self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(m[0], i, m[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, new, x, y = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != x or j >= n or symbols[j] != y:
                continue
            symbols[i], symbols[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, symbols[k])):
                    heapq.heappush(queue, (m[0], i, m[1], new, symbols[k]))
            h = before[i]
            if h >= 0 and (m := merges.get((symbols[h], new))):
                heapq.heappush(queue, (m[0], h, m[1], symbols[h], new))
        return [s for s in symbols if s >= 0]

    def _piece(self, piece: str) -> bytes:
        ids = self.merged([self.start[b] for b in piece.encode()])
        found = self.known[piece] = np.array(ids, dtype="<u4").tobytes()
        return found

    def _plain(self, text: str) -> bytes:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, out = self.known, self.pieces.findall(text)
        for i, piece in enumerate(out):
            out[i] = known.get(piece) or self._piece(piece)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; strings of special tokens are those tokens."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode(errors="replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _added(path: str, source: str, target: str, kind: pa.DataType, of: Callable[[Bpe], Callable]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = of(load(path))
        for batch in (whole.slice(lo, 1000) for whole in batches for lo in range(0, whole.num_rows, 1000)):
            column = batch.column(source)
            done = pa.array((None if x is None else step(x) for x in column.to_pylist()), kind)
            yield pa.record_batch([*batch.columns, done], names=[*batch.schema.names, target])

    return run


def encode(documents: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``: the whole text's token ids as little-endian unsigned 32-bit integers, by the byte-level BPE
    vocabulary file at ``path`` (on every machine). Strings of special tokens in a text are encoded as those.

    Defined results: a null text has no ids (empty binary), like an empty one; rows may repeat; an empty table
    gives an empty one; other columns stay as they are (one named like ``ids`` is replaced). A text is one
    task's work; only the ids of single pieces are remembered, in a cache of bounded size."""
    rest = documents.drop(ids).withColumn(text, F.coalesce(F.col(text), F.lit("")))
    schema = rest.select("*", F.lit(b"").alias(ids)).schema
    return rest.mapInArrow(_added(path, text, ids, pa.binary(), lambda b: b.encode), schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``: the text of ``ids``, special tokens included; bytes that are no UTF-8 become the replacement
    character; null ids give null. An id outside the vocabulary fails the job."""
    rest = encoded.drop(text)
    schema = rest.select("*", F.lit("").alias(text)).schema
    return rest.mapInArrow(_added(path, ids, text, pa.string(), lambda b: b.decode), schema)
