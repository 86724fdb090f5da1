"""Token ids in files of patched frame-of-reference blocks."""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playbill.llm import files
from playbill.llm.store import written
from playbill.session import fresh_path

#: Ids of a block, and the share of them that its width covers at least.
BLOCK, COVERED = 128, 0.9
#: Ids of a frame at least (a frame holds whole documents); bounds what a task holds.
FRAME = 1 << 20
#: Encoded words that a worker remembers.
REMEMBERED = 1_000_000

_MAGIC = b"PFOR"
_HEAD = struct.Struct("<4sQQQ")  # magic, documents, ids, bytes of the payload


def pack(values: np.ndarray) -> bytes:
    """Blocks of unsigned 32-bit integers: the least value, the width in bits and the number of exceptions of
    every block, the start of each, then the blocks. A block's values less its least are packed at
    the width that covers ``COVERED`` of them; the others stand in its exception list, place and value."""
    n = len(values)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, values[-1] if n else 0, dtype=np.uint32)
    grid[:n] = values
    grid = grid.reshape(blocks, BLOCK)
    least = grid.min(axis=1)
    grid = grid - least[:, None]
    covering = np.partition(grid, int(BLOCK * COVERED) - 1, axis=1)[:, int(BLOCK * COVERED) - 1]
    width = np.ceil(np.log2(covering.astype(np.float64) + 1)).astype(np.uint8)
    beyond = grid.astype(np.uint64) >> width[:, None].astype(np.uint64) > 0
    count = beyond.sum(axis=1).astype(np.uint8)
    size = width.astype(np.int64) * (BLOCK // 8) + count.astype(np.int64) * 5
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        if w:
            low = grid[own] & np.uint32((1 << int(w)) - 1)
            out[start[own][:, None] + np.arange(int(w) * BLOCK // 8)] = _bits(low, int(w))
    row, place = np.nonzero(beyond)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(count, dtype=np.int64) - count, count)
    after = (start + width.astype(np.int64) * (BLOCK // 8))[row]
    out[after + rank] = place
    values_at = (after + count[row])[:, None] + rank[:, None] * 4 + np.arange(4)
    out[values_at] = grid[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return b"".join((least.astype("<u4").tobytes(), width.tobytes(), count.tobytes(), start.astype("<u8").tobytes(), out.tobytes()))


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """Each row's values, ``width`` bits each, lowest first."""
    if width in (8, 16, 32):
        return values.astype(f"<u{width // 8}").view(np.uint8).reshape(len(values), -1)
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(len(values), BLOCK, 4), axis=2, bitorder="little")
    return np.packbits(bits[:, :, :width].reshape(len(values), -1), axis=1, bitorder="little")


def _unbits(packed: np.ndarray, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.ascontiguousarray(packed).view(f"<u{width // 8}").astype(np.uint32)
    bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), BLOCK, width)
    whole = np.zeros((len(packed), BLOCK, 32), dtype=np.uint8)
    whole[:, :, :width] = bits
    return np.packbits(whole, axis=2, bitorder="little").view("<u4").reshape(len(packed), BLOCK)


def unpack(data: bytes, n: int) -> np.ndarray:
    """The ``n`` values that ``pack`` wrote."""
    blocks = -(-n // BLOCK)
    least = np.frombuffer(data, "<u4", blocks)
    width = np.frombuffer(data, np.uint8, blocks, 4 * blocks)
    count = np.frombuffer(data, np.uint8, blocks, 5 * blocks).astype(np.int64)
    start = np.frombuffer(data, "<u8", blocks, 6 * blocks).astype(np.int64)
    body = np.frombuffer(data, np.uint8, offset=14 * blocks)
    grid = np.zeros((blocks, BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        if w:
            grid[own] = _unbits(body[start[own][:, None] + np.arange(int(w) * BLOCK // 8)], int(w))
    row = np.repeat(np.arange(blocks), count)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    after = (start + width.astype(np.int64) * (BLOCK // 8))[row]
    values = body[(after + count[row])[:, None] + rank[:, None] * 4 + np.arange(4)]
    grid[row, body[after + rank]] = np.ascontiguousarray(values).view("<u4").ravel()
    return (grid + least[:, None]).ravel()[:n]


def frame(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A frame: the documents' ids and numbers of tokens, then the packed tokens."""
    payload = pack(ids)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    head = _HEAD.pack(_MAGIC, len(doc_ids), len(ids), len(payload))
    return b"".join((head, known.tobytes(), names.tobytes(), lengths.astype("<i8").tobytes(), payload))


def frames(f) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Documents' ids, numbers of tokens and tokens of each frame of an open file."""
    while head := f.read(_HEAD.size):
        magic, docs, n, size = _HEAD.unpack(head)
        if magic != _MAGIC:
            raise ValueError("not a file of token blocks")
        known = np.frombuffer(f.read(docs), np.uint8).tolist()
        names = np.frombuffer(f.read(8 * docs), "<i8").tolist()
        lengths = np.frombuffer(f.read(8 * docs), "<i8")
        yield [d if k else None for d, k in zip(names, known, strict=True)], lengths, unpack(f.read(size), n)


class WordEncoder:
    """Texts to ids with a vocabulary whose pieces never span white space: a word is encoded once and then
    remembered, in arrays of bounded size. The tokenizers library gets new words many at a time, as one
    text; the places of its tokens tell which word each belongs to."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def _learn(self, new: list[str]) -> None:
        groups = [new[lo : lo + 256] for lo in range(0, len(new), 256)]
        ids, sizes = [self.ids], [self.sizes]
        for group, found in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            starts = np.cumsum(np.fromiter((len(w) + 1 for w in group), dtype=np.int64, count=len(group)))
            got = found.ids
            place = np.fromiter((o[0] for o in found.offsets), dtype=np.int64, count=len(got))
            ids.append(np.array(got, dtype=np.uint32))
            sizes.append(np.bincount(np.searchsorted(starts, place, side="right"), minlength=len(group)))
        self.known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids."""
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = pc.list_flatten(words).dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self._forget()
        known = self.known
        if new := [w for w in names if w not in known]:
            self._learn(new)
        word = np.fromiter(map(known.__getitem__, names), dtype=np.int64, count=len(names))[coded.indices.to_numpy()]
        many = self.sizes[word]
        ends = np.cumsum(many)
        start = (np.cumsum(self.sizes) - self.sizes)[word] - (ends - many)
        ids = self.ids[np.repeat(start, many) + np.arange(int(ends[-1]) if len(ends) else 0)]
        total = np.r_[0, ends]
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        return total[bounds[1:]] - total[bounds[:-1]], ids


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _write(folder: str, path: str, end: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, held, docs, total = files.new_name(folder, part), [], 0, 0
        with files.writing(name) as out:

            def flush() -> int:
                if not held:
                    return 0
                lengths, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
                out.write(frame([d for h in held for d in h[0]], lengths, ids))
                held.clear()
                return len(ids)

            for batch in batches:
                for lo in range(0, batch.num_rows, 4000):
                    some = batch.slice(lo, 4000)
                    lengths, ids = encoder(path).encode(some.column("text"))
                    ids = np.insert(ids, np.cumsum(lengths), end).astype(np.uint32)
                    held.append((some.column("doc_id").to_pylist(), lengths + 1, ids))
                    docs += some.num_rows
                    if sum(len(h[2]) for h in held) >= FRAME:
                        total += flush()
            total += flush()
        if docs:
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([total], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])

    return run


def write(documents: DataFrame, path: str, end: int) -> DataFrame:
    """Encode ``text`` with the vocabulary file at ``path``, add the id ``end`` to each document and write all, in
    ascending order of ``doc_id`` (nulls first, then by a hash of the text), to files in the shared folder; gives a row for each file:
    ``part`` (its place in that order), ``path``, ``n_docs``, ``n_tokens``.

    Null and empty texts have the id ``end`` alone; rows may repeat; an empty table has no files. A
    file is one range of ids, written frame by frame."""
    folder = fresh_path(documents.sparkSession, "tokens")
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Rows with one id, or none, can be cut into several ranges by a hash of their text.
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text").select("doc_id", "text")
    return written(ordered.mapInArrow(_write(folder, path, end), "part int, path string, n_docs long, n_tokens long"), "files")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            with files.reading(path) as f:
                for names, lengths, ids in frames(f):
                    ends = np.cumsum(lengths)
                    tokens = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                    yield pa.record_batch(
                        [pa.array(names, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(tokens, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    start += len(ids)


def read(written_files: DataFrame) -> DataFrame:
    """Documents of the files that ``write`` reported: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` (end id included) and ``ids`` (little-endian unsigned 32-bit integers)."""
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    placed = written_files.select("path", F.coalesce(before, F.lit(0)).alias("start"))
    # With a number of partitions, which rows as small as these would otherwise be merged into one.
    parts = int(written_files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")
