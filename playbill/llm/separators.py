"""Token counts of documents in flat files of token ids that have no index."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playbill.llm import files
from playbill.llm.store import written
from playbill.session import fresh_path

#: Bytes of a file that a task searches at once.
BLOCK = 1 << 22


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _write(folder: str, path: str, pattern: str, end: int, kind: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first = files.new_name(folder, TaskContext.get().partitionId()), 0
        with files.writing(name) as out:
            for batch in batches:
                encode, tail = _encoding(path, pattern).encode_ordinary, np.array([end], dtype=kind).tobytes()
                for text in batch.column("text"):
                    out.write(np.array(encode(text.as_py() or ""), dtype=kind).tobytes() + tail)
                ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id"))
                yield pa.record_batch([pa.array([name]), pa.array([first], pa.int64()), ids], names=["path", "first", "doc_ids"])
                first += batch.num_rows

    return run


def write(documents: DataFrame, path: str, pattern: str, end: int, kind: str = "<u2") -> DataFrame:
    """Write each partition's texts, tokenised with the rank file at ``path`` and ended by the id ``end``, as one flat
    file of integers of the numpy type ``kind``. Gives which documents a file has, in order: ``path``, ``first``
    (place of the first in the file) and ``doc_ids``. The files themselves know nothing of documents.

    Null and empty texts have the end id alone; rows may repeat and ids be null. No shuffle."""
    folder = fresh_path(documents.sparkSession, "flat")
    rows = documents.select("doc_id", "text").mapInArrow(_write(folder, path, pattern, end, kind), "path string, first long, doc_ids array<long>")
    return written(rows, "contents")


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = []
        for path in batch.column("path").to_pylist():
            with files.reading(path) as f:
                sizes.append(f.size())
        yield pa.record_batch([batch.column("path"), pa.array(sizes, pa.int64())], names=["path", "bytes"])


def _searched(end: int, kind: str) -> Callable:
    wide = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, at, size in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "size")), strict=True):
                with files.reading(path) as f:
                    tokens = np.frombuffer(f.read_at(size, at), dtype=kind)
                ends = np.flatnonzero(tokens == end) + at // wide
                out.append((path, at // wide, len(tokens), len(ends), ends[0] if len(ends) else None, ends[-1] if len(ends) else None, np.diff(ends) - 1))
            columns = list(zip(*out, strict=True))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["path", "at", "n", "found", "first", "last", "inner"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def scan(paths: DataFrame, end: int, kind: str = "<u2", block: int = BLOCK) -> DataFrame:
    """Documents of the flat files in ``path``: ``path``, ``place`` (of the document in its file, from 0), ``start`` (its first
    token's place in the file), ``n_tokens`` (end id not counted) and ``ended`` (false for tokens after a file's last end id).

    Files are cut into blocks of ``block`` bytes, and each is searched for ``end`` by itself, as one array. A
    prefix scan over a file's blocks then gives every block how many documents ended before it and where
    the last of them did, and so the length of the document that began in an earlier block, over however
    many blocks. A file without tokens has no documents; a path may not be null; block sizes are rounded to whole tokens."""
    wide = np.dtype(kind).itemsize
    step = max(wide, block // wide * wide)
    sized = paths.select("path").distinct().mapInArrow(_sized, "path string, bytes long").where(f"bytes >= {wide}")
    blocks = sized.select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - {wide}, {step}L)")).alias("at"))
    # With a number of partitions, which rows as small as these would otherwise be merged into one.
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = blocks.select("path", "at", F.least(F.lit(step), F.col("bytes") - F.col("at")).alias("size")).repartition(parts, "path", "at")
    found = written(
        cut.mapInArrow(_searched(end, kind), "path string, at long, n long, found long, first long, last long, inner array<long>"), "blocks"
    )
    earlier = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    file = Window.partitionBy("path")
    scanned = found.select(
        "*",
        F.coalesce(F.sum("found").over(earlier), F.lit(0)).alias("before"),
        (F.coalesce(F.max("last").over(earlier), F.lit(-1)) + 1).alias("open"),
        F.max(F.col("at") + F.col("n")).over(file).alias("tokens"),
        (F.coalesce(F.max("last").over(file), F.lit(-1)) + 1).alias("tail"),
        F.sum("found").over(file).alias("all_found"),
    )
    lengths = F.expr("case when found > 0 then concat(array(first - open), inner) end")
    ended = scanned.where("found > 0").select("path", "before", "open", F.posexplode(lengths).alias("k", "n_tokens"))
    sums = F.sum(F.col("n_tokens") + 1).over(Window.partitionBy("path", "before").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    whole = ended.select("path", (F.col("before") + F.col("k")).alias("place"), (F.col("open") + F.coalesce(sums, F.lit(0))).alias("start"), "n_tokens", F.lit(True).alias("ended"))
    rest = scanned.where("at = 0 and tail < tokens").select(
        "path", F.col("all_found").alias("place"), F.col("tail").alias("start"), (F.col("tokens") - F.col("tail")).alias("n_tokens"), F.lit(False).alias("ended")
    )
    return whole.unionAll(rest)


def counts(contents: DataFrame, end: int, kind: str = "<u2", block: int = BLOCK) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of the documents that ``write`` reported, found in their files alone."""
    named = contents.select("path", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("path", (F.col("first") + F.col("k")).alias("place"), "doc_id")
    return named.join(scan(contents, end, kind, block), ["path", "place"]).select("doc_id", "n_tokens")
