"""Removal of long word sequences that occur more than once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playbill.llm.arrays import Runs, Words, long, mix, words

#: Bits of the hash that grams are grouped by before the exact count.
CELL_BITS = 48
#: Rows that a task counts at once.
CHUNK = 1 << 21

_ROWS = "key long, text_key long, start int, n int"


def _least(values: np.ndarray, span: int, of=np.minimum) -> np.ndarray:
    """Extreme of each ``span`` neighbouring values, by doubling."""
    width, now = 1, values
    while width < span:
        step = min(width, span - width)
        now = of(now[: len(now) - step], now[step:])
        width += step
    return now


class _Grams:
    """Hashes of the words' grams, and each window's anchor: its smallest gram hash."""

    def __init__(self, w: Words, window: int, gram: int):
        span = window - gram + 1
        self.w, self.span = w, span
        self.runs = Runs(w.hashes)
        left = w.left()
        self.gram = mix(self.runs.of(gram))
        self.whole = left >= window  # words that start a window
        self.anchor = np.zeros(len(w.hashes), dtype=np.uint64)
        if len(self.gram) >= span:
            least = _least(self.gram, span)
            self.anchor[: len(least)] = least
        self.gram = np.concatenate([self.gram, np.zeros(len(w.hashes) - len(self.gram), dtype=np.uint64)])

    def anchors(self) -> np.ndarray:
        """Places whose gram is the anchor of a window that covers it."""
        top = np.zeros(len(self.anchor) + self.span - 1, dtype=np.uint64)
        top[self.span - 1 :] = np.where(self.whole, self.anchor, np.uint64(0))
        any_whole = np.zeros(len(top), dtype=bool)
        any_whole[self.span - 1 :] = self.whole
        if not len(self.anchor):
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero((_least(top, self.span, np.maximum) == self.gram) & _least(any_whole, self.span, np.logical_or))

    def under(self, places: np.ndarray) -> np.ndarray:
        """Windows whose anchor is at one of the places."""
        none = np.iinfo(np.uint64).max
        kept = np.full(len(self.anchor) + self.span - 1, none, dtype=np.uint64)
        kept[places] = self.gram[places]
        return np.flatnonzero(self.whole & (_least(kept, self.span) == self.anchor)) if len(self.anchor) else places


def _merged(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Count a chunk's keys. A key that is here once goes on with its place; of one that is here several
    times the count goes on without a place, and each place under a key of its own with the count 2."""
    key, text, start, many = (np.concatenate(c) for c in zip(*rows, strict=True))
    order = np.argsort(key, kind="stable")
    key, text, start, many = key[order], text[order], start[order], many[order]
    new = np.r_[True, key[1:] != key[:-1]]
    at = np.flatnonzero(new)
    n = np.add.reduceat(many, at)
    size = np.diff(np.r_[at, len(key)])
    known = np.repeat(n >= 2, size)
    own = mix(text.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start.astype(np.uint64))
    once, told = ~known, at[n >= 2]
    nothing = pa.nulls(len(told), pa.int64())
    return pa.record_batch(
        [
            pa.array(np.r_[long(key[once]), long(own[known]), long(key[told])]),
            pa.concat_arrays([pa.array(np.r_[text[once], text[known]]), nothing]),
            pa.concat_arrays([pa.array(np.r_[start[once], start[known]].astype(np.int32)), nothing.cast(pa.int32())]),
            pa.array(np.r_[many[once], np.full(int(known.sum()), 2), np.full(len(told), 2)].astype(np.int32)),
        ],
        names=["key", "text_key", "start", "n"],
    )


def _counted(find: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, ...]]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for batch in batches:
            for found in find(batch):
                rows.append(found)
                n += len(found[0])
                if n >= CHUNK:
                    yield _merged(rows)
                    rows, n = [], 0
        if n:
            yield _merged(rows)

    return run


def _cells(window: int, gram: int) -> Callable:
    shift = np.uint64(64 - CELL_BITS)

    def find(batch: pa.RecordBatch):
        keys, copies = batch.column("text_key").to_numpy(), batch.column("copies").to_numpy()
        for w in words(batch.column("text")):
            g = _Grams(w, window, gram)
            at = g.anchors()
            own = w.owner()[at]
            yield g.gram[at] >> shift, keys[own], at - w.at[own - w.first], np.minimum(copies[own], 2)

    return _counted(find)


def _windows(window: int, gram: int) -> Callable:
    def find(batch: pa.RecordBatch):
        keys, copies, held = batch.column("text_key").to_numpy(), batch.column("copies").to_numpy(), batch.column("starts")
        for w in words(batch.column("text")):
            places = [np.asarray(held[w.first + i].values) + w.at[i] for i in range(w.n) if held[w.first + i].is_valid]
            if not places:
                continue
            g = _Grams(w, window, gram)
            at = g.under(np.concatenate(places))
            own = w.owner()[at]
            yield mix(g.runs.between(at, at + window)), keys[own], at - w.at[own - w.first], np.minimum(copies[own], 2)

    return _counted(find)


def _repeated(rows: DataFrame) -> DataFrame:
    """Starts, gathered by text, whose key is counted more than once over all tasks."""
    total = F.sum("n").over(Window.partitionBy("key"))
    return (
        rows.withColumn("total", total)
        .where("total >= 2 and text_key is not null")
        .groupBy("text_key")
        .agg(F.collect_list("start").alias("starts"))
    )


def _cut(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, out = batch.column("starts"), []
            for i, text in enumerate(batch.column("text")):
                own = text.as_py().encode().split()
                kept, n = own, len(own)
                if held[i].is_valid:
                    edge = np.zeros(n + 1, dtype=np.int32)
                    starts = np.asarray(held[i].values)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                    kept = list(compress(own, (np.cumsum(edge[:-1]) == 0).tolist()))
                out.append((n, n - len(kept), b" ".join(kept).decode()))
            n_words, removed, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch(
                [batch.column("text_key"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["text_key", "n_words", "n_removed", "kept"],
            )

    return run


def cut_repeats(documents: DataFrame, window: int = 35, gram: int = 16, columns: dict[str, Column] | None = None) -> DataFrame:
    """Cut every word that lies in a ``window`` of words which starts at more than one place.

    ``documents`` has ``doc_id`` and ``text``; its rows come back with ``n_words``, ``n_removed`` and
    ``kept`` (the words left, one space between) in place of ``text``, or with ``columns``, made of these.
    Further columns are not read.

    A count of *anchors* goes before the exact count, in place of a count-min sketch: a grouping by 48 bits of
    their hash, through a shuffle. The least gram of a window occurs at least as often
    as the window, and neighbouring windows share it. Tasks count their own part, the
    parts are summed, and windows whose anchor's count stays at 1 are certainly unique. Counts
    only overestimate, so no repeated window is lost. The windows left are counted exactly by a
    64-bit hash. In both counts a task sums its own rows first, so a key has at most one row a chunk.

    Defined results: a null or empty text has no words; a text shorter than the window keeps all of
    them; documents with the same text, under whatever id, are copies and lose every window; an empty table
    gives an empty table. Texts too are told apart by 64 bits of hash.
    """
    named = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    texts = named.groupBy("text_key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    estimated = _repeated(texts.mapInArrow(_cells(window, gram), _ROWS))
    windows = texts.join(estimated, "text_key", "left").mapInArrow(_windows(window, gram), _ROWS)
    cut = texts.join(_repeated(windows), "text_key", "left").mapInArrow(_cut(window), "text_key long, n_words long, n_removed long, kept string")
    # What is asked for is made once a text, before it is handed to the documents.
    wanted = columns or {c: F.col(c) for c in ("n_words", "n_removed", "kept")}
    made = cut.select("text_key", *[c.alias(name) for name, c in wanted.items()])
    return named.select("doc_id", "text_key").join(made, "text_key").drop("text_key")
