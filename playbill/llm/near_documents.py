"""Near-duplicate documents by BagMinHash over multisets of word shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.llm.arrays import Runs, Words, long, mix, words
from playbill.llm.components import close, link
from playbill.llm.store import free, written

#: Longs of a text's bitmap of shingles.
LONGS = 16

_STRIDE = np.uint64(0x9E3779B97F4A7C15)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of each run of ``k`` words; a text with fewer words has one, of all its words."""
    runs, counts, owner = Runs(w.hashes), w.counts(), w.owner()
    at = np.flatnonzero(w.left() >= k)
    few = np.flatnonzero((counts > 0) & (counts < k))
    start, end = np.r_[at, w.at[few]], np.r_[at + k, w.at[few] + counts[few]]
    return owner[start], mix(runs.between(start, end) + (end - start).astype(np.uint64))


def _counted(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])]) if len(owner) else order
    return owner[new], value[new], np.diff(np.r_[new, len(owner)])


def bag_minhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (``n`` x ``m``) of weighted sets; two agree in a place with the probability of their weighted Jaccard similarity.

    The weights 0 to 1, 1 to 2, 2 to 4, 4 to 8, ... are the intervals of a hierarchy. Each interval of an
    element carries a Poisson process in time, of a rate in proportion to its width, seeded by both
    alone; each point has a place of the signature and a weight inside the interval, and belongs to the
    sets that give the element more than that weight. A place's value is its earliest point. Points are
    made in order of time and only up to the time by which all places are likely to be taken;
    sets with a place still free go on with twice the time. So the work is about one draw an element
    and m log m points a set.
    """
    first, last, seen = np.full(n * m, np.inf), np.zeros(n * m, dtype=np.uint64), np.zeros(n, dtype=bool)
    total = np.bincount(owner, weights=weight, minlength=n)
    horizon = (np.log(m) + 3) / np.maximum(total, 1)
    octaves = np.ceil(np.log2(weight)).astype(np.int64) + 1  # intervals that the weight reaches
    row = np.repeat(np.arange(len(owner)), octaves)
    level = np.arange(len(row)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    seed = mix(element[row] + level.astype(np.uint64) * _STRIDE)
    todo = np.arange(len(row))
    while len(todo):
        at, time, step = todo, np.zeros(len(todo)), 0
        while len(at):
            step += 1
            draw = mix(seed[at] + np.uint64(step * int(_STRIDE) % (1 << 64)))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * width[at])
            on = time <= horizon[owner[row[at]]]
            at, time, draw = at[on], time[on], mix(draw[on] + np.uint64(1))
            inside = low[at] + width[at] * ((draw >> np.uint64(32)).astype(np.float64) * 2.0**-32) < weight[row[at]]
            slot = owner[row[at[inside]]] * m + (draw[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64) % m
            np.minimum.at(first, slot, time[inside])
            hit = first[slot] == time[inside]
            last[slot[hit]] = draw[inside][hit]
        free = np.isinf(first).reshape(n, m).any(axis=1) & (total > 0)
        seen |= ~free
        horizon = np.where(free, horizon * 2, horizon)
        todo = todo[free[owner[row[todo]]]]
    return last.reshape(n, m)


def _signed(k: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, sketches = [], [], []
            for w in words(pc.utf8_lower(batch.column("text"))):
                owner, element = shingles(w, k)
                sizes.append(np.bincount(owner - w.first, minlength=w.n))
                owner, element, weight = _counted(owner - w.first, element)
                bitmap = np.zeros((w.n, 64 * LONGS), dtype=bool)
                bitmap[owner, (mix(element) % np.uint64(64 * LONGS)).astype(np.int64)] = True
                packed = np.packbits(bitmap, axis=1).view(np.int64)
                sketches.append(np.column_stack([sizes[-1].astype(np.int64), bitmap.sum(axis=1), packed]))
                signature = bag_minhash(owner, element, weight, w.n, bands * rows).reshape(w.n, bands, rows)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (w.n, bands))
                for r in range(rows):
                    key = mix(key * _STRIDE + signature[:, :, r])
                keys.append(key)
            size = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
            key = long(np.concatenate(keys).ravel()) if keys else np.zeros(0, dtype=np.int64)
            column = pa.ListArray.from_arrays(np.arange(len(size) + 1, dtype=np.int32) * bands, pa.array(key))
            wide = 2 + LONGS
            sketch = np.concatenate(sketches).ravel() if sketches else np.zeros(0, dtype=np.int64)
            sign = pa.ListArray.from_arrays(np.arange(len(size) + 1, dtype=np.int32) * wide, pa.array(sketch))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("text_key"), batch.column("check"), pa.array(size), column, sign],
                names=["doc_id", "text_key", "check", "size", "buckets", "sign"],
            )

    return run


def overlap(a: pa.Array, b: pa.Array, k: int) -> np.ndarray:
    """Multiset Jaccard similarity of two columns' texts, row by row; two texts without words have 0."""
    sides = [[shingles(w, k) for w in words(pc.utf8_lower(c))] for c in (a, b)]
    flat = [(np.concatenate([x[0] for x in s] or [np.zeros(0, dtype=np.int64)]), np.concatenate([x[1] for x in s] or [np.zeros(0, dtype=np.uint64)])) for s in sides]
    row, value = np.r_[flat[0][0], flat[1][0]], np.r_[flat[0][1], flat[1][1]]
    left = np.arange(len(row)) < len(flat[0][0])
    if not len(row):
        return np.zeros(len(a))
    order = np.lexsort((value, row))
    row, value, left = row[order], value[order], left[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])])
    x, y = np.add.reduceat(left.astype(np.int64), new), np.add.reduceat((~left).astype(np.int64), new)
    both = np.bincount(row[new], weights=np.minimum(x, y), minlength=len(a))
    either = np.bincount(row[new], weights=np.maximum(x, y), minlength=len(a))
    return np.divide(both, either, out=np.zeros(len(a)), where=either > 0)


def _similar(k: int, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(overlap(batch.column("text_a"), batch.column("text_b"), k) >= threshold)
            yield batch.select(["a", "b"]).filter(keep)

    return run


def groups(documents: DataFrame, k: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 4) -> DataFrame:
    """The near-duplicate group of every document: ``doc_id``, ``text_key``, ``check`` (two hashes of the text),
    ``component_id`` (smallest ``doc_id`` of the group) and ``kept`` (whether the document is that one).

    Texts are lower-cased multisets of runs of ``k`` words; two are linked if the multisets overlap in
    ``threshold`` or more of their union, and groups are closed under links. A pair at 0.8 shares
    one of 24 bands of 4 values in more than 99.999 % of cases, and their bitmaps are close enough in 99.99 %; every
    link is verified on the texts.

    Defined results: equal texts are one group from the start and are signed and compared once; null and
    empty texts (and those of white space) are alone, each document a group of its own; rows that repeat
    ``doc_id`` and text share a group; a group whose ids are all null has the id null, and its rows are
    kept; an empty table gives an empty one. Further columns are not read.
    """
    named = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(
        {"text_key": F.xxhash64("text"), "check": F.xxhash64(F.lit(1), "text")}
    )
    signed = named.mapInArrow(_signed(k, bands, rows), "doc_id long, text_key long, check long, size long, buckets array<long>, sign array<long>")
    texts = written(
        signed.groupBy("text_key", "check")
        .agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("buckets").alias("buckets"), F.first("sign").alias("sign"))
        .withColumn("id", F.monotonically_increasing_id()),
        "signatures",
    )

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = texts.join(ids, "id").select("id", F.col("doc_id").alias("d"), F.col("text_key").alias("t"), F.col("check").alias("c"))
        same = named.join(wanted, F.expr("text_key = t and check = c and doc_id <=> d"))
        return same.dropDuplicates(["id"]).select("id", "text")

    some = texts.where("size > 0")
    linked = link(
        some.select("id", F.explode(F.array_distinct("buckets")).alias("bucket")),
        some.select("id", "sign"),
        lambda ids: written(fetch(ids), "texts"),
        lambda pairs: pairs.mapInArrow(_similar(k, threshold), "a long, b long"),
        lambda x, y: f"least({x}[0], {y}[0]) >= {threshold - 1e-9} * greatest({x}[0], {y}[0]) and {close(x, y, LONGS, threshold)}",
        at_once=True,
    )
    placed = texts.join(linked, "id", "left").select("text_key", "check", "doc_id", "size", F.coalesce("component", "id").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = placed.join(least, "component").select("text_key", "check", "size", "component_id")
    return (
        named.select("doc_id", "text_key", "check")
        .join(found, ["text_key", "check"])
        .withColumn("component_id", F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
        .select("doc_id", "text_key", "check", "component_id", F.expr("doc_id <=> component_id").alias("kept"))
    )


def drop_near_copies(documents: DataFrame, **settings: float) -> DataFrame:
    """``documents`` with one row of each near-duplicate group, the first by ``doc_id``. Rows that repeat both id
    and text leave one of them, whichever Spark meets first; null or blank texts stay, one row for each id."""
    names = free(documents, "text_key", "check")
    keyed = documents.withColumns({names[0]: F.xxhash64(F.coalesce("text", F.lit(""))), names[1]: F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))}).alias("whole")
    kept = groups(documents, **settings).where("kept").select("doc_id", "text_key", "check").distinct().alias("kept")
    same = F.expr(f"whole.{names[0]} = kept.text_key and whole.{names[1]} = kept.check and whole.doc_id <=> kept.doc_id")
    return keyed.join(kept, same, "left_semi").dropDuplicates([*names, "doc_id"]).drop(*names)
