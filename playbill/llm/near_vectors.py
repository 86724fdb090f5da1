"""Near-duplicate embeddings by a pigeonhole join over subspaces."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.llm.components import components
from playbill.llm.store import written

#: Dimensions of a block; its first two also say in which cell of the block's grid a vector lies.
BLOCK = 8
#: Vectors of a cell that are compared with others at once.
PACK = 2048
#: Half of a cell's neighbourhood: each pair of neighbouring cells meets once.
_AROUND = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]


@lru_cache(maxsize=4)
def _rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]


def _blocks(dim: int) -> list[slice]:
    n = max(1, dim // BLOCK)
    return [slice(dim * b // n, dim * (b + 1) // n) for b in range(n)]


def _budgets(dim: int, threshold: float) -> np.ndarray:
    """Squared distance that each block may take; together that of unit vectors at the threshold."""
    sizes = np.array([b.stop - b.start for b in _blocks(dim)])
    return (2 - 2 * threshold) * sizes / dim * (1 + 1e-9) + 1e-12


def _placed(threshold: float) -> Callable:
    """Rotate unit vectors, and place each in a cell of every block's grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, weights, vectors = (batch.column(c) for c in ("id", "weight", "embedding"))
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                rows = vectors.take(pa.array(own))
                x = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(own), dim)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                turned = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ _rotation(int(dim))
                packed = pa.array([r.tobytes() for r in turned], pa.binary())
                for b, (cut, budget) in enumerate(zip(_blocks(dim), _budgets(dim, threshold), strict=True)):
                    cells = np.floor(turned[:, cut][:, :2] / np.sqrt(budget)).astype(np.int32)
                    n = len(own)
                    yield pa.record_batch(
                        [
                            pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, b, np.int32)),
                            pa.array(cells[:, 0].copy()), pa.array(cells[:, -1].copy()),
                            ids.take(pa.array(own)), weights.take(pa.array(own)), packed,
                        ],
                        names=["dim", "block", "x", "y", "id", "weight", "vector"],
                    )

    return run


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of ``n`` nodes by the links ``a``-``b``."""
    root = np.arange(n)
    while True:
        now = root.copy()
        least = np.minimum(now[a], now[b])
        np.minimum.at(now, a, least)
        np.minimum.at(now, b, least)
        now = now[now]
        if (now == root).all():
            return root
        root = now


def _links(x: np.ndarray, y: np.ndarray, same: bool, block: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of two packs that no earlier block finds: within this block's budget first, then exactly."""
    dim = x.shape[1]
    cuts, budgets = _blocks(dim), _budgets(dim, threshold)
    p, q = x[:, cuts[block]].astype(np.float32), y[:, cuts[block]].astype(np.float32)
    # Half the squared distance within the budget, with room for single precision.
    floor = ((p * p).sum(axis=1, keepdims=True) - np.float32(budgets[block] + 1e-5)) / 2
    tail, starts = (q * q).sum(axis=1) / 2, [c.start for c in cuts]
    found = []
    for lo in range(0, len(x), 256):
        i, j = np.nonzero(p[lo : lo + 256] @ q.T - tail >= floor[lo : lo + 256])
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 15):
            r, s = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            near = np.einsum("ij,ij->i", x[r], y[s]) >= threshold
            r, s = r[near], s[near]
            parts = np.add.reduceat((x[r] - y[s]) ** 2, starts, axis=1) <= budgets
            mine = np.argmax(parts, axis=1) == block
            found.append((r[mine], s[mine]))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([f[0] for f in found] or [none]), np.concatenate([f[1] for f in found] or [none])


def _compared(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, block = batch.column("dim")[row].as_py(), batch.column("block")[row].as_py()
                same = batch.column("same")[row].as_py()
                sides = []
                for side in ("left", "right")[: 1 if same else 2]:
                    items = batch.column(side)[row].values
                    vectors = np.frombuffer(b"".join(items.field("vector").to_pylist()), dtype=np.float64).reshape(-1, dim)
                    sides.append((items.field("id").to_numpy(), items.field("weight").to_numpy(), vectors))
                (ids, weights, x), (ids2, weights2, y) = sides[0], sides[-1]
                i, j = _links(x, y, same, block, threshold)
                if not len(i):
                    continue
                own = ids if same else np.r_[ids, ids2]
                k = j if same else j + len(ids)
                n = np.bincount(i, weights=weights2[j], minlength=len(own)) + np.bincount(k, weights=weights[i], minlength=len(own))
                root = _roots(i, k, len(own))
                hit = np.flatnonzero(n)
                yield pa.record_batch([pa.array(own[hit]), pa.array(n[hit].astype(np.int64)), pa.array(own[root[hit]])], names=["id", "n", "root"])

    return run


def links(embeddings: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``vec_id``, ``n_links`` (other vectors at a cosine of ``threshold`` or more), ``component_id`` (smallest
    ``vec_id`` reachable by links, its own included) and ``kept`` (whether it is that one) of every row of
    ``embeddings`` (``vec_id``, ``embedding``; other columns are not read).

    Unit vectors at the threshold lie within a squared distance of ``2 - 2 * threshold``. They are rotated
    at random and cut into blocks of eight dimensions; if no block of a pair kept within its
    share of that distance, the pair as a whole could not. So each block is joined on its own: a
    vector meets those of its own and the neighbouring cells of a grid over the block, is compared within
    the block, and only pairs within the budget are verified exactly, over all dimensions. A pair counts in
    the first block that finds it. A cell is compared pack by pack, each of bounded size; links are counted
    and joined to trees inside a comparison, so no list of all pairs is made.

    Defined results: equal vectors are compared once and are linked with each other; vectors that are
    null, empty, zero or hold null or non-finite components have no links and are a component each; vectors
    of different length are never linked; a null ``vec_id`` is no smallest id, and a component without
    any other has the id null; an empty table gives an empty one.
    """
    sound = F.expr(
        "embedding is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0)"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    rows = embeddings.select("vec_id", "embedding")
    one = written(
        rows.where(sound).groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight")).withColumn("id", F.monotonically_increasing_id()),
        "vectors",
    )
    cell = ["dim", "block", "x", "y"]
    placed = one.select("id", "weight", "embedding").mapInArrow(_placed(threshold), "dim int, block int, x int, y int, id long, weight long, vector binary")
    counts = placed.groupBy(*cell).agg(F.count("*").alias("held"))
    packs = (
        placed.join(counts, cell)
        .withColumn("pack", F.pmod(F.xxhash64("id"), F.ceil(F.col("held") / PACK)))
        .groupBy(*cell, "pack")
        .agg(F.collect_list(F.struct("id", "weight", "vector")).alias("items"))
    )
    around = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in _AROUND])
    left = packs.withColumn("d", F.explode(around)).select(
        "dim", "block", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"),
        F.expr("d.dx = 0 and d.dy = 0").alias("own"), F.col("pack").alias("pack_2"), F.col("items").alias("left"),
    )
    met = left.join(packs, cell).where("not own or pack_2 <= pack")
    pairs = met.select("dim", "block", F.expr("own and pack_2 = pack").alias("same"), "left", F.col("items").alias("right"))
    found = written(pairs.mapInArrow(_compared(threshold), "id long, n long, root long"), "links")
    linked = found.groupBy("id").agg(F.sum("n").alias("n"))
    tree = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    placed_in = one.join(linked, "id", "left").join(tree, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = placed_in.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    answer = placed_in.join(least, "component").select("embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    full = rows.where(sound).join(answer, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(F.coalesce(~sound, F.lit(True))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.unionAll(alone).withColumn("kept", F.expr("vec_id <=> component_id"))
