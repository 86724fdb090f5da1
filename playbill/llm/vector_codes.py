"""Product codes of integer vectors: exact k-means per part, with bounds that spare most distances."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.llm.store import discard, scratch, written

#: Integers a unit, and rows that a task compares with a codebook at once.
SCALE, ROWS = 4096, 4096
_FAR = np.iinfo(np.int64).max
_BLOCK = "ids array<long>, labels array<{label}>, vectors binary, state binary, delta array<long>, work array<long>"
#: What is kept of a part: its entry, the squared distance to it and the round of that, the squared distance to
#: the second nearest entry and the round of that.
_STATE = np.dtype([("entry", "u1"), ("near", "<i8"), ("near_round", "u1"), ("next", "<i8"), ("next_round", "u1")])


@dataclass(frozen=True)
class Shape:
    """Length of a part, number of parts, and the largest size of a component."""

    width: int
    parts: int
    most: int

    def exact_in_floats(self) -> bool:
        return 4 * self.most * self.most * self.width < 1 << 53


def _integers(vectors: pa.Array, shape: Shape) -> np.ndarray:
    """``floor(4096 * x)`` of all components, padded with zeros, as rows of parts."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), shape.parts * shape.width), dtype=np.int32)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = np.clip(np.floor(flat * SCALE), -shape.most, shape.most)
    return out.reshape(len(sizes), shape.parts, shape.width)


def _distances(x: np.ndarray, entries: np.ndarray, floats: bool) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    if floats:
        x, entries = x.astype(np.float64), entries.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)).astype(np.int64)
    x = x.astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


class _Bounds:
    """How far the entries of a part lie from where they were, by the round that a bound was taken in."""

    def __init__(self, history: np.ndarray):
        # history: rounds, entries, width. Net displacement: from then to now, not the sum of the steps between.
        net = np.sqrt(((history[-1] - history).astype(np.float64) ** 2).sum(axis=2))
        self.own = net
        largest = np.argmax(net, axis=1)
        rest = net.copy()
        rest[np.arange(len(net)), largest] = 0
        self.others = np.where(np.arange(net.shape[1]) == largest[:, None], rest.max(axis=1)[:, None], net.max(axis=1)[:, None])

    def sure(self, state: np.ndarray) -> np.ndarray:
        """Rows whose entry is certainly still the nearest, and the only one."""
        upper = np.sqrt(state["near"].astype(np.float64)) + self.own[state["near_round"], state["entry"]]
        lower = np.sqrt(state["next"].astype(np.float64)) - self.others[state["next_round"], state["entry"]]
        return upper * (1 + 1e-12) < lower * (1 - 1e-12)


def _assigned(x: np.ndarray, state: np.ndarray | None, history: np.ndarray, floats: bool) -> tuple[np.ndarray, int, int]:
    """State of one part of all rows under the last codebook of ``history``; how many rows had one distance, and all, computed."""
    now, entries = len(history) - 1, history[-1]
    if state is None:
        state, doubt, tightened = np.zeros(len(x), dtype=_STATE), np.arange(len(x)), 0
    else:
        state, bounds = state.copy(), _Bounds(history)
        doubt = np.flatnonzero(~bounds.sure(state))
        tightened = len(doubt)
        own = x[doubt].astype(np.int64) - entries[state["entry"][doubt]]
        state["near"][doubt], state["near_round"][doubt] = (own * own).sum(axis=1), now
        doubt = doubt[~bounds.sure(state[doubt])]
    for lo in range(0, len(doubt), ROWS):
        rows = doubt[lo : lo + ROWS]
        d = _distances(x[rows], entries, floats)
        entry = np.argmin(d, axis=1)  # the lowest index of equal ones
        at = np.arange(len(rows))
        near = d[at, entry]
        d[at, entry] = _FAR
        for name, value in (("entry", entry), ("near", near), ("near_round", now), ("next", d.min(axis=1)), ("next_round", now)):
            state[name][rows] = value
    return state, tightened, len(doubt)


def _round(history: np.ndarray, shape: Shape, label: pa.DataType) -> Callable:
    """Blocks of vectors, or vectors, to blocks with their state under the last codebook; a task's last row has what its
    reassigned parts add to the sums and counts of the entries, and its numbers of distances."""
    k = history.shape[2]
    floats = shape.exact_in_floats()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((shape.parts, k, shape.width), dtype=np.int64)
        counts = np.zeros((shape.parts, k), dtype=np.int64)
        work = np.zeros(2, dtype=np.int64)
        types = [pa.list_(pa.int64()), pa.list_(label), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["ids", "labels", "vectors", "state", "delta", "work"]

        def row(*values) -> pa.RecordBatch:
            return pa.record_batch([v.cast(t) if isinstance(v, pa.Array) else pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        def one(column: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)

        for batch in batches:
            for ids, labels, x, old in _blocks(batch, shape):
                new = np.empty((len(x), shape.parts), dtype=_STATE)
                for p in range(shape.parts):
                    own, was = x[:, p], None if old is None else old[:, p]
                    new[:, p], *did = _assigned(own, was, history[:, p], floats)
                    work += did
                    moved = np.arange(len(x)) if was is None else np.flatnonzero(new["entry"][:, p] != was["entry"])
                    for sign, entry in ((1, new["entry"][moved, p]), *(() if was is None else ((-1, was["entry"][moved]),))):
                        np.add.at(sums[p], entry, sign * own[moved].astype(np.int64))
                        counts[p] += sign * np.bincount(entry, minlength=k)
                yield row(one(ids), one(labels), x.tobytes(), new.tobytes(), None, None)
        yield row(None, None, None, None, np.concatenate([sums.ravel(), counts.ravel()]), work)

    return run


def _blocks(batch: pa.RecordBatch, shape: Shape) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray | None]]:
    if "embedding" in batch.schema.names:
        if batch.num_rows:
            yield batch.column("vec_id"), batch.column("label"), _integers(batch.column("embedding"), shape), None
        return
    for i in range(batch.num_rows):
        ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
        x = np.frombuffer(batch.column("vectors")[i].as_buffer(), dtype=np.int32).reshape(len(ids), shape.parts, shape.width)
        yield ids, labels, x, np.frombuffer(batch.column("state")[i].as_buffer(), dtype=_STATE).reshape(len(ids), shape.parts)


def _named(history: np.ndarray, shape: Shape) -> Callable:
    """Code and error of every vector under the last codebook."""
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, x, old in _blocks(batch, shape):
                new = [_assigned(x[:, p], None if old is None else old[:, p], history[:, p], shape.exact_in_floats())[0] for p in range(shape.parts)]
                # The bound on the nearest may be of an earlier round; the error is not.
                error = np.zeros(len(x), dtype=np.int64)
                for p, state in enumerate(new):
                    error += ((x[:, p].astype(np.int64) - history[-1, p][state["entry"]]) ** 2).sum(axis=1)
                code = digits[new[0]["entry"]].astype(object)
                for state in new[1:]:
                    code = code + digits[state["entry"]].astype(object)
                yield pa.record_batch([ids, labels, pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


@dataclass(frozen=True)
class Codes:
    """``rows``: ``vec_id``, ``label``, ``code``, ``error`` of every vector kept. ``codebooks``: parts, entries, components.
    ``work``: by round, the parts for which one distance, and all distances, were computed."""

    rows: DataFrame
    codebooks: np.ndarray
    work: list[tuple[int, int]]

    def digest(self) -> str:
        """SHA-256 of all components in decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> Codes:
    """Code the vectors of ``embeddings`` (``vec_id``, ``embedding``, ``label``; other columns are not read) by the
    nearest entry of a codebook for each of ``parts`` equal parts.

    Each component becomes ``floor(4096 * x)``. A part's codebook starts as that part of the vectors with the
    ``entries`` smallest ids; a round assigns every part to its nearest entry (squared distance, the lower index of equal
    ones) and replaces each entry by the floored mean of its parts; unused entries stay. After ``rounds``
    rounds parts are assigned once more. All arithmetic that decides is on integers.

    Of each part a row of the state keeps the distance to its entry and to the second nearest entry, and the round of either.
    Every codebook so far goes to the tasks, so a bound taken in round t is corrected by the way each entry has come since t as the crow
    flies, which is never longer than the sum of its steps. While the first distance stays below the second, the
    entry is certainly the same; otherwise the first is computed anew, and only if that does not help all of them. A round
    is one pass over a written table of blocks; sums change only by what was reassigned. No vectors are shuffled, and
    the driver holds the codebooks, whose size is fixed by the arguments and the length of a vector.

    Defined results: rows whose vector is null or holds null or non-finite components are dropped; shorter vectors, and a
    length that the number of parts does not divide, are filled with zeros at the end; with fewer vectors than
    ``entries`` the codebooks are as short; equal ids take their order from their vectors, a null id comes last; repeated rows count
    each; integers stop at the size whose squared distances still fit 64 bits (2**27 for 64 components, that is beyond
    32,768 before scaling); an empty table gives no rows and empty codebooks.
    """
    sound = F.expr("embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    kept = embeddings.select("vec_id", "label", "embedding").where(sound)
    length = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(1, -(-length // parts))
    shape = Shape(width, parts, 1 << (63 - (width * parts - 1).bit_length()) // 2 - 1)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    start = _integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), shape).astype(np.int64)
    if not len(first):
        nothing = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return Codes(nothing, start.transpose(1, 0, 2), [])
    history = start.transpose(1, 0, 2)[None]
    k, size = len(first), parts * len(first) * width
    schema = _BLOCK.format(label=kept.schema["label"].dataType.simpleString())
    label = kept.select("label").limit(0).toArrow().schema.field(0).type
    total, source, old, work = np.zeros(size + parts * k, dtype=np.int64), kept, None, []
    for _ in range(rounds):
        blocks, path = scratch(source.mapInArrow(_round(history, shape, label), schema), "codes")
        if old:
            discard(kept.sparkSession, old)
        old, source = path, blocks.where("ids is not null")
        ends = blocks.where("delta is not null")
        change = ends.select(F.posexplode("delta").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
        for r in change:
            total[r["at"]] += r["x"]
        work.append(tuple(ends.agg(F.sum(F.col("work")[0]), F.sum(F.col("work")[1])).first()))
        counts = total[size:].reshape(parts, k, 1)
        means = total[:size].reshape(parts, k, width) // np.maximum(counts, 1)
        history = np.concatenate([history, np.where(counts > 0, means, history[-1])[None]])
    plain = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    rows = written(source.mapInArrow(_named(history, shape), plain), "codes")
    if old:
        discard(kept.sparkSession, old)
    return Codes(rows, history[-1], work)


def digests(codes: Codes) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` (the errors of all rows with an equal label, nulls together) and
    ``codebooks_sha256``."""
    rows = codes.rows
    of = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    joined = rows.join(of, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The digests in SQL, for vectors of equal length that the number of parts divides, in plain rounds of all distances."""
    floored = "(s - ((s % n) + n) % n) // n"
    steps = [
        f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
    SELECT vec_id, p::int AS p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) r(p)),
c0 AS MATERIALIZED (
    SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1)::int AS e, x AS c FROM part
    WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))"""
    ]
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    for r in range(rounds + 1):
        steps.append(
            f"""
a{r} AS MATERIALIZED (
    SELECT vec_id, p, x, min(({distance}, e)) AS best FROM part JOIN c{r} USING (p) GROUP BY vec_id, p, x)"""
        )
        if r < rounds:
            steps.append(
                f"""
m{r} AS (
    SELECT p, e, list(m ORDER BY i) AS c FROM (
        SELECT p, e, i, {floored} AS m FROM (
            SELECT p, best[2] AS e, i, sum(x[i])::bigint AS s, count(*) AS n FROM a{r}, generate_series(1, len(x)) g(i) GROUP BY ALL))
    GROUP BY p, e),
c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (p, e))"""
            )
    last = f"""
coded AS (
    SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::bigint AS error FROM a{rounds} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), books
"""
    return ",".join(steps) + "," + last
