"""Benchmark passages in documents, found in a latent space of TF-IDF passages."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.llm.arrays import Runs, Words, words

#: Buckets of hashed words, dimensions kept of the decomposition, and those sketched.
BITS, KEPT, SKETCHED = 14, 128, 144
#: Words of a passage of the decomposition.
PASSAGE = 64
#: Words whose vectors are held at once, and terms of passages multiplied at once.
BLOCK, TERMS = 1 << 14, 1 << 11
#: Items of the benchmark that one pass over the documents searches for.
ITEMS = 10_000
#: Words of the shortest item that windows search for; shorter ones are found by their exact words.
LEAST = 8

_SHIFT = np.uint64(64 - BITS)


def _terms(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, bucket and count of the terms of a step's passages, in order."""
    counts = w.counts()
    place = np.arange(len(w.hashes)) - np.repeat(w.at[:-1], counts)
    passages = -(-counts // PASSAGE)
    passage = np.repeat(np.cumsum(passages) - passages, counts) + place // PASSAGE
    key, n = np.unique((passage << BITS) | (w.hashes >> _SHIFT).astype(np.int64), return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), n


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, passages = np.zeros(1 << BITS, dtype=np.int64), 0
    for batch in batches:
        for w in words(pc.utf8_lower(batch.column("text"))):
            passage, bucket, _ = _terms(w)
            seen += np.bincount(bucket, minlength=1 << BITS)
            passages += len(np.unique(passage))
    hit = np.flatnonzero(seen)
    yield pa.record_batch([pa.array(np.r_[hit, -1]), pa.array(np.r_[seen[hit], passages])], names=["bucket", "n"])


def _omega() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((1 << BITS, SKETCHED)).astype(np.float32)


def _sketch(idf: np.ndarray) -> Callable:
    """Sums over a task's passages ``a`` (unit TF-IDF rows) of ``a' (a Omega)``: its part of ``A' A Omega``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega, total = _omega(), np.zeros((1 << BITS, SKETCHED))
        near, blocks = np.zeros((1 << BITS, SKETCHED), dtype=np.float32), 0
        for batch in batches:
            for w in words(pc.utf8_lower(batch.column("text"))):
                passage, bucket, n = _terms(w)
                if not len(passage):
                    continue
                value = n * idf[bucket]
                norm = np.sqrt(np.bincount(passage, weights=value * value))
                value = (value / np.maximum(norm, 1e-12)[passage]).astype(np.float32)
                first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
                edges = np.unique(np.r_[first[np.searchsorted(first, np.arange(0, len(passage), TERMS), side="right") - 1], len(passage)])
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    # The block's passages as a small dense matrix over the buckets that it has.
                    held, column = np.unique(bucket[lo:hi], return_inverse=True)
                    row = np.cumsum(np.r_[False, passage[lo + 1 : hi] != passage[lo : hi - 1]])
                    dense = np.zeros((row[-1] + 1, len(held)), dtype=np.float32)
                    dense[row, column] = value[lo:hi]
                    near[held] += dense.T @ (dense @ omega[held])
                    blocks += 1
                    # Few blocks are summed in single precision.
                    if blocks % 256 == 0:
                        total += near
                        near[:] = 0
        total += near
        hit = np.flatnonzero(total.any(axis=1))
        columns = [pa.array(hit), *(pa.array(total[hit, c].copy()) for c in range(SKETCHED))]
        yield pa.record_batch(columns, names=["bucket", *(f"y{c}" for c in range(SKETCHED))])

    return run


def basis(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """What each word bucket adds to a passage's latent vector: IDF times right singular vectors over singular values; and the IDF.

    The decomposition is a randomised SVD of the TF-IDF matrix of all passages of all documents: a first pass
    counts passages by bucket, a second multiplies the matrix and its transpose with a random matrix, both
    summed by Spark; the small factorisation (a Nystroem one) happens on the driver, whose arrays have
    ``2 ** BITS`` rows whatever the input. Dividing by the singular values weighs all latent directions alike, so
    vectors of unrelated passages are nearly at right angles."""
    rows = documents.select("text")
    counted = rows.mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    seen = dict(zip(counted.column("bucket").to_pylist(), counted.column("n").to_pylist(), strict=True))
    passages = seen.pop(-1, 0)
    # Above zero for every bucket, also for one in all passages: no item's vector vanishes.
    idf = np.full(1 << BITS, np.log(2.0 + passages))
    idf[list(seen)] = np.log(1.0 + (1.0 + passages) / (1.0 + np.array(list(seen.values()))))
    parts = rows.mapInArrow(_sketch(idf), "bucket long, " + ", ".join(f"y{c} double" for c in range(SKETCHED)))
    summed = parts.groupBy("bucket").agg(*[F.sum(f"y{c}").alias(f"y{c}") for c in range(SKETCHED)]).toArrow()
    y = np.zeros((1 << BITS, SKETCHED))
    if summed.num_rows:
        y[summed.column("bucket").to_numpy()] = np.stack([summed.column(f"y{c}").to_numpy() for c in range(SKETCHED)], axis=1)
    omega = _omega().astype(np.float64)
    shift = 1e-9 * max(np.linalg.norm(y), 1e-9)
    y += shift * omega
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    half = vectors / np.sqrt(np.maximum(values, 1e-12 * max(values.max(), 1e-300)))
    u, s, _ = np.linalg.svd(y @ half, full_matrices=False)
    kept = s > s[0] * 1e-6
    return (idf[:, None] * u[:, kept][:, :KEPT] / s[kept][:KEPT]).astype(np.float32), idf


def _exact(benchmark: pa.Table, blank: set[int]) -> dict[int, dict[int, list[tuple[int, np.ndarray]]]]:
    """Items too short for windows, and those at the places ``blank``, which have no latent vector: their id and words, by their number
    of words and the hash of them all."""
    found: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = defaultdict(lambda: defaultdict(list))
    ids = benchmark.column("item_id").to_pylist()
    for w in words(pc.utf8_lower(benchmark.column("text").combine_chunks())):
        for i in range(w.n):
            own = w.hashes[w.at[i] : w.at[i + 1]]
            if (0 < len(own) < LEAST or w.first + i in blank) and ids[w.first + i] is not None:
                found[len(own)][int(Runs(own).of(len(own))[0])].append((ids[w.first + i], own))
    return {n: dict(of) for n, of in found.items()}


@dataclass
class _Item:
    item_id: int
    words: list[int]
    own: set[int]  # the different ones
    latent: np.ndarray
    offset: int  # of the part that is searched for


def _lengths(n: int) -> int:
    """The length of window that an item of ``n`` words is searched with: a step of a geometric scale, so few lengths serve all items."""
    length = LEAST
    while int(length * 1.2) + 1 <= n:
        length = int(length * 1.2) + 1
    return length


def _prepared(benchmark: pa.Table, weights: np.ndarray) -> tuple[dict[int, list[_Item]], set[int]]:
    """Items by the length of window that finds them, and the places of those without a latent vector."""
    found: dict[int, list[_Item]] = defaultdict(list)
    blank: set[int] = set()
    texts = benchmark.column("text").combine_chunks()
    ids = benchmark.column("item_id").to_pylist()
    for w in words(pc.utf8_lower(texts)):
        for i in range(w.n):
            own = w.hashes[w.at[i] : w.at[i + 1]]
            if len(own) < LEAST or ids[w.first + i] is None:
                continue
            length = _lengths(len(own))
            offset = (len(own) - length) // 2
            latent = weights[(own[offset : offset + length] >> _SHIFT).astype(np.int64)].sum(axis=0)
            if (norm := np.linalg.norm(latent)) > 0:
                found[length].append(_Item(ids[w.first + i], own.tolist(), set(own.tolist()), latent / norm, offset))
            else:
                blank.add(w.first + i)
    return dict(found), blank


def common(item: list[int], region: list[int]) -> int:
    """Length of the longest common subsequence (bit by bit: a clear bit for each word of the item matched so far)."""
    places: dict[int, int] = {}
    for i, word in enumerate(item):
        places[word] = places.get(word, 0) | (1 << i)
    row = full = (1 << len(item)) - 1
    for word in region:
        if (hit := row & places.get(word, 0)):
            row = (row + hit) | (row - hit)
    return len(item) - (row & full).bit_count()


def _rare(items: list[_Item], idf: np.ndarray, part: float) -> tuple[np.ndarray, int]:
    """Words, and how many of them the words around a window hold wherever an item has ``part`` of its words there.

    Of an item's different words, ``need`` or more are there; so are ``least`` or more of the rarest of them, taken as many that only
    ``need - least`` are left out. 0 if an item needs none."""
    need = [int(np.ceil(part * len(i.words) - (len(i.words) - len(i.own)) - 1e-9)) for i in items]
    if min(need) < 1:
        return np.zeros(0, dtype=np.uint64), 0
    least, found = max(1, 2 * min(need) // 5), set()
    for item, n in zip(items, need, strict=True):
        by_idf = sorted(item.own, key=lambda word: (-idf[word >> (64 - BITS)], word))
        found.update(by_idf[: len(by_idf) - n + least])
    return np.array(sorted(found), dtype=np.uint64), least


def _found(items: dict[int, list[_Item]], short: dict[int, dict[int, list[tuple[int, np.ndarray]]]], weights: np.ndarray, idf: np.ndarray, cosine: float, whole: float, part: float, answer: int) -> Callable:
    def judged(item: _Item, region: list[int]) -> int | None:
        """Words of the item found in order, if that makes a leak."""
        n = len(item.words)
        if len(item.own.intersection(region)) + n - len(item.own) < part * n:
            return None
        lcs = common(item.words, region)
        if lcs >= whole * n:
            return lcs
        tail = item.words[-answer:]
        return lcs if lcs >= part * n and common(tail, region) == len(tail) else None

    longest = max(items, default=0)
    sizes = {length: np.array([len(i.words) for i in own]) for length, own in items.items()}
    offsets = {length: np.array([i.offset for i in own]) for length, own in items.items()}
    searched = {length: (own, np.stack([i.latent for i in own], axis=1), min(whole, part) * sizes[length].min()) for length, own in items.items()}
    rare = {length: _rare(own, idf, part) for length, own in items.items()}
    # Words of the region that a window is judged by, before its first word and from it on, at most.
    reach = {length: tuple(int(n.max()) + max(1, length // 6) + 2 for n in (offsets[length], sizes[length] - offsets[length])) for length in items}
    # All rare words in order, the greatest value last, and for each length which of them are its own.
    every = np.unique(np.concatenate([np.array([2**64 - 1], dtype=np.uint64), *[of for of, _ in rare.values()]]))
    member = {length: np.isin(every, of) for length, (of, least) in rare.items() if least}
    # A row of zeros stands for places behind a window's end.
    padded = np.vstack([weights, np.zeros((1, weights.shape[1]), dtype=weights.dtype)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[tuple[int, int], tuple[int, float, int]] = {}
            for w in words(pc.utf8_lower(batch.column("text"))):
                if not len(w.hashes):
                    continue
                left, counts, owners = w.left(), w.counts(), w.owner()
                if short:
                    runs = Runs(w.hashes)
                    for n, of in short.items():
                        run = runs.of(n)
                        for p in np.flatnonzero(np.isin(run, np.array(list(of), dtype=np.uint64)) & (left[: len(run)] >= n)):
                            for item_id, own in of[int(run[p])]:
                                if (w.hashes[p : p + n] == own).all():
                                    best[int(owners[p]), item_id] = (n, 1.0, n)
                place = np.arange(len(left)) - np.repeat(w.at[:-1], counts)
                plain = w.hashes.tolist() if items else []
                bucket = np.r_[(w.hashes >> _SHIFT).astype(np.int64), len(weights)]
                found = np.searchsorted(every, w.hashes)
                found[every[found] != w.hashes] = len(every) - 1
                # How many rare words lie before each place, from ``reach`` places before the first to as many behind the last.
                seen = {length: np.pad(np.cumsum(of[found], dtype=np.int32), (reach[length][0] + 1, reach[length][1]), "edge") for length, of in member.items()}
                for length, sums in seen.items():
                    sums[: reach[length][0] + 1] = 0
                for lo in range(0, len(plain) if items else 0, BLOCK):
                    hi = min(lo + BLOCK, len(plain))
                    sums = None
                    rest, own_place = left[lo:hi], place[lo:hi]
                    for length, (own, latent, least) in searched.items():
                        step = max(1, length // 6)
                        at = np.arange(hi - lo)
                        if length in seen:
                            # Around the others no item can have enough of its words to be judged a leak.
                            wide = sum(reach[length])
                            at = np.flatnonzero(seen[length][lo + wide : hi + wide] - seen[length][lo:hi] >= rare[length][1])
                        # A text that is shorter has one window, of all its words.
                        whole_window = (rest[at] >= length) & ((own_place[at] % step == 0) | (rest[at] == length))
                        at = at[whole_window | ((own_place[at] == 0) & (rest[at] < length) & (rest[at] >= least))]
                        if not len(at):
                            continue
                        if len(at) * length <= 4 * (hi - lo):
                            places = np.arange(length)
                            inside = np.where(places < rest[at][:, None], (at + lo)[:, None] + places, len(plain))
                            window = padded[bucket[inside]].sum(axis=1)
                        else:
                            if sums is None:
                                sums = np.zeros((min(hi + longest, len(plain)) - lo + 1, weights.shape[1]))
                                np.cumsum(weights[bucket[lo : lo + len(sums) - 1]], axis=0, dtype=np.float64, out=sums[1:])
                            window = (sums[at + np.minimum(rest[at], length)] - sums[at]).astype(np.float32)
                        window /= np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-30)
                        near = window @ latent
                        rs, cs = np.nonzero(near >= cosine)
                        at += lo
                        row = owners[at[rs]]
                        begin = at[rs] - offsets[length][cs]
                        first = np.maximum(w.at[row - w.first], begin - step - 2).tolist()
                        last = np.minimum(w.at[row - w.first + 1], begin + sizes[length][cs] + step + 2).tolist()
                        for c, r, f, e, x in zip(cs.tolist(), row.tolist(), first, last, near[rs, cs].tolist(), strict=True):
                            lcs = judged(own[c], plain[f:e])
                            if lcs is not None:
                                key, n = (r, own[c].item_id), len(own[c].words)
                                best[key] = max(best.get(key, (0, 0.0, 0)), (lcs, x, n))
            rows = [r for r, _ in best]
            yield pa.record_batch(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())), batch.column("text_key").take(pa.array(rows, pa.int64())),
                    pa.array([i for _, i in best], pa.int64()), pa.array([v[0] for v in best.values()], pa.int64()),
                    pa.array([v[2] for v in best.values()], pa.int64()), pa.array([v[1] for v in best.values()], pa.float64()),
                ],
                names=["doc_id", "text_key", "item_id", "lcs", "n_words", "cosine"],
            )

    return run


def find(documents: DataFrame, benchmark: DataFrame, cosine: float = 0.3, whole: float = 0.8, part: float = 0.6, answer: int = 5) -> DataFrame:
    """Benchmark items (``item_id``, ``text``) that documents (``doc_id``, ``text``) hold: ``doc_id``, ``text_key`` (xxhash64 of the
    text), ``item_id``, ``lcs`` (words of the item found in order), ``n_words`` (of the item) and ``cosine`` (of the best window).

    Windows of about an item's length slide over every document, in steps of a sixth of it, and a document with fewer words
    is one window; those whose latent vector has ``cosine`` or more with the item's are candidates. A candidate is a leak if the item and the
    words around the window have a common subsequence of ``whole`` of the item, or of ``part`` of it and its
    last ``answer`` words too, all of them: a paraphrase that keeps the answer. Words are
    lower-cased runs without white space.

    Items under eight words, and any whose latent vector is zero, are found by their exact words in sequence.

    Defined results: null and empty texts, and items without words or with a null id, match nothing; equal documents
    and equal items each have their own rows; a document without leaks has no row. The items come
    to the driver and go to the tasks in blocks of ``ITEMS``, with one pass over the documents each.
    """
    weights, idf = basis(documents)
    named = documents.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    blocks = max(1, -(-items.count() // ITEMS))
    kind = "doc_id long, text_key long, item_id long, lcs long, n_words long, cosine double"
    out = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        prepared, blank = _prepared(own, weights)
        found = named.mapInArrow(_found(prepared, _exact(own, blank), weights, idf, cosine, whole, part, answer), kind)
        out = found if out is None else out.unionAll(found)
    return out


def drop_leaks(documents: DataFrame, benchmark: DataFrame, **settings: float) -> DataFrame:
    """``documents`` without those that hold a benchmark item; all their columns stay."""
    held = find(documents, benchmark, **settings).select("doc_id", "text_key").distinct().alias("held")
    same = F.col("whole.doc_id").eqNullSafe(F.col("held.doc_id")) & (F.xxhash64(F.col("whole.text")) == F.col("held.text_key"))
    return documents.alias("whole").join(held, same, "left_anti")
