"""Language identification: the family first, then the languages within it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playbill.llm.arrays import STEP, utf8

#: Buckets that byte trigrams are hashed into.
BUCKETS = 1 << 12
UNKNOWN = "und"
#: Families by language code; a language of no family here is one by itself.
FAMILIES = {
    **dict.fromkeys(["de", "en", "nl", "sv", "da", "no", "is"], "germanic"),
    **dict.fromkeys(["fr", "es", "it", "pt", "ro", "ca", "gl"], "romance"),
    **dict.fromkeys(["ru", "pl", "cs", "uk", "bg", "sr", "hr", "sk", "sl"], "slavic"),
}

_LETTERS = np.full(256, 32, dtype=np.uint32)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = _LETTERS[65:91] = np.arange(97, 123)


def trigrams(texts: pa.Array) -> np.ndarray:
    """Share of each bucket among a text's trigrams of bytes, a row for each text. Case is folded, and all that
    is neither a letter of ASCII nor beyond ASCII is a blank. Texts under three bytes have zeros."""
    bounds, data = utf8(pc.utf8_lower(texts.fill_null("")))
    out, lo = [np.zeros((0, BUCKETS), dtype=np.float32)], 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + STEP, side="right")) - 1)
        own = bounds[lo : hi + 1] - bounds[lo]
        x = _LETTERS[data[bounds[lo] : bounds[hi]]]
        n = hi - lo
        code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
        bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
        text = np.repeat(np.arange(n), np.diff(own))[: len(bucket)]
        whole = np.repeat(own[1:], np.diff(own))[: len(bucket)] - np.arange(len(bucket)) >= 3
        counts = np.bincount(text[whole] * BUCKETS + bucket[whole], minlength=n * BUCKETS).reshape(n, BUCKETS)
        out.append((counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32))
        lo = hi
    return np.concatenate(out)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge loss), by coordinate descent on the dual; the last column of ``x`` is 1, its
    weight the bias; ``y`` is 1 or -1. Classes weigh alike, whatever their sizes."""
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    ridge = share / cost  # half the inverse of each row's cost
    # Row by row: the driver holds no second matrix.
    norm, alpha, w = np.array([(row * row).sum() for row in x]) + ridge, np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            slope = y[i] * (x[i] @ w) - 1 + ridge[i] * alpha[i]
            now = max(alpha[i] - slope / norm[i], 0.0)
            w += (now - alpha[i]) * y[i] * x[i]
            alpha[i] = now
    return w


@dataclass
class Model:
    """Weights over trigram shares: a row for each family against the others, and for each pair of languages of a family."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS + 1)))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        margin = trigrams(texts) @ self.weights[:, :-1].T.astype(np.float32) + self.weights[:, -1]
        sure = 1 / (1 + np.exp(-2 * margin))
        n = len(self.families)
        family = margin[:, :n].argmax(axis=1)
        score, names = sure[np.arange(len(family)), family], np.empty(len(family), dtype=object)
        for f, name in enumerate(self.families):
            rows, own = np.flatnonzero(family == f), self.languages[name]
            votes, trust = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for k, (a, b) in enumerate(self.pairs, start=n):
                if a in own:
                    i, j, p = own.index(a), own.index(b), sure[rows, k]
                    votes[:, i] += p >= 0.5
                    votes[:, j] += p < 0.5
                    trust[:, i] += p
                    trust[:, j] += 1 - p
            best = (votes + trust / max(len(own), 1)).argmax(axis=1)
            names[rows] = np.array(own, dtype=object)[best]
            if len(own) > 1:
                score[rows] *= trust[np.arange(len(rows)), best] / (len(own) - 1)
        return names.tolist(), np.clip(score, 0, 1).astype(np.float64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [pa.array([r.tobytes() for r in trigrams(batch.column("text"))], pa.binary())]
        yield pa.record_batch([batch.column("lang"), *rows], names=["lang", "shares"])


def fit(documents: DataFrame, known: Column, per_language: int = 500, families: Mapping[str, str] = FAMILIES) -> Model:
    """Learn from the ``text`` and ``lang`` of documents that meet ``known`` and have both.

    The sample is bounded: of each language the ``per_language`` different texts with the least hash,
    16 KB of trigram shares each, come to the driver. Texts are read whole."""
    rows = documents.where(known).where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    some = rows.groupBy("lang", "h").agg(F.first("text").alias("text")).withColumn("place", place).where(F.col("place") <= per_language).select("lang", "text")
    sample = some.mapInArrow(_features, "lang string, shares binary").toArrow()
    langs = np.array(sample.column("lang").to_pylist(), dtype=object)
    if not len(langs):
        return Model()
    x = np.ones((len(langs), BUCKETS + 1))
    for row, shares in zip(x, sample.column("shares"), strict=True):
        row[:-1] = np.frombuffer(shares.as_buffer(), dtype=np.float32)
    del sample
    # Rare trigrams count as much as frequent ones; the factor goes into the weights.
    factor = 1 / np.sqrt(x[:, :-1].mean(axis=0) + 1e-5)
    x[:, :-1] *= factor
    languages: dict[str, list[str]] = {}
    for name in sorted(set(langs)):
        languages.setdefault(families.get(name, name), []).append(name)
    names = sorted(languages)
    of = np.array([families.get(v, v) for v in langs], dtype=object)
    weights, pairs = [], []
    for name in names:
        y = np.where(of == name, 1.0, -1.0)
        weights.append(svm(x, y) if len(names) > 1 else np.r_[np.zeros(BUCKETS), 1e3])
    for name in names:
        for a, b in combinations(languages[name], 2):
            own = (langs == a) | (langs == b)
            weights.append(svm(x[own], np.where(langs[own] == a, 1.0, -1.0)))
            pairs.append((a, b))
    stacked = np.array(weights)
    stacked[:, :-1] *= factor
    return Model(names, languages, pairs, stacked)


def _predicted(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            names, score = model.predict(texts)
            lettered = [t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()]
            names = [n if ok else UNKNOWN for n, ok in zip(names, lettered, strict=True)]
            score = np.where(np.array(lettered, dtype=bool), score, 0.0)
            yield pa.record_batch([*batch.columns, pa.array(names, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return run


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred`` (a learned language, or ``und``) and ``score`` (0 to 1: how sure the family is, times how
    sure the language is within it) to every document, from its whole ``text`` alone.

    Families are told apart one against the rest, languages of a family in pairs that vote; linear machines
    all of them. Defined results: a text that is null or has no letter is ``und`` with score 0, and so is
    every text if nothing was learned; other columns stay as they are, but for columns named like the
    two that are added, which are replaced; an empty table gives an empty one. The model has 16 KB for
    each machine, whatever the input, and goes to the tasks with the code."""
    rest = documents.drop("lang_pred", "score")
    schema = rest.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rest.mapInArrow(_predicted(model), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Every fifth document by the crc32 of its id; documents without an id are held out too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
