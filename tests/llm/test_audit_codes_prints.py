"""Filter audit, vector codes and fingerprints against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from oracle import compare, connect
from playbill.llm import filter_audit, fingerprints, vector_codes
from playbill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 700}x{i // 700}" for i in range(30_000))
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one two", ""), (5, LONG, "a"), (6, LONG + " end", "b"), (7, "one two", "b"),
    (7, "one two", "b"), (None, "no id", "b"), (None, "no id", "b"), (9, "ünï 漢字 😀. Zwei!\n" * 30, "b"), (9, "ünï 漢字 😀. Zwei!\n" * 31, "b"),
    (10, "AB C " * 300 + "$", "a"), (11, "x" * 20_000, "a"), (12, "A b.\n" * 400, "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names the operators use themselves."""
    rows = [(d, t, s, "clash", i, i, i) for i, (d, t, s) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, part string, mask int, row int, pair int")


@pytest.fixture(scope="module")
def odd_labels(spark):
    rows = [(1, 1, 0, 5), (1, 0, 1, 5), (5, 1, 1, 5), (7, 1, 0, 5), (12, None, 1, 5), (None, 1, 1, 5), (99, 1, 1, 5)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, part int")


def plain_audit(documents, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    first = {}
    for d, t, _ in documents:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    rows = {}
    for d, t, s in documents:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if d is not None and d > first[t] else set()
        rows.setdefault(s or "", []).append((d, fails))
    out = Counter()
    for part, own in rows.items():
        removed_in_all, got = Counter(), []
        for order in permutations("ABCDE"):
            for i, x in enumerate(order):
                before = set(order[:i])
                here = [d for d, f in own if x in f and not f & before]
                removed_in_all[x] += len(here)
                got.append(
                    ("".join(order), i + 1, sum(not f & (before | {x}) for _, f in own), len(here), sum(x in f and bool(f & before) for _, f in own),
                     sum(f == {x} for _, f in own), sum(d in good for d in here), sum(d in toxic for d in here), x)
                )
        for *row, x in got:
            out[(part, *row, removed_in_all[x])] += 1
    return out


def test_audit(odd, odd_labels):
    got = Counter(tuple(r) for r in filter_audit.audit(odd, odd_labels).collect())
    assert got == plain_audit(ODD, [tuple(r)[:3] for r in odd_labels.collect()])


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_vector_codes"])
def test_sql(spark, name):
    assert name in ORACLES
    rows, problem = compare(spark, connect(SF), SF, name)
    assert rows and problem is None


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(v, e, x) for v, e, x in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    if not kept:
        return [], ""
    width = max(1, -(-max(len(e) for _, e, _ in kept) // parts))
    x = [[math.floor(4096 * float(np.float32(c))) for c in e] + [0] * (parts * width - len(e)) for _, e, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for v in x] for p in range(parts)]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, [float(np.float32(c)) for c in kept[i][1]]))[:entries]
    books = [[cut[p][i] for i in order] for p in range(parts)]

    def nearest(p):
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(books[p])) for v in cut[p]]

    for _ in range(rounds):
        for p in range(parts):
            at = nearest(p)
            for e in range(len(books[p])):
                own = [cut[p][i] for i, (_, f) in enumerate(at) if f == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    last = [nearest(p) for p in range(parts)]
    codes = ["".join(f"{last[p][i][1]:02x}" for p in range(parts)) for i in range(len(kept))]
    errors = [sum(last[p][i][0] for p in range(parts)) for i in range(len(kept))]
    of = Counter()
    for (_, _, label), e in zip(kept, errors):
        of[label] += e
    text = ",".join(str(c) for b in books for e in b for c in e)
    return [(v, c, e, of[label]) for (v, _, label), c, e in zip(kept, codes, errors)], hashlib.sha256(text.encode()).hexdigest()


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dim))
    rows = [(int(i) if i % 9 else i // 2, [float(c) for c in centres[i % 5] + 0.2 * rng.standard_normal(dim)], [None, 1, 2][i % 3]) for i in range(n)]
    return rows + [(n, None, 1), (n + 1, [float("nan")] * dim, 1), (n + 2, [None] + [0.5] * (dim - 1), 1), (n + 3, [float("inf")] * dim, 2), (n + 4, [0.0] * dim, 2), (None, [0.25] * dim, 2), (n + 5, [], 1), (n + 6, [1.0] * (dim // 2), 1), *rows[:7]]


@pytest.mark.parametrize(("n", "dim"), [(300, 16), (60, 13), (4, 3), (0, 8)])
def test_codes(spark, n, dim):
    rows = vectors(n, dim, n)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, of int").repartition(3)
    codes = vector_codes.compress(df)
    want, digest = plain_codes(rows)
    assert Counter(tuple(r)[:4] for r in vector_codes.digests(codes).collect()) == Counter(want)
    assert codes.digest() == digest


def test_codes_of_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.uniform(-9000, 9000, 8)], i % 2) for i in range(100)]
    codes = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    want, digest = plain_codes(rows)
    assert Counter(tuple(r)[:4] for r in vector_codes.digests(codes).collect()) == Counter(want) and codes.digest() == digest


def test_bounds_spare_distances(spark):
    rng = np.random.default_rng(2)
    centres = 10 * rng.standard_normal((16, 16))
    rows = [(i, [float(c) for c in centres[i % 16] + 0.1 * rng.standard_normal(16)], 0) for i in range(2000)]
    work = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).work
    assert work[0] == (0, 2000 * 8)
    assert all(one <= 2000 * 8 // 2 and every <= 2000 * 8 // 10 for one, every in work[2:])


def test_codes_of_nothing(spark):
    for rows in ([], [(1, None, 1), (2, [None], 1)]):
        codes = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
        assert vector_codes.digests(codes).count() == 0 and codes.digest() == hashlib.sha256(b"").hexdigest()


def pieces(text):
    return set(re.findall("[^ \t\n\x0b\f\r][^\n]{0,239}+[^\n.!?]*+[.!?]*+", text or ""))


def plain_versions(rows):
    """Rows with the same id and text are one document; ids descending, nulls last."""
    one = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (d, t) in enumerate(one):
        after = one[(i + 1) % len(one)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        near = []
        for other in (edited, after):
            a, b = pieces(t), pieces(other)
            near.append(len(a & b) / len(a | b) if a | b else 1.0)
        out[d, t] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), *near)
    return out


def versions(df):
    got = fingerprints.compare(df).collect()
    assert df.sparkSession.createDataFrame(got, fingerprints.compare(df.limit(0)).schema).columns == [
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    ]
    return got


def test_fingerprints(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = plain_versions(rows)
    got = {r.doc_id: r for r in versions(df)}
    assert len(got) == len(rows)
    by_text = {}
    for d, t in rows:
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == want[d, t][:2]
        assert r.near_edited == pytest.approx(want[d, t][2], abs=1e-12) and r.near_next == pytest.approx(want[d, t][3], abs=1e-12)
        by_text.setdefault(t, set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len({x for s in by_text.values() for x in s}) == len(by_text)


def test_fingerprints_of_odd_rows(spark, odd):
    rows = [(d, t) for d, t, _ in ODD if d != 9]
    want = plain_versions(rows)
    left = odd.where("doc_id is null or doc_id <> 9")
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in versions(left))
    assert got == Counter((d, *want[d, t or ""][:2], *[round(x, 9) for x in want[d, t or ""][2:]]) for d, t in rows)
    # Rows with the same id but other texts are documents of their own.
    assert sum(r.doc_id == 9 for r in versions(odd)) == 2
    assert versions(odd.limit(0)) == []
    alone = versions(spark.createDataFrame([(5, "A b. C d.\nE")], "doc_id long, text string"))
    assert len(alone) == 1 and alone[0].near_next == 1.0 and alone[0].n_chars == 11


def test_differences_grow_until_they_are_found(spark):
    rng = random.Random(4)
    sets = []
    for i, (common, x, y) in enumerate([(0, 0, 0), (5, 0, 0), (0, 3, 0), (40, 2, 5), (10, 30, 0), (900, 700, 350), (0, 9000, 9000), (3000, 1, 1)]):
        every = [rng.getrandbits(64) - 2**63 for _ in range(common + x + y)]
        sets.append((i, every[: common + x], every[:common] + every[common + x :]))
    df = spark.createDataFrame([*sets, (99, None, None), (98, [7], None)], "pair long, a array<long>, b array<long>")
    found = {r.pair: r for r in fingerprints.differences(df).collect()}
    assert set(found) == {2, 3, 4, 5, 6, 7, 98}
    for i, a, b in [*sets, (98, [7], [])]:
        if i in found:
            assert sorted(found[i].removed) == sorted(set(a) - set(b)) and sorted(found[i].added) == sorted(set(b) - set(a))
    counted = {r.pair: (r.removed, r.added) for r in fingerprints.differences(df, digests=False).collect()}
    assert counted == {i: (len(r.removed), len(r.added)) for i, r in found.items()}


def test_one_table_is_enough_for_small_differences(spark):
    rng = random.Random(5)
    rows = [(i, n, [rng.getrandbits(62) for _ in range(size)]) for i in range(200) for n, size in ((1, 20), (-1, 15))]
    sets = spark.createDataFrame(rows, "id long, n int, digests array<long>").repartition("id")
    left = fingerprints.peel(fingerprints.tables(sets)).collect()
    whole = {i for i in range(200)} - {r.id for r in left if r.got is None}
    assert len(whole) >= 198
    for i in whole:
        assert sorted((r.n, r.got) for r in left if r.id == i) == sorted((n, d) for k, n, own in rows if k == i for d in own)


def test_long_text_takes_time_in_proportion(spark):
    import time

    text = " ".join(f"Satz {i} von {i % 7919} Wörtern." for i in range(120_000))
    df = spark.createDataFrame([(1, text), (2, "kurz")], "doc_id long, text string")
    begun = time.time()
    got = {r.doc_id: r for r in fingerprints.compare(df).collect()}
    assert got[1].n_chars == len(text) and 0.4 < got[1].near_edited < 0.6 and time.time() - begun < 120


def test_queries_take_empty_tables(spark, tmp_path):
    for name in ("documents", "embeddings", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("op11_text_fingerprints", "op12_filter_audit", "op13_vector_codes"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0
