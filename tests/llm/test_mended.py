"""Cases that once went wrong: leaks that vanished, clashing names, very many matches, few partitions, equal and missing ids."""

from __future__ import annotations

import random
import sys
import time
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from playbill.llm import languages, leaks, lines, near_documents, personal, store, token_blocks
from playbill.llm.components import components, link
from playbill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("copies", [1, 3])
def test_a_table_that_is_nothing_but_the_benchmark(spark, copies):
    rng = random.Random(1)
    item = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(40))
    df = spark.createDataFrame([(i, item) for i in range(copies)], "doc_id long, text string")
    got = leaks.find(df, spark.createDataFrame([(7, item), (8, "other words " * 10)], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, 7) for i in range(copies)]


def test_leaks_against_brute_force(spark):
    """Every document against every item by the longest common subsequence with any stretch of its words."""
    docs = [(r.doc_id, (r.text or "").lower().split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for d, w in docs:
        held = defaultdict(list)
        for i, x in enumerate(w):
            held[x].append(i)
        for item_id, own in items:
            n, length = len(own), 0
            places = [p for x in own for p in held.get(x, ())]
            # Stretches as long as the item, around each place of one of its words, stand for all.
            for at in sorted({p // 8 * 8 for p in places}) if len(set(own) & set(held)) >= 0.8 * len(set(own)) else ():
                length = max(length, leaks.common(own, w[max(0, at - n) : at + n + 8]))
            if length >= 0.8 * n:
                want.add((d, item_id))
    got = {(r.doc_id, r.item_id) for r in leaks.find(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))).collect()}
    assert want and want <= got


def test_stars_are_seen_without_another_round(spark):
    """Edges that are stars already take no round; a node with two smaller neighbours, or in the middle, does."""

    def shape(*edges):
        return link.__globals__["_shape"](spark.createDataFrame(edges, "a long, b long"))

    assert shape((2, 1), (3, 1), (9, 8)) == (3, True)
    assert shape((3, 2), (2, 1)) == (2, False)
    assert shape((3, 1), (3, 2)) == (2, False)
    assert link.__globals__["_shape"](spark.createDataFrame([], "a long, b long")) == (0, True)
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    for few in (1_000_000, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setitem(components.__globals__, "BROADCAST", few)
            got = {(r.id, r.component) for r in components(chain).collect()}
        assert got == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_windows_left_out_hold_no_leak():
    """Windows without enough rare words of any item are not scored: few are, and the leaks are those of all windows."""
    rng, words = random.Random(3), [f"w{i}" for i in range(400)]
    idf, weights = np.full(1 << leaks.BITS, 1.0), np.random.default_rng(3).standard_normal((1 << leaks.BITS, 16)).astype(np.float32)
    items = [rng.choices(words, weights=range(400, 0, -1), k=rng.randint(9, 60)) for _ in range(40)]
    texts = []
    for i in range(300):
        own = rng.choices(words, weights=range(400, 0, -1), k=rng.randint(0, 300))
        held = [x for x in items[i % 40] if rng.random() > 0.25] if i % 3 == 0 else []
        at = rng.randint(0, len(own))
        texts.append(" ".join(own[:at] + held + own[at:]))
    prepared, blank = leaks._prepared(pa.table({"item_id": list(range(40)), "text": [" ".join(x) for x in items]}), weights)
    batch = pa.record_batch({"doc_id": list(range(300)), "text_key": list(range(300)), "text": texts})

    def found(cosine):
        own = leaks._found(prepared, {}, weights, idf, cosine, 0.8, 0.6, 5)([batch])
        return sorted((r["doc_id"], r["item_id"], r["lcs"]) for part in own for r in part.to_pylist())

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(leaks, "_rare", lambda *_: (np.zeros(0, dtype=np.uint64), 0))
        every = {cosine: found(cosine) for cosine in (-1.0, 0.3)}
    assert len(every[-1.0]) > 40 and every == {cosine: found(cosine) for cosine in every}


def test_stages_take_columns_with_their_own_names(spark):
    names = ["__d", "__k", "__t", "__c", "__gone", "__lines", "gone", "lines", "text_key", "check", "d", "k", "id", "held", "whole", "removed", "component_id", "kept"]
    line = "the same long line of words that stands here and there in several texts"
    texts = ["one text\n" + line, "another text of its own\n" + line, None, "", " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60))]
    rows = [(i, t, *range(len(names))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    benchmark = spark.createDataFrame([(1, texts[4])], "item_id long, text string")
    for left, want in ((lines.drop_repeats(df, k=4), {0, 1, 2, 3, 4}), (near_documents.drop_near_copies(df), {0, 1, 2, 3, 4}), (leaks.drop_leaks(df, benchmark), {0, 1, 2, 3})):
        assert left.columns == df.columns
        got = left.collect()
        assert {r.doc_id for r in got} == want and all(tuple(r)[2:] == tuple(range(len(names))) for r in got)
    assert store.free(df, "gone", "x", "GONE") == ["_gone", "x", "__GONE" if "__gone" not in names else "___GONE"]


def test_lines_equal_brute_force_at_the_registered_run(spark):
    """At runs of four characters, as the query and the pipeline take them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids, rows = {}, []
    for r in docs.collect():
        for p, x in enumerate((r.text or "").split("\n")):
            if plain := x.strip(" \t\r").lower():
                rows.append((r.doc_id, p, ids.setdefault(plain, len(ids))))
    sets, having = [{x[i : i + 4] for i in range(max(1, len(x) - 3))} for x in ids], defaultdict(set)
    # Pairs that can reach the threshold share one of the rarest fifth of a set's runs, or so many that any of them will do.
    count = defaultdict(int)
    for x in sets:
        for g in x:
            count[g] += 1
    for i, x in enumerate(sets):
        for g in sorted(x, key=lambda g: (count[g], g))[: len(x) - int(0.8 * len(x) + 0.999999) + 1]:
            having[g].add(i)
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for own in having.values():
        some = sorted(own)
        for i, a in enumerate(some):
            for b in some[i + 1 :]:
                both = len(sets[a] & sets[b])
                if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                    root[max(find(a), find(b))] = min(find(a), find(b))
    first, want = {}, defaultdict(list)
    for d, p, i in rows:
        first[find(i)] = min((d, p), first.get(find(i), (d, p)))
    for d, p, i in rows:
        if first[find(i)] != (d, p):
            want[d].append(p)
    assert {r.doc_id: r.removed for r in lines.marks(docs, k=lines.SHORT).collect()} == want


def test_very_many_matches_in_one_text(spark):
    n = 100_000
    df = spark.createDataFrame([(1, "1.2.3.4," * 3), (2, "11," * n + " 9.8.7.6")], "doc_id long, text string")
    begun = time.time()
    got = {r.doc_id: r.spans for r in personal.find(df).select("doc_id", personal.listed(F.col("spans"), personal.BASE).alias("spans")).collect()}
    assert got[1] == "ip:0:7,ip:8:15,ip:16:23" and got[2] == f"ip:{3 * n + 1}:{3 * n + 8}"
    assert time.time() - begun < 60
    # Around the edges of the runs that are placed together.
    for m in (personal.RUN - 1, personal.RUN, personal.RUN + 1, 3 * personal.RUN):
        text = "a@b.co é " * m
        spans = personal.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
        assert [(s.start, s.end) for s in spans] == [(9 * i, 9 * i + 6) for i in range(m)]


def test_token_files_of_equal_and_missing_ids(spark):
    import public_tokenizers

    rows = [(None, f"word {i}") for i in range(400)] + [(5, f"other {i}") for i in range(400)] + [(9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    # Not merged, as they would be for a table as small as this.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = token_blocks.write(df, public_tokenizers.path("word_bpe_49k.json"), end=2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_blocks.read(files).orderBy("start").collect()
    assert files.count() > 3 and [r.doc_id for r in got] == [None] * 400 + [5] * 400 + [9]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert token_blocks.read(files).rdd.getNumPartitions() == 8


def test_every_query_takes_empty_tables(spark, tmp_path):
    for name in ("documents", "embeddings", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("op5_separator_scan", "op6_token_blocks", "op7_personal_data", "op8_language", "op10_bpe_codec"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0, name


def test_lines_meet_by_likeness_and_not_by_chance(spark):
    """Keys of six values: lines of one language, a fifth of whose runs are common, hardly meet; lines at the threshold do, and their marks are near."""
    rng = random.Random(8)
    some = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(60)]
    rows = []
    for i in range(300):
        line = " ".join(rng.choices(some, k=rng.randint(30, 60)))
        at = rng.randrange(20, len(line) - 20)
        rows += [(2 * i, line), (2 * i + 1, f"{line[:at]}##{line[at + 2:]}")]
    signed = {r.i: r for r in lines._signed(spark.createDataFrame(rows, "i long, line string"), lines.SHORT).collect()}
    met = {(a, b) for a in signed for b in signed if a < b and any(x == y for x, y in zip(signed[a]["keys"], signed[b]["keys"], strict=True))}
    pairs = {(2 * i, 2 * i + 1) for i in range(300)}
    assert pairs <= met and len(met) < 5 * len(pairs)
    marks = spark.createDataFrame([(signed[a].mark, signed[b].mark, signed[a].sign, signed[b].sign) for a, b in pairs], "x long, y long, s array<long>, t array<long>")
    assert marks.where(f"{lines._near('x', 'y', 0.8)} and {lines._alike('s', 't', 0.8)}").count() == len(pairs)


def test_lines_are_signed_in_compiled_columns(spark):
    signed = lines._signed(spark.createDataFrame([("abcdefgh",)], "line string"), lines.SHORT)
    assert "Generate" not in signed._jdf.queryExecution().toString()


def test_members_met_in_full_are_not_looked_at_again(spark, monkeypatch):
    linking = sys.modules["playbill.llm.components"]
    kept, scratch = [], linking.scratch
    monkeypatch.setattr(linking, "scratch", lambda df, name: (kept.extend(df.collect()) if name == "met" else None) or scratch(df, name))
    buckets = {1: [1], 2: [2, 3], 3: [4, 5, 6], 4: [7, 8, 9, 10, 11], 5: [12, 13, 14]}
    rows = spark.createDataFrame([(b, i, 100 if i in (12, 13, 14) and i % 2 else 0) for b, ids in buckets.items() for i in ids], "bucket long, id long, mark long")
    texts = lambda ids: ids.withColumn("text", F.col("id").cast("string"))
    # 5 is like 6 and not like 4; 9 and 10 are alike, and neither is like an end of their bucket.
    alike = "concat(a, '-', b) in ('3-2', '6-5', '10-9', '13-12', '14-12')"
    found = linking.link_marked([rows.where("bucket < 4"), rows.where("bucket >= 4")], texts, lambda p: p.where(alike).select("a", "b"), lambda x, y: f"{x} = {y}", lambda p: p)
    assert {(r.id, r.component) for r in found.collect()} == {(2, 2), (3, 2), (5, 5), (6, 5), (9, 9), (10, 9), (12, 12), (14, 12)}
    assert {r.id for r in kept if r.bucket is not None} == {7, 8, 9, 10, 11}
    assert {r.id for r in kept if r.bucket is None} == {3, 5, 6, 14}


def test_the_sample_of_languages_is_held_once():
    x = np.hstack([np.random.default_rng(0).random((400, 2000)), np.ones((400, 1))])
    tracemalloc.start()
    languages.svm(x, np.where(np.arange(400) % 2, 1.0, -1.0), rounds=1)
    assert tracemalloc.get_traced_memory()[1] < x.nbytes / 4
    tracemalloc.stop()
