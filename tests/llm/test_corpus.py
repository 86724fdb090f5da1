"""Each operator against a plain version of it, and on nulls, empty and long texts, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from playbill.llm import bpe, languages, leaks, lines, near_documents, near_vectors, personal, separators, substrings, token_blocks
from playbill.llm.components import components
from playbill.llm.leaks import LEAST
from playbill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 700}x{i // 700}" for i in range(30_000))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, LONG), (6, LONG + " end"), (7, "one two"), (7, "one two"),
    (None, "no id here, a line of its own\nand one more line that is long enough"), (9, "ünï 漢字 😀\n" * 3),
    (10, "12 34 5678"), (11, "x" * 20_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names the operators use themselves."""
    rows = [(d, t, "en" if i % 2 else None, "s", i, "k", i) for i, (d, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id int, text_key string, n int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def union(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(a) for a in range(n)]


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 400)] + [(5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = union(401, links)
    assert got == {i: root[i] for i in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("odd_rows", [False, True])
def test_substrings(docs, odd, odd_rows):
    df = odd if odd_rows else docs
    split = [(d, (t or "").encode().split()) for d, t in texts(df)]
    seen = Counter(tuple(w[k : k + 35]) for _, w in split for k in range(len(w) - 34))
    want = Counter()
    for d, w in split:
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        want[d, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()] += 1
    assert Counter(tuple(r) for r in substrings.cut_repeats(df).collect()) == want


def bag(text):
    w = (text or "").lower().encode().split()
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_near_documents(docs):
    rows = texts(docs)
    bags = [bag(t) for _, t in rows]
    links = []
    for i, x in enumerate(bags):
        for j in range(i):
            both = sum((x & bags[j]).values())
            if both and both >= 0.8 * sum((x | bags[j]).values()):
                links.append((i, j))
    root = union(len(rows), links)
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min(d, least.get(r, d))
    got = {r.doc_id: r.component_id for r in near_documents.groups(docs).collect()}
    assert got == {d: least[r] for (d, _), r in zip(rows, root, strict=True)}


def test_near_documents_odd(odd):
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_documents.groups(odd).collect())
    assert got[1, 1, True] and got[2, 2, True] and got[3, 3, True] and got[None, None, True]
    assert got[7, 4, False] == 2 and got[6, 5, False] == 1 and sum(got.values()) == len(ODD)
    left = near_documents.drop_near_copies(odd)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 9, 10, 11]


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    element = rng.integers(0, 2**63, 60).astype(np.uint64)
    x, y = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    x[:10], y[50:] = 0, 0
    own, other = np.flatnonzero(x), np.flatnonzero(y)
    owner = np.r_[np.zeros(len(own), dtype=np.int64), np.ones(len(other), dtype=np.int64)]
    s = near_documents.bag_minhash(owner, np.r_[element[own], element[other]], np.r_[x[own], y[other]], 2, 4096)
    assert abs((s[0] == s[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.03


def test_lines(docs, odd):
    def shingles(line):
        return {line[i : i + 10] for i in range(max(1, len(line) - 9))}

    rows, ids = [], {}
    for d, t in texts(docs):
        for p, line in enumerate((t or "").split("\n")):
            if plain := line.strip(" \t\r").lower():
                rows.append((d, p, ids.setdefault(plain, len(ids))))
    sets, having = [shingles(x) for x in ids], defaultdict(list)
    for i, x in enumerate(sets):
        for s in x:
            having[s].append(i)
    shared = Counter((a, b) for own in having.values() for a in own for b in own if a < b)
    root = union(len(sets), [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)])
    first = {}
    for d, p, i in rows:
        first[root[i]] = min((d, p), first.get(root[i], (d, p)))
    want = defaultdict(list)
    for d, p, i in rows:
        if first[root[i]] != (d, p):
            want[d].append(p)
    assert {r.doc_id: r.removed for r in lines.marks(docs).collect()} == want
    cut = lines.drop_repeats(odd)
    assert cut.columns == odd.columns
    left = {r.doc_id: r.text for r in cut.collect()}
    assert left[1] is None and left[2] == "" and left[4] == "one two" and 7 not in left and left[9] == "ünï 漢字 😀\n"


def test_lines_with_one_character_changed(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for i, n in enumerate(range(40, 101)):
        line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=n - 2))
        at = rng.randrange(8, n - 10)
        rows += [(2 * i, f"<{line}>"), (2 * i + 1, f"<{line[:at]}#{line[at + 1:]}>")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    removed = {r.doc_id: r.n_removed for r in QUERIES["op2_fuzzy_lines"](spark, str(tmp_path)).collect()}
    assert removed == {d: d % 2 for d, _ in rows}


def test_line_signatures_are_independent(spark):
    rng = random.Random(7)
    pairs = []
    for _ in range(3000):
        union = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(5)]
        pairs.append(union)
    # Lines are taken as their words here: sets of 5 and 4 words, 4 in common.
    rows = [(i, j, w) for i, u in enumerate(pairs) for j, own in enumerate((u, u[:4])) for w in own]
    words = spark.createDataFrame(rows, "pair long, side int, w string").withColumn("h", F.xxhash64("w"))
    values = [lines.half(F.xxhash64("h", F.lit(j // 2)), j) for j in range(lines.BANDS * lines.ROWS)]
    signed = words.groupBy("pair", "side").agg(*[F.min(v).alias(f"m{j}") for j, v in enumerate(values)]).collect()
    sign = {(r.pair, r.side): r[2:] for r in signed}
    same = np.array([[x == y for x, y in zip(sign[i, 0], sign[i, 1], strict=True)] for i in range(len(pairs))])
    assert abs(same.mean() - 0.8) < 0.01
    # All of eight bands differ in 0.3 % of cases if values are independent, in 1.8 % if they are one hash exclusive-ored.
    missed = ~same.reshape(len(pairs), -1, lines.ROWS).all(axis=2)
    assert missed[:, :8].all(axis=1).mean() < 0.009 and missed.all(axis=1).mean() < 0.002


def test_native_operators_run_no_python(docs):
    for df in (personal.find(docs), lines.drop_repeats(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 24))
    rows = [(i, (base[i % 40] + rng.standard_normal(24) * 0.2 * (i % 5)).tolist()) for i in range(240)]
    rows += [(500 + i, rows[0][1]) for i in range(3)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] + [1.0] * 23), (904, [])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    ids = [i for i, _ in rows[:243]]
    x = np.array([e for _, e in rows[:243]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    root = union(243, list(zip(*np.nonzero(near), strict=True)))
    for k, i in enumerate(ids):
        assert got[i] == (near[k].sum() - 1, ids[root[k]], ids[root[k]] == i)
    assert all(got[i] == (0, i, True) for i in range(900, 905))


def test_leaks(spark, odd):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(3000)]
    clean = [(i, " ".join(rng.choices(vocabulary, k=200))) for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=20 + i))) for i in range(20)] + [(50, None), (51, ""), (52, "too short"), (None, clean[0][1])]
    planted = [(1000 + i, clean[i][1] + " " + items[i][1].upper() + "  " + clean[i + 1][1]) for i in range(20)]
    df = spark.createDataFrame(clean + planted, "doc_id long, text string").unionAll(odd.select("doc_id", "text"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.find(df, benchmark).collect()}
    assert got == {(1000 + i, i) for i in range(20)}
    assert leaks.drop_leaks(df, benchmark).count() == df.count() - 20
    assert leaks.find(df.limit(0), benchmark).count() == 0


def test_leaks_in_short_texts_and_of_short_items(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(3000)]
    clean = [(i, " ".join(rng.choices(vocabulary, k=200))) for i in range(300)]
    items = [(n, rng.choices(vocabulary, k=n)) for n in range(1, 80)]
    alone = []
    for n, own in items[LEAST - 1 :]:
        for gone in (1, 2, 3, n // 5):
            if n - gone >= 0.8 * n:
                out = set(rng.sample(range(n - 5), gone))
                alone.append((1000 * n + gone, " ".join(x for i, x in enumerate(own) if i not in out)))
    short = [(500 + n, clean[n][1] + " #" + str(n) + " " + " ".join(own)) for n, own in items[1 : LEAST - 1]]
    df = spark.createDataFrame(clean + alone + short, "doc_id long, text string")
    benchmark = spark.createDataFrame([(n, " ".join(own)) for n, own in items if n > 1], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.find(df, benchmark).collect()}
    assert {(d, d // 1000) for d, _ in alone} | {(d, d - 500) for d, _ in short} <= got
    plain = {d: " " + t + " " for d, t in clean + alone + short}
    assert {(d, n) for d, n in got if n < LEAST} == {(d, n) for n, own in items[1 : LEAST - 1] for d, t in plain.items() if " " + " ".join(own) + " " in t}


def test_leaks_that_keep_the_answer(spark):
    """Paraphrases at the edge of what the common subsequence accepts are found, not only whole passages."""
    rng = random.Random(9)
    rows = texts(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"))
    benchmark = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/benchmark.parquet")
    items = [(r.item_id, r.text.split()) for r in benchmark.collect()]
    vocabulary = [x for _, t in rows for x in (t or "").split()]
    planted = []
    # Each item once, as copies would be a latent direction of their own.
    for i, (item_id, own) in enumerate(items):
        share, n = (0.15, 0.2, 0.3, 0.38)[i % 4], len(own)
        for at in rng.sample(range(n if share <= 0.2 else n - 5), int(share * n)):
            own[at] = rng.choice(vocabulary)
        planted.append((1_000_000 + 1000 * item_id + i, " ".join(rng.choices(vocabulary, k=90) + own + rng.choices(vocabulary, k=90))))
    df = spark.createDataFrame(rows + planted, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.find(df, benchmark).collect()}
    found = [(d, (d - 1_000_000) // 1000) in got for d, _ in planted]
    assert len(found) == 200 and sum(found) >= 198, [sum(found[i::4]) for i in range(4)]


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert leaks.common(a, b) == table[-1][-1]


@pytest.mark.parametrize("block", [64, 1 << 22])
def test_separators(odd, block):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encode = separators._encoding(path, public_tokenizers.PATTERN).encode_ordinary
    assert isinstance(separators._encoding(path, public_tokenizers.PATTERN), tiktoken.Encoding)
    contents = separators.write(odd, path, public_tokenizers.PATTERN, 50256)
    got = Counter(tuple(r) for r in separators.counts(contents, 50256, block=block).collect())
    assert got == Counter((d, len(encode(t or ""))) for d, t in ODD)


def test_token_blocks(docs, odd):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for df in (docs, odd.where("doc_id is not null")):
        rows = sorted(((d, t or "") for d, t in texts(df)), key=lambda r: (r[0], r[1].encode()))
        want, start = [], 0
        for d, t in rows:
            ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
            want.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
            start += len(ids)
        files = token_blocks.write(df, public_tokenizers.path("word_bpe_49k.json"), 2)
        read = token_blocks.read(files).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
        assert sorted(map(tuple, read)) == sorted(want)
    assert token_blocks.read(token_blocks.write(odd.limit(0), public_tokenizers.path("word_bpe_49k.json"), 2)).count() == 0


def test_block_packing():
    rng = np.random.default_rng(0)
    for values in (rng.integers(0, 49408, 5000), np.r_[rng.integers(5, 9, 999), 2**32 - 1], rng.integers(0, 2**32, 200), np.full(300, 7), np.zeros(0)):
        values = values.astype(np.uint32)
        assert (token_blocks.unpack(token_blocks.pack(values), len(values)) == values).all()


def test_bpe(odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, own = Tokenizer.from_file(path), bpe.load(path)
    rng = random.Random(1)
    some = ["<|endoftext|>", "a<|endoftext|> b", "I've don't 'S  x   \n\n y\t", "é ﬁ １２ ½", "a" * 3000, LONG]
    some += ["".join(chr(rng.choice([rng.randrange(1, 0x3000), rng.randrange(0x1F300, 0x1F700), 32])) for _ in range(25)) for _ in range(500)]
    for text in some:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
        assert own.decode(own.encode(text)) == tokenizer.decode(ids, skip_special_tokens=False)
    coded = bpe.decode(bpe.encode(odd, path), path)
    assert coded.columns == [*odd.columns, "ids", "decoded"]
    assert all(r.decoded == (r.text or "") for r in coded.collect())


def base_spans(text):
    def luhn(digits):
        values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return sum(v - 9 * (v > 9) for v in values) % 10 == 0

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    checks = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)),
        "phone": lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, text or "") if checks[k](m[0]))


def test_personal(spark, docs, odd):
    rng = random.Random(3)
    fuzz = ["".join(rng.choices("ab1234567890.@-+ ()%_ é😀\nDE", k=rng.randrange(60))) for _ in range(1500)]
    fuzz += ["a" * 9000 + "@b.c_d@e.f", "1" * 9000, "1." * 3000, "+1" + " " * 9000, "4111 1111 1111 1111", "é😀 a@b.co 1.2.3.4.5.6.7.8 1.2.3.256"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(fuzz)], "doc_id long, text string")
    for rows in (df, docs, odd):
        for r in personal.find(rows).select("text", personal.listed(F.col("spans"), personal.BASE).alias("spans")).collect():
            assert r.spans == base_spans(r.text)
    added = spark.createDataFrame([(1, "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765433; amex 378282246310005; tel 030 1234567" + "; " * 30 + "no 030 7654321")], "doc_id long, text string")
    assert personal.find(added).select(personal.listed(F.col("spans"))).first()[0] == "iban:5:32,short_card:63:78,local_phone:84:95"
    assert personal.redact(added).first().text.startswith("IBAN <iban>, GB82")


def test_account_numbers_end_with_their_last_group(spark):
    whole = ["BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "PL61 1090 1014 0000 0712 1981 2874", "DE89 3704 0044 0532 0130 00"]
    after = [" BIC GKCC", " 2024", " IN", " ABCD 1234 EF", ",", "", " DE89 3704 0044 0532 0130 00 X"]
    rows = [(w, a, f"é IBAN {w}{a}") for w in whole for a in after] + [("", "", "IBAN BE68 5390 0754 7035 2024"), ("", "", "IBAN DE89 3704 0044 0532 0130 01")]
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: [s.text for s in r.spans if s.kind == "iban"] for r in personal.find(df).collect()}
    for i, (w, a, t) in enumerate(rows):
        assert got[i] == ([w] if w else []) + (["DE89 3704 0044 0532 0130 00"] if "DE89" in a else []), t


def test_languages(spark, docs, odd):
    known = ~languages.held_out()
    model = languages.fit(docs, known)
    got = languages.identify(docs.select("doc_id", "text", "lang", languages.held_out().alias("held")), model).where("held").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    named = Counter((r.doc_id, r.lang_pred == "und") for r in languages.identify(odd, model).collect())
    assert all(named[d, True] for d in (1, 2, 3, 10)) and named[9, False] and named[7, False] == 2
    nothing = languages.fit(docs.limit(0), known)
    assert {r.lang_pred for r in languages.identify(odd, nothing).collect()} == {"und"}
    assert languages.identify(odd.limit(0), model).count() == 0


def test_languages_learn_from_different_texts(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(x, "".join(rng.choices(letters, k=30))) for x, letters in (("de", "abcdef "), ("fr", "uvwxyz ")) for _ in range(20)]
    df = spark.createDataFrame(rows, "lang string, text string")
    low = df.where("lang = 'de'").orderBy(F.xxhash64("text")).first()
    copies = spark.createDataFrame([tuple(low)] * 60, df.schema)
    seen, svm = [], languages.svm
    monkeypatch.setattr(languages, "svm", lambda x, y: seen.append(len(np.unique(x, axis=0))) or svm(x, y))
    languages.fit(df.unionAll(copies), F.lit(True), per_language=10)
    assert seen == [20, 20]


def test_pipeline_keeps_documents_without_labels(spark, odd):
    import corpus_pipeline

    plain = odd.withColumn("lang", F.lit(None).cast("string"))
    left = corpus_pipeline.known_language(spark, plain, SF)
    assert left.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 4, 5, 6, 7, 7, 9, 11]


def test_queries_take_empty_tables(spark, tmp_path):
    for name in ("documents", "embeddings", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("op1_near_vectors", "op2_fuzzy_lines", "op3_near_documents", "op4_benchmark_leaks", "op9_substring_dedup"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_digests(spark):
    got = {r.doc_id: r for r in QUERIES["op9_substring_dedup"](spark, SF).collect()}
    kept = {r.doc_id: r.kept for r in substrings.cut_repeats(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert all(got[d].kept_sha256 == hashlib.sha256(k.encode()).hexdigest() for d, k in kept.items())


def test_pipeline(spark, docs):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF)
    kept = {r.doc_id: r for r in rows.collect()}
    before = {d: t for d, t in texts(docs)}
    assert 0 < len(kept) <= len(before) and all(r.exact for r in kept.values())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "benchmark", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
