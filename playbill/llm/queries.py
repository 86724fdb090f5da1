"""One query for each operator, over its whole table, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill.llm import bpe, filter_audit, fingerprints, languages, leaks, lines, near_documents, near_vectors, personal, separators, substrings, token_blocks, vector_codes
from playbill.session import configure, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(configure(spark), sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.links(table(spark, sf_dir, "embeddings"))


@query
def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    marked = lines.marks(documents, k=lines.SHORT)
    text = F.coalesce("text", F.lit(""))
    every = documents.select("doc_id", F.xxhash64(text).alias("text_key"), F.size(F.split(text, "\n")).cast("long").alias("n_lines"))
    same = F.expr("doc_id <=> d and text_key = k")
    return every.join(marked.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "removed"), same, "left").select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed"),
    )


@query
def op3_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents.groups(table(spark, sf_dir, "documents")).select("doc_id", "component_id", "kept")


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[personal.count(spans, kind).alias(f"n_{kind}") for kind in personal.BASE],
        F.sha2(personal.listed(spans, personal.BASE), 256).alias("base_sha256"),
        personal.listed(spans).alias("spans"),
    )


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = languages.fit(documents, ~languages.held_out())
    named = documents.select("doc_id", "text", languages.held_out().alias("held_out"))
    return languages.identify(named, model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.col("kept").cast("binary"), 256)
    columns = {"n_words": F.col("n_words"), "n_removed": F.col("n_removed"), "kept_sha256": digest}
    return substrings.cut_repeats(table(spark, sf_dir, "documents"), columns=columns)


@query
def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "lcs", "n_words")


@query
def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    contents = separators.write(table(spark, sf_dir, "documents"), path, pattern, end=50256)
    return separators.counts(contents, end=50256)


@query
def op6_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_blocks.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)
    return token_blocks.read(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op11_text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = filter_audit.SQL


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(vector_codes.compress(table(spark, sf_dir, "embeddings")))


ORACLES["op13_vector_codes"] = vector_codes.sql()
