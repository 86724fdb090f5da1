"""Start lists: set operations on state tables, exclusions and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions import urls
from playbill.functions.dates import modified_after
from playbill.operators.grouping import cap_per_category, distinct_in_order
from playbill.session import computed


def exclude(df: DataFrame, blocked: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not in ``blocked``: a blacklist, processed URLs or failing ids."""
    return df.join(blocked.select(*on), on, "left_anti")


def seen_filter(keys: DataFrame, on: list[str], blocks: int) -> DataFrame:
    """A Bloom filter of ``keys`` as a table: ``_block`` and ``_bits``, 32,768 bits in each of ``blocks`` rows at most. All bits of a
    key lie in one block, so a key is looked up in one row."""
    bits = keys.select(_block(on, blocks).alias("_block"), F.explode(_places(on)).alias("_bit"))
    # The function takes positions from 0 and sets a bit once however often it comes; tasks combine before the shuffle.
    return bits.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def _block(on: list[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), *on), F.lit(blocks))


def _places(on: list[str]) -> Column:
    """The bits of a key: seven places of 15 bits from two hashes."""
    a, b = F.xxhash64(F.lit("a"), *on), F.xxhash64(F.lit("b"), *on)
    cuts = [F.shiftrightunsigned(a, 15 * i) for i in range(4)] + [F.shiftrightunsigned(b, 15 * i) for i in range(3)]
    return F.array(*[c.bitwiseAND(F.lit(32767)) for c in cuts])


def exclude_seen(df: DataFrame, seen: DataFrame, on: list[str], blocks: int = 4096) -> DataFrame:
    """``exclude`` for a table that is much larger than the rows in question, such as all URLs ever processed.

    A Bloom filter of it, 4 KB times ``blocks`` at most whatever its size, goes to every executor and lets rows that it does not know
    pass where they are. Only the others are looked up: they are few, so the large table is filtered by them first, and what it has of
    them is taken out. With more keys than about a tenth of the bits more rows are looked up; the result is the same.
    """
    rows = df.withColumns({"_block": _block(on, blocks), "_places": _places(on)})
    marked = rows.join(F.broadcast(seen_filter(seen.select(*on), on, blocks)), "_block", "left")

    def bit(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("bit_get", byte, (place % 8).cast("int")) == 1

    maybe = F.coalesce(F.forall("_places", bit), F.lit(False))
    marked = computed(marked.select(*df.columns, "_bits", "_places"), {"_maybe": maybe}).select(*df.columns, "_maybe")
    new, known = marked.filter(~F.col("_maybe")).drop("_maybe"), marked.filter("_maybe").drop("_maybe")
    hits = seen.select(*on).join(known.select(*on).distinct(), on, "left_semi").distinct()
    return new.unionByName(exclude(known, hits, on).select(*df.columns))


def unprocessed(content: DataFrame, processed: DataFrame) -> DataFrame:
    """Content whose ``(content_type, url)`` has not been handled yet; rows without a URL go."""
    usable = F.coalesce(F.col("url"), F.lit("")) != ""
    return exclude(content.filter(usable), processed, ["content_type", "url"])


def unprocessed_feed_items(items: DataFrame, processed_ids: DataFrame, known: list[str]) -> DataFrame:
    """Feed items with an unseen ``(content_type, id)``; types outside ``known`` and null ids go."""
    items = items.withColumn("content_type", urls.canonical_type(F.col("content_type")))
    items = items.filter(F.col("content_type").isin(known) & (F.coalesce(F.col("id"), F.lit(0)) != 0))
    return exclude(items, processed_ids, ["content_type", "id"])


def mark_processed(processed: DataFrame, done: DataFrame) -> DataFrame:
    """Set union into a state table."""
    return processed.unionByName(done.select(*processed.columns)).distinct()


def add_pending(pending: DataFrame, candidates: DataFrame, processed: DataFrame) -> DataFrame:
    """Pending URLs plus candidates minus processed ones. Earlier entries keep their place;
    candidates queue behind them."""
    both = pending.select("content_type", "url", F.lit(0).alias("wave"), "pos").unionByName(
        candidates.select("content_type", "url", F.lit(1).alias("wave"), "pos")
    )
    place = F.min(F.struct("wave", "pos")).alias("place")
    merged = both.groupBy("content_type", "url").agg(place)
    return exclude(merged.select("content_type", "url", "place.*"), processed, ["content_type", "url"])


def pending_urls(pending: DataFrame, kind: str, limit: int = 0) -> DataFrame:
    """The first ``limit`` pending URLs of a type in queue order; 0 means all."""
    rows = pending.filter(F.col("content_type") == kind)
    return rows.orderBy("wave", "pos").limit(limit) if limit else rows


def enrich(frontier: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Add lastmod and api_id from the sitemap; the id is read from the URL where absent."""
    known = sitemap.select("url", "lastmod", F.col("api_id").alias("_id"))
    found = F.coalesce(F.col("_id"), urls.post_id(F.col("url"), "sitemap"))
    return frontier.join(known, "url", "left").withColumn("api_id", found).drop("_id")


def start_urls(
    parsed: DataFrame,
    processed: DataFrame,
    blacklist: DataFrame,
    incremental: bool = True,
    cap: int | None = None,
) -> DataFrame:
    """The crawl list of every category from a parsed-URL table
    ``(category, is_modified, url, pos)``.

    A category with modified entries uses only those when incremental, else its full list.
    URLs are normalised, then processed, blacklisted and non-content ones go; input order and
    the cap per category hold.
    """
    parsed = parsed.withColumn("category", urls.canonical_type(F.col("category")))
    parsed = parsed.filter(F.col("category").isin(list(urls.CONTENT_SEGMENTS)))
    if incremental:
        # One row for each of the known content types at most.
        has = parsed.groupBy("category").agg(F.bool_or("is_modified").alias("_has"))
        parsed = parsed.join(F.broadcast(has), "category").filter(F.col("is_modified") == F.col("_has")).drop("_has")
    else:
        parsed = parsed.filter(~F.col("is_modified"))
    clean = computed(parsed.select("category", "url", "pos"), {"url": urls.normalize_url(F.col("url"), nfkc=True)})
    valid = clean.filter(urls.is_content_url(F.col("url"), F.col("category")))
    rows = distinct_in_order(valid, ["category", "url"])
    rows = exclude(rows, processed.withColumnRenamed("content_type", "category"), ["category", "url"])
    rows = exclude(rows, blacklist, ["url"])
    return cap_per_category(rows, cap, order=("pos", "url")) if cap else rows


def modified_union(tables: dict[str, DataFrame], since: Column) -> DataFrame:
    """Posts of several types changed after ``since``, with their type; unparsable times stay."""
    parts = [
        df.filter(modified_after(F.col("modified"), since, on_unparsed=True)).withColumn("content_type", F.lit(kind))
        for kind, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
