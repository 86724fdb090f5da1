"""Per-key operators that stay bounded when one key holds a large share of the rows.

Nothing here sorts or collects a whole group in one task: reductions run through partial
aggregation, top-n runs in two rounds over salted groups, and collected groups are divided
into blocks by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playbill.session import written

SALTS = 32


def latest_per_key(df: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """One row per key: the one with the greatest ``newest`` tuple. Only one candidate per key
    leaves each map task."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*newest)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*df.columns)


def keep_latest(df: DataFrame, keys: list[str], lastmod: str = "lastmod", pos: str = "pos") -> DataFrame:
    """The record with the greatest lastmod, compared as text; missing ones lose and ties keep
    the earliest ``pos``."""
    return latest_per_key(df, keys, [F.coalesce(F.col(lastmod), F.lit("")), -F.col(pos)])


def keep_last(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """The last arrival per key."""
    return latest_per_key(df, keys, [F.col(pos)])


def distinct_in_order(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Distinct keys with the position of their first occurrence."""
    return df.groupBy(*keys).agg(F.min(pos).alias(pos))


def first_n_per_group(
    df: DataFrame, keys: list[str], order: list[str], n: int, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of every group by ``order``, which must identify a row in its group.

    The first round keeps n rows of each salted slice of a group, the second n of at most
    ``SALTS * n`` survivors, so that no task sorts a whole hot group.
    """
    slice_ = F.pmod(F.xxhash64(*order), F.lit(SALTS))
    first = W.partitionBy(*keys, "_slice").orderBy(*order)
    last = W.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_slice", slice_)
    df = df.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= n).drop("_slice", "_n")
    df = df.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= n)
    return df.withColumnRenamed("_n", rank) if rank else df.drop("_n")


def cap_per_category(df: DataFrame, n: int, category: str = "category", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """At most ``n`` rows per category, in input order."""
    return first_n_per_group(df, [category], list(order), n)


def newest_snapshots(df: DataFrame, snapshot: str, k: int = 5) -> DataFrame:
    """Rows of the ``k`` newest snapshots. At most k ids reach the join."""
    ids = df.select(snapshot).distinct().orderBy(F.col(snapshot).desc()).limit(k)
    return df.join(F.broadcast(ids), snapshot, "left_semi").select(*df.columns)


def block_of(value: Column, blocks: int | Column) -> Column:
    """The block, of a given number, that a text value falls into by its hash."""
    number = F.conv(F.substring(F.md5(F.encode(value, "UTF-8")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(number, F.lit(blocks)).cast("int")


def collect_in_blocks(df: DataFrame, keys: list[str], value: Column, blocks: int, name: str) -> DataFrame:
    """Sorted distinct values per key as arrays, one for each block with any: ``(keys, block, name)``. The block of a value
    depends on the value alone, so every key is divided in the same way and nothing is counted first; choose ``blocks`` so that the
    largest group's share fits a task."""
    rows = df.select(*keys, value.alias("_value")).dropDuplicates()
    rows = rows.withColumn("block", block_of(F.col("_value").cast("string"), blocks))
    return rows.groupBy(*keys, "block").agg(F.array_sort(F.collect_list("_value")).alias(name))


def collect_in_parts(df: DataFrame, keys: list[str], value: Column, most: int, name: str) -> DataFrame:
    """Sorted distinct values per key as arrays: ``(keys, part, parts, name)``. A key with more than ``most`` values is divided by their
    hash into as many parts as that takes, so that no task holds a very large group; any other is one part."""
    rows = df.select(*keys, value.alias("_value")).dropDuplicates()
    parts = F.ceil(F.count("*") / most).cast("int")
    hot = rows.groupBy(*keys).agg(parts.alias("parts")).filter("parts > 1")
    # A row for every ``most`` values at most.
    hot = F.broadcast(hot.select(F.struct(*keys).alias("_key"), "parts"))
    rows = rows.join(hot, F.struct(*keys).eqNullSafe(F.col("_key")), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.when(F.col("parts") > 1, block_of(F.col("_value").cast("string"), F.col("parts")))
    rows = rows.withColumn("part", F.coalesce(part, F.lit(0)))
    return rows.groupBy(*keys, "part", "parts").agg(F.array_sort(F.collect_list("_value")).alias(name))


def ranked(df: DataFrame, order: list[Column], place: str) -> DataFrame:
    """Number all rows from 1 in an order, without bringing them together: ranges of the order, places inside a range, and
    the rows of the ranges before it. Rows that are equal in the order get neighbouring numbers in any order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, so that a lost task cannot cut the ranges otherwise.
    ranges = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    # A row for each range.
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    rows = ranges.withColumn("_at", inside).join(F.broadcast(offsets), "_part")
    return rows.withColumn(place, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")
