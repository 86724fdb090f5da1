"""Fingerprints of texts as invertible Bloom lookup tables of their paragraphs, and what two versions differ in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playbill.llm.store import written
from playbill.session import computed

#: Cells of a table: three ranges, one cell of each for every digest. A table that is too small is replaced by one of ``LARGER`` times
#: the cells. A cycle peels each range once.
RANGE, RANGES, LARGER, CYCLES = 64, 3, 8, 2
#: A paragraph: a line, or of a long line the piece up to the first sentence end after so many characters.
PIECE = 240
_PARAGRAPH = rf"\S[^\n]{{0,{PIECE - 1}}}+[^\n.!?]*+[.!?]*+"


def paragraphs(text: Column) -> Column:
    """Digests of the different paragraphs of a text, in the order of their first places; null counts as empty."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda x: F.xxhash64(x)))


def _range(level: int) -> int:
    return RANGE * LARGER**level


def _cells(digest: Column, level: int) -> list[Column]:
    """The cell of a digest in each range."""
    size, spread = _range(level), F.xxhash64(F.lit(level), digest)
    return [F.pmod(F.shiftrightunsigned(spread, 21 * j), F.lit(size)) + size * j for j in range(RANGES)]


def _summed(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of a cell added up: their numbers, and the XOR of their digests and checks. Cells in which nothing is left go."""
    cells = entries.groupBy(*keys).agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
    return cells.where("n <> 0 or key <> 0 or check <> 0")


def tables(sets: DataFrame, level: int = 0, keys: list[str] = ["id"]) -> DataFrame:
    """The table of each set: for its ``keys`` its cells in use with ``cell``, ``n``, ``key``, ``check``.

    ``sets`` has ``keys``, ``digests`` (an array of longs, each once) and ``n``, 1 or -1. Tables are sums: rows with the same keys make one table, and
    a set with -1 is subtracted. Where the rows of a key lie in one partition they stay there."""
    each = sets.select(*keys, F.col("n").cast("long").alias("n"), F.explode("digests").alias("key"))
    spread = each.select(*keys, "n", "key", F.hash("key").alias("check"), F.explode(F.array(*_cells(F.col("key"), level))).alias("cell"))
    return _summed(spread, [*keys, "cell"])


def peel(cells: DataFrame, level: int = 0, digests: bool = True) -> DataFrame:
    """What the tables of differences give away: of every ``id`` its remaining cells (``got`` null) and a row for each digest
    recovered (``got``, with ``n`` 1 if the first set has it alone and -1 if the second). A table without a remaining cell is recovered whole.
    Without ``digests`` those recovered of either side are counted: two rows at most, ``got`` 1 or -1, and the number in ``n``.

    A cell that holds one digest alone gives it away; taken out of its other cells it may leave one alone there. Within one range a
    digest lies in one cell, so the pure cells of a range can be peeled at once without taking anything out twice. The ranges
    take turns. Each turn adds the cells up again in the partition they are in."""
    columns = ("cell", "got", "n", "key", "check")

    def entry(*values: Column) -> Column:
        return F.struct(*[v.alias(c) for v, c in zip(values, columns, strict=True)])

    cell, got, n, key, check = (F.col(c) for c in columns)
    rows, size, none = cells.select("id", "cell", F.lit(None).cast("long").alias("got"), "n", "key", "check"), _range(level), F.lit(None).cast("long")
    for j in [*range(RANGES)] * CYCLES:
        pure = cell.between(size * j, size * (j + 1) - 1) & got.isNull() & (F.abs(n) == 1) & (check == F.hash(key))
        out = [entry(c, none, -n, key, check) for i, c in enumerate(_cells(key, level)) if i != j]
        told = entry(F.lit(-1).cast("long"), *((key, n) if digests else (n, F.abs(n))), F.lit(0).cast("long"), F.lit(0))
        rows = rows.select("id", F.inline(F.when(pure, F.array(*out, told)).otherwise(F.array(entry(cell, got, n, key, check)))))
        rows = _summed(rows, ["id", "cell", "got"])
    return rows.select("id", "cell", "got", "n", "key", "check")


def differences(pairs: DataFrame, digests: bool = True) -> DataFrame:
    """The digests in which the sets ``a`` and ``b`` of each ``pair`` (a long, different in every row) differ: ``pair``, ``removed``
    (of ``a`` alone) and ``added`` (of ``b`` alone), as arrays or, without ``digests``, as numbers. Pairs that do not differ have no row.

    The tables of both sets are subtracted and peeled. Where cells remain the table was too small, and the pair is tried again with
    one of ``LARGER`` times the cells and other places, until every difference is found; only pairs that failed are read again. The work
    on a pair is in proportion to its sets at each size, as cells that are not in use take no room. Null sets count as empty."""
    none = F.array().cast("array<long>")
    every = pairs.select("pair", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    rows, done, level = every.repartition("pair"), [], 0
    while True:
        sides = F.array(F.struct(F.lit(1).alias("n"), F.col("a").alias("digests")), F.struct(F.lit(-1).alias("n"), F.col("b").alias("digests")))
        left = peel(tables(rows.select(F.col("pair").alias("id"), F.inline(sides)), level), level, digests)
        both = {"removed": 1, "added": -1}
        if digests:
            told = [F.collect_list(F.when(F.col("got").isNotNull() & (F.col("n") == n), F.col("got"))).alias(c) for c, n in both.items()]
        else:
            told = [F.sum(F.when(F.col("got") == n, F.col("n")).otherwise(0)).alias(c) for c, n in both.items()]
        tried = written(left.groupBy(F.col("id").alias("pair")).agg((F.count_if(F.col("got").isNull()) == 0).alias("ok"), *told), "peeled")
        done.append(tried.where("ok").drop("ok"))
        failed = tried.where("not ok").select("pair")
        if failed.isEmpty():
            return reduce(DataFrame.unionAll, done)
        rows, level = every.join(failed, "pair", "left_semi").repartition("pair"), level + 1


def likeness(n_a: Column, n_b: Column, differing: Column) -> Column:
    """Jaccard likeness of two sets from their sizes and the number of digests of one of them alone; of empty sets 1."""
    both = n_a + n_b
    return F.when(both == 0, 1.0).otherwise((both - differing).cast("double") / (both + differing))


def fingerprints(sets: DataFrame, columns: list[str]) -> DataFrame:
    """``id`` and, for each of the columns, arrays of digests, the fingerprint of that set under the column's name: its size and its table as text,
    ``size:cell,cell,...``, each cell in use with its place, its number, and its digests and checks in hexadecimal, in points."""
    rows = sets.repartition("id")
    sides = F.array(*[F.struct(F.lit(i).alias("of"), F.col(c).alias("digests")) for i, c in enumerate(columns)])
    cells = tables(rows.select("id", F.lit(1).alias("n"), F.inline(sides)), keys=["id", "of"])
    place = F.lpad(F.col("cell").cast("string"), 3, "0")
    text = F.concat_ws(".", place, F.col("n").cast("string"), F.hex("key"), F.hex(F.col("check").cast("long").bitwiseAND(0xFFFFFFFF)))
    lists = [F.sort_array(F.collect_list(F.when(F.col("of") == i, text))).alias(f"_{c}") for i, c in enumerate(columns)]
    told = rows.select("id", *[F.size(c).alias(c) for c in columns]).join(cells.groupBy("id").agg(*lists), "id", "left")
    return told.select("id", *[F.concat(F.col(c).cast("string"), F.lit(":"), F.coalesce(F.array_join(f"_{c}", ","), F.lit(""))).alias(c) for c in columns])


_KEY = ["k0", "none", "k1", "k2"]


def _keyed(documents: DataFrame) -> DataFrame:
    """Documents with what names a row: ``k0`` and ``none`` for ``doc_id``, which may be null, and two independent hashes of the text."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    names = [F.coalesce("doc_id", F.lit(0)).alias("k0"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]
    return rows.select(*names, F.length("text").cast("long").alias("n"), "text")


def _followed(keyed: DataFrame) -> DataFrame:
    """Each different row with the one that it follows (its key with ``p_`` in front, and ``p_n``) in
    descending order of ``doc_id``, nulls last; the first follows the last. Only ids and hashes are moved."""
    key, order = _KEY, [F.col("none"), F.col("k0").desc(), F.col("k1"), F.col("k2")]
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = keyed.groupBy(*key).agg(F.max("n").alias("n"))
    # Ranges of the order; written, so that a lost task cannot cut them otherwise.
    ranges = written(one.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("part").orderBy(*order)
    row = F.struct(*key, "n")
    ranged = ranges.select("part", *key, F.lag(row).over(inside).alias("p"), F.lead("part").over(inside).isNull().alias("last"), "n")
    # A row for each range at most.
    ends = ranged.where("last").select("part", row.alias("end"))
    every = Window.orderBy("part")
    before = F.coalesce(F.lag("end").over(every), F.last("end").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = ends.select(F.col("part").alias("own"), before.alias("end"))
    joined = ranged.join(F.broadcast(ends), F.col("part") == F.col("own"))
    p = F.coalesce("p", "end")
    return joined.select(*key, *[p[c].alias(f"p_{c}") for c in (*key, "n")])


def compare(documents: DataFrame) -> DataFrame:
    """Every row of ``documents`` (``doc_id``, ``text``; others are not read) against its edited text and against the next document.

    The edited text has the last half of the characters (code points, rounded down) replaced by as many of the first of the
    next document, or all it has; the next document is that of the next smaller ``doc_id``, after the last the first. Columns: ``doc_id``, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, and ``near_edited`` and ``near_next``, the Jaccard likeness of the
    paragraph sets, from their sizes and the digests that peeling recovers from the difference of their tables.

    The order is found on ids and hashes alone: ranges, and inside a range the row before. A text goes to a join under its own key, which gives it
    the key of the row it follows and sends that one the characters it needs; there they meet the text that the same shuffle has brought. Tables
    are made, subtracted and peeled as ``differences`` says; most pairs need the first size only.

    Defined results: a null text is empty; equal texts have equal fingerprints, and texts of the same paragraphs (blank
    lines, order and repeats aside) are alike by 1; rows with the same ``doc_id`` are ordered by hashes of
    their texts, null ids come last; rows with the same id and text are one document and have equal results; a single document is its own next;
    an empty table gives an empty one. Functions of Spark only.
    """
    keyed = _keyed(documents)
    place = _followed(keyed)
    # Both joins use these columns by the same key, so that the texts are read, cut and shuffled once.
    docs = keyed.withColumn("own", paragraphs(F.col("text")))
    sender = [f"p_{c}" for c in _KEY]
    need = F.least(F.floor(F.col("p_n") / 2), F.col("n")).cast("int")
    sent = docs.join(place, _KEY).select(*sender, F.left(F.col("text"), need).alias("head"), F.col("own").alias("next"))
    # Repeated rows send the same once.
    sent = sent.groupBy(*sender).agg(F.first("head").alias("head"), F.first("next").alias("next"))
    rows = docs.join(sent, reduce(lambda x, y: x & y, [F.col(c) == F.col(f"p_{c}") for c in _KEY]))
    stays = F.left(F.col("text"), (F.col("n") - F.floor(F.col("n") / 2)).cast("int"))
    doc_id = F.when(~F.col("none"), F.col("k0")).alias("doc_id")
    rows = computed(rows.select(doc_id, "n", "own", "next", stays.alias("stays"), "head"), {"edited": F.concat("stays", "head")})
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col("n").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha"),
        "own", paragraphs(F.col("edited")).alias("edited"), "next",
    )
    return _likened(written(rows, "versions"))


def _likened(rows: DataFrame) -> DataFrame:
    """Fingerprints and likeness from the paragraph sets ``own``, ``edited`` and ``next`` of every ``row``."""
    # Even numbers for the edited text, odd ones for the next document.
    sides = F.array(*[F.struct((F.col("row") * 2 + i).alias("pair"), F.col(c).alias("b")) for i, c in enumerate(("edited", "next"))])
    pairs = rows.select(F.col("own").alias("a"), F.inline(sides))
    found = differences(pairs, digests=False).select(F.shiftright("pair", 1).alias("row"), (F.col("pair") % 2).alias("of"), (F.col("removed") + F.col("added")).alias("n"))
    differing = found.groupBy("row").agg(*[F.sum(F.when(F.col("of") == i, F.col("n"))).alias(f"d_{c}") for i, c in enumerate(("edited", "next"))])
    prints = fingerprints(rows.select(F.col("row").alias("id"), F.col("own").alias("fingerprint"), F.col("edited").alias("edited_fingerprint")), ["fingerprint", "edited_fingerprint"])
    sizes = [F.size(c).alias(f"n_{c}") for c in ("own", "edited", "next")]
    told = rows.select("row", "doc_id", "n_chars", "sha", *sizes).join(prints.withColumnRenamed("id", "row"), "row").join(differing, "row", "left")
    near = [likeness(F.col("n_own"), F.col(f"n_{c}"), F.coalesce(f"d_{c}", F.lit(0))).alias(f"near_{c}") for c in ("edited", "next")]
    return told.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", *near)
