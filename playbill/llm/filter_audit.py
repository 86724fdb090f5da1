"""How document filters act on each other: what every filter removes at every place of every order."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.llm.store import written
from playbill.session import computed

#: The filters by letter; the bit of a letter is its place.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Counts of a step, in the order of output.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

_BLANK = r"[\x20\x09-\x0D]+"
_TALLY = "struct<" + ",".join(f"{c}:long" for c in COUNTS) + ">"


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def failures(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``part`` (the source, empty if null), ``mask`` (bits of the filters A to D that the text fails) and
    ``digest`` (SHA-256 of the text) of every row of ``documents`` (``doc_id``, ``text``, ``source``)."""
    rows = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    # Counted once a row: a filter on a projected column would count again.
    rows = computed(rows, {"words": F.array_remove(F.split(text, _BLANK), "")})
    rows = computed(rows, {"words": F.size("words"), "distinct": F.size(F.array_distinct("words"))})
    fails = {
        "A": F.col("words") < 200,
        "B": 100 * F.col("distinct").cast("long") < 50 * F.col("words").cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }
    mask = sum((F.when(x, _bit(k)).otherwise(0) for k, x in fails.items()), F.lit(0))
    return rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The mask cells of every part: ``part``, ``mask`` (bits of the filters failed, E included), ``n`` documents and, of
    them, ``good`` and ``toxic`` ones. At most 32 rows a part."""
    facts = written(failures(documents), "failures")
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    # Written, so that the join meets two plain shuffles and a text with very many copies can be split.
    first = written(first, "firsts")
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copied = F.when(F.col("doc_id") > F.col("first"), _bit("E")).otherwise(0)
    rows = facts.join(first.select("digest", "first"), "digest", "left").join(known, "doc_id", "left")
    return rows.groupBy("part", (F.col("mask") + copied).alias("mask")).agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )


def _folded(cell: Column) -> Column:
    """The tallies of one cell, order by order and step by step."""
    orders = F.expr("array(" + ",".join("array(" + ",".join(str(_bit(x)) for x in o) + ")" for o in ORDERS) + ")")
    begin = F.struct(F.lit(0).alias("seen"), F.array().cast(f"array<{_TALLY}>").alias("out"))

    def step(acc: Column, bit: Column) -> Column:
        fails, before = cell["mask"].bitwiseAND(bit) != 0, cell["mask"].bitwiseAND(acc["seen"]) != 0
        removed = fails & ~before
        held = {
            "kept": (~fails & ~before, "n"),
            "removed": (removed, "n"),
            "redundant": (fails & before, "n"),
            "unique_fails": (cell["mask"] == bit, "n"),
            "good_lost": (removed, "good"),
            "toxic_lost": (removed, "toxic"),
        }
        tally = F.struct(*[F.when(held[c][0], cell[held[c][1]]).otherwise(F.lit(0).cast("long")).alias(c) for c in COUNTS])
        return F.struct(acc["seen"].bitwiseOR(bit).alias("seen"), F.array_append(acc["out"], tally.cast(_TALLY)).alias("out"))

    return F.flatten(F.transform(orders, lambda o: F.aggregate(o, begin, step, lambda acc: acc["out"])))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of five filters does at each place of each of their 120 orders, by part (source) of ``documents``.

    ``documents`` has ``doc_id``, ``text``, ``source``, ``labels`` has ``doc_id``, ``quality``, ``toxic``; further columns are
    not read. A text fails A under 200 words, B if less than half of its words are distinct, C if more than 2 % of its
    characters are ``A`` to ``Z``, D if it holds one of ``#$%&*|``, E if a row with a smaller ``doc_id`` has the same text.

    One row per ``part``, ``filter_order`` and ``step`` (600 a part, zeros included): documents ``kept`` after the step,
    ``removed`` by it, ``redundant`` (failing its filter, but gone before), ``unique_fails`` (failing its filter alone),
    ``good_lost`` and ``toxic_lost`` (removed here, with quality 1 or toxic 1), and ``shapley``, what the step's filter
    removes in all 120 orders together.

    Documents are counted by mask, the bits of the filters they fail; a part has 32 masks at most, and only those
    counts are gathered. Each mask is folded over all orders, which gives 600 tallies, and the tallies of a part's masks are
    added element by element. So the work on orders does not grow with the documents.

    Defined results: a null text is empty (fails A only, and E after the first), a null source is the part ``''``; rows with the same ``doc_id``
    are no copies of each other; a null ``doc_id`` is neither smaller nor larger than another and has no label; a label
    given several times holds if one of its rows has it; an empty table gives an empty one.
    """
    cell = cells(documents, labels)
    parts = cell.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    none = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]), 5 * len(ORDERS)).cast(f"array<{_TALLY}>")

    def added(x: Column, y: Column) -> Column:
        return F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS]).cast(_TALLY)

    parts = computed(parts, {"tallies": F.aggregate("cells", none, lambda acc, c: F.zip_with(acc, _folded(c), added))})
    letters = F.lit("".join(ORDERS))

    def in_all(x: str) -> Column:
        """What the filter removes, over all orders."""
        mine = F.filter(own, lambda p: F.substr(letters, p["at"] + 1, F.lit(1)) == x)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda a, p: a + p["tally"]["removed"])

    at = F.sequence(F.lit(0), F.lit(5 * len(ORDERS) - 1))
    own = F.arrays_zip(at.alias("at"), F.col("tallies").alias("tally"))
    parts = computed(parts, {f"of_{x}": in_all(x) for x in FILTERS})
    rows = parts.select("part", F.posexplode("tallies").alias("at", "tally"), *[f"of_{x}" for x in FILTERS])
    letter = F.substr(letters, F.col("at") + 1, F.lit(1))
    shapley = F.coalesce(*[F.when(letter == x, F.col(f"of_{x}")) for x in FILTERS])
    return rows.select(
        "part",
        F.substr(letters, F.floor(F.col("at") / 5).cast("int") * 5 + 1, F.lit(5)).alias("filter_order"),
        (F.col("at") % 5 + 1).alias("step"),
        *[F.col(f"tally.{c}").alias(c) for c in COUNTS],
        shapley.alias("shapley"),
    )


#: The same rows in SQL.
SQL = r"""
WITH facts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM facts GROUP BY text),
known AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id),
failed AS (
    SELECT f.part, coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic,
        (len(words) < 200)::int AS a,
        (100 * len(list_distinct(words)) < 50 * len(words))::int AS b,
        (100 * (length(f.text) - length(regexp_replace(f.text, '[A-Z]', '', 'g'))) > 2 * length(f.text))::int AS c,
        regexp_matches(f.text, '[#$%&*|]')::int AS d,
        coalesce(f.doc_id > s.first, false)::int AS e
    FROM facts f JOIN firsts s ON f.text = s.text LEFT JOIN known k ON f.doc_id = k.doc_id),
cells AS (
    SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
    FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
    SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
    FROM letters p, letters q, letters r, letters s, letters t
    WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND (p.bit | q.bit | r.bit | s.bit | t.bit) = 31),
steps AS (
    SELECT filter_order, step::int AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::int AS seen
    FROM orders, range(1, 6) r(step)),
counted AS (
    SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (seen | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & bit > 0 AND mask & seen = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & bit > 0 AND mask & seen > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & bit > 0 AND mask & seen = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & bit > 0 AND mask & seen = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant,
    unique_fails::bigint AS unique_fails, good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost,
    sum(removed) OVER (PARTITION BY part, bit)::bigint AS shapley
FROM counted
"""
