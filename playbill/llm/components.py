"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.llm.store import discard, scratch, written


#: Buckets whose hubs are sent to every executor at most (a few longs each; an eighth as many signs of hubs), and hubs of a bucket.
BROADCAST, HUBS = 1_000_000, 3
#: Rounds with further hubs where a bucket holds several components, and hubs of a round.
ROUNDS, MORE = 1, 20
#: Members of large buckets that are looked at in one go, and not a group at a time.
TOGETHER = 4_000_000


def _stars(edges: DataFrame, both: bool, few: bool) -> DataFrame:
    """One half of a round: every node sends its larger (``both``) or all smaller neighbours to the smallest of its neighbourhood.
    Of ``few`` edges the minima go to every executor, and the edges stay where they are."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        near = near.unionAll(edges.select("b", "a"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = near.join(F.broadcast(least) if few else least, "u")
    if both:
        return moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(own).where("a > b")


def _shape(edges: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether they are stars: no node has two smaller neighbours, or both a smaller and a larger one.
    Then another round would change nothing, and none is needed to see it."""
    ends = edges.select(F.explode(F.expr("array(struct(a as u, 1L as down), struct(b as u, 0L as down))")).alias("e"))
    nodes = ends.groupBy("e.u").agg(F.sum("e.down").alias("down"), F.min("e.down").alias("least"))
    rows, mixed = nodes.agg(F.sum("down"), F.count(F.when((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("least") == 0)), 1))).first()
    return rows or 0, not mixed


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component``, the smallest id it is linked to, for every id in the edges ``a``, ``b``
    (two columns of longs); loops and nulls are ignored, no edges give no rows.

    Union-find by rounds of stars: every node links its larger neighbours, then its smaller ones,
    to the smallest node it knows, until all are stars; the rounds grow with the logarithm of the
    graph. Minima are combined before each shuffle and joins can be split, so a node with very many
    links is no single task's work. Each round's edges are a written table, which ends its lineage.
    """
    spark = edges.sparkSession
    now, path = scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        rows, stars = _shape(now)
        if stars:
            break
        few, before = rows <= BROADCAST // 8, path
        now, path = scratch(_stars(_stars(now, True, few), False, few).distinct(), "edges")
        discard(spark, before)
    ids = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ids.unionAll(now.select("b", "b").distinct())


def close(x: str, y: str, longs: int, threshold: float) -> str:
    """SQL condition that two sets of a Jaccard similarity of ``threshold`` or more meet. ``x`` and ``y`` are arrays: the set's size
    or more, the number of bits set in its bitmap, and the bitmap (a bit for each member's hash) as ``longs`` longs.

    Members of one set alone set at most a bit each, and only where the other has none: no more bits differ than
    sets at the threshold have such members, and, in all but one of ten thousand cases, than the share of free bits lets expect.
    """
    alone = f"({x}[0] + {y}[0]) * {(1 - threshold) / (1 + threshold) + 1e-9}D"
    hit = f"({alone} * (1 - least({x}[1], {y}[1]) / {64 * longs}D))"
    differ = " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(2, 2 + longs))
    return f"({differ}) <= least({alone}, {hit} + 3.7D * sqrt({hit}))"


def link(
    members: DataFrame,
    signs: DataFrame,
    texts: Callable[[DataFrame], DataFrame],
    similar: Callable[[DataFrame], DataFrame],
    can: Callable[[str, str], str],
    at_once: bool = False,
) -> DataFrame:
    """``id`` and ``component`` of the texts that share a bucket and are similar to another one.

    ``members`` has ``bucket`` and ``id`` (a row for each bucket of an id) and is read several times, so make it of a written table; ``signs`` has
    ``id`` and ``sign``. ``texts`` gives ``id`` and ``text`` of a table of ids; ``similar`` keeps, of pairs ``a``, ``b`` with the texts ``text_a`` and
    ``text_b``, the true links; ``can(x, y)`` is a SQL condition on two signs that true links meet.

    First each member is compared with a few hubs of its bucket: the smallest id, the largest, and the first in another order.
    Where a bucket then holds several components, ids outside its largest one are compared with more hubs of that, in
    rounds. What still lies in different components of a bucket after that is compared pair by pair, a pair in one bucket only.
    With ``at_once`` all hubs are compared in one go: fewer
    jobs, but more pairs. So a group of copies takes a few comparisons a member, and no link that could join two components is left out. Rows of buckets carry
    ids alone; signs and texts are fetched for pairs.
    """
    picked = [F.min("id"), F.max("id"), *[F.min_by("id", F.xxhash64(F.lit(j), "id")) for j in range(2, HUBS)]]
    hubs = members.groupBy("bucket").agg(*[p.alias(f"hub_{j}") for j, p in enumerate(picked)]).where("hub_0 <> hub_1")
    hubs = written(hubs, "hubs")
    # Small enough to send to every executor up to the bound, and joined by a shuffle beyond it.
    few = hubs.count() <= BROADCAST
    shared = members.join(F.broadcast(hubs) if few else hubs, "bucket")

    def verified(pairs: DataFrame) -> DataFrame:
        met, path = scratch(pairs, "pairs")
        found = texts(met.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        with_a = met.join(found.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        links = written(similar(with_a.join(found.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")), "links")
        discard(met.sparkSession, path)
        return links

    def compared(hub_of: DataFrame) -> DataFrame:
        """Links among ``id`` and ``hub``."""
        star = hub_of.where("id <> hub").distinct()
        own = signs.join(hub_of.select(F.col("hub").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("hub"), F.col("sign").alias("sign_b"))
        own, path = scratch(own, "hub-signs")
        near = F.broadcast(own) if own.count() <= BROADCAST // 8 else own
        signed = star.join(signs.select("id", F.col("sign").alias("sign_a")), "id").join(near, "hub").where(can("sign_a", "sign_b"))
        links = verified(signed.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct())
        discard(own.sparkSession, path)
        return links

    every_hub = F.explode(F.array(*[f"hub_{j}" for j in range(0 if at_once else 1, HUBS)])).alias("hub")
    others = shared.select("id", every_hub).where("id <> hub").distinct()
    if at_once:
        tree = components(compared(others))
    else:
        # Most members are linked to the first hub of a bucket; with the others only those are compared that it has not joined to them.
        tree = components(compared(shared.select("id", F.col("hub_0").alias("hub"))))
        ends = [tree.select(F.col("id").alias(c), F.col("component").alias(f"in_{c}")) for c in ("id", "hub")]
        apart = others.join(ends[0], "id", "left").join(ends[1], "hub", "left").where("coalesce(in_id, id) <> coalesce(in_hub, hub)")
        tree = components(tree.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(compared(apart.select("id", "hub"))))
    held, turn = shared.select("bucket", "id"), 0
    while True:
        placed = held.select("bucket", "id").join(tree, "id", "left").withColumn("component", F.coalesce("component", "id"))
        more = [F.min_by("id", F.xxhash64(F.lit(HUBS + turn * MORE + j), "id")) for j in range(MORE)]
        parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.array_distinct(F.array(*more)).alias("hubs"))
        main = parts.groupBy("bucket").agg(
            F.max_by(F.struct("component", "hubs"), F.struct("n", "component")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n")
        )
        mixed = main.where("parts > 1").select("bucket", F.col("main.component").alias("main"), "main.hubs", "n")
        held = written(placed.join(mixed, "bucket"), "mixed")
        if turn == ROUNDS or held.isEmpty():
            break
        # Each id outside meets the hubs of its fullest bucket; the rounds need not be complete.
        outside = held.where("component <> main").groupBy("id").agg(F.max_by("hubs", F.struct("n", "bucket")).alias("hubs"))
        new = compared(outside.select("id", F.explode("hubs").alias("hub")))
        if new.isEmpty():
            break
        tree = components(tree.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(new))
        turn += 1
    if held.isEmpty():
        return tree
    every = held.groupBy("id").agg(F.array_sort(F.collect_set("bucket")).alias("buckets"))
    one = held.select("bucket", "id", "component", "main").join(signs.select("id", "sign"), "id").join(every, "id")
    one = written(one, "rest")
    two = one.select("bucket", *[F.col(c).alias(f"{c}_2") for c in ("id", "sign", "component", "buckets")])
    once = "(component_2 = main or id < id_2) and array_min(array_intersect(buckets, buckets_2)) = bucket"
    rest = one.where("component <> main").join(two, "bucket").where(f"component <> component_2 and {can('sign', 'sign_2')} and {once}")
    pairs = rest.select(F.greatest("id", "id_2").alias("a"), F.least("id", "id_2").alias("b"))
    return components(tree.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(verified(pairs)))


def link_marked(
    groups: list[DataFrame],
    texts: Callable[[DataFrame], DataFrame],
    similar: Callable[[DataFrame], DataFrame],
    near: Callable[[str, str], str],
    sure: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``link`` for members that are many and mostly meet by chance. Each of ``groups`` has ``bucket``, ``id`` and ``mark`` for some of the buckets,
    so that one group is shuffled at a time. ``near(x, y)`` is a SQL condition on two marks that true links meet, tried inside the joins;
    ``sure`` leaves out pairs ``a``, ``b`` that a larger sign tells apart; ``texts`` and ``similar`` are those of ``link``.

    First each member is compared with the smallest and the largest id of its bucket, which are all pairs where it holds no more than three. Members of
    larger buckets are kept on the way, and only these are looked at again: those outside a bucket's largest component, if that is large, meet
    a few more members of that, then all that still lie in different components of a bucket meet, each pair once.
    """
    spark = groups[0].sparkSession

    def verified(parts: list[DataFrame]) -> DataFrame:
        all_, paths = None, []
        for part in parts:
            one, path = scratch(part.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct(), "pairs")
            all_ = one if all_ is None else all_.unionAll(one)
            paths.append(path)
        met, path = scratch(sure(all_.distinct()), "pairs")
        for old in paths:
            discard(spark, old)
        found = texts(met.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        with_a = met.join(found.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        links = written(similar(with_a.join(found.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")), "links")
        discard(spark, path)
        return links

    def met(rows: DataFrame) -> DataFrame:
        """Members that an end of their bucket may be linked with (``others``), and all of buckets of more than three, only these with their ``bucket``."""
        hubs = rows.groupBy("bucket").agg(
            *[f(c, "id").alias(f"{c}_{end}") for end, f in (("lo", F.min_by), ("hi", F.max_by)) for c in ("id", "mark")], F.count("*").alias("n")
        )
        shared = rows.join(hubs.where("id_lo <> id_hi"), "bucket")
        others = [
            f"case when id <> id_lo and {near('mark', 'mark_lo')} then id_lo end",
            f"case when id <> id_hi and id <> id_lo and {near('mark', 'mark_hi')} then id_hi end",
        ]
        found = shared.select(F.when(F.col("n") > 3, F.col("bucket")).alias("bucket"), "id", "mark", F.array_compact(F.array(*map(F.expr, others))).alias("others"))
        return found.where("bucket is not null or size(others) > 0")

    def joined(tree: DataFrame, new: DataFrame) -> DataFrame:
        return components(tree.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(new))

    def placed(rows: DataFrame, tree: DataFrame, more: int) -> tuple[DataFrame, DataFrame]:
        """Members with their component, and each bucket's largest component with ``more`` of its members."""
        hubs = [F.struct(F.min_by(F.col("id"), o).alias("other"), F.min_by(F.col("mark"), o).alias("mark_2")) for o in (F.xxhash64(F.lit(j), "id") for j in range(more))]
        parts = rows.join(tree, "id").groupBy("bucket", "component").agg(F.count("*").alias("n"), F.array(*hubs).alias("hubs"))
        of = F.struct("n", "component")
        main = parts.groupBy("bucket").agg(F.max_by("component", of).alias("main"), F.max_by("hubs", of).alias("hubs"), F.max("n").alias("n"))
        return rows.join(tree, "id", "left").withColumn("component", F.coalesce("component", "id")), main

    def rounded(rows: DataFrame, tree: DataFrame) -> DataFrame | None:
        """Worth it only where a component has far more members in a bucket than are met."""
        every, main = placed(rows, tree, MORE)
        large = written(main.where(f"n > {2 * MORE}"), "large")
        n = large.count()
        if not n:
            return None
        met = every.join(F.broadcast(large) if n <= BROADCAST // 8 else large, "bucket").where("component <> main").select("id", "mark", F.inline(F.array_distinct("hubs")))
        return met.where(f"id <> other and {near('mark', 'mark_2')}").select("id", "other")

    def rest(rows: DataFrame, tree: DataFrame) -> DataFrame:
        every, main = placed(rows, tree, 0)
        one = every.join(main.select("bucket", "main"), "bucket", "left").withColumn("main", F.coalesce("main", F.lit(-1))).where("component <> main")
        two = every.select("bucket", *[F.col(c).alias(f"{c}_2") for c in ("id", "mark", "component")])
        apart = f"component <> component_2 and (component_2 = main or id < id_2) and {near('mark', 'mark_2')}"
        return one.join(two, "bucket").where(apart).select("id", F.col("id_2").alias("other"))

    def known(tree: DataFrame) -> DataFrame:
        return F.broadcast(tree) if tree.count() <= BROADCAST else tree

    parts = [scratch(met(rows), "met") for rows in groups]
    pairs = [part.select("id", F.explode("others").alias("other")) for part, _ in parts]
    tree = written(components(verified([reduce(DataFrame.unionAll, pairs)])), "components")
    large = [part.where("bucket is not null").select("bucket", "id", "mark") for part, _ in parts]
    if sum(rows.count() for rows in large) <= TOGETHER:
        large = [reduce(DataFrame.unionAll, large)]
    for step in (rounded, rest):
        few = known(tree)
        if more := [part for rows in large if not rows.isEmpty() and (part := step(rows, few)) is not None]:
            tree = written(joined(tree, verified(more)), "components")
    for _, path in parts:
        discard(spark, path)
    return tree
