"""Groups of records that are linked directly or through others.

Connected components by seed-tree pruning. In each round every vertex tells its
neighbours the smallest vertex of its neighbourhood. A vertex that is nobody's
smallest drops out and hangs below its own smallest in the propagation forest;
the others go on in a smaller graph that links what they were told to its
minimum. When no link is left, the vertices that never dropped out are the seeds,
and their identifiers flow down the forest, from the last round to the first.

Vertices are 64-bit ordinals in the order of the values, so the smallest vertex
is the smallest value and rounds shuffle numbers only. Aggregates are combined
before the shuffle; joins are on vertices, where adaptive execution splits hubs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.session import Scratch


def star_links(rows: DataFrame, members: str) -> DataFrame:
    """(a, b): each row's smallest member with each other; chains through the smallest link the whole row."""
    ms = F.array_distinct(F.filter(F.coalesce(F.col(members), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))
    return (
        rows.select(ms.alias("m"))
        .where(F.size("m") > 1)
        .select(F.array_min("m").alias("a"), F.explode("m").alias("b"))
        .where("a <> b")
        .distinct()
    )


def _ordinals(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(value, id): ids rise with the value in byte order.

    Range partitions are in order and each is sorted, so partition number and
    place make an ordered id without numbering anything in one task. The table
    is written, as a second run might draw other partition borders.
    """
    values = links.select(F.explode(F.array("a", "b")).alias("value")).distinct()
    ordered = values.repartitionByRange("value").sortWithinPartitions("value")
    return scratch.keep(ordered.select("value", F.monotonically_increasing_id().alias("id")), "ordinals")


def seed_tree(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(id, seed) of all vertices of an edge list (u, v) of distinct longs; the seed is the smallest of the group."""
    graph = scratch.keep(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "graph")
    vertices = graph
    forest: list[str] = []
    levels: dict[str, DataFrame] = {}
    for r in range(max_rounds):
        if graph.isEmpty():
            break
        least = graph.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # what each vertex was told: the minima of its neighbours and its own
        told = scratch.keep(
            graph.join(least, "u").select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m")).distinct(), "told"
        )
        mine = told.groupBy("x").agg(F.min("m").alias("low"), F.max(F.col("m") == F.col("x")).alias("stays"))
        level = f"level{r}"
        levels[level] = scratch.keep(mine.where("not stays").select(F.col("x").alias("id"), F.col("low").alias("parent")), level)
        forest.append(level)
        new = told.join(mine.select("x", "low"), "x").where("m <> low").select(F.col("m").alias("u"), F.col("low").alias("v"))
        if r == 0:
            # all vertices that remain after the first round are somebody's minimum
            vertices = scratch.keep(told.where("x = m").select(F.col("x").alias("id")), "kept")
        graph = scratch.keep(new.unionByName(new.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "graph")
    else:
        raise RuntimeError(f"links are left after {max_rounds} rounds")
    if not forest:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("seed")).limit(0)
    # roots: kept after the first round and in no later level
    dropped = levels[forest[0]].select("id").limit(0)
    for name in forest[1:]:
        dropped = dropped.unionByName(levels[name].select("id"))
    labels = scratch.keep(vertices.join(dropped, "id", "left_anti").select("id", F.col("id").alias("seed")), "labels")
    for name in reversed(forest):
        down = levels[name].join(labels.select(F.col("id").alias("parent"), "seed"), "parent").select("id", "seed")
        labels = scratch.keep(labels.unionByName(down), "labels")
    scratch.drop("told", "graph", "kept", *forest)
    return labels


def groups(links: DataFrame) -> DataFrame:
    """(group_address, address) for every value of a link table (a, b) of strings.

    The group identifier is the group's smallest value in byte order, which is
    paired with itself too. Null values and links of a value with itself link
    nothing; a value without any other link is in no group. Repeated links and
    either direction count once. An empty table gives no rows.
    """
    with Scratch(links.sparkSession) as scratch:
        scratch.hold("ordinals", "labels")
        links = scratch.keep(links.where("a is not null and b is not null and a <> b").select("a", "b"), "links")
        ids = _ordinals(links, scratch)
        edges = links.join(ids.select(F.col("value").alias("a"), F.col("id").alias("u")), "a").join(ids.select(F.col("value").alias("b"), F.col("id").alias("v")), "b").select("u", "v")
        labels = seed_tree(edges, scratch)
        if "labels" not in scratch._paths:  # no link at all: the empty result still reads the links
            scratch.hold("links", "graph")
    named = labels.join(ids.withColumnRenamed("value", "address"), "id")
    seeds = labels.where("id = seed").join(ids, "id").select("seed", F.col("value").alias("group_address"))
    return named.join(seeds, "seed").select("group_address", "address")


def co_spent(tx: DataFrame) -> DataFrame:
    """Groups of addresses that appear together in the inputs of a row, directly or through others."""
    return groups(star_links(tx.select(F.col("inputs.address").alias("m")), "m"))
