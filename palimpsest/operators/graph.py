"""Connectivity of an undirected graph: degrees, bottlenecks, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.hashing import unit
from ..sources.store import discard, stage_table
from .snapshots import ranked

MAX_ROUNDS = 60
#: Links a task holds in a round: small graphs are few files.
TASK_LINKS = 500_000
METHOD = "degrees and connected components"


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, degree): distinct neighbours, itself included where it has a loop; 0 without edges."""
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("other")).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("other")))
    near = both.distinct().groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").distinct().join(near, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def isolated(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return degrees(edges, nodes).filter("degree = 0").select("id")


def bottlenecks(edges: DataFrame, nodes: DataFrame, k: int | None = 10) -> DataFrame:
    """Nodes with some edges but fewer than 0.3 of the mean degree; the first ``k`` by id, or all."""
    return _bottlenecks(degrees(edges, nodes), k)


def _bottlenecks(of: DataFrame, k: int | None = 10) -> DataFrame:
    mean = of.agg(F.avg("degree").alias("_mean"))  # one row
    found = of.crossJoin(F.broadcast(mean)).filter((F.col("degree") > 0) & (F.col("degree") < 0.3 * F.col("_mean"))).select("id", "degree")
    return found if k is None else found.orderBy("id").limit(k)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links`` (a, b); the component is its smallest node.

    Alternating stars: large ones hang each node's larger neighbours on its smallest, small ones the smaller. Both are
    minima by node, combined before the shuffle and joined back; every round is a staged table, and there are
    logarithmically many. A node with very many links is split by the skew handling of joins, in which
    the minima, one a node, are the hashed side.

    Nodes that are no integers go by a hash of theirs that no two share: minima of numbers are aggregated by hashing, those
    of texts by sorting. The names come back in the end.
    """
    if not isinstance(links.schema["a"].dataType, IntegralType):
        return _named_components(links)
    edges = stage_table(_canonical(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links")
    mark = _mark(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _canonical(both.filter(F.col("v") > F.col("u")).join(least.hint("shuffle_hash"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("shuffle_hash"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, edges = edges, stage_table(_canonical(small).coalesce(1 + mark[0] // TASK_LINKS), "links")
        discard(old)
        if (now := _mark(edges)) == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _named_components(links: DataFrame) -> DataFrame:
    """``connected_components`` of nodes of any type, over numbers that stand for them."""
    links = stage_table(links.select("a", "b"), "named")
    ends = stage_table(links.filter("a <> b").select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    for seed in range(MAX_ROUNDS):
        number = lambda c, seed=seed: F.xxhash64(F.lit(seed), F.col(c))
        total, different = ends.agg(F.count("*"), F.count_distinct(number("node"))).first()
        if total == different:
            break
    else:
        raise RuntimeError("every hash makes two nodes one")
    found = connected_components(links.filter("a <> b").select(number("a").alias("a"), number("b").alias("b")))
    rows = stage_table(ends.select("node", number("node").alias("of")).join(found.withColumnsRenamed({"node": "of", "component": "group"}), "of").select("node", "group"), "groups")
    discard(links, ends)
    first = rows.groupBy("group").agg(F.min("node").alias("component"))
    return rows.join(first, "group").select("node", "component")


def _canonical(edges: DataFrame) -> DataFrame:
    """Each link once, its larger end first, without loops."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """A count and two sums that tell whether a round changed anything."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.hash("u", "v").cast("long"))).first())


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component) of every node; one without links is a component by itself."""
    found = connected_components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    return nodes.select("id").distinct().join(found, F.col("id") == found["node"], "left").select("id", F.coalesce("component", "id").alias("component"))


def analyze(edges: DataFrame, nodes: DataFrame, named: int = 1000) -> DataFrame:
    """One row: totals, the first bottlenecks, how many nodes are isolated, the first ``named`` of them (``isolated`` gives all), and what to do about it."""
    return _analysis(edges, nodes, stage_table(degrees(edges, nodes), "degrees"), named)


def _analysis(edges: DataFrame, nodes: DataFrame, of: DataFrame, named: int) -> DataFrame:
    groups = components(edges, nodes).agg(F.count("*").alias("total_nodes"), F.count_distinct("component").alias("connected_components"))
    few = _bottlenecks(of).agg(F.array_sort(F.collect_list("id")).alias("bottlenecks"))
    single = of.filter("degree = 0").select("id")
    alone = single.orderBy("id").limit(named).agg(F.array_sort(F.collect_list("id")).alias("isolated_nodes"))
    alone = alone.crossJoin(F.broadcast(single.agg(F.count("*").alias("isolated"))))
    quoted = F.array_join(F.transform(F.slice("bottlenecks", 1, 3), lambda x: F.format_string("'%s'", x)), ", ")
    # fixed values: the texts that clients see
    advice = F.when(F.col("connected_components") > 1, F.format_string("Found %d disconnected groups. Consider connecting via: [%s]", "connected_components", quoted)).otherwise("Well-connected structure.")
    return groups.crossJoin(F.broadcast(few)).crossJoin(F.broadcast(alone)).withColumn("method", F.lit(METHOD)).withColumn("recommendation", advice)


def report(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The report as rows (name, value), in text: totals, the advice, the first bottlenecks, and a row for every isolated node, however many there are."""
    nodes = stage_table(nodes.select("id").distinct(), "nodes")
    of = stage_table(degrees(edges, nodes), "degrees")
    one = _analysis(edges, nodes, of, named=0)
    names = ("total_nodes", "connected_components", "method", "recommendation")
    totals = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names])).alias("x")).select("x.*")
    rows = lambda df, name: df.select(F.lit(name).alias("name"), F.col("id").cast("string").alias("value"))
    return totals.unionByName(rows(_bottlenecks(of), "bottleneck")).unionByName(rows(of.filter("degree = 0"), "isolated_node"))


#: The part of the edges held out, the one of a graph of fewer than FEW edges, and how many strata there are.
HELD_OUT, HELD_OUT_OF_FEW, FEW, STRATA = 0.1, 0.2, 50, 4


def held_out(edges: DataFrame) -> DataFrame:
    """(source, target, stratum, validation) of distinct edges: some of each stratum, one at least, are held out.

    An edge counts by the degrees of its ends together; strata are quarters of the edges by that, ties by the ends.
    Which are held out is drawn by a hash of the ends. Both are places in an order that spans tasks.
    """
    edges = edges.select("source", "target").distinct()
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    of = degrees(edges, ends)
    side = lambda end: of.select(F.col("id").alias(end), F.col("degree").alias(f"_{end}"))
    rows = edges.join(side("source"), "source").join(side("target"), "target").select("source", "target", (F.col("_source") + F.col("_target")).alias("_both"), F.lit(0).alias("_all"))
    placed = stage_table(ranked(rows, "_all", ["_both", "source", "target"], "_place"), "placed")
    n = placed.count()
    size, more = n // STRATA, n % STRATA  # the first ones have one more
    early = F.floor((F.col("_place") - 1) / (size + 1)) + 1
    stratum = F.when(F.col("_place") <= more * (size + 1), early).otherwise(F.floor((F.col("_place") - 1 - more) / max(size, 1)) + 1)
    drawn = ranked(placed.select("source", "target", stratum.cast("int").alias("stratum"), unit(F.col("source"), F.col("target"), seed="held").alias("_coin")), "stratum", ["_coin", "source", "target"], "_drawn")
    part = HELD_OUT_OF_FEW if n < FEW else HELD_OUT
    sizes = F.lit(size) + F.when(F.col("stratum") <= more, 1).otherwise(0)
    return drawn.select("source", "target", "stratum", (F.col("_drawn") <= F.greatest(F.lit(1), F.floor(sizes * part))).alias("validation"))
