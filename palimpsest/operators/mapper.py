"""Mapper graphs: an overlapping cover of a lens, density clusters within each interval, edges where clusters share members.

A point is a core if ``LEAST`` points, itself included, lie within ``EPS``; cores within ``EPS`` of each other are one
cluster, other points belong to the first cluster of a core within ``EPS``, or to none. Clusters are named by their
interval and first core, ``00003:id``, by text.

Points fall into cells in which any two are within ``EPS``. A cell of ``LEAST`` points and more is made of cores alone,
all of one cluster, and its points are never compared with each other. The fewer than ``LEAST`` points of any other cell
are compared with those of the cells around, so that a point meets a bounded number of them however full its cell is.
Whether two full cells touch is found from boxes around what smaller and smaller sub-cells hold: two boxes whose farthest
corners are within ``EPS`` touch, boxes whose nearest sides aren't do not, and only those in between are cut further, down
to single places. So no two full cells are ever compared point by point.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import discard, stage_table
from .graph import connected_components

EPS, LEAST = 0.5, 5
#: Sub-cells a side is cut into, again and again.
CUT = 8


def cover(low: float, high: float, intervals: int, overlap: float) -> list[tuple[float, float]]:
    """Intervals of equal length from ``low`` to ``high``; each shares that part of its length with the next."""
    length = (high - low) / (intervals - (intervals - 1) * overlap)
    return [(low + k * length * (1 - overlap), low + k * length * (1 - overlap) + length) for k in range(intervals)]


def _square(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [p * p for p in parts])


def _cell(dims: int, size: float, name: str = "x") -> Column:
    return F.array(*[F.floor(F.col(f"{name}{d}") / size) for d in range(dims)])


def clusters(points: DataFrame, dims: int, eps: float = EPS, least: int = LEAST) -> DataFrame:
    """(level, id, cluster): members of the density clusters of points (level, id, x0, x1, ...), level by level. Points have no nulls, and an id occurs once a level."""
    xs = [f"x{d}" for d in range(dims)]
    size = eps / math.sqrt(dims) * (1 - 1e-9)  # rounding never puts two points of a cell beyond eps
    name = F.format_string("%05d:%s", "level", F.col("id").cast("string"))
    rows = points.select("level", "id", *xs, name.alias("node"), _cell(dims, size).alias("cell"))
    full = rows.groupBy("level", "cell").agg((F.count("*") >= least).alias("full"), F.min("node").alias("head"))
    rows = stage_table(rows.join(full, ["level", "cell"]), "points")

    # points of thin cells, and what is near them
    reach = range(-math.ceil(math.sqrt(dims)), math.ceil(math.sqrt(dims)) + 1)
    around = [o for o in itertools.product(reach, repeat=dims) if sum(max(0, abs(v) - 1) ** 2 for v in o) <= dims]
    offsets = F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in around])
    thin = rows.filter("NOT full").select("level", F.col("node").alias("a"), *[F.col(x).alias(f"a_{x}") for x in xs], F.explode(F.transform(offsets, lambda o: F.zip_with("cell", o, lambda p, q: p + q))).alias("cell"))
    near = thin.join(rows.select("level", "cell", F.col("node").alias("b"), *xs, "full"), ["level", "cell"]).filter(_square([F.col(f"a_{x}") - F.col(x) for x in xs]) <= eps * eps)
    near = stage_table(near.select("a", "b", F.col("full").alias("b_core")), "near")
    cores = near.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(F.col("a").alias("core"))
    cores = stage_table(cores, "cores")
    known = near.join(cores.withColumnRenamed("core", "b"), "b", "left_semi").unionByName(near.filter("b_core")).select("a", "b")
    linked = known.join(cores.withColumnRenamed("core", "a"), "a", "left_semi")
    within = rows.filter("full").select(F.col("node").alias("a"), F.col("head").alias("b"))
    touching = _touching(rows.filter("full"), dims, eps, size, around)
    links = linked.unionByName(within).unionByName(touching)
    parts = connected_components(links)  # of cores alone
    every = rows.filter("full").select(F.col("node").alias("core")).unionByName(cores)
    named = stage_table(every.join(parts, F.col("core") == F.col("node"), "left").select("core", F.coalesce("component", "core").alias("cluster")), "clusters")
    # others: the first cluster of a core nearby
    border = known.join(cores.withColumnRenamed("core", "a"), "a", "left_anti").join(named.withColumnRenamed("core", "b"), "b").groupBy(F.col("a").alias("core")).agg(F.min("cluster").alias("cluster"))
    found = named.unionByName(border).withColumnRenamed("core", "node")
    return rows.select("level", "id", "node").join(found, "node").select("level", "id", "cluster")


def _touching(rows: DataFrame, dims: int, eps: float, size: float, around: list[tuple[int, ...]]) -> DataFrame:
    """(a, b): heads of full cells of which some points are within eps, each pair once."""
    xs = [f"x{d}" for d in range(dims)]
    later = [o for o in around if o > (0,) * dims]
    offsets = F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in later])
    cells = rows.select("level", "cell", "head").distinct()
    beside = cells.select("level", F.col("head").alias("a"), F.explode(F.transform(offsets, lambda o: F.zip_with("cell", o, lambda p, q: p + q))).alias("cell"))
    open_ = stage_table(beside.join(cells.withColumnRenamed("head", "b"), ["level", "cell"]).select("a", "b").withColumn("a_box", F.col("a")).withColumn("b_box", F.col("b")), "beside")
    points = rows.select(F.col("head").alias("cell"), F.col("head").alias("box"), *xs)
    out, spare = None, []
    while open_.take(1):
        size /= CUT
        # a box of a box: its name goes on with the places of the sub-cell
        cut = points.withColumn("inner", F.concat_ws("/", "box", *[F.floor(F.col(x) / size).cast("string") for x in xs]))
        boxes = cut.groupBy("cell", "box", "inner").agg(*[F.min(x).alias(f"{x}_lo") for x in xs], *[F.max(x).alias(f"{x}_hi") for x in xs])
        boxes = stage_table(boxes, "boxes")
        side = lambda s: boxes.select(F.col("cell").alias(s), F.col("box").alias(f"{s}_box"), F.col("inner").alias(f"{s}_inner"), *[F.col(f"{x}_{e}").alias(f"{s}_{x}_{e}") for x in xs for e in ("lo", "hi")])
        pairs = open_.join(side("a"), ["a", "a_box"]).join(side("b"), ["b", "b_box"])
        gap = [F.greatest(F.col(f"b_{x}_lo") - F.col(f"a_{x}_hi"), F.col(f"a_{x}_lo") - F.col(f"b_{x}_hi"), F.lit(0.0)) for x in xs]
        span = [F.greatest(F.col(f"b_{x}_hi") - F.col(f"a_{x}_lo"), F.col(f"a_{x}_hi") - F.col(f"b_{x}_lo")) for x in xs]
        pairs = stage_table(pairs.select("a", "b", F.col("a_inner").alias("a_box"), F.col("b_inner").alias("b_box"), _square(gap).alias("least"), _square(span).alias("most")).filter(F.col("least") <= eps * eps), "pairs")
        sure = pairs.filter(F.col("most") <= eps * eps).select("a", "b").distinct()
        out = sure if out is None else out.unionByName(sure)
        left = stage_table(pairs.join(sure, ["a", "b"], "left_anti").select("a", "b", "a_box", "b_box"), "beside")
        spare += [boxes]
        discard(open_)
        open_ = left
        wanted = left.select(F.col("a_box").alias("inner")).unionByName(left.select(F.col("b_box").alias("inner"))).distinct()
        points = cut.join(wanted, "inner", "left_semi").select("cell", F.col("inner").alias("box"), *xs)
    discard(open_, *spare)
    return rows.sparkSession.createDataFrame([], "a string, b string") if out is None else out


def mapper(points: DataFrame, lens: Column, intervals: list[tuple[float, float]], dims: int, eps: float = EPS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the nerve: nodes (cluster, level, members, c0, c1, ...: the centroid), edges (source, target, weight: shared members).

    ``points`` are (id, x0, x1, ...); a null lens or coordinate lies in no interval. A point in k intervals has k
    clusters at most, so that it adds to no more than k (k - 1) / 2 edges.
    """
    xs = [f"x{d}" for d in range(dims)]
    inside = F.filter(F.array(*[F.when((lens >= lo) & (lens <= hi), F.lit(k)) for k, (lo, hi) in enumerate(intervals)]), lambda k: k.isNotNull())
    whole = points.filter(reduce(lambda a, b: a & b, [F.col(x).isNotNull() & ~F.isnan(x) for x in xs]))
    rows = stage_table(whole.select(F.explode(inside).alias("level"), "id", *[F.col(x).cast("double").alias(x) for x in xs]), "covered")
    found = stage_table(clusters(rows, dims, eps, least), "members")
    nodes = found.join(rows, ["level", "id"]).groupBy("cluster", "level").agg(F.count("*").alias("members"), *[F.avg(x).alias(f"c{d}") for d, x in enumerate(xs)])
    one, two = (found.select("id", F.col("cluster").alias(n), F.col("level").alias(f"_{n}")) for n in ("source", "target"))
    edges = one.join(two, "id").filter("_source < _target").groupBy("source", "target").agg(F.count("*").alias("weight"))
    return nodes, edges
