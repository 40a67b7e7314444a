"""Mapper graph of the parts by size and price."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mapper
from ..sources.adapters import table

#: Prices over 200 in ten overlapping intervals.
COVER = mapper.cover(4.0, 11.5, 10, 0.3)


def _graph(spark, sf_dir):
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / F.lit(5.0)).alias("x0"), (F.col("p_retailprice") / F.lit(200.0)).alias("x1"))
    return mapper.mapper(points, F.col("x1"), COVER, 2)


def mapper_nodes(spark, sf_dir):
    nodes, _ = _graph(spark, sf_dir)
    return nodes.select("cluster", "level", "members", F.round("c0", 6).alias("c0"), F.round("c1", 6).alias("c1"))


def mapper_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


_COVER = ", ".join(f"({k}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for k, (lo, hi) in enumerate(COVER))
_CLUSTERS = f"""pts AS MATERIALIZED (SELECT k AS level, p_partkey AS id, printf('%05d:%d', k, p_partkey) AS node, p_size / 5.0::DOUBLE AS x, p_retailprice / 200.0::DOUBLE AS y
    FROM part, (VALUES {_COVER}) c(k, lo, hi) WHERE p_retailprice / 200.0::DOUBLE BETWEEN lo AND hi),
  near AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM pts a JOIN pts b ON a.level = b.level AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {mapper.EPS * mapper.EPS}),
  core AS MATERIALIZED (SELECT a AS node FROM near GROUP BY 1 HAVING count(*) >= {mapper.LEAST}),
  links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT node FROM core) AND b IN (SELECT node FROM core)),
  comp(id, component) USING KEY (id) AS (SELECT node, node FROM core UNION
    SELECT l.b, min(c.component) FROM comp c JOIN links l ON l.a = c.id JOIN recurring.comp o ON o.id = l.b WHERE c.component < o.component GROUP BY l.b),
  member AS (SELECT id AS node, component AS cluster FROM comp UNION ALL
    SELECT n.a, min(c.component) FROM near n JOIN comp c ON c.id = n.b WHERE n.a NOT IN (SELECT node FROM core) GROUP BY 1),
  found AS (SELECT level, id, x, y, cluster FROM pts JOIN member USING (node))"""
QUERIES = {"mapper_nodes": mapper_nodes, "mapper_edges": mapper_edges}
SQL = {
    "mapper_nodes": f"WITH RECURSIVE {_CLUSTERS} SELECT cluster, level, count(*) AS members, round(avg(x), 6) AS c0, round(avg(y), 6) AS c1 FROM found GROUP BY 1, 2",
    "mapper_edges": f"WITH RECURSIVE {_CLUSTERS} SELECT s.cluster AS source, t.cluster AS target, count(*) AS weight FROM found s JOIN found t ON s.id = t.id AND s.level < t.level GROUP BY 1, 2",
}
