"""Connectivity of the part-supplier graph over every line of ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eventlog, graph
from ..sources.adapters import graph_events, graph_nodes, graph_relations
from ..sources.store import stage_table


def _graph(spark, sf_dir):
    nodes = graph_nodes(spark, sf_dir)
    return stage_table(eventlog.active_edges(graph_relations(spark, sf_dir), nodes), "edges"), nodes


def active_edges(spark, sf_dir):
    return eventlog.active_edges(graph_relations(spark, sf_dir), graph_nodes(spark, sf_dir))


def degrees(spark, sf_dir):
    return graph.degrees(*_graph(spark, sf_dir))


def isolated(spark, sf_dir):
    return graph.isolated(*_graph(spark, sf_dir))


def bottlenecks(spark, sf_dir):
    """Every one of them; the report names the first by id."""
    return graph.bottlenecks(*_graph(spark, sf_dir), k=None)


def components(spark, sf_dir):
    return graph.components(*_graph(spark, sf_dir))


def analyze_structure(spark, sf_dir):
    out = graph.analyze(*_graph(spark, sf_dir))
    return out.select("total_nodes", "connected_components", F.array_join("bottlenecks", ",").alias("bottlenecks"), "isolated", "recommendation")


def structure_report(spark, sf_dir):
    """A project's structure from the payloads of an event log, every isolated node among the rows."""
    edges, nodes = eventlog.graph_of(stage_table(graph_events(spark, sf_dir), "log"), "shop")
    return graph.report(stage_table(edges, "edges"), nodes)


_GRAPH = """nodes AS (SELECT 'p' || p_partkey AS id FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier),
  rel AS (SELECT l_returnflag AS f, 'p' || l_partkey AS source, 's' || l_suppkey AS target FROM lineitem WHERE l_returnflag IN ('N', 'R')),
  edges AS (SELECT DISTINCT source, target FROM rel WHERE f = 'N' AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)
    AND (source, target) NOT IN (SELECT (source, target) FROM rel WHERE f = 'R')),
  both_ AS (SELECT source AS id, target AS other FROM edges UNION SELECT target, source FROM edges),
  deg AS (SELECT n.id, count(b.other) AS degree FROM nodes n LEFT JOIN both_ b ON b.id = n.id GROUP BY n.id)"""
_NARROW = "narrow AS (SELECT id, degree FROM deg WHERE degree > 0 AND degree < 0.3 * (SELECT avg(degree) FROM deg) ORDER BY id LIMIT 10)"
#: Each round takes the smallest component among a node's neighbours; all pairs that reach each other would not fit.
_SPREAD = """comp(id, component) USING KEY (id) AS (SELECT id, id FROM nodes UNION
  SELECT b.other, min(c.component) FROM comp c JOIN both_ b ON b.id = c.id JOIN recurring.comp o ON o.id = b.other WHERE c.component < o.component GROUP BY b.other)"""
QUERIES = {"active_edges": active_edges, "degrees": degrees, "isolated": isolated, "bottlenecks": bottlenecks, "components": components, "analyze_structure": analyze_structure, "structure_report": structure_report}
SQL = {
    "active_edges": f"WITH {_GRAPH} SELECT source, target FROM edges",
    "degrees": f"WITH {_GRAPH} SELECT id, degree FROM deg",
    "isolated": f"WITH {_GRAPH} SELECT id FROM deg WHERE degree = 0",
    "bottlenecks": f"WITH {_GRAPH} SELECT id, degree FROM deg WHERE degree > 0 AND degree < 0.3 * (SELECT avg(degree) FROM deg)",
    "components": f"WITH RECURSIVE {_GRAPH}, {_SPREAD} SELECT id, component FROM comp",
    "analyze_structure": f"""WITH RECURSIVE {_GRAPH}, {_SPREAD}, {_NARROW}, x AS (SELECT count(*) AS total_nodes, count(DISTINCT component) AS connected_components FROM comp),
      b AS (SELECT coalesce(string_agg(id, ',' ORDER BY id), '') AS bottlenecks, coalesce(string_agg('''' || id || '''', ', ' ORDER BY id) FILTER (id IN (SELECT id FROM narrow ORDER BY id LIMIT 3)), '') AS few FROM narrow)
      SELECT total_nodes, connected_components, bottlenecks, (SELECT count(*) FROM deg WHERE degree = 0) AS isolated,
        CASE WHEN connected_components > 1 THEN 'Found ' || connected_components || ' disconnected groups. Consider connecting via: [' || few || ']' ELSE 'Well-connected structure.' END AS recommendation FROM x CROSS JOIN b""",
}
_SHOP = _GRAPH.replace("'p' ||", "'node:part:' ||").replace("'s' ||", "'node:supplier:' ||").replace("FROM part UNION", "FROM part WHERE p_partkey % 5 <> 0 UNION").replace("FROM supplier)", "FROM supplier WHERE s_suppkey % 7 <> 0)")
SQL["structure_report"] = f"""WITH RECURSIVE {_SHOP}, {_SPREAD}, {_NARROW}, x AS (SELECT count(*) AS n, count(DISTINCT component) AS c FROM comp),
  few AS (SELECT coalesce(string_agg('''' || id || '''', ', ' ORDER BY id) FILTER (id IN (SELECT id FROM narrow ORDER BY id LIMIT 3)), '') AS few FROM narrow)
  SELECT 'total_nodes' AS name, n::VARCHAR AS value FROM x UNION ALL SELECT 'connected_components', c::VARCHAR FROM x UNION ALL SELECT 'method', '{graph.METHOD}'
  UNION ALL SELECT 'recommendation', CASE WHEN c > 1 THEN 'Found ' || c || ' disconnected groups. Consider connecting via: [' || few || ']' ELSE 'Well-connected structure.' END FROM x, few
  UNION ALL SELECT 'bottleneck', id FROM narrow UNION ALL SELECT 'isolated_node', id FROM deg WHERE degree = 0"""
