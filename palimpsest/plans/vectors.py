"""Structural vectors: memories' and nodes' features, the ball, and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.hashing import bucket10
from ..operators import vectors
from ..sources.adapters import memories, parts_as_nodes, table
from ..sources.store import scratch
from ..sources.vectors import VectorStore
from .memory import MEMORIES, NOW, tokens_sql, words_sql

SOURCE = 17
K = 10



def content_features(spark, sf_dir):
    names = ("length", "distinct_share", "tags", "project_bucket", "recency")
    x = memories(spark, sf_dir).select("id", vectors.content_features(NOW).alias("x"))
    return x.select("id", *[F.round(F.col("x")[i], 6).alias(n) for i, n in enumerate(names)])


def project_bucket(spark, sf_dir):
    return memories(spark, sf_dir).select("project").distinct().select("project", bucket10(F.col("project")).cast("long").alias("bucket"))


def memory_knn(spark, sf_dir):
    return vectors.similar_memories(memories(spark, sf_dir), SOURCE, NOW, k=K)


def memory_knn_project(spark, sf_dir):
    return vectors.similar_memories(memories(spark, sf_dir), SOURCE, NOW, k=K, project="src3")


def text_knn(spark, sf_dir):
    return vectors.similar_to_text(memories(spark, sf_dir), "und der rotation of tokens", ["x"], "src3", NOW, k=K)


def node_features(spark, sf_dir):
    x = parts_as_nodes(spark, sf_dir).select("id", vectors.node_features().alias("x"))
    return x.select("id", *[F.col("x")[i].alias(n) for i, n in enumerate(("priority", "tags", "author", "complexity"))])


def embed_nodes(spark, sf_dir):
    x = parts_as_nodes(spark, sf_dir).select("id", geometry.embed(vectors.node_features()).alias("x"))
    return x.select("id", *[F.round(F.col("x")[i], 6).alias(f"x{i}") for i in range(4)])


def node_knn(spark, sf_dir):
    nodes = parts_as_nodes(spark, sf_dir)
    return vectors.similar_nodes(nodes, SOURCE, k=K, tombstones=nodes.filter("id % 4 = 0").select(F.col("id").alias("node_id")))


def _raw(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


def _to_first(spark, sf_dir, out):
    """Each vector with the first one, a single row, beside it."""
    raw = _raw(spark, sf_dir)
    first = raw.filter("id = 0").select(F.col("vector").alias("x"))
    return raw.crossJoin(F.broadcast(first)).select("id", out.alias("v"))


def poincare_distance(spark, sf_dir):
    return _to_first(spark, sf_dir, geometry.distance(F.col("x"), F.col("vector"))).select("id", F.round("v", 3).alias("distance"))


def project_ball(spark, sf_dir):
    return _raw(spark, sf_dir).select("id", F.round(geometry.norm(geometry.to_ball(F.col("vector"))), 6).alias("norm"), F.round(geometry.norm(geometry.clip(F.col("vector"))), 6).alias("clipped"))


def _half(c: str):
    return geometry.scale(F.col(c), F.lit(0.5))


def _entries(x):
    """All of a vector, an entry a row."""
    return x.select("id", F.posexplode("v").alias("place", "value")).select("id", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


def mobius_add(spark, sf_dir):
    return _entries(_to_first(spark, sf_dir, geometry.mobius_add(_half("x"), _half("vector"))))


def exp_map(spark, sf_dir):
    return _entries(_to_first(spark, sf_dir, geometry.exp_map(_half("x"), _half("vector"))))


def vector_knn(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return vectors.nearest(raw, raw.filter("id = 0"), K).select("id", F.round("distance", 3).alias("distance"))


def adaptive_dimension(spark, sf_dir):
    n = table(spark, sf_dir, "customer").select((F.col("c_custkey") * F.col("c_custkey")).alias("nodes"))
    return n.distinct().select("nodes", geometry.dimension(F.col("nodes")).cast("long").alias("dim"))


def _bucket_sql(text: str) -> str:
    """Hexadecimal digits as numbers; 16 to any power is 6 modulo 10."""
    digits = f"[strpos('0123456789abcdef', sha256({text})[i]) - 1 for i in range(1, 65)]"
    return f"((list_sum({digits}) * 6 - 5 * (strpos('0123456789abcdef', sha256({text})[64]) - 1)) % 10)"


def _dot(a: str, b: str) -> str:
    return f"list_sum([({a})[i] * ({b})[i] for i in range(1, len({a}) + 1)])"


def _embed_sql(x: str) -> str:
    """The vector scaled between its extremes, then to norm 0.95 (its largest entry is 1)."""
    s = f"[(v - list_min({x})) / (list_max({x}) - list_min({x})) for v in {x}]"
    return f"CASE WHEN list_max({x}) - list_min({x}) <= 1e-8 THEN [0.0::DOUBLE for v in {x}] ELSE [v * (0.95::DOUBLE / sqrt({_dot(s, s)})) for v in {s}] END"


def _distance_sql(a: str, b: str) -> str:
    gap = f"list_sum([pow({a}[i] - {b}[i], 2) for i in range(1, len({a}) + 1)])"
    return f"acosh(greatest(1, 1 + 2 * {gap} / ((1 - {_dot(a, a)}) * (1 - {_dot(b, b)}) + 1e-10)))"


_CONTENT = f"""feats AS (SELECT id, project, content, forgotten, [least(1.0, {words_sql('content')} / 200.0)::DOUBLE, (len(list_distinct({tokens_sql('content')})) / greatest(1, len({tokens_sql('content')})))::DOUBLE,
  (len(tags) / 10.0)::DOUBLE, ({_bucket_sql('project')} / 10.0)::DOUBLE, 1 / (1 + greatest(0, epoch(TIMESTAMP '{NOW}' - created_at) / 86400.0))::DOUBLE] AS x FROM memories)"""
_MEMORY_KNN = f"""WITH {MEMORIES}, {_CONTENT}, v AS (SELECT id, project, content, {_embed_sql('x')} AS x FROM feats WHERE NOT forgotten), s AS (SELECT x FROM v WHERE id = {SOURCE}),
  d AS (SELECT v.id, {_distance_sql('v.x', 's.x')} AS d, v.content FROM v CROSS JOIN s WHERE v.id <> {SOURCE} /*scope*/)
  SELECT id, round(d, 4) AS distance, CASE WHEN length(content) > 120 THEN left(content, 120) || '…' ELSE content END AS content_preview FROM d ORDER BY d, id LIMIT {K}"""
_NODES = f"nodes AS (SELECT p_partkey AS id, [p_size % 10, len(string_split(p_name, ' ')), {_bucket_sql('p_brand')}, p_size]::DOUBLE[] AS x FROM part)"
_RAW = """raw AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings), sq AS (SELECT id, x, sqrt(list_sum([v * v for v in x])) AS n FROM raw),
  clipped AS (SELECT id, CASE WHEN n > 0.99 THEN [v * (0.99 / n) for v in x] ELSE x END AS x FROM sq), one AS (SELECT x AS y FROM clipped WHERE id = 0)"""
_HALVES = "h AS (SELECT id, [v * 0.5 for v in x] AS v FROM raw), f AS (SELECT v AS x FROM h WHERE id = 0)"


def _mobius_sql(rel: str) -> str:
    """Over ``rel`` of (id, x, y)."""
    return f"""m AS (SELECT id, x, y, {_dot('x', 'y')} AS xy, {_dot('x', 'x')} AS xx, {_dot('y', 'y')} AS yy FROM {rel}),
      r AS (SELECT id, [((1 + 2 * xy + yy) * x[i] + (1 - xx) * y[i]) / (1 + 2 * xy + xx * yy + 1e-10) for i in range(1, len(x) + 1)] AS v FROM m) SELECT id, place, round(v[place + 1], 6) AS value FROM (SELECT id, v, unnest(range(len(v))) AS place FROM r)"""


def vector_store(spark, sf_dir):
    """Vectors stored, some again, some taken out, and read back in 80 dimensions and in 3."""
    store = VectorStore(spark, scratch(spark, "vectors"))
    rows = _raw(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "vector", F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("project"), F.col("id").alias("n"))
    store.put(rows)
    store.put(rows.filter("n % 3 = 0").withColumn("vector", F.reverse("vector")))
    store.take_out(rows.filter("n % 5 = 0"))
    store.resize(32)
    wide, cut = store.load(80), store.load(3).select("id", F.size("vector").alias("cut"))
    return wide.join(cut, "id").select("id", "project", F.size("vector").alias("dim"), "cut", *[F.round(F.col("vector")[i].cast("double"), 6).alias(f"x{i}") for i in (0, 30, 79)])


QUERIES = {
    "vector_store": vector_store,
    "content_features": content_features, "project_bucket": project_bucket, "memory_knn": memory_knn, "memory_knn_project": memory_knn_project, "text_knn": text_knn, "node_features": node_features, "embed_nodes": embed_nodes,
    "node_knn": node_knn, "poincare_distance": poincare_distance, "project_ball": project_ball, "mobius_add": mobius_add, "exp_map": exp_map, "vector_knn": vector_knn, "adaptive_dimension": adaptive_dimension,
}
SQL = {
    "vector_store": """SELECT vec_id::VARCHAR AS id, 'p' || (vec_id % 3) AS project, 80 AS dim, 3 AS cut, round(v[1]::DOUBLE, 6) AS x0, round(v[31]::DOUBLE, 6) AS x30, 0.0::DOUBLE AS x79
      FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_reverse(embedding) ELSE embedding END AS v FROM embeddings WHERE vec_id % 5 <> 0)""",
    "content_features": f"WITH {MEMORIES}, {_CONTENT} SELECT id, round(x[1], 6) AS length, round(x[2], 6) AS distinct_share, round(x[3], 6) AS tags, round(x[4], 6) AS project_bucket, round(x[5], 6) AS recency FROM feats",
    "project_bucket": f"SELECT DISTINCT source AS project, {_bucket_sql('source')}::BIGINT AS bucket FROM documents",
    "memory_knn": _MEMORY_KNN, "memory_knn_project": _MEMORY_KNN.replace("/*scope*/", "AND v.project = 'src3'"),
    "text_knn": f"""WITH {MEMORIES}, {_CONTENT}, v AS (SELECT id, {_embed_sql('x')} AS x FROM feats WHERE NOT forgotten), t AS (SELECT [5 / 200.0, 1.0, 0.1, {_bucket_sql("'src3'")} / 10.0, 1.0]::DOUBLE[] AS x), s AS (SELECT {_embed_sql('x')} AS x FROM t)
      SELECT id, round(d, 4) AS distance FROM (SELECT v.id, {_distance_sql('v.x', 's.x')} AS d FROM v CROSS JOIN s) ORDER BY d, id LIMIT {K}""",
    "node_features": f"WITH {_NODES} SELECT id, x[1] AS priority, x[2] AS tags, x[3] AS author, x[4] AS complexity FROM nodes",
    "embed_nodes": f"WITH {_NODES}, v AS (SELECT id, {_embed_sql('x')} AS x FROM nodes) SELECT id, round(x[1], 6) AS x0, round(x[2], 6) AS x1, round(x[3], 6) AS x2, round(x[4], 6) AS x3 FROM v",
    "node_knn": f"""WITH {_NODES}, v AS (SELECT id, {_embed_sql('x')} AS x FROM nodes WHERE id % 4 <> 0), s AS (SELECT x FROM v WHERE id = {SOURCE})
      SELECT id, round(d, 4) AS distance FROM (SELECT v.id, {_distance_sql('v.x', 's.x')} AS d FROM v CROSS JOIN s WHERE v.id <> {SOURCE}) ORDER BY d, id LIMIT {K}""",
    "poincare_distance": f"WITH {_RAW} SELECT id, round({_distance_sql('x', 'y')}, 3) AS distance FROM clipped CROSS JOIN one",
    "project_ball": f"WITH {_RAW} SELECT id, round(CASE WHEN n >= 0.95 THEN 0.95 ELSE n END, 6) AS norm, round(CASE WHEN n > 0.99 THEN 0.99 ELSE n END, 6) AS clipped FROM sq",
    "mobius_add": f"WITH {_RAW}, {_HALVES}, p AS (SELECT h.id, f.x, h.v AS y FROM h CROSS JOIN f), {_mobius_sql('p')}",
    "exp_map": f"WITH {_RAW}, {_HALVES}, p AS (SELECT h.id, f.x, [w * (tanh(sqrt({_dot('h.v', 'h.v')})) / sqrt({_dot('h.v', 'h.v')})) for w in h.v] AS y FROM h CROSS JOIN f), {_mobius_sql('p')}",
    "vector_knn": f"WITH {_RAW} SELECT id, round(d, 3) AS distance FROM (SELECT id, {_distance_sql('x', 'y')} AS d FROM clipped CROSS JOIN one WHERE id <> 0) ORDER BY d, id LIMIT {K}",
    "adaptive_dimension": "SELECT DISTINCT nodes, CASE WHEN nodes < 50 THEN 32 ELSE least(128, greatest(16, ceil(4 * log2(nodes)))) END::BIGINT AS dim FROM (SELECT c_custkey * c_custkey AS nodes FROM customer)",
}
