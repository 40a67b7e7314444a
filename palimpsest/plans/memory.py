"""Memories: tokens, frequencies, ranked retrieval, budgets, previews and statistics over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, preview, token_estimate, tokens
from ..operators import commands, retrieval, stats
from ..sources.adapters import memories

QUERY = "Einber lichlich und the eroning atonou license"
PROJECT = "src3"
NOW = "2024-02-01 00:00:00"
K = 10


def tokenize(spark, sf_dir):
    m = memories(spark, sf_dir)
    return m.select("id", F.size(tokens(F.col("content"))).alias("n_tokens"), F.array_join(tokens(F.col("content")), " ").alias("tokens"))


def term_freq(spark, sf_dir):
    return retrieval.term_frequencies(memories(spark, sf_dir))


def doc_freq(spark, sf_dir):
    return retrieval.document_frequencies(retrieval.active(memories(spark, sf_dir)))


def idf(spark, sf_dir):
    return retrieval.inverse_frequencies(retrieval.active(memories(spark, sf_dir))).withColumn("idf", F.round("idf", 6))


def recall(spark, sf_dir):
    return retrieval.recall(memories(spark, sf_dir), QUERY, NOW, k=K, recency_weight=0.0)


def recall_project(spark, sf_dir):
    return retrieval.recall(memories(spark, sf_dir), QUERY, NOW, project=PROJECT, k=K, recency_weight=0.0)


def recall_recency(spark, sf_dir):
    return retrieval.recall(memories(spark, sf_dir), QUERY, NOW, k=K, recency_weight=0.3)


def token_budget(spark, sf_dir):
    return retrieval.budget(recall(spark, sf_dir))


def token_estimates(spark, sf_dir):
    return memories(spark, sf_dir).select("id", token_estimate(F.col("content")).cast("long").alias("token_estimate"))


def forgotten_filter(spark, sf_dir):
    return retrieval.active(memories(spark, sf_dir)).select("id", "project")


def previews(spark, sf_dir):
    return memories(spark, sf_dir).select("id", preview(F.col("content")).alias("content_preview"))


def memory_stats(spark, sf_dir):
    return stats.memory_stats(memories(spark, sf_dir))


def forget_command(spark, sf_dir):
    """Forget every id, and as many unknown ones."""
    m = memories(spark, sf_dir)
    asked = m.select(F.explode(F.array("id", F.col("id") + 1_000_000_000)).alias("id"), F.lit(None).cast("string").alias("reason"))
    return commands.forget(asked, m, NOW)[0]


def update_command(spark, sf_dir):
    """Rewrite every memory, each ninth with a blank; and each seventh id again as an unknown one."""
    m = memories(spark, sf_dir)
    ids = F.when(F.col("id") % 7 == 0, F.array("id", F.col("id") + 1_000_000_000)).otherwise(F.array("id"))
    asked = m.select(F.explode(ids).alias("id")).select("id", F.when(F.col("id") % 9 == 0, "  ").otherwise("two new words").alias("content"))
    return commands.update(asked, m, NOW)[0].select("id", "status", F.col("token_estimate").cast("long").alias("token_estimate"))


def remember_command(spark, sf_dir):
    asked = memories(spark, sf_dir).select("id", F.when(F.col("id") % 9 == 0, "").otherwise(F.col("content")).alias("content"), "project", "tags")
    return commands.remember(asked, NOW)[0].withColumn("token_estimate", F.col("token_estimate").cast("long"))


_LIST = "[" + ",".join(f"'{w}'" for w in STOP_WORDS) + "]"
MEMORIES = """memories AS (
  SELECT d.doc_id AS id, d.source AS project, d.text AS content, [d.lang] AS tags, TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS created_at, l.doc_id IS NOT NULL AS forgotten,
    TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) + CASE WHEN l.doc_id IS NOT NULL THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS updated_at
  FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id
)"""


def tokens_sql(text: str) -> str:
    kept = f"[t for t in regexp_extract_all(lower({text}), '[a-z0-9]+') if length(t) >= 2 and not list_contains({_LIST}, t)]"
    stem = """CASE WHEN length(t) > 5 AND t LIKE '%ing' THEN left(t, -3) WHEN length(t) > 4 AND t LIKE '%ed' THEN left(t, -2)
      WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, -1) ELSE t END"""
    return f"[{stem} for t in {kept}]"


def words_sql(text: str) -> str:
    return f"len(regexp_extract_all({text}, '\\S+'))"


def estimate_sql(text: str) -> str:
    return f"greatest(1, round_even({words_sql(text)} * 0.75, 0))::BIGINT"


def ranking_sql(candidates: str, fitted: str, limit: int, recency: float = 0.0, query: str = QUERY) -> str:
    """CTEs that end in (id, score) ``ranked`` over two relations of (id, content, created_at)."""
    asked = tokens_sql(f"'{query}'")
    boost = f"score * (1 + {recency} / (1 + greatest(0, epoch(TIMESTAMP '{NOW}' - created_at) / 86400.0)))" if recency else "score"
    first = f"ORDER BY score DESC, id LIMIT {3 * limit}" if recency else ""
    return f"""fitted AS (SELECT id, {tokens_sql('content')} AS toks FROM {fitted}),
    q AS (SELECT t, count(*) AS c, (SELECT len({asked})) AS total FROM (SELECT unnest({asked}) AS t) GROUP BY t),
    df AS (SELECT t, count(DISTINCT id) AS df FROM (SELECT id, unnest(toks) AS t FROM fitted) WHERE t IN (SELECT t FROM q) GROUP BY t),
    n AS (SELECT count(*) AS n FROM fitted WHERE len(toks) > 0),
    cand AS (SELECT id, created_at, {tokens_sql('content')} AS toks FROM {candidates}),
    hits AS (SELECT id, created_at, len(toks) AS len, t, count(*) AS c FROM (SELECT id, created_at, toks, unnest(toks) AS t FROM cand) GROUP BY id, created_at, toks, t),
    scored AS (SELECT h.id, h.created_at, sum((h.c / h.len) * (q.c / q.total) * pow(ln((n.n + 1) / (df.df + 1)) + 1, 2)) AS score
      FROM hits h JOIN q ON q.t = h.t JOIN df ON df.t = h.t CROSS JOIN n GROUP BY h.id, h.created_at),
    first AS (SELECT * FROM scored WHERE score > 0 {first}),
    ranked AS (SELECT id, {boost} AS score FROM first ORDER BY {boost} DESC, id LIMIT {limit})"""


def answer_sql(source: str) -> str:
    return f"SELECT r.id, m.project, m.content, round(r.score, 5) AS score, {estimate_sql('m.content')} AS token_estimate FROM ranked r JOIN {source} m ON m.id = r.id"


_ACTIVE = "active AS (SELECT * FROM memories WHERE NOT forgotten)"
_RECALL = f"WITH {MEMORIES}, {_ACTIVE}, {ranking_sql('active', 'active', K)} {answer_sql('active')}"

QUERIES = {
    "tokenize": tokenize, "term_freq": term_freq, "doc_freq": doc_freq, "idf": idf, "recall": recall, "recall_project": recall_project, "recall_recency": recall_recency, "token_budget": token_budget,
    "token_estimate": token_estimates, "forgotten_filter": forgotten_filter, "preview": previews, "memory_stats": memory_stats, "forget_command": forget_command, "update_command": update_command,
    "remember_command": remember_command,
}
SQL = {
    "tokenize": f"WITH {MEMORIES}, x AS (SELECT id, {tokens_sql('content')} AS toks FROM memories) SELECT id, len(toks) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM x",
    "term_freq": f"WITH {MEMORIES} SELECT id, token, count(*) AS tf FROM (SELECT id, unnest({tokens_sql('content')}) AS token FROM memories) GROUP BY id, token",
    "doc_freq": f"WITH {MEMORIES}, {_ACTIVE} SELECT token, count(DISTINCT id) AS df FROM (SELECT id, unnest({tokens_sql('content')}) AS token FROM active) GROUP BY token",
    "idf": f"""WITH {MEMORIES}, {_ACTIVE}, x AS (SELECT id, {tokens_sql('content')} AS toks FROM active), n AS (SELECT count(*) AS n FROM x WHERE len(toks) > 0),
      d AS (SELECT token, count(DISTINCT id) AS df FROM (SELECT id, unnest(toks) AS token FROM x) GROUP BY token) SELECT token, df, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf FROM d CROSS JOIN n""",
    "recall": _RECALL,
    "recall_project": f"WITH {MEMORIES}, {_ACTIVE}, inside AS (SELECT * FROM active WHERE project = '{PROJECT}'), {ranking_sql('inside', 'active', K)} {answer_sql('active')}",
    "recall_recency": f"WITH {MEMORIES}, {_ACTIVE}, {ranking_sql('active', 'active', K, 0.3)} {answer_sql('active')}",
    "token_budget": f"SELECT count(*) AS count, (40 + coalesce(sum(token_estimate), 0))::BIGINT AS total_tokens FROM ({_RECALL})",
    "token_estimate": f"WITH {MEMORIES} SELECT id, {estimate_sql('content')} AS token_estimate FROM memories",
    "forgotten_filter": f"WITH {MEMORIES} SELECT id, project FROM memories WHERE NOT forgotten",
    "preview": f"WITH {MEMORIES} SELECT id, CASE WHEN length(content) > 120 THEN left(content, 120) || '…' ELSE content END AS content_preview FROM memories",
    "memory_stats": f"""WITH {MEMORIES} SELECT count(*) FILTER (NOT forgotten) AS active, count(*) FILTER (forgotten) AS forgotten,
      count(*) FILTER (NOT forgotten AND len({tokens_sql('content')}) > 0) AS indexed, count(*) FILTER (NOT forgotten) AS vectors FROM memories""",
    "remember_command": f"""WITH {MEMORIES}, x AS (SELECT *, id % 9 = 0 OR trim(content) = '' AS bad FROM memories)
      SELECT id, project, CASE WHEN bad THEN 'error' ELSE 'remembered' END AS status, CASE WHEN bad THEN NULL ELSE {estimate_sql('content')} END AS token_estimate,
        CASE WHEN NOT bad THEN (SELECT count(*) FROM x WHERE NOT bad AND len({tokens_sql('content')}) > 0) END AS indexed_terms, CASE WHEN NOT bad THEN true END AS embedded FROM x""",
    "forget_command": f"""WITH {MEMORIES}, asked AS (SELECT unnest([id, id + 1000000000]) AS id FROM memories)
      SELECT a.id, CASE WHEN m.id IS NULL THEN 'not_found' WHEN m.forgotten THEN 'already_forgotten' ELSE 'forgotten' END AS status, 'manual' AS reason FROM asked a LEFT JOIN memories m ON m.id = a.id""",
    "update_command": f"""WITH {MEMORIES}, asked AS (SELECT id FROM memories UNION ALL SELECT id + 1000000000 FROM memories WHERE id % 7 = 0),
      x AS (SELECT a.id, a.id % 9 = 0 OR m.id IS NULL OR m.forgotten AS bad FROM asked a LEFT JOIN memories m ON m.id = a.id)
      SELECT id, CASE WHEN bad THEN 'error' ELSE 'updated' END AS status, CASE WHEN bad THEN NULL ELSE 2 END::BIGINT AS token_estimate FROM x""",
}
