"""Memories in time over ``conversations``: version intervals, snapshots and retrieval as of a moment."""

from __future__ import annotations

from ..operators import retrieval, versions
from ..sources.adapters import memory_log
from .memory import answer_sql, ranking_sql

QUERY = "einber tion lichlich und reenin the que der para"
MOMENT = "2024-01-01T03:30:00+05:30"
NAIVE = "2024-01-01 03:30:00"
K = 10


def _state(spark, sf_dir):
    log = memory_log(spark, sf_dir)
    return versions.current(log), versions.versions(log)


def version_intervals(spark, sf_dir):
    return versions.intervals(memory_log(spark, sf_dir))


def current_memories(spark, sf_dir):
    return versions.current(memory_log(spark, sf_dir)).select("id", "project", "content", "created_at", "updated_at", "forgotten")


def asof_content(spark, sf_dir):
    return versions.snapshot(*_state(spark, sf_dir), NAIVE).select("id", "project", "content")


def query_at(spark, sf_dir):
    return retrieval.query_at(*_state(spark, sf_dir), QUERY, MOMENT, k=K)


def query_at_project(spark, sf_dir):
    return retrieval.query_at(*_state(spark, sf_dir), QUERY, MOMENT, project="p2", k=K)


def answer_at(spark, sf_dir):
    """Answers for a good moment, one that is none, and a blank query."""
    state = _state(spark, sf_dir)
    out = [retrieval.answer_at(*state, query, when, k=K) for query, when in ((QUERY, MOMENT), (QUERY, "not_a_date"), (" ", MOMENT))]
    return out[0].unionByName(out[1]).unionByName(out[2])


_LOG = """ops AS (
  SELECT CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN 'create' ELSE 'update' END AS op, conv_id AS id, 'p' || (conv_id % 5) AS project, text AS content, TIMESTAMP '2024-01-01' + to_minutes(conv_id + 60 * turn) AS ts
  FROM conversations
), ends AS (
  SELECT conv_id AS id, 'p' || (conv_id % 5) AS project, TIMESTAMP '2024-01-01' + to_minutes(conv_id + 60 * max(turn) + 30) AS ts FROM conversations WHERE conv_id % 10 = 0 GROUP BY conv_id
), intervals AS (
  SELECT id AS memory_id, project, content, ts AS valid_from, lead(ts) OVER (PARTITION BY id ORDER BY ts) AS valid_to FROM ops
)"""
#: The answer straight from the log: the last content written by the moment, of memories not forgotten by it.
_PAST = f"""past AS (
  SELECT memory_id AS id, project, content, valid_from AS created_at FROM intervals
  WHERE valid_from <= TIMESTAMP '{NAIVE}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{NAIVE}') AND memory_id NOT IN (SELECT id FROM ends WHERE ts <= TIMESTAMP '{NAIVE}')
)"""
QUERIES = {"version_intervals": version_intervals, "current_memories": current_memories, "asof_content": asof_content, "query_at": query_at, "query_at_project": query_at_project, "answer_at": answer_at}
SQL = {
    "version_intervals": f"WITH {_LOG} SELECT memory_id, content, valid_from, valid_to FROM intervals",
    "current_memories": f"""WITH {_LOG}, x AS (SELECT id, project, arg_max(content, ts) AS content, min(ts) AS created_at, max(ts) AS last FROM ops GROUP BY id, project)
      SELECT x.id, x.project, x.content, x.created_at, coalesce(e.ts, x.last) AS updated_at, e.id IS NOT NULL AS forgotten FROM x LEFT JOIN ends e ON e.id = x.id""",
    "answer_at": f"""WITH {_LOG}, {_PAST}, {ranking_sql('past', 'past', K, query=QUERY)}, answer AS ({answer_sql('past')})
      SELECT '{MOMENT}' AS as_of, count(*) AS count, (40 + coalesce(sum(token_estimate), 0))::BIGINT AS total_tokens, NULL::VARCHAR AS error FROM answer
      UNION ALL SELECT 'not_a_date', 0, 0, 'Invalid ISO 8601 timestamp: ' || chr(39) || 'not_a_date' || chr(39) UNION ALL SELECT '{MOMENT}', 0, 0, NULL""",
    "asof_content": f"WITH {_LOG}, {_PAST} SELECT id, project, content FROM past",
    "query_at": f"WITH {_LOG}, {_PAST}, {ranking_sql('past', 'past', K, query=QUERY)} {answer_sql('past')}",
    "query_at_project": f"WITH {_LOG}, {_PAST}, local AS (SELECT * FROM past WHERE project = 'p2'), {ranking_sql('local', 'local', K, query=QUERY)} {answer_sql('local')}",
}
