"""Task order over ``orders``: a project is a customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commands, eventlog, schedule
from ..sources.adapters import table, task_events, tasks


def _constraints(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("node_id"), F.when(F.col("o_orderkey") % 3 == 0, "temporal").otherwise("dependency").alias("constraint_type"),
        F.array((F.col("o_orderkey") % 100).cast("string")).alias("depends_on"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
    )


def merged_constraints(spark, sf_dir):
    merged = schedule.merged_constraints(commands.add_constraints(_constraints(spark, sf_dir))[1])
    return merged.select("node_id", F.array_join("depends_on", ",").alias("depends_on"), "priority")


def constraint_command(spark, sf_dir):
    return commands.add_constraints(_constraints(spark, sf_dir))[0].select("constraint_id", "enforced", F.col("warning").isNotNull().alias("warned"))


def constrained_tasks(spark, sf_dir):
    """Customers as tasks without a priority of their own, every second one, with the constraints on them."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.lit(1)).alias("priority"), F.array().cast("array<string>").alias("depends_on"))
    merged = schedule.merged_constraints(commands.add_constraints(_constraints(spark, sf_dir))[1])
    return schedule.with_constraints(people, merged).select("id", "priority", F.size("depends_on").cast("long").alias("n_depends"))


def ready_tasks(spark, sf_dir):
    return schedule.ready_now(tasks(spark, sf_dir))


def suggest_order(spark, sf_dir):
    return schedule.order(tasks(spark, sf_dir)).select("project", F.col("position").cast("long").alias("position"), "id", "cycle")


def event_order(spark, sf_dir):
    """The order of the tasks of all projects, from their events."""
    return schedule.order(eventlog.tasks(task_events(spark, sf_dir))).select("project", F.col("position").cast("long").alias("position"), "id", "cycle")


def cycle_tasks(spark, sf_dir):
    return schedule.order(tasks(spark, sf_dir)).filter("cycle").select("project", "id")


def suggest_next(spark, sf_dir):
    return schedule.suggest(tasks(spark, sf_dir)).withColumn("suggested_order", F.array_join("suggested_order", ","))


_TASKS = """t AS (
  SELECT *, CASE WHEN seq // 2 > 0 THEN list(id) OVER (PARTITION BY project ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)[seq // 2]
    WHEN project % 7 = 0 AND seq = 1 AND last <> id THEN last END AS dep
  FROM (SELECT o_custkey AS project, o_orderkey AS id, left(o_orderpriority, 1)::INT AS priority, strftime(o_orderdate, '%Y-%m-%d') AS due, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders)
)"""
_ORDER = f"""{_TASKS}, step AS (
  SELECT DISTINCT project, []::BIGINT[] AS done FROM t
  UNION ALL
  SELECT s.project, list_append(s.done, arg_min(t.id, (t.priority, t.due, coalesce(list_position(s.done, t.dep), 0), t.seq))) AS done
  FROM step s JOIN t ON t.project = s.project WHERE NOT list_contains(s.done, t.id) AND (t.dep IS NULL OR list_contains(s.done, t.dep)) GROUP BY s.project, s.done
), final AS (SELECT project, arg_max(done, len(done)) AS done FROM step GROUP BY project),
placed AS (
  SELECT t.project, CASE WHEN list_contains(f.done, t.id) THEN list_position(f.done, t.id)
    ELSE len(f.done) + row_number() OVER (PARTITION BY t.project, list_contains(f.done, t.id) ORDER BY t.seq) END AS position, t.id, NOT list_contains(f.done, t.id) AS cycle
  FROM t JOIN final f ON f.project = t.project
)"""
QUERIES = {
    "merged_constraints": merged_constraints, "constraint_command": constraint_command, "constrained_tasks": constrained_tasks, "ready_tasks": ready_tasks, "suggest_order": suggest_order, "cycle_tasks": cycle_tasks, "suggest_next": suggest_next, "event_order": event_order,
}
SQL = {
    "merged_constraints": """SELECT o_custkey AS node_id, string_agg((o_orderkey % 100)::VARCHAR, ',' ORDER BY o_orderkey) AS depends_on, least(99, min(left(o_orderpriority, 1)::INT)) AS priority
      FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1""",
    "constraint_command": "SELECT o_orderkey AS constraint_id, o_orderkey % 3 <> 0 AS enforced, o_orderkey % 3 = 0 AS warned FROM orders",
    "constrained_tasks": """WITH m AS (SELECT o_custkey AS id, count(*) AS n, min(left(o_orderpriority, 1)::INT) AS p FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1)
      SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE m.p END AS priority, coalesce(m.n, 0) AS n_depends FROM customer c LEFT JOIN m ON m.id = c.c_custkey""",
    "ready_tasks": f"WITH {_TASKS} SELECT project, count(*) AS total_tasks, count(*) FILTER (dep IS NULL) AS ready_now FROM t GROUP BY project",
    "suggest_order": f"WITH RECURSIVE {_ORDER} SELECT project, position, id, cycle FROM placed",
    "event_order": f"WITH RECURSIVE {_ORDER.replace('FROM orders)', 'FROM orders WHERE o_orderkey % 13 <> 0)')} SELECT 'c' || project AS project, position, 'node:c' || project || ':o' || id AS id, cycle FROM placed",
    "cycle_tasks": f"WITH RECURSIVE {_ORDER} SELECT project, id FROM placed WHERE cycle",
    "suggest_next": f"""WITH RECURSIVE {_ORDER} SELECT p.project, string_agg(p.id::VARCHAR, ',' ORDER BY p.position) FILTER (p.position <= 5) AS suggested_order, count(*) AS total_tasks, count(*) FILTER (t.dep IS NULL) AS ready_now
      FROM placed p JOIN t ON t.project = p.project AND t.id = p.id GROUP BY p.project""",
}
