"""Sales as tasks for the vendors of the client's nation: skills are the kinds of items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import assignment
from ..sources.adapters import table

KINDS = 6


def _sales(spark, sf_dir):
    """(project, id, skills, high): a sale asks for the kinds of its items, that of first priority and 100 or more is high."""
    sales = table(spark, sf_dir, "sales").groupBy(F.col("sale_id").alias("id")).agg(F.min("client_id").alias("client_id"), F.coalesce((F.min("priority") == 1) & (F.max("total") >= 100), F.lit(False)).alias("high"))
    nation = table(spark, sf_dir, "clients").groupBy("client_id").agg(F.min("nation_id").alias("project"))
    kinds = _kinds(spark, sf_dir).groupBy(F.col("sale_id").alias("id")).agg(F.collect_set("kind").alias("skills"))
    return sales.join(nation, "client_id", "left").join(kinds, "id", "left").select("project", "id", "skills", "high")


def _kinds(spark, sf_dir):
    items = table(spark, sf_dir, "items").groupBy("item_id").agg(F.min("kind").alias("kind"))
    return table(spark, sf_dir, "sale_lines").select("sale_id", "item_id", "vendor_id").join(items, "item_id")


def _vendors(spark, sf_dir):
    """(project, id, skills, capacity): a vendor knows the kinds that are a sixth of their lines or more, and has a seat for every fourth line."""
    count = _kinds(spark, sf_dir).groupBy(F.col("vendor_id").alias("id"), "kind").agg(F.count("*").alias("n"))
    known = count.groupBy("id").agg(F.collect_list(F.struct("kind", "n")).alias("of"), F.sum("n").alias("all"))  # as many as there are kinds
    known = known.select("id", F.transform(F.filter("of", lambda x: x["n"] * KINDS >= F.col("all")), lambda x: x["kind"]).alias("skills"), (1 + F.floor(F.col("all") / 4)).alias("capacity"))
    return table(spark, sf_dir, "vendors").groupBy(F.col("vendor_id").alias("id")).agg(F.min("nation_id").alias("project")).join(known, "id", "left").select("project", "id", "skills", "capacity")


def skill_fits(spark, sf_dir):
    """How many vendors may take each sale, and how well the best of them fits."""
    return assignment.eligible(_sales(spark, sf_dir), _vendors(spark, sf_dir))


def assigned_sales(spark, sf_dir):
    """The vendor that each sale goes to, and how well they fit."""
    return assignment.assigned(_sales(spark, sf_dir), _vendors(spark, sf_dir), step=0.05)


def resolution_confidence(spark, sf_dir):
    """The confidence in each month's resolution of a client's sales, whose score is the share that is done."""
    score = table(spark, sf_dir, "sales").filter("sold_at IS NOT NULL").groupBy("client_id", F.date_format("sold_at", "yyyy-MM").alias("month")).agg(F.avg(F.when(F.col("status") == "done", 1.0).otherwise(0.0)).alias("score"))
    order = Window.partitionBy("client_id").orderBy("month")  # a row a month
    score = score.withColumn("last", F.lag("score").over(order)).withColumn("before", F.lag("score", 2).over(order))
    return score.select("client_id", "month", F.round(assignment.confidence(F.col("score"), F.col("last"), F.col("before")), 9).alias("confidence"))


QUERIES = {"skill_fits": skill_fits, "assigned_sales": assigned_sales, "resolution_confidence": resolution_confidence}
SQL = {
    "skill_fits": f"""WITH k AS (SELECT sale_id, vendor_id, kind FROM sale_lines JOIN (SELECT item_id, min(kind) AS kind FROM items GROUP BY 1) i USING (item_id)),
      t AS (SELECT s.id, coalesce(c.nation::VARCHAR, '') AS project, coalesce(a.n, 0) AS n FROM (SELECT sale_id AS id, min(client_id) AS client_id FROM sales WHERE sale_id IS NOT NULL GROUP BY 1) s
        LEFT JOIN (SELECT client_id, min(nation_id) AS nation FROM clients GROUP BY 1) c USING (client_id) LEFT JOIN (SELECT sale_id AS id, count(DISTINCT kind) AS n FROM k GROUP BY 1) a USING (id)),
      p AS (SELECT vendor_id, coalesce(min(nation_id)::VARCHAR, '') AS project FROM vendors WHERE vendor_id IS NOT NULL GROUP BY 1),
      has AS (SELECT vendor_id, kind FROM (SELECT vendor_id, kind, count(*) AS c, sum(count(*)) OVER (PARTITION BY vendor_id) AS total FROM k GROUP BY 1, 2) WHERE c * {KINDS} >= total AND kind IS NOT NULL),
      m AS (SELECT t.id, h.vendor_id, count(*) AS s FROM (SELECT DISTINCT sale_id AS id, kind FROM k) a JOIN t USING (id) JOIN p ON p.project = t.project JOIN has h ON h.vendor_id = p.vendor_id AND h.kind = a.kind GROUP BY 1, 2),
      f AS (SELECT t.id, CASE WHEN t.n = 0 THEN 1 ELSE floor(coalesce(m.s, 0) * 1000000 / t.n) / 1000000.0 END AS fit FROM t JOIN p ON p.project = t.project LEFT JOIN m ON m.id = t.id AND m.vendor_id = p.vendor_id WHERE t.n = 0 OR m.s >= t.n * 0.5),
      g AS (SELECT id, count(*) AS eligible, max(fit)::DOUBLE AS best FROM f GROUP BY 1)
      SELECT project, id, coalesce(eligible, 0) AS eligible, best FROM t LEFT JOIN g USING (id)""",
    "resolution_confidence": """WITH s AS (SELECT client_id, strftime(sold_at, '%Y-%m') AS month, avg(CASE WHEN status = 'done' THEN 1.0 ELSE 0.0 END) AS x FROM sales WHERE sold_at IS NOT NULL GROUP BY 1, 2),
      l AS (SELECT *, lag(x) OVER w AS y, lag(x, 2) OVER w AS z FROM s WINDOW w AS (PARTITION BY client_id ORDER BY month)),
      n AS (SELECT *, sqrt(z * z + y * y) * sqrt(y * y + x * x) AS size FROM l)
      SELECT client_id, month, round(0.5::DOUBLE * x + 0.3::DOUBLE * coalesce(greatest(0, x - y), 0) + 0.2::DOUBLE * CASE WHEN z IS NULL OR y IS NULL THEN 1 WHEN size > 0 THEN (z * y + y * x) / size END, 9) AS confidence FROM n""",
}
