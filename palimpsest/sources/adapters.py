"""The star-schema and corpus tables as inputs of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE = "2024-01-01 00:00:00"
#: event_type of the stream -> event type of the log.
EVENT_KINDS = {"signup": "node_created", "view": "node_updated", "error": "node_deleted", "purchase": "node_restored", "click": "relation_added"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _after(minutes: Column) -> Column:
    return F.lit(BASE).cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(1)) * minutes


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as memories; those labelled toxic are forgotten a day after their creation."""
    labels = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("toxic"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    made = _after(F.col("doc_id"))
    gone = F.coalesce("toxic", F.lit(False))
    return docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("project"), F.col("text").alias("content"), F.array("lang").alias("tags"), made.alias("created_at"),
        F.when(gone, made + F.make_dt_interval(days=F.lit(1))).otherwise(made).alias("updated_at"), gone.alias("forgotten"),
    )


def memory_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a log: the first turn creates a memory, each later one updates it, every tenth is forgotten in the end."""
    turns = table(spark, sf_dir, "conversations")
    when = _after(F.col("conv_id") + 60 * F.col("turn"))
    project = F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string"))
    tags = F.array("role")
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    ops = turns.join(first, "conv_id").select(
        F.when(F.col("turn") == F.col("first"), "create").otherwise("update").alias("op"), F.col("conv_id").alias("id"), project.alias("project"), F.col("text").alias("content"), tags.alias("tags"), when.alias("ts")
    )
    ends = first.filter(F.col("conv_id") % 10 == 0).select(
        F.lit("forget").alias("op"), F.col("conv_id").alias("id"), project.alias("project"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("array<string>").alias("tags"),
        _after(F.col("conv_id") + 60 * F.col("last") + 30).alias("ts"),
    )
    return ops.unionByName(ends)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in EVENT_KINDS.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("node:p"), (F.col("user_id") % 10).cast("string"), F.lit(":u"), F.col("user_id").cast("string")).alias("aggregate_id"),
        F.coalesce(F.try_element_at(kind, F.col("event_type")), "event_type").alias("event_type"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("props").alias("payload"),
    )


def parts_as_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and the four structural attributes of a node."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_size") % 10).alias("priority"), F.size(F.split("p_name", " ")).alias("n_tags"), F.col("p_brand").alias("author"), F.col("p_size").alias("complexity")
    )


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return parts.unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")))


def graph_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, source, target): every line not returned added, every line returned removed."""
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("N", "R"))
    return lines.select(
        F.when(F.col("l_returnflag") == "N", "relation_added").otherwise("relation_removed").alias("event_type"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"),
    )


def tasks(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """orders (all, or those given) as tasks: within a customer the n-th depends on the (n / 2)-th; where the customer's number is a multiple of 7, the first on the last as well."""
    place = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    every = Window.partitionBy("o_custkey")
    half = F.floor(F.col("seq") / 2).cast("int")
    t = (table(spark, sf_dir, "orders") if orders is None else orders).select(
        F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("due_date"),
        F.row_number().over(place).alias("seq"), F.max("o_orderkey").over(every).alias("last"),
    )
    earlier = t.select("project", F.col("seq").alias("half"), F.col("id").alias("dep"))
    t = t.withColumn("half", half).join(earlier, ["project", "half"], "left")
    cyclic = (F.col("project") % 7 == 0) & (F.col("seq") == 1) & (F.col("last") != F.col("id"))
    deps = F.when(F.col("half") > 0, F.array("dep")).when(cyclic, F.array("last")).otherwise(F.array().cast("array<bigint>"))
    return t.select("project", "id", "priority", "due_date", "seq", deps.alias("depends_on"))


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event log of the tasks: each order creates a node, and every thirteenth is deleted a day later; the others are tasks among themselves."""
    orders = table(spark, sf_dir, "orders")
    gone = F.col("o_orderkey") % 13 == 0
    name = lambda project, id_: F.concat(F.lit("node:c"), project.cast("string"), F.lit(":o"), id_.cast("string"))
    kept = tasks(spark, sf_dir, orders.filter(~gone)).select("project", "id", "priority", "due_date", F.transform("depends_on", lambda d: name(F.col("project"), d)).alias("depends_on"))
    lost = orders.filter(gone).select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"), F.lit(1).alias("priority"), F.lit(None).cast("string").alias("due_date"), F.array().cast("array<string>").alias("depends_on"))
    payload = F.to_json(F.struct(F.concat(F.lit("c"), F.col("project").cast("string")).alias("project_id"), "priority", "due_date", "depends_on"))
    event = lambda rows, kind, days: rows.select(F.lit(kind).alias("event_type"), F.concat(F.lit(f"{kind}-"), F.col("id").cast("string")).alias("id"), name(F.col("project"), F.col("id")).alias("aggregate_id"), (_after(F.col("id")) + F.make_dt_interval(days=F.lit(days))).alias("ts"), payload.alias("payload"))
    return event(kept, "node_created", 0).unionByName(event(lost, "node_created", 0)).unionByName(event(lost, "node_deleted", 1))


def suppliers_as_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, id, treated, confounder, outcome) for matching."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("seq"), F.col("s_suppkey").alias("id"), (F.col("s_nationkey") < 8).alias("treated"), (F.col("s_suppkey") * 37 % 101).cast("double").alias("confounder"), F.col("s_acctbal").alias("outcome")
    )


def click_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clicks as an event log: a client is an aggregate, repeated rows count once, clicks without a client go."""
    kind = F.create_map(*[F.lit(x) for pair in EVENT_KINDS.items() for x in pair])
    rows = table(spark, sf_dir, "clicks").filter("client_id IS NOT NULL").select("click_id", "client_id", "kind", "ts", "props").distinct()
    return rows.select(
        F.col("click_id").cast("string").alias("id"), F.concat(F.lit("node:shop:c"), F.col("client_id").cast("string")).alias("aggregate_id"), F.try_element_at(kind, F.col("kind")).alias("event_type"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("props").alias("payload")
    )


def _events(rows: DataFrame, kind: str, node: Column, days: int, payload: Column) -> DataFrame:
    return rows.select(F.concat(F.lit(f"{kind}-"), node).alias("id"), node.alias("aggregate_id"), F.lit(kind).alias("event_type"), _after(F.lit(days * 1440)).alias("ts"), payload.alias("payload"))


def graph_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part-supplier graph as a log: every fifth part is of another project, every seventh supplier is deleted, every line adds or removes a relation."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    p, s = F.concat(F.lit("node:part:"), F.col("p_partkey").cast("string")), F.concat(F.lit("node:supplier:"), F.col("s_suppkey").cast("string"))
    of = lambda project: F.to_json(F.struct(project.alias("project_id")))
    lines = graph_relations(spark, sf_dir)
    end = lambda c, name: F.concat(F.lit(f"node:{name}:"), F.substring(c, 2, 20))
    relation = lines.select(F.lit(None).cast("string").alias("id"), end("source", "part").alias("aggregate_id"), "event_type", _after(F.lit(2880)).alias("ts"), F.to_json(F.struct(end("source", "part").alias("source"), end("target", "supplier").alias("target"))).alias("payload"))
    made = _events(part, "node_created", p, 0, of(F.when(F.col("p_partkey") % 5 == 0, "other").otherwise("shop"))).unionByName(_events(supplier, "node_created", s, 0, of(F.lit("shop"))))
    return made.unionByName(_events(supplier.filter("s_suppkey % 7 = 0"), "node_deleted", s, 1, F.lit('{"reason": "gone"}'))).unionByName(relation)


def customer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a log of nodes with a team, a size and a score; every eleventh is deleted."""
    rows = table(spark, sf_dir, "customer")
    node = F.concat(F.lit("node:shop:c"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    payload = F.to_json(F.struct(F.col("c_mktsegment").alias("team"), F.col("c_acctbal").alias("size"), (F.col("c_custkey") % 97).alias("score")))
    return _events(rows, "node_created", node, 0, payload).unionByName(_events(rows.filter("c_custkey % 11 = 0"), "node_deleted", node, 1, F.lit('{"reason": "left"}')))
