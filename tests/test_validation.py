"""Scores, nearest controls, bootstrap, rules in order and names, against plain versions."""

import hashlib
import hmac
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions.hashing import anonymised, hmac256, is_anonymised
from palimpsest.operators import graph, ordered, propensity
from palimpsest.streaming import admission
from palimpsest.streaming import events as streams


def test_scores_equal_plain_regression(spark):
    rng = np.random.default_rng(1)
    n = 400
    x = np.c_[rng.normal(3, 2, n), rng.exponential(5, n), np.full(n, 7.0)]
    y = rng.random(n) < 1 / (1 + np.exp(-(0.8 * (x[:, 0] - 3) - 0.1 * x[:, 1])))
    rows = spark.createDataFrame([(i, bool(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x, strict=True))], "seq long, treated boolean, a double, b double, c double")
    model = propensity.fit(rows, ("a", "b", "c"))
    z = np.c_[(x - x.mean(0)) / np.where(x.std(0) < 1e-12, 1, x.std(0)), np.ones(n)]
    weight = np.where(y, n / (2 * y.sum()), n / (2 * (~y).sum()))
    w, ridge = np.zeros(4), np.diag([1.0, 1, 1, 0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ w)
    assert np.abs(model.weights - w).max() < 1e-6 and model.weights[2] == 0
    got = np.array([r.propensity for r in propensity.scored(rows, model).orderBy("seq").collect()])
    assert np.abs(got - 1 / (1 + np.exp(-z @ w))).max() < 1e-6
    with pytest.raises(ValueError):
        propensity.fit(rows.filter("treated"), ("a",))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_equals_a_full_scan(spark, seed):
    rng = random.Random(seed)
    draw = (lambda: rng.gauss(0, 1)) if seed < 3 else (lambda: rng.randrange(6) / 2)
    rows = [(i, rng.random() < 0.4, None if rng.random() < 0.03 else draw()) for i in range(500)]
    df = spark.createDataFrame(rows, "seq long, treated boolean, logit double").repartition(5)
    want = {t: min((abs(x - c), k) for k, side, c in rows if not side and c is not None) for t, treated, x in rows if treated and x is not None}
    assert {r.seq: (r.distance, r.control) for r in propensity.nearest(df).collect()} == want
    values = np.array([x for _, _, x in rows if x is not None])
    keep = {}
    for t, (d, k) in sorted(want.items()):
        if d <= 0.2 * values.std() and k not in keep:
            keep[k] = t
    assert {r.control: r.seq for r in propensity.matched(df).collect()} == keep


def test_nearest_without_a_side(spark):
    df = spark.createDataFrame([(1, True, 0.5)], "seq long, treated boolean, logit double")
    assert propensity.nearest(df).collect() == [] and propensity.nearest(df.limit(0)).collect() == []


def test_nearest_sums_no_window_anew_for_every_row(spark):
    df = spark.range(40).select(F.col("id").alias("seq"), (F.col("id") % 2 == 0).alias("treated"), F.col("id").cast("double").alias("logit"))
    assert "unboundedfollowing" not in propensity.nearest(df)._jdf.queryExecution().analyzed().toString().lower()


def test_bootstrap_agrees_over_partitions(spark):
    df = spark.range(3000).select(F.col("id").alias("seq"), (F.col("id") % 10).cast("double").alias("effect"))
    a, b = (propensity.replicates(df.repartition(k)).first() for k in (1, 7))
    assert all(abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True)) and len(set(a)) == 5 and all(abs(x - 4.5) < 0.3 for x in a)
    drawn = spark.range(20000).select(propensity.poisson((F.col("id") + 0.5) / 20000).alias("k")).agg(F.avg("k"), F.var_pop("k")).first()
    assert abs(drawn[0] - 1) < 0.01 and abs(drawn[1] - 1) < 0.02


def test_validation_tells_a_sound_effect(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1200):
        x = rng.gauss(0, 1)
        t = bool(rng.random() < 1 / (1 + np.exp(-0.3 * x)))
        rows.append((i, t, x, 5.0 * t + x + rng.gauss(0, 0.5)))
    df = spark.createDataFrame(rows, "seq long, treated boolean, x double, outcome double")
    found = propensity.validated(df, ("x",)).first()
    assert found.status == "counterfactual_validated" and abs(found.ate - 5) < 0.2 and found.max_smd < 0.1 and found.stable
    flat = propensity.validated(df.withColumn("outcome", F.lit(0.0)), ("x",)).first()
    assert (flat.status, flat.stable) == ("observational", False)


def events(seed, n=300):
    rng = random.Random(seed)
    base = datetime(2024, 1, 1)
    return [(f"k{rng.randrange(6)}", "node:a:b", rng.choice(["node_created", "node_updated"]), base + timedelta(minutes=7 * i), "{}") for i in range(n)]


def loop(rows):
    held, out = {}, []
    for key, _, kind, ts, _ in rows:
        if key not in held or ts - held[key][0] >= timedelta(hours=24):
            held[key] = (ts, kind)
            out.append((key, ts, "accepted"))
        else:
            out.append((key, ts, "duplicate" if held[key][1] == kind else "conflict"))
    return sorted(out)


KEYED = "id string, aggregate_id string, event_type string, ts timestamp_ntz, payload string"


def test_admission_equals_a_loop(spark):
    rows = events(1)
    got = ordered.admitted_within(spark.createDataFrame([*rows, (None, "a", "b", rows[0][3], "c")], KEYED))
    assert sorted((r.id, r.ts, r.status) for r in got.collect()) == loop(rows)
    assert sum(s == "accepted" for _, _, s in loop(rows)) > 6


def test_admission_as_a_stream_over_restarts(spark, tmp_path):
    """Two starts on one checkpoint give what one batch does; ids of a day ago are forgotten by their timers."""
    rows = events(2)
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    for part in (rows[:100], rows[100:180], rows[180:]):
        df = spark.createDataFrame(part, KEYED).withColumn("ts", F.col("ts").cast("timestamp"))
        df.write.mode("append").parquet(source)
        streams.fold(admission.admitted(streams.read(spark, source, df.schema)), target, marks)
    got = spark.read.parquet(f"{target}/*").select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), "status").collect()
    assert sorted((r.id, r.ts, r.status) for r in got) == loop(rows)


def test_reembedding_equals_a_loop(spark):
    rng = random.Random(3)
    base = datetime(2024, 1, 1)
    rows = [(f"n{i % 4}", base + timedelta(minutes=20 * i), rng.choice([0.1, 0.16, 0.2, 0.24, 0.3, None])) for i in range(400)]
    want, state = [], {}
    for node, ts, x in rows:
        past, last = state.setdefault(node, ([], None))
        past.append(x)
        fires = x is not None and x > 0.25 or len(past) >= 3 and all(v is not None and v > 0.15 for v in past[-3:]) and (last is None or ts - last > timedelta(hours=6))
        if fires:
            state[node] = (past, ts)
        want.append((node, ts, bool(fires)))
    got = ordered.reembedding(spark.createDataFrame(rows, "node_id string, ts timestamp_ntz, loss double"))
    assert sorted((r.node_id, r.ts, r.reembed) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("n", [5, 43, 230])
def test_held_out_edges(spark, n):
    edges = spark.createDataFrame([(f"a{i % 7}", f"b{i}") for i in range(n)], "source string, target string")
    found = graph.held_out(edges.unionByName(edges)).collect()
    sizes = [sum(r.stratum == k for r in found) for k in (1, 2, 3, 4)]
    assert len(found) == n and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    assert [sum(r.validation for r in found if r.stratum == k) for k in (1, 2, 3, 4)] == [max(1, int(s * (0.2 if n < 50 else 0.1))) for s in sizes]


@pytest.mark.parametrize("key", ["", "k", "x" * 63, "x" * 64, "x" * 65, "é" * 200])
def test_hmac_equals_the_standard_library(spark, key):
    names = ["", "alice", "Zoë 漢字", "n" * 300, None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    want = [None if n is None else hmac.new(key.encode(), n.encode(), hashlib.sha256).hexdigest() for n in names]
    assert [r[0] for r in df.select(hmac256(F.col("name"), key)).collect()] == want
    row = spark.range(1).select(anonymised(F.lit("bob"), key, "k7").alias("a")).select("a", is_anonymised(F.col("a"), F.lit("bob"), {"k7": key}), is_anonymised(F.col("a"), F.lit("eve"), {"k7": key}), is_anonymised(F.col("a"), F.lit("bob"), {"k8": key})).first()
    assert row[0] == f"anon:{hmac.new(key.encode(), b'bob', hashlib.sha256).hexdigest()[:32]}:k7" and tuple(row)[1:] == (True, False, False)


def test_vector_store(spark, tmp_path):
    from palimpsest.sources.vectors import VectorStore

    store = VectorStore(spark, str(tmp_path / "v"))
    assert store.load(4).collect() == []
    kind = "id string, vector array<float>, project string"
    store.put(spark.createDataFrame([(f"m{i}", [float(i), 1.0], "p") for i in range(60)], kind))
    store.put(spark.createDataFrame([("m1", [9.0], "q"), ("new", [0.5] * 40, None)], kind))
    store.take_out(spark.createDataFrame([("m2",), ("unknown",)], "id string"))
    held = {r.id: (r.vector, r.project) for r in store.load().collect()}
    assert len(held) == 60 and held["m1"] == ([9.0], "q") and "m2" not in held
    assert {r.id: r.vector for r in store.load(3).collect()}["m1"] == [9.0, 0.0, 0.0]
    assert store.resize(16) == 24 and len(store.batches()) == 1
    again = {r.id: r.vector for r in store.load().collect()}
    assert {len(v) for v in again.values()} == {24} and again["new"] == [0.5] * 24 and again["m3"][:3] == [3.0, 1.0, 0.0]
    assert store.resize(24) == 24


def test_report_names_every_isolated_node(spark):
    nodes = spark.range(1500).select(F.concat(F.lit("n"), F.col("id")).alias("id"))
    edges = spark.createDataFrame([("n0", "n1")], "source string, target string")
    rows = graph.report(edges, nodes).collect()
    assert sum(r.name == "isolated_node" for r in rows) == 1498
    assert {r.name: r.value for r in rows if r.name in ("total_nodes", "connected_components")} == {"total_nodes": "1500", "connected_components": "1499"}
