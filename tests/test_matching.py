"""Matching over ranges of scores equals matching one by one."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import causal


def check(spark, rows, range_rows):
    """rows: (treated, score) in order."""
    df = spark.createDataFrame([(i, f"n{i}", t, float(s), float(i)) for i, (t, s) in enumerate(rows)], "seq long, id string, treated boolean, score double, outcome double")
    sides = [[(float(s), i) for i, (t, s) in enumerate(rows) if t == side] for side in (True, False)]
    want = sorted((f"n{t}", f"n{c}", float(t), float(c)) for t, c in causal.greedy(*sides))
    assert sorted(map(tuple, causal.match(df, range_rows=range_rows).collect())) == want
    return want


def brute(treatment, control, caliper=causal.CALIPER):
    used, pairs = set(), []
    for s, t in treatment:
        near = min(((abs(s - c), i) for c, i in control if i not in used and abs(s - c) < caliper), default=None)
        if near:
            used.add(near[1])
            pairs.append((t, near[1]))
    return pairs


@pytest.mark.parametrize("seed", range(6))
def test_greedy_equals_a_plain_loop(seed):
    rng = random.Random(seed)
    draw = (lambda: rng.gauss(0, 1)) if seed % 2 else (lambda: rng.randrange(-4, 5) / 4)
    t, c = ([(draw(), i) for i in range(200)] for _ in range(2))
    assert causal.greedy(t, c) == brute(t, c)


@pytest.mark.parametrize(("share", "draw", "range_rows"), [(0.3, "gauss", 60), (0.7, "gauss", 40), (0.5, "grid", 50), (0.6, "ties", 30), (0.5, "gauss", 10_000)])
def test_match_equals_greedy(spark, share, draw, range_rows):
    rng = random.Random(draw)
    value = {"gauss": lambda: rng.gauss(0, 1), "grid": lambda: rng.randrange(-200, 200) / 100, "ties": lambda: rng.choice([-1.0, -0.5, -0.25, 0.0, 0.0, 0.0, 0.25, 0.5, 1.0])}[draw]
    assert check(spark, [(rng.random() < share, value()) for _ in range(600)], range_rows)


def test_match_displaces_over_many_ranges(spark):
    """Early treatments far from their controls push later ones on, range after range."""
    rows = [(True, k / 50) for k in range(60)] + [(False, 0.25 + k / 50) for k in range(40)] + [(True, 0.3)] * 20
    assert check(spark, rows, 12)


def test_match_odd(spark):
    assert check(spark, [], 10) == []
    assert check(spark, [(True, 0.0)] * 3, 1) == []
    assert check(spark, [(False, 0.0)] * 3, 1) == []
    assert check(spark, [(True, 0.0), (False, 0.5)], 1) == []  # the caliper is strict
    assert len(check(spark, [(True, 0.0), (False, 0.4999), (False, -0.4999)] * 5, 1)) == 5


def test_unmatched_analysis_has_an_error_row(spark):
    rows = [(i, i, i < 3, 0.0 if i < 3 else 1e6 * i, 1.0) for i in range(6)]
    nodes = spark.createDataFrame(rows, "seq long, id long, treated boolean, confounder double, outcome double")
    found = causal.analyze(nodes, "outcome", "size").first()
    assert (found.n, found.ate, found.status, found.error, found.interpretation) == (0, 0.0, "hypothesis", "no match within the caliper", None)
    few = causal.analyze(nodes.filter(F.col("seq") > 0), "outcome", "size").first()
    assert (few.error, few.treatment_n, few.control_n) == ("too few samples on one side", 2, 3)
