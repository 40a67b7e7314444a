"""Density clusters and the nerve against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import mapper


def brute(points, eps, least):
    """{name: cluster} of points (level, id, coordinates)."""
    name = lambda p: f"{p[0]:05d}:{p[1]}"
    near = {name(p): [name(q) for q in points if q[0] == p[0] and sum((a - b) * (a - b) for a, b in zip(p[2], q[2], strict=True)) <= eps * eps] for p in points}
    core = {n for n, m in near.items() if len(m) >= least}
    of = {n: n for n in core}
    changed = True
    while changed:
        changed = False
        for n in core:
            best = min(of[m] for m in near[n] if m in core)
            if best < of[n]:
                of[n], changed = best, True
    for n, m in near.items():
        if n not in core and any(x in core for x in m):
            of[n] = min(of[x] for x in m if x in core)
    return of


def check(spark, points, eps=0.5, least=5):
    dims = len(points[0][2])
    df = spark.createDataFrame([(lv, i, *map(float, x)) for lv, i, x in points], f"level int, id long, {', '.join(f'x{d} double' for d in range(dims))}")
    got = {f"{r.level:05d}:{r.id}": r.cluster for r in mapper.clusters(df, dims, eps, least).collect()}
    assert got == brute(points, eps, least)
    return got


@pytest.mark.parametrize(("seed", "dims", "n"), [(1, 2, 250), (2, 1, 200), (3, 3, 150)])
def test_clusters(spark, seed, dims, n):
    rng = random.Random(seed)
    centres = [[rng.uniform(-4, 4) for _ in range(dims)] for _ in range(6)]
    points = [(i % 2, i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)] if rng.random() < 0.8 else [rng.uniform(-5, 5) for _ in range(dims)]) for i in range(n)]
    assert len(set(check(spark, points).values())) > 1


def test_full_cells_that_just_touch_or_just_do_not(spark):
    """Two heaps, each in one cell, whose nearest points are at eps, or a bit beyond."""
    rng = random.Random(4)
    for far, n in ((0.5, 1), (0.5000001, 2)):
        left = [(0, i, [-rng.random() * 0.2, rng.random() * 0.01]) for i in range(60)] + [(0, 60, [0.0, 0.0])]
        right = [(0, 100 + i, [far + rng.random() * 0.2, rng.random() * 0.01]) for i in range(60)] + [(0, 160, [far, 0.0])]
        assert len(set(check(spark, left + right).values())) == n


def test_copies_of_one_place(spark):
    assert set(check(spark, [(0, i, [1.0, 1.0]) for i in range(300)] + [(0, 400 + i, [1.4, 1.0]) for i in range(3)] + [(0, 500, [9.0, 9.0])]).values()) == {"00000:0"}


def test_mapper_of_a_ring(spark):
    """A ring over four intervals is a cycle of clusters."""
    import math

    points = [(i, math.cos(i / 100 * math.pi), math.sin(i / 100 * math.pi)) for i in range(200)] + [(900, None, 0.0), (901, float("nan"), 0.0), (902, 0.0, None)]
    df = spark.createDataFrame(points, "id long, x0 double, x1 double")
    nodes, edges = mapper.mapper(df, F.col("x1"), mapper.cover(-1.0, 1.0, 4, 0.3), 2, eps=0.2)
    assert (nodes.count(), edges.count()) == (6, 6)
    assert all(r.weight > 0 and r.source[:5] < r.target[:5] for r in edges.collect())
    assert mapper.mapper(df.limit(0), F.col("x1"), [(0.0, 1.0)], 2)[0].collect() == []
