"""Assignments against an exact search, fits and confidence against plain rules."""

import random
from functools import cache

import pandas as pd
import pytest

from palimpsest.operators import assignment

TASK, PERSON = "project string, id int, skills array<string>, high boolean", "project string, id int, skills array<string>, capacity int"


def share(task, person):
    asked, has = ({s for s in x if s is not None} for x in (task[2] or (), person[2] or ()))
    fit = 1.0 if not asked else len(asked & has) / len(asked)
    return fit if (task[0] or "") == (person[0] or "") and fit >= 0.5 else None


def best(tasks, people):
    """The largest sum of fits, by trying everybody for each task in turn."""
    room = tuple(1 if p[3] is None else max(p[3], 0) for p in people)

    @cache
    def go(i, room, busy):
        if i == len(tasks):
            return 0.0
        t, out = tasks[i], go(i + 1, room, busy)
        for j, p in enumerate(people):
            fit = share(t, p)
            if fit is not None and room[j] and not (t[3] and j in busy):
                out = max(out, fit + go(i + 1, room[:j] + (room[j] - 1,) + room[j + 1 :], busy | {j} if t[3] else busy))
        return out

    return go(0, room, frozenset())


def check(spark, tasks, people, step, **how):
    got = assignment.assigned(spark.createDataFrame(tasks, TASK), spark.createDataFrame(people, PERSON), step, **how).collect()
    assert sorted(r.id for r in got) == [t[1] for t in tasks]
    task, person, used, busy = {t[1]: t for t in tasks}, {p[1]: p for p in people}, {}, set()
    for r in got:
        assert (r.assignee is None) == (r.fit is None)
        if r.assignee is not None:
            assert r.fit == pytest.approx(share(task[r.id], person[r.assignee]), abs=1e-6)
            used[r.assignee] = used.get(r.assignee, 0) + 1
            assert not (task[r.id][3] and r.assignee in busy)
            busy |= {r.assignee} if task[r.id][3] else set()
    assert all(n <= (1 if person[p][3] is None else person[p][3]) for p, n in used.items())
    total = sum(r.fit or 0 for r in got)
    assert best(tasks, people) - len(tasks) * (step + 2e-6) <= total <= best(tasks, people) + 1e-5
    return got


@pytest.mark.parametrize(("seed", "step", "links"), [(0, 0.05, 0), (1, 0.1, 0), (1, 0.1, 10_000), (2, 0.01, 10_000)])
def test_total_is_the_best_but_for_a_step_a_task(spark, seed, step, links):
    """In rounds of the cluster (no project's links fit a task) and with each project in a task."""
    rng = random.Random(seed)
    some = lambda n: rng.sample("abcdef", rng.randint(0 if n else 1, 4))
    tasks = [("p", i, some(1), rng.random() < 0.4) for i in range(9)]
    people = [("p", i, some(0), rng.randint(1, 2)) for i in range(4)]
    check(spark, tasks, people, step, task_links=links)


def test_markets_without_spark():
    """Many small markets settled class by class: no seat twice, and the best total but for a step a task."""
    rng = random.Random(7)
    for _ in range(150):
        supply = {f"s{j}": rng.randint(1, 3) for j in range(rng.randint(1, 4))}
        links = [(f"c{i}", n, s, rng.randint(50, 100) * 10_000, supply[s]) for i in range(rng.randint(1, 5)) for n in [rng.randint(1, 3)] for s in supply if rng.random() < 0.7]
        if not links:
            continue
        frame = pd.DataFrame(links, columns=["class", "n", "slot", "fit", "supply"])
        got = assignment._market(frame, 20_000)
        fit, asks = {(c, s): f for c, _, s, f, _ in links}, {c: n for c, n, *_ in links}
        assert all(got[got["slot"] == s]["n"].sum() <= k for s, k in supply.items())
        assert all(got[got["class"] == c]["n"].sum() <= n for c, n in asks.items())
        total = sum(fit[c, s] * n for c, s, n in zip(got["class"], got["slot"], got["n"], strict=True))
        one = [c for c, n in asks.items() for _ in range(n)]
        places = tuple(supply)

        @cache
        def go(i, room, one=tuple(one), places=places, fit=fit):
            if i == len(one):
                return 0
            return max([go(i + 1, room)] + [fit[one[i], s] + go(i + 1, room[:j] + (room[j] - 1,) + room[j + 1 :]) for j, s in enumerate(places) if room[j] and (one[i], s) in fit])

        most = go(0, tuple(supply.values()))
        assert most - 20_000 * len(one) <= total <= most


def test_many_equal_tasks_and_other_projects(spark):
    """Equal tasks share what seats there are; nobody of another project helps; nulls have a defined result."""
    tasks = [("p", i, ["a", "b"], False) for i in range(6)] + [("p", 6, ["a", "b", None, "a"], None), ("q", 7, ["a"], True), (None, 8, None, True), (None, 9, ["x"], None), ("p", 10, ["a"], True), ("p", 11, ["a"], True), ("p", 12, ["a"], True)]
    people = [("p", 0, ["a", "b"], 3), ("p", 1, ["b"], 2), ("p", 2, ["a", None], None), ("p", 3, ["z"], 9), ("p", 4, ["a", "b"], 0), (None, 5, None, 1)]
    got = {r.id: r.assignee for r in check(spark, tasks, people, 0.05)}
    assert got[7] is None and got[8] == 5 and got[9] is None
    assert assignment.assigned(spark.createDataFrame([], TASK), spark.createDataFrame(people, PERSON)).count() == 0
    alone = assignment.assigned(spark.createDataFrame(tasks, TASK), spark.createDataFrame([], PERSON)).collect()
    assert {r.assignee for r in alone} == {None} and len(alone) == len(tasks)


def test_hot_class_spans_chunks(spark):
    """A thousand equal tasks: as many seats as there are go, the best ones for those who have all of the skills."""
    tasks = [("p", i, ["a", "b"], False) for i in range(1000)] + [("p", 1000 + i, ["b", "c"], False) for i in range(300)]
    people = [("p", i, ["a", "b"], 7) for i in range(90)] + [("p", 100 + i, ["b"], 5) for i in range(100)]
    got = assignment.assigned(spark.createDataFrame(tasks, TASK), spark.createDataFrame(people, PERSON)).collect()
    assert len({r.id for r in got}) == len(got) == 1300
    taken = [r for r in got if r.assignee is not None]
    assert len(taken) == 90 * 7 + 100 * 5
    assert sum(r.fit for r in taken) >= 630 * 1.0 + 500 * 0.5 - 1300 * 0.05
    used = {}
    for r in taken:
        used[r.assignee] = used.get(r.assignee, 0) + 1
    assert all(n == (7 if p < 100 else 5) for p, n in used.items())


def test_confidence(spark):
    rows = spark.createDataFrame([(0.8, None, None), (0.8, 0.5, None), (0.8, 0.5, 0.9), (0.5, 0.0, 0.0)], "now double, last double, before double")
    from pyspark.sql import functions as F

    got = [r[0] for r in rows.select(assignment.confidence(F.col("now"), F.col("last"), F.col("before"))).collect()]
    cosine = (0.9 * 0.5 + 0.5 * 0.8) / ((0.9**2 + 0.5**2) ** 0.5 * (0.5**2 + 0.8**2) ** 0.5)
    assert got[:3] == pytest.approx([0.4 + 0.2, 0.4 + 0.09 + 0.2, 0.4 + 0.09 + 0.2 * cosine])
    assert got[3] is None
