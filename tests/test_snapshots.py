"""Snapshots, states from them, and the log on disk, against a plain loop."""

import os
import random
from datetime import date, datetime, timedelta

import pytest

from palimpsest.operators import snapshots
from palimpsest.sources.log import EVENT, EventLog
from palimpsest.streaming import events as streams
from palimpsest.streaming import snapshots as stream_of

KINDS = ["node_created", "node_updated", "node_updated", "node_deleted", "node_deleted", "node_restored", "relation_added", None]


def made(seed, n=700):
    rng = random.Random(seed)
    who = ["node:p:hot"] * 5 + [f"node:p:{k}" for k in range(6)] + [None]
    base = datetime(2024, 1, 1)
    return [(f"e{i:05d}", rng.choice(who), rng.choice(KINDS), None if rng.random() < 0.02 else base + timedelta(hours=rng.randrange(2000)), None if rng.random() < 0.1 else f"p{i}") for i in range(n)]


def loop(rows):
    """{aggregate: [(number, version, payload, deleted_at, deleted_by), ...]}"""
    out = {}
    for i, who, kind, ts, payload in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[3] is not None, r[3] or 0, r[0]) if r[3] else (False, datetime.min, r[0])):
        n, version, said, at, by = out[who][-1] if who in out else (0, 0, None, None, None)
        if kind in snapshots.WRITES:
            version, said = version + 1, payload
        elif kind == "node_restored":
            at = by = None
        elif kind == "node_deleted" and by is None:
            at, by = ts, i
        out.setdefault(who, []).append((n + 1, version, said, at, by))
    return out


@pytest.mark.parametrize("every", [1, 7, 100])
def test_states_and_snapshots(spark, every):
    rows = made(every)
    want = loop(rows)
    log = snapshots.numbered(spark.createDataFrame(rows, EVENT))
    taken = snapshots.snapshots(log, every)
    got = sorted((r.aggregate_id, r.sequence_number, r.version, r.payload, r.deleted_at, r.deleted_by) for r in snapshots.states(log, taken, every).collect())
    assert got == sorted((who, *s) for who, states in want.items() for s in states)
    assert sorted((r.aggregate_id, r.sequence_number, r.event_count, r.version) for r in taken.collect()) == sorted((who, s[0], every, s[1]) for who, states in want.items() for s in states if s[0] % every == 0)
    rest = snapshots.tail(log, taken)
    assert rest.count() == sum(len(s) % every for s in want.values())
    now = {r.aggregate_id: (r.sequence_number, r.version, r.payload, r.deleted_at, r.deleted_by) for r in snapshots.rehydrated(taken, rest, every).collect()}
    assert now == {who: states[-1] for who, states in want.items()}


def test_empty_log(spark):
    log = snapshots.numbered(spark.createDataFrame([], EVENT))
    taken = snapshots.snapshots(log)
    assert taken.collect() == [] and snapshots.states(log, taken).collect() == [] and snapshots.rehydrated(taken, log).collect() == []


def test_keyed_state_goes_on_over_restarts(spark, tmp_path):
    """Two starts on one checkpoint: the second goes on with the numbers of the first."""
    rows = [(f"e{i:03d}", f"node:p:{i % 3}", "node_updated", datetime(2024, 1, 1) + timedelta(minutes=i), str(i)) for i in range(90)]
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    for part in (rows[:50], rows[50:]):
        spark.createDataFrame(part, EVENT).write.mode("append").parquet(source)
        streams.fold(stream_of.snapshots(streams.read(spark, source, spark.createDataFrame([], EVENT).schema), 10), target, marks)
    got = sorted((r.aggregate_id, r.sequence_number, r.version, r.payload) for r in spark.read.parquet(f"{target}/*").collect())
    assert got == sorted((f"node:p:{k}", n, n, str(3 * (n - 1) + k)) for k in range(3) for n in (10, 20, 30))


def test_keyed_state_holds_a_delete_without_a_moment(spark, tmp_path):
    rows = [("e0", "node:p:0", "node_deleted", None, None), ("e1", "node:p:0", "node_updated", datetime(2024, 1, 1), "x"), ("e2", "node:p:1", "node_updated", datetime(2024, 1, 1), "y")]
    spark.createDataFrame(rows, EVENT).write.parquet(source := str(tmp_path / "in"))
    streams.fold(stream_of.snapshots(streams.read(spark, source, spark.createDataFrame([], EVENT).schema), 1), str(tmp_path / "out"), str(tmp_path / "marks"))
    got = sorted((r.aggregate_id, r.sequence_number, r.version, r.payload, r.deleted_at, r.deleted_by) for r in spark.read.parquet(str(tmp_path / "out" / "*")).collect())
    assert got == sorted((who, *s) for who, states in loop(rows).items() for s in states)


def test_retention_and_compaction_keep_states(spark, tmp_path):
    rows = made(5)
    log = EventLog(spark, str(tmp_path / "log"))
    assert log.state().collect() == []
    for k in range(3):
        log.append(spark.createDataFrame(rows[k::3], EVENT))
    key = lambda r: (r.aggregate_id, r.sequence_number, r.version, r.payload, r.deleted_at, r.deleted_by)
    want = sorted((who, *states[-1]) for who, states in loop(rows).items())
    assert sorted(map(key, log.state().collect())) == want
    log.compact()
    assert all(len([f for f in os.listdir(tmp_path / "log" / "days" / f"day={d}") if f.endswith(".parquet")]) == 1 for d in log.days())
    assert sorted(map(key, log.state().collect())) == want
    for today, kept in ((date(2024, 4, 10), date(2024, 1, 11)), (date(2024, 5, 10), date(2024, 2, 10)), (date(2024, 5, 10), date(2024, 2, 10))):
        assert log.retain(today) == kept and min(log.days()) >= kept
        assert sorted(map(key, log.state().collect())) == want
    assert os.listdir(tmp_path / "log" / "snapshots") == ["upto=2024-02-10"]
    # an event older than the snapshot isn't lost
    log.append(spark.createDataFrame([("late", "node:p:new", "node_created", datetime(2024, 1, 2), "x")], EVENT))
    assert [r.version for r in log.state().filter("aggregate_id = 'node:p:new'").collect()] == [1]
