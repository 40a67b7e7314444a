"""Queries over whole tables against brute force, on the smallest tables."""

import pytest

from palimpsest import plans


@pytest.fixture(scope="module")
def graph(spark, sf_dir):
    """(nodes, edges) of every line with flag N or R."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()
    nodes = {f"p{r.p_partkey}" for r in read("part")} | {f"s{r.s_suppkey}" for r in read("supplier")}
    lines = {f: {(f"p{r.l_partkey}", f"s{r.l_suppkey}") for r in read("lineitem") if r.l_returnflag == f} for f in "NR"}
    return nodes, {e for e in lines["N"] - lines["R"] if set(e) <= nodes}


def test_graph_takes_every_line(spark, sf_dir, graph):
    nodes, edges = graph
    run = lambda name: plans.queries()[name](spark, sf_dir).collect()
    assert {tuple(r) for r in run("active_edges")} == edges
    near = {n: {e[0] if e[1] == n else e[1] for e in edges if n in e} for n in nodes}
    assert {r.id: r.degree for r in run("degrees")} == {n: len(x) for n, x in near.items()}
    assert {r.id for r in run("isolated")} == {n for n, x in near.items() if not x}
    mean = sum(map(len, near.values())) / len(nodes)
    narrow = {n for n, x in near.items() if 0 < len(x) < 0.3 * mean}
    assert {r.id for r in run("bottlenecks")} == narrow
    component = {}
    for n in sorted(nodes):
        todo = [n]
        while todo:
            if (m := todo.pop()) not in component:
                component[m] = n
                todo += near[m]
    assert {r.id: r.component for r in run("components")} == component
    (report,) = run("analyze_structure")
    assert (report.total_nodes, report.connected_components, report.isolated) == (len(nodes), len(set(component.values())), sum(not x for x in near.values()))
    assert report.bottlenecks == ",".join(sorted(narrow)[:10])


def test_commands_ask_for_every_memory(spark, sf_dir):
    ids = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    for name, states in (("forget_command", {"forgotten", "already_forgotten", "not_found"}), ("update_command", {"updated", "error"})):
        got = plans.queries()[name](spark, sf_dir).collect()
        assert ids < {r.id for r in got}
        assert {r.status for r in got} == states


@pytest.mark.parametrize("name", ["mobius_add", "exp_map"])
def test_vectors_come_whole(spark, sf_dir, name):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    got = plans.queries()[name](spark, sf_dir).collect()
    assert len(got) == 64 * n
    assert {r.place for r in got} == set(range(64))
