import numpy as np
import pytest
from pyspark.sql import functions as F

from eventcast.operators import graph
from eventcast.operators.attach import prefilter

EDGES = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "e")]
NODES = ["a", "b", "c", "d", "e", "lonely"]


def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string")


def nodes(spark):
    return spark.createDataFrame([(n, "T", float(i)) for i, n in enumerate(NODES)], "id string, node_type string, h double")


def ids(df):
    return {r["id"] for r in df.collect()}


def test_last_event_wins_an_edge(spark, day):
    events = spark.createDataFrame([
        (1, day("2001-01-02"), "C", "R", "X", "bomb", "gun", 1.0, 0.0), (2, day("2001-01-01"), "C", "R", "X", "bomb", "knife", 9.0, 0.0),
        (3, day("2001-01-02"), "C", "R", "X", "bomb", "car", 5.0, 2.0),
    ], "eventid long, date date, country_txt string, region_txt string, city string, attacktype1_txt string, weaptype1_txt string, nkill double, nwound double")
    built = graph.build_edges(events.withColumn("casualties", F.col("nkill") + F.col("nwound"))).collect()
    assert len(built) == 3
    typed = next(r for r in built if r["dst"] == "AttackType|bomb")
    assert typed["attrs"]["weapon_type"] == "car" and typed["attrs"]["total_casualties"] == 7.0
    assert all(r["attrs"] is None for r in built if r["src"].startswith("Date|"))
    assert graph.build_nodes(events).count() == 4


@pytest.mark.parametrize("radius, expected", [(0, {"a"}), (1, {"a", "b"}), (2, {"a", "b", "c", "e"}), (9, {"a", "b", "c", "d", "e"})])
def test_ego_nodes(spark, radius, expected):
    assert ids(graph.ego_nodes(edges(spark), "a", radius)) == expected


def test_ego_of_an_unknown_node_is_empty(spark):
    assert ids(graph.ego_nodes(edges(spark), "zzz", 2)) == set()


def test_induced_subgraph(spark):
    members = spark.createDataFrame([("b",), ("c",), ("e",)], "id string")
    found = {(r["src"], r["dst"]) for r in graph.induced_subgraph(edges(spark), members).collect()}
    assert found == {("b", "c"), ("b", "e")}


def test_degrees_and_centrality(spark):
    found = {r["id"]: (r["degree"], r["centrality"]) for r in graph.degree_centrality(nodes(spark), edges(spark)).collect()}
    assert found["b"] == (3, 0.6) and found["lonely"] == (0, 0.0)
    assert [r["id"] for r in graph.most_central(nodes(spark), edges(spark), 2).collect()] == ["b", "c"]


def test_index_is_dense(spark):
    indexed, pairs = graph.index_graph(nodes(spark), edges(spark))
    assert sorted(r["node_index"] for r in indexed.collect()) == list(range(6))
    assert {(r["src_index"], r["dst_index"]) for r in pairs.collect()} == {(0, 1), (1, 2), (2, 3), (1, 4)}


@pytest.mark.parametrize("hops", [1, 3])
def test_propagation_equals_matrix_power(spark, hops):
    a = np.eye(6)
    for s, t in EDGES:
        a[NODES.index(s), NODES.index(t)] = a[NODES.index(t), NODES.index(s)] = 1
    root = np.diag(1 / np.sqrt(a.sum(1)))
    expected = np.linalg.matrix_power(root @ a @ root, hops) @ np.arange(6.0)
    found = {r["id"]: r["h"] for r in graph.propagate(nodes(spark), edges(spark), ["h"], hops).collect()}
    assert [found[n] for n in NODES] == pytest.approx(list(expected))


def random_graph(spark, n=400, m=3000):
    rng = np.random.default_rng(8)
    pairs = {(f"n{a}", f"n{b}") for a, b in rng.integers(0, n, (m, 2)) if a < b} | {("n0", f"n{b}") for b in range(1, n)}  # one hub
    nodes = spark.createDataFrame([(f"n{i}", float(i % 17)) for i in range(n + 3)], "id string, h double")
    return nodes, spark.createDataFrame(sorted(pairs), "src string, dst string").repartition(4)


def test_bucketed_edges_give_the_same_and_do_not_move(spark):
    nodes, edges = random_graph(spark)
    plain = {r["id"]: r["h"] for r in graph.propagate(nodes, edges, ["h"], 3).collect()}
    bucketed = graph.propagate(nodes, edges, ["h"], 3, broadcast_bytes=0)
    assert {r["id"]: pytest.approx(r["h"], abs=1e-9) for r in bucketed.collect()} == plain
    plan = graph.propagate(nodes, edges, ["h"], 3, broadcast_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [src" in plan and "Bucketed: true" in plan
    # Node rows and partial sums are exchanged, edges (src, _part, dst) are not.
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(src" in line]
    assert len(moved) == 1 and plan.count("Exchange hashpartitioning(id") <= 3


def test_frontiers_too_large_to_broadcast(spark):
    nodes, edges = random_graph(spark)
    for centre in ("n0", "n7"):
        assert ids(graph.ego_nodes(edges, centre, 2, broadcast_bytes=0)) == ids(graph.ego_nodes(edges, centre, 2))
    members = nodes.filter("h < 5").select("id")
    rows = lambda df: {(r["src"], r["dst"]) for r in df.collect()}
    assert rows(graph.induced_subgraph(edges, members, broadcast_bytes=0)) == rows(graph.induced_subgraph(edges, members))


def test_prefilter_keeps_all_and_drops_most(spark):
    rows = spark.range(200_000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), "id").unionByName(
        spark.createDataFrame([(None, 1)], "k string, id long"))
    keys = rows.filter("id % 50 = 0").select("k")
    left = prefilter(rows, keys, "k", 4000)
    assert left.columns == rows.columns
    assert left.join(keys, "k", "left_semi").count() == 4000 and left.count() < 30_000
    assert prefilter(rows, keys, "k", 4000, limit=100).count() == 200_001
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
