"""Evidence that expands and the choice of tasks, on small graphs with gaps; whole results are compared with SQL in test_queries."""

import pytest

from curato.operators import tasks as tk

EDGES = "src string, rel string, dst string"


@pytest.fixture(scope="module")
def graph(spark):
    hub = [("hub", "holds", f"leaf{i:02d}") for i in range(40)] + [("hub", "keeps", "leaf00")]
    chain = [("a", "to", "b"), ("b", "to", "c"), ("c", "to", "d"), ("c", "back", "b"), ("b", "self", "b")]
    return spark.createDataFrame([*hub, *chain, *chain, (None, "to", "a"), ("a", None, "b"), ("a", "to", None)], EDGES)


def rows(df):
    return sorted((r.id, int(r.eid[1:]), r.head, r.relation, r.tail, r.direction, r.step) for r in df.collect())


def test_steps(spark, graph):
    found = rows(tk.evidence_bank(graph, spark.createDataFrame([("hub",), ("a",), ("hub",), (None,)], "id string"), seed="x"))
    hub, a = [r for r in found if r[0] == "hub"], [r for r in found if r[0] == "a"]
    # a node of many edges stops at 30, one relation for each neighbour, and never expands
    assert len(hub) == 30 and {r[6] for r in hub} == {0} and all(r[3] == "holds" for r in hub)
    # a has one edge; the second hop is b's two, and a drawn path fills up
    assert [r[2:6] for r in a if r[6] == 0] == [("a", "to", "b", "out")]
    assert {r[2:5] for r in a if r[6] == 2} == {("b", "to", "c"), ("b", "self", "b")}
    assert 1 <= len([r for r in a if r[6] == 3]) <= 2 and [r[1] for r in a] == list(range(1, len(a) + 1))
    assert len({r[2:5] for r in a}) == len(a)


def test_reruns_agree_and_strangers_borrow_a_path(spark, graph):
    who = spark.createDataFrame([("nobody",), ("c",), ("leaf03",)], "id string")
    first = rows(tk.evidence_bank(graph, who, seed="x"))
    assert first == rows(tk.evidence_bank(graph.repartition(3), who, seed="x"))
    assert {r[6] for r in first if r[0] == "nobody"} == {3}
    assert ("hub", "holds", "leaf03", "in", 1) in {r[2:] for r in first if r[0] == "leaf03"}
    assert not rows(tk.evidence_bank(spark.createDataFrame([], EDGES), who))


def test_failing_candidates_are_replaced(spark, graph):
    # of 41 nodes with this keyword only the hub has out-neighbours; by degree the hub comes first
    nodes = graph.selectExpr("src AS id").union(graph.selectExpr("dst")).distinct().selectExpr("id", "'thing' AS type")
    chosen = tk.centres_by_keyword(nodes, "word", "b", "x").unionByName(tk.centres_by_degree(graph, "degree")).unionByName(tk.centres_by_type(nodes, "none", ["gene"], otherwise=0))
    found = tk.tasks(graph, chosen, wanted=1, need=30, seed="x").groupBy("kind", "rank", "id").count().collect()
    assert sorted(map(tuple, found)) == [("degree", 1, "hub", 30), ("word", 1, "hub", 30)]
    assert tk.tasks(graph, chosen.limit(0), 1).count() == 0


def test_allowed(spark, graph):
    bank = tk.evidence_bank(graph, spark.createDataFrame([("hub",)], "id string"))
    places = {r.place: r.entity for r in tk.allowed_entities(bank, graph, 2).collect()}
    assert places[1] == "hub" and places[2] == "leaf00" and len(places) == 12
