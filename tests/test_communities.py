"""Louvain against a plain sequential implementation, and on graphs whose communities are known."""

import collections
import random

import pytest

from curato.operators import communities as cm


def plain_modularity(links, label):
    k, inner = collections.Counter(), collections.Counter()
    for a, b, w in links:
        k[label[a]] += w
        k[label[b]] += w
        if label[a] == label[b]:
            inner[label[a]] += 2 * w
    m2 = sum(k.values())
    return sum(inner[c] / m2 - (k[c] / m2) ** 2 for c in k)


def plain_louvain(links):
    """Node by node, level by level."""
    nodes = sorted({x for a, b, _ in links for x in (a, b)})
    of, graph = {x: x for x in nodes}, collections.defaultdict(collections.Counter)
    for a, b, w in links:
        graph[a][b] += w
        graph[b][a] += w
    while True:
        k = {x: sum(graph[x].values()) for x in graph}
        m2, c, total = sum(k.values()), {x: x for x in graph}, dict(k)
        moved = changed = True
        any_move = False
        while moved:
            moved = False
            for x in sorted(graph):
                near = collections.Counter()
                for y, w in graph[x].items():
                    if y != x:
                        near[c[y]] += w
                total[c[x]] -= k[x]
                best = max([c[x], *sorted(near)], key=lambda d: (near[d] - k[x] * total[d] / m2, d == c[x]))
                if near[best] - k[x] * total[best] / m2 > near[c[x]] - k[x] * total[c[x]] / m2 + 1e-12:
                    c[x], moved, any_move = best, True, True
                total[c[x]] += k[x]
        if not any_move:
            return of
        of, up = {x: c[of[x]] for x in of}, collections.defaultdict(collections.Counter)
        for x, row in graph.items():
            for y, w in row.items():
                up[c[x]][c[y]] += w
        graph = up


def planted(groups, size, inside, outside, seed):
    rng = random.Random(seed)
    n = groups * size
    return [(a, b, 1.0) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a // size == b // size else outside)]


def cliques(groups, size):
    out = [(g * size + i, g * size + j, 1.0) for g in range(groups) for i in range(size) for j in range(i + 1, size)]
    return out + [(g * size, (g + 1) % groups * size + 1, 1.0) for g in range(groups)]


@pytest.mark.parametrize(("links", "alone"), [(cliques(6, 4), True), (cliques(4, 4), False), (planted(4, 20, 0.5, 0.03, 1), True), (planted(6, 12, 0.6, 0.06, 2), True), (planted(8, 40, 0.3, 0.05, 3), True)])
def test_louvain_equals_the_plain_one(spark, monkeypatch, links, alone):
    if not alone:
        monkeypatch.setattr(cm, "LINKS_PER_TASK", 0)
    edges = spark.createDataFrame(links, "src long, dst long, w double")
    told = [(dict(map(tuple, labels.collect())), q) for labels, q in cm.levels(edges, "w", least=1e-3)]
    nodes = {x for a, b, _ in links for x in (a, b)}
    for label, q in told:
        assert set(label) == nodes and q == pytest.approx(plain_modularity(links, label))
    assert [q for _, q in told] == sorted(q for _, q in told)
    assert told[-1][1] >= 0.99 * plain_modularity(links, plain_louvain(links))
    named = {r.id: r.community for r in cm.louvain(edges, "w", least=1e-3).collect()}
    first = {}
    for x in sorted(nodes):
        first.setdefault(told[-1][0][x], x)
    assert named == {x: first[told[-1][0][x]] for x in nodes}


def test_weights_loops_and_lone_nodes(spark):
    rows = [(1, 2, 1.0), (1, 2, 9.0), (2, 1, 1.0), (2, 3, 0.5), (3, 4, 10.0), (5, 5, 3.0), (None, 6, 1.0), (3, None, 1.0)]
    edges = spark.createDataFrame(rows, "src long, dst long, w double")
    assert sorted((r.src, r.dst, r.w) for r in cm.weighted_links(edges.where("src < 5 and dst < 5"), "w").collect()) == [(1, 2, 11.0), (2, 1, 11.0), (2, 3, 0.5), (3, 2, 0.5), (3, 4, 10.0), (4, 3, 10.0)]
    assert {r.w for r in cm.weighted_links(edges.where("src < 5 and dst < 5")).collect()} == {1.0}
    assert {r.id: r.community for r in cm.louvain(edges, "w").collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert {r.id: r.community for r in cm.louvain(edges.where("src = 5")).collect()} == {5: 5}
    assert cm.louvain(edges.limit(0)).count() == 0


def test_rounds_are_undone_where_modularity_falls(spark, monkeypatch):
    """All of a clique's nodes want the same at once; what is kept never falls, and text ids do as well."""
    monkeypatch.setattr(cm, "LINKS_PER_TASK", 0)
    links = [(f"n{a}", f"n{b}", w) for a, b, w in planted(2, 8, 0.9, 0.2, 4)]
    edges = spark.createDataFrame(links, "src string, dst string, w double")
    told = [q for _, q in cm.levels(edges, "w", least=1e-3)]
    assert told == sorted(told) and told[-1] > 0
    monkeypatch.setattr(cm, "LINKS_PER_TASK", 1000)
    labels = dict(map(tuple, cm.louvain(edges, "w").collect()))
    assert plain_modularity(links, labels) >= 0.99 * plain_modularity(links, plain_louvain(links))


def test_modularity_of_given_labels(spark):
    links, label = planted(3, 10, 0.5, 0.1, 5), {x: x % 4 for x in range(30)}
    both = cm.weighted_links(spark.createDataFrame(links, "src long, dst long, w double"))
    got = cm.modularity(both, spark.createDataFrame(list(label.items()), "id long, community long")).first()[0]
    assert got == pytest.approx(plain_modularity(links, label))
    assert cm.modularity(both.limit(0), spark.createDataFrame(list(label.items()), "id long, community long")).first()[0] == 0.0
