"""Best paths against all simple paths, and triangles by degree order."""

import itertools
import random

from curato.operators import graph as g


def test_best_paths_are_the_best_of_all(spark):
    rng = random.Random(2)
    weights = {"a": 1.0, "b": 0.8, "c": 0.2}
    edges = sorted({(rng.randrange(9), rng.choice("abcd"), rng.randrange(9)) for _ in range(34)})
    asked = [(0, 5), (1, 7), (3, 3), (2, 8), (0, 5), (4, 99)]
    got = g.best_paths(spark.createDataFrame(edges, "src long, rel string, dst long"), spark.createDataFrame(asked, "start long, end long"), weights, 4, 4).collect()
    want = []
    for start, end in sorted(set(asked)):
        found, now = [], [((start,), ())]
        for _ in range(4):
            now = [((*n, t), (*r, rel)) for n, r in now for s, rel, t in edges if s == n[-1] and t not in n and n[-1] != end]
            found += [x for x in now if x[0][-1] == end]
        scored = [(-round(0.7 * sum(weights.get(x, 0.5) for x in r) / len(r) + 0.3 / (1 + len(r)), 9), ">".join(map(str, n)), ">".join(r)) for n, r in found] if start != end else []
        want += [(start, end, i, x[0], x[1], x[2]) for i, x in enumerate(sorted(scored)[:4], 1)]
    assert sorted((r.start, r.end, r.rank, -r.score, ">".join(map(str, r.nodes)), ">".join(r.rels)) for r in got) == sorted(want) and len(want) > 5


def test_triangles_of_a_hub(spark):
    links = [(0, i) for i in range(1, 60)] + [(1, 2), (2, 3), (5, 5), (3, 2)]
    row = g.properties(spark.createDataFrame(links, "src long, dst long")).first()
    simple = {tuple(sorted(x)) for x in links if x[0] != x[1]}
    assert row.triangles == sum(all(p in simple for p in itertools.combinations(t, 2)) for t in itertools.combinations(range(60), 3)) == 2 and row.self_loops == 1
