"""Files found by paths that are not quite theirs, and path lengths by sketches against all pairs."""

import random

import pytest

from curato.operators import graph as g
from curato.operators import tables as o


def test_rules_of_files(spark):
    files = [("a/b/c/x.md",), ("z/b/c/x.md",), ("A/B/Y.md",), ("q/only.txt",), ("q/.hidden",), (None,), ("",), ("a/b/c/x.md",)]
    asked = {
        "a/b/c/x.md": ("a/b/c/x.md", "exact"), "  z/b/c/x.md ": ("z/b/c/x.md", "exact"), "./a//b\\y.md": ("A/B/Y.md", "tidied"), "/mnt/b/c/x.md": ("a/b/c/x.md", "tail"),
        "k/z/b/c/X.md": ("z/b/c/x.md", "tail"), "m/x.md": ("a/b/c/x.md", "name"), "only.json": ("q/only.txt", "stem"), "w/.hidden": ("q/.hidden", "name"), "none.md": (None, None),
        "": (None, None), "  ": (None, None), "/": (None, None), None: (None, None),
    }
    df = spark.createDataFrame([(p, i) for i, p in enumerate([*asked, "m/x.md"])], "path string, file_no int")
    found = o.find_files(df, spark.createDataFrame(files, "file string"))
    assert found.columns == ["path", "file_no", "file", "rule"] and found.count() == len(asked) + 1
    assert {r.path: (r.file, r.rule) for r in found.collect()} == asked
    assert {r.file for r in o.find_files(df, spark.createDataFrame([], "file string")).collect()} == {None}


@pytest.mark.parametrize("lg", [8, 12])
def test_lengths_near_all_pairs(spark, lg):
    rng = random.Random(5)
    links = [(i, i // 2) for i in range(1, 600)] + [(rng.randrange(600), rng.randrange(600)) for _ in range(250)] + [(3, 3), (None, 4), (900, 901)]
    edges = spark.createDataFrame(links, "src long, dst long")
    both = edges.union(edges.select("dst", "src"))
    near = {}
    for a, b in links:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    exact = {}
    for s in near:
        dist, layer = {s: 0}, [s]
        while layer:
            layer = [y for x in layer for y in near[x] if y not in dist and not dist.update({y: dist[x] + 1})]
        exact[s] = dist
    every = [d for x in exact.values() for d in x.values() if d]
    reach = g.neighbourhoods(both, lg).persist()
    row = g.sketched_lengths(reach).first()
    tolerance = 0.05 if lg == 12 else 0.15
    assert row.pairs == pytest.approx(len(every), rel=tolerance) and row.avg_path_length == pytest.approx(sum(every) / len(every), rel=tolerance)
    ninety = sorted(every)[int(0.9 * len(every))]
    assert ninety - 1 - tolerance * ninety <= row.effective_diameter <= ninety + tolerance * ninety
    if lg == 12:
        told = {r.id: r.closeness for r in g.sketched_closeness(reach).collect()}
        n = len(near)
        for s, dist in exact.items():
            total, r = sum(dist.values()), len(dist) - 1
            assert told[s] == pytest.approx(r / total * r / (n - 1), rel=0.05)


def test_no_pairs(spark):
    empty = spark.createDataFrame([], "src long, dst long")
    assert tuple(g.sketched_lengths(g.neighbourhoods(empty)).first()) == (0, None, None, None)
    loop = spark.createDataFrame([(1, 1)], "src long, dst long")
    assert tuple(g.sketched_lengths(g.neighbourhoods(loop)).first()) == (0, None, None, None) and g.sketched_closeness(g.neighbourhoods(loop)).count() == 0
