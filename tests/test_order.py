"""Counts, means and turns in order, over several partitions and groups of most rows, against plain loops."""

import collections
import random

import pytest

from curato.operators import tables as o


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(8)
    rows = [(i, None if i % 50 == 0 else "hot" if rng.random() < 0.8 else f"g{rng.randrange(5)}", rng.randrange(2)) for i in range(1200)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id long, g string, ok int").repartition(5)


def test_recent_counts_and_means(events):
    rows, df = events
    n, mean, want = collections.Counter(), collections.defaultdict(lambda: 0.5), {}
    for i, g, ok in sorted(rows):
        n[g] += 1
        want[i] = n[g]
        mean[g] = mean[g] * 0.9 + ok * 0.1
    assert {r.id: r.rank + 1 for r in o.rank_in(df, "g", "id").collect()} == want
    assert {r.id: r.recent for r in o.recent_count(df, "g", ["id"], 100).collect()} == {i: min(100, k) for i, k in want.items()}
    assert {r.g: r.mean for r in o.smoothed(df, "g", "id", "ok").collect()} == {g: pytest.approx(m) for g, m in mean.items()}
    assert o.smoothed(df.limit(0), "g", "id", "ok").count() == o.rank_in(df.limit(0), "g", "id").count() == 0


@pytest.mark.parametrize(("k", "rows"), [(3, 10), (5, 1000), (7, 100), (4, 1), (1, 5), (6, 3)])
def test_least_used(events, k, rows):
    given, df = events
    names = [f"s{j}" for j in range(k)][::-1]
    last, want = [], {}
    for i, _, _ in sorted(given):
        used = collections.Counter(last)
        want[i] = min(names, key=lambda s: (used[s], s))
        last = [*last, want[i]][-rows:]
    assert {r.id: r.strategy for r in o.least_used(df, ["id"], [*names, names[0]], rows).collect()} == want
