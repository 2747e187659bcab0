"""Results that must be whole and equal to plain ones where rows tie, repeat or are many."""

import collections
import os
import random

import pytest

from curato.operators import chunking as ch
from curato.operators import graph as g
from curato.operators import nearness as nr
from curato.operators import tables as o
from curato.operators import validation as va
from curato.plans import structures
from curato.plans.base import Tables


def test_retrieval_ranks_by_rounded_scores(spark):
    # words of 1 and 7 documents weigh as much as words of 2 and 4, up to the last bit of their sum: 1.5 * 7.5 = 2.5 * 4.5
    has = {"one": [0], "seven": [0, 6, 7, 8, 9, 10, 11], "two": [5, 6], "four": [5, 7, 8, 9]}
    for n in (16, 20, 32, 36, 40):
        for swap in ({}, {0: 5, 5: 0}):
            texts = [(swap.get(i, i), " ".join([f"w{i}", *[w for w, at in has.items() if i in at]])) for i in range(n)]
            got = o.retrieve(spark.createDataFrame([(1, "one two four seven")], "qid long, q string"), spark.createDataFrame(texts, "did long, d string"), 2).collect()
            assert [r.did for r in sorted(got, key=lambda r: (-r.score, r.did))] == [0, 5]
            first = o.retrieve(spark.createDataFrame([(1, "one two four seven")], "qid long, q string"), spark.createDataFrame(texts, "did long, d string"), 1).collect()
            assert [r.did for r in first] == [0]


def test_key_sentences_split_a_text_once(spark):
    said = [f"{'the ' if i % 3 == 0 else ''}sentence {i}." for i in range(3000)]
    df = spark.createDataFrame([(" ".join(said),), (None,), ("",)], "t string").select(ch.key_sentences("t", ["the"], most=10**6).alias("k"))
    # each further one would be work that grows as the square of the sentences
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    weight = lambda i: (i % 3 == 0) + 1 - 0.5 * i / len(said)
    best = sorted(sorted(range(len(said)), key=lambda i: (-weight(i), i))[:1800])
    assert [r.k for r in df.collect()] == [" ".join(said[i] for i in best), None, ""]


def test_path_lengths_fold_nodes_of_equal_neighbours(spark):
    rng = random.Random(5)
    links = [(i, rng.randrange(i)) for i in range(1, 12)] + [(100 + i, i % 4) for i in range(40)] + [(200 + i, j) for i in range(5) for j in (2, 3)]
    near = collections.defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    far = []
    for start in near:
        seen = {start: 0}
        todo = collections.deque([start])
        while todo:
            v = todo.popleft()
            for w in near[v] - seen.keys():
                seen[w] = seen[v] + 1
                todo.append(w)
        far += [d for d in seen.values() if d]
    edges = spark.createDataFrame([(a, "r", b) for a, b in links], "src long, rel string, dst long")
    held = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    for parts in (None, 3):
        told = g.path_lengths(edges, parts).first()
        assert (told.diameter, told.avg_path_length) == (max(far), pytest.approx(sum(far) / len(far)))
    # no level stays on disk
    assert not [x for x in set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - held if x.startswith("front-")]
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    sizes, small = g.folded(both)
    # 40 leaves of four nodes, and five nodes of two, but for those that made ones join
    assert sizes.agg({"m": "sum"}).first()[0] == len(near) and sizes.count() <= len(near) - 36 - 4 and small.count() < both.count() / 2
    assert g.path_lengths(edges.limit(0)).first() == (None, None)


def test_keyword_pairs_compare_equal_sets_once(spark):
    rng = random.Random(3)
    sets = [rng.sample("abcdefghijklmnop", rng.randrange(1, 12)) for _ in range(40)]
    rows = [(i, ws) for i, ws in enumerate([*sets, *[list("abcdefghij")] * 30, *[list("jihgfedcba")] * 30, *[list("abcdefg")] * 20, [], None])]
    want = sorted((i, j) for i, x in rows for j, y in rows if x and y and i < j and 10 * len({*x} & {*y}) >= 7 * max(len(x), len(y)))
    df = spark.createDataFrame(rows, "id long, words array<string>").repartition(3)
    for slice_ in (500, 7):
        assert sorted(tuple(r) for r in nr.keyword_pairs(df, 0.7, slice_).collect()) == want
    plan = nr.keyword_pairs(df, 0.7)._jdf.queryExecution().optimizedPlan().toString()
    # tasks by slices, which stay as many as they are
    assert plan.count("RepartitionByExpression") == 2


def test_answers_judged_in_shares_are_those_judged_at_once(spark, sf, monkeypatch):
    tables = structures.claimed(Tables(spark, sf))
    told = lambda df: sorted(map(tuple, df.collect()), key=repr)
    whole = told(va.validate(*tables))
    monkeypatch.setattr(va, "MANY", 1)
    held = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    parts = va.validate(*tables)
    made = sorted(x.split("-")[0] for x in set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - held)
    assert told(parts) == whole and len(whole) == tables[0].count() and made == ["answers"] * va.SHARES
    # shuffle files of a table that is written are gone, and the session is as it was
    assert spark.conf.get(nr.CLEANS) == "false"
