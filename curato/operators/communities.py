"""G-11: communities of a graph by modularity (Louvain), as joins over tables of links and labels.

A level starts with each node by itself. A round sums each node's links by the community at their other end, takes the move of
best gain for each node, and lets those nodes move that nothing stands in the way of: of two neighbours of which one leaves the
community that the other moves to, the one of larger degree waits (of equal ones that of the smaller hash of the round), so
neighbours never change places, and a hub's many small neighbours need not wait for it. Many nodes may still move into one
community together; if modularity has fallen after a round, the round is undone and tried again with a random half of its
movers, and so on down to few. A level ends when a round gains less than `least` or nothing moves. Then communities become nodes,
links between them are summed, inner ones as a loop, and the next level starts, until a level gains nothing.

Modularity of the links' weights w, of degrees k and of m2 = sum k:  sum over communities (inner / m2 - (degrees / m2)^2).

A graph of few links (LINKS_PER_TASK, whatever it was contracted from) is worked on by one task, node after node; so only large graphs
take rounds, and their levels shrink until one task is enough. Both ways are tested on the same graphs.

Each round's sums and labels are tables in the shared folder; a task sees links by hash of their end. A hub's links are summed by
community before they are shuffled on. The driver sees numbers only: moves, modularity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from curato.operators.nearness import stored

#: Shares of a round's movers that are tried after one another.
SHARES = (1.0, 0.5, 0.25, 0.1)
#: Links of a graph that one task works on alone.
LINKS_PER_TASK = 200_000
ROUNDS, LEVELS, LEAST_GAIN = 30, 12, 1e-4


def weighted_links(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """src, dst, w in both directions, once each: weights of parallel edges add up (without weights they count once), and loops go."""
    both = edges.select("src", "dst", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).where("src != dst")
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg((F.sum("w") if weight else F.max("w")).alias("w"))


def modularity(links: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row, modularity, of links (src, dst, w) both ways and labels (id, community); 0 without links."""
    a, b = labels.toDF("src", "ca"), labels.toDF("dst", "cb")
    sums = links.join(a, "src").join(b, "dst").groupBy("ca").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inner"))
    parts = sums.agg(F.sum("inner").alias("i"), F.sum(F.col("k") * F.col("k")).alias("k2"), F.sum("k").alias("m2"))
    return parts.select(F.coalesce(F.col("i") / F.col("m2") - resolution * F.col("k2") / F.col("m2") / F.col("m2"), F.lit(0.0)).alias("modularity"))


def _sums(links: DataFrame, state: DataFrame) -> DataFrame:
    """src, c, own, k and w: weight of a node's links to each community, its own too if there is none; loops apart."""
    at = state.select(F.col("id").alias("dst"), F.col("c"))
    near = links.where("src != dst").join(at, "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("w"))
    return near.unionByName(state.select("id", "c", F.lit(0.0).alias("w"))).groupBy("id", "c").agg(F.sum("w").alias("w")).join(state.select("id", F.col("c").alias("own"), "k", "loop"), "id")


def _wanted(near: DataFrame, totals: DataFrame, m2: float, resolution: float) -> DataFrame:
    """id, to: each node's move of best gain, of equal ones to the smallest community; none that gains nothing."""
    here = F.col("c") == F.col("own")
    score = F.col("w") - resolution * F.col("k") * (F.col("total") - F.when(here, F.col("k")).otherwise(0.0)) / m2
    scored = near.join(totals, "c").select("id", "c", "k", "own", here.alias("here"), score.alias("score"))
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "c")).alias("b"), F.max(F.when(F.col("here"), F.col("score"))).alias("stay"), F.first("k").alias("k"), F.first("own").alias("own"))
    return best.select("id", "own", "k", F.col("b.c").alias("to"), (-F.col("b.s") - F.col("stay")).alias("gain")).where("gain > 1e-9")


def _movers(wanted: DataFrame, links: DataFrame, turn: int) -> DataFrame:
    """Those of the nodes that want to move whose way is free.

    Neighbours of which one leaves the community that the other moves to stand in each other's way.
    """
    drawn = stored(wanted.withColumn("draw", F.struct((-F.col("k")).alias("k"), F.xxhash64("id", F.lit(turn)).alias("h"))))
    mine = drawn.select(F.col("id").alias("src"), F.col("draw").alias("a"), F.col("own").alias("own_a"), F.col("to").alias("to_a"))
    other = drawn.select(F.col("id").alias("dst"), F.col("draw").alias("b"), F.col("own").alias("own_b"), F.col("to").alias("to_b"))
    wait = links.select("src", "dst").where("src != dst").join(mine, "src").join(other, "dst").where("b > a AND (to_a = own_b OR to_b = own_a)")
    return drawn.join(wait.select(F.col("src").alias("id")).distinct(), "id", "left_anti").select("id", "to", "draw")


def _level(links: DataFrame, m2: float, least: float, resolution: float, seed: int) -> tuple[DataFrame, float]:
    """id, c of every node after the moves of one level, and the modularity."""
    loop = F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0))
    state = stored(links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"), loop.alias("loop")).select("id", F.col("id").alias("c"), "k", "loop"))

    def judged(state: DataFrame) -> tuple[DataFrame, DataFrame, float]:
        near, totals = stored(_sums(links, state)), state.groupBy("c").agg(F.sum("k").alias("total"))
        inner = near.where("c = own").agg(F.sum(F.col("w") + F.col("loop")).alias("i"))
        row = inner.join(totals.agg(F.sum(F.col("total") * F.col("total")).alias("t2")), F.lit(True)).first()
        return near, totals, row.i / m2 - resolution * row.t2 / m2 / m2

    near, totals, now = judged(state)
    for turn in range(ROUNDS):
        movers = _movers(_wanted(near, totals, m2, resolution), links, seed + turn)
        for share in SHARES:
            go = movers.where(F.pmod(F.col("draw.h"), F.lit(1000)) < int(1000 * share)).select("id", "to")
            new = stored(state.join(go, "id", "left").select("id", F.coalesce("to", "c").alias("c"), "k", "loop"))
            told = judged(new)
            if told[2] > now:
                break
        gain = told[2] - now
        if gain > 0:
            state, (near, totals, now) = new, told
        if gain <= least:
            break
    return state.select("id", "c"), now


def _alone(links: DataFrame, m2: float, least: float, resolution: float) -> DataFrame:
    """id, c of every node after one level on a graph that one task holds: node after node moves at once to where it gains most."""
    kind = links.schema["src"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("c", kind)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, links_schema)
        ends = [table.column(c).combine_chunks() for c in ("src", "dst")]
        ids = pc.unique(ends[0]).sort()
        src, dst = (pc.index_in(e, ids).to_numpy() for e in ends)
        w = table.column("w").to_numpy()
        order = np.argsort(src, kind="stable")
        src, dst, w = src[order], dst[order], w[order]
        n = len(ids)
        degree = np.bincount(src, w, n)
        begin = np.searchsorted(src, np.arange(n + 1))
        label, total = np.arange(n), degree.copy()
        swept = 1.0
        while swept > least:
            swept = 0.0
            for i in range(n):
                own, k = label[i], degree[i]
                near = slice(begin[i], begin[i + 1])
                inner = dst[near] != i
                to, back = np.unique(np.r_[own, label[dst[near][inner]]], return_inverse=True)
                score = np.bincount(back, np.r_[0.0, w[near][inner]], len(to)) - resolution * k * (total[to] - k * (to == own)) / m2
                best = int(score.argmax())
                gain = score[best] - score[np.searchsorted(to, own)]
                if gain > 1e-9:
                    total[own] -= k
                    total[to[best]] += k
                    label[i] = to[best]
                    swept += 2 * gain / m2
            if swept <= 0:
                break
        yield pa.RecordBatch.from_arrays([ids, ids.take(pa.array(label))], ["id", "c"])

    links_schema = to_arrow_schema(links.schema)
    return stored(links.coalesce(1).mapInArrow(work, schema))


def levels(edges: DataFrame, weight: str | None = None, resolution: float = 1.0, least: float = LEAST_GAIN) -> Iterator[tuple[DataFrame, float]]:
    """After each level, labels (id, community) of all nodes that have a link, and their modularity, which never falls."""
    links = stored(weighted_links(edges, weight))
    m2 = links.agg(F.sum("w")).first()[0]
    if not m2:
        return
    labels, last = None, None
    for n in range(LEVELS):
        if links.count() <= LINKS_PER_TASK:
            moved = _alone(links, m2, least, resolution)
            now = modularity(links, moved.toDF("id", "community"), resolution).first()[0]
        else:
            moved, now = _level(links, m2, least, resolution, 1000 * n)
        if last is not None and now <= last + 1e-12:
            return
        labels = stored(moved.toDF("id", "community") if labels is None else labels.join(moved.toDF("community", "c"), "community").select("id", F.col("c").alias("community")))
        last = now
        yield labels, now
        a, b = moved.toDF("src", "a"), moved.toDF("dst", "b")
        links = stored(links.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))


def louvain(edges: DataFrame, weight: str | None = None, resolution: float = 1.0, least: float = LEAST_GAIN) -> DataFrame:
    """id, community of all nodes of edges (src, dst): the smallest id of the community; a node without links to others is its own.

    Null ends are no nodes, so their edges don't count. Without edges the table is empty.
    """
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    labels = None
    for labels, _ in levels(edges, weight, resolution, least):  # noqa: B007
        pass
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    if labels is None:
        return nodes.select("id", F.col("id").alias("community"))
    named = labels.join(labels.groupBy("community").agg(F.min("id").alias("first")), "community").select("id", "first")
    return nodes.join(named, "id", "left").select("id", F.coalesce("first", "id").alias("community"))
