"""Connected components of a link table by union-find inside tasks and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curato.llm import shared

#: Links that one task joins at most; the number of tasks follows.
LINKS_PER_TASK = 250_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task become links of each node to the smallest node it reaches there."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := up.setdefault(top, top)) != top:
            top = p
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in list(up)]
    for i in range(0, len(pairs), 50_000):
        part = [p for p in pairs[i : i + 50_000] if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], names=["a", "b"])


def large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a").toDF("a", "b")).where("a != b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(least).distinct()


def components(links: DataFrame) -> DataFrame:
    """v, label: for every node that occurs in links (columns a and b, long) the smallest node it is joined to, itself included.

    Few links are joined in one task; more go to as many tasks as LINKS_PER_TASK asks for, and what their forests still
    share is contracted by alternating large and small stars until nothing changes, each round written to the shared folder.
    """
    links = shared.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    tasks = max(1, -(-links.count() // LINKS_PER_TASK))
    # dealt by a key only if several tasks follow, whose forests the stars then join
    dealt = links.repartition(tasks, "b") if tasks > 1 else links.coalesce(1)
    now = shared.keep(dealt.mapInArrow(forest, "a long, b long"), "forest")
    shared.forget(links)
    sign = None
    while tasks > 1:
        said = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if said == sign:
            break
        sign, last = said, now
        now = shared.keep(small_star(large_star(now)), "stars")
        shared.forget(last)
    return now.select(F.col("a").alias("v"), F.col("b").alias("label")).union(now.select(F.col("b").alias("v"), F.col("b").alias("label")).distinct())
