"""Approximate nearest neighbours by NN-descent and greedy graph search.

Vectors that differ by a power of two only are one node. A first graph comes from TREES partitions of the nodes by random
hyperplanes, whose medians are fitted on at most SAMPLE vectors and cut all nodes into leaves of about LEAF; cells that hold
less than CELL_SAMPLE of the sample are cut on at the medians of the last cell that held more. A larger leaf is dealt to parts
by hash. Inside a part each node's K nearest are found by blocks of matrix products. NN-descent then improves the graph by Spark
joins: each node is a pivot whose neighbours, and those that have it as neighbour, meet there as neighbours of neighbours and
offer each other what is nearer than their present worst; a pivot takes up to MEET of them, chosen by a hash that changes
each round, and rounds go on until hardly an entry of the lists changes. Queries search the graph greedily: a query holds the EF
nearest nodes found, and EF_A_LEVEL more for each level of the trees; each round expands its STEP nearest
unexpanded ones by a join with the graph, and it rests when none is left. The RERANK nearest of each query are measured on the
original vectors in double precision.

Trees, descent and search measure Euclidean distances of unit vectors, which order as cosines do, on codes: each component as a
whole number over the range that the components have, in one byte at first. Where vectors lie so near to each other that the
rounding of codes blurs the distances of the k-th and the K-th neighbour, for more than BLURRED of the nodes, the graph is made
anew of two bytes a component, then of four, which tell more than cosines in double precision do.

No table is broadcast and no step compares all queries with all nodes: the work of a node or query does not depend on how
many there are, apart from more rounds of descent and search and longer pools, by the level.

Defined results: vectors that are null, empty, all zero, hold null or non-finite components, or have another length than most
vectors (of equally common lengths the longest) take no part, neither as query nor as candidate; nor do rows without id.
Rows that repeat an id count once, with the smallest vector. Fewer candidates than asked give fewer rows. Empty tables give
an empty table. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curato.llm import shared

K, TREES, LEAF, SAMPLE, CELL_SAMPLE, ROUNDS, MEET, OFFERS = 32, 6, 256, 20_000, 32, 2, 32, 5
EF, EF_A_LEVEL, STEP, RERANK, SEED = 64, 24, 32, 32, 41
#: Descent ends after the first of its rounds, but ROUNDS at least, that changes a smaller share of the list entries.
SETTLED = 0.002
#: Codes, coarse to fine. A list is blurred if its k-th and last distance differ by less than SHARP standard deviations of rounding.
KINDS, SHARP, BLURRED = ("i1", "i2", "i4"), 6, 0.002
LISTS = "u long, ids array<long>, scores array<float>"


def _lists(u: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> pa.RecordBatch:
    """One row a node: its k nearest, nearest first, from edges (u, c, s)."""
    by = np.lexsort((c, u))
    u, c, s = u[by], c[by], s[by]
    new = np.r_[True, (u[1:] != u[:-1]) | (c[1:] != c[:-1])][: len(u)] & (u != c)
    u, c, s = u[new], c[new], s[new]
    by = np.lexsort((c, -s, u))
    u, c, s = u[by], c[by], s[by]
    heads = np.flatnonzero(np.r_[True, u[1:] != u[:-1]][: len(u)])
    rank = np.arange(len(u)) - np.repeat(heads, np.diff(np.r_[heads, len(u)]))
    near = rank < k
    u, c, s = u[near], c[near], s[near]
    heads = np.flatnonzero(np.r_[True, u[1:] != u[:-1]][: len(u)]).astype(np.int32)
    at = pa.array(np.r_[heads, np.int32(len(u))].astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(u[heads]), pa.ListArray.from_arrays(at, pa.array(c)), pa.ListArray.from_arrays(at, pa.array(s.astype(np.float32)))], names=["u", "ids", "scores"])


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Pieces of a stream sorted by its first column that split no key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and held[-1].column(0)[0].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def regroup(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(shared.partitions(df.sparkSession), key).sortWithinPartitions(key)


def decoded(raw: list[bytes], kind: str) -> np.ndarray:
    """Codes as floats that hold them, and for one byte also their products, without loss."""
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float32 if kind == "i1" else np.float64)


def nearness(x: np.ndarray) -> np.ndarray:
    """Negative squared distances between the rows of x, or of each of a stack of such arrays."""
    # from a row among them, so that near rows far from the origin lose no digits
    x = x - x[..., :1, :]
    size = np.einsum("...i,...i->...", x, x)
    return np.minimum(2 * (x @ np.swapaxes(x, -1, -2)) - size[..., :, None] - size[..., None, :], 0)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    e = vectors[embedding].cast("array<double>")
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), e.alias("e")).where("vec_id is not null and size(e) > 0")
    rows = rows.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0))
    # a row a length of vectors
    length = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("e") == (length["n"] if length else 0))


def scaled(df: DataFrame) -> DataFrame:
    """vec_id and e times the power of two that brings its largest component to 0.5 to 1: cosines stay as they are, to the bit,
    and squares stay finite."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
                at = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["vec_id", "e"])

    return df.select("vec_id", "e").mapInArrow(work, "vec_id long, e array<double>")


def units(batch: pa.RecordBatch, column: int) -> np.ndarray:
    x = batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def ranges(nodes: DataFrame) -> tuple[np.ndarray, float]:
    """The middle of each component's range over all unit vectors, and half the widest range."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for b in batches:
            if b.num_rows:
                x = units(b, 0)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low), pa.array(high)], names=["i", "low", "high"])

    # a row a component
    got = nodes.select("e").mapInArrow(work, "i long, low double, high double").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    low, high = np.array([r["low"] for r in got]), np.array([r["high"] for r in got])
    return (low + high) / 2, float(max((high - low).max(initial=0) / 2, 1e-300))


def coded(nodes: DataFrame, middle: np.ndarray, half: float, kind: str) -> DataFrame:
    """node and its unit vector as q, one signed whole number a component."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.iinfo(kind).max
        for b in batches:
            if b.num_rows:
                small = np.clip(np.rint((units(b, 1) - middle) / half * most), -most, most).astype(kind)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in small], pa.binary())], names=["node", "q"])

    return shared.keep(nodes.select("node", "e").mapInArrow(work, "node long, q binary"), "codes")


def depth_of(n: int, leaf: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n / leaf))))


def trees_of(sample: np.ndarray, n: int, trees: int, leaf: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each tree and level: a hyperplane and the median of each cell, by cell number; cells of levels for which the sample
    is too small have the median of the cell above them that it is large enough for."""
    rng, depth, out = np.random.default_rng(SEED), depth_of(n, leaf), []
    known = max(0, int(math.log2(max(1, len(sample) / CELL_SAMPLE))))
    for _ in range(trees):
        cell, levels = np.zeros(len(sample), np.int64), []
        for d in range(depth):
            plane = rng.normal(size=sample.shape[1])
            along = sample @ plane
            by = np.lexsort((along, cell))
            edges = np.searchsorted(cell[by], np.arange(2 ** min(d, known) + 1))
            middle = along[by][np.clip((edges[:-1] + edges[1:]) // 2, 0, max(0, len(by) - 1))] if len(by) else np.zeros(2 ** min(d, known))
            levels.append((plane, middle))
            if d < known:
                cell = cell * 2 + (along > middle[cell])
        out.append(levels)
    return out


def cells_of(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    cell = np.zeros(len(x), np.int64)
    for d, (plane, middle) in enumerate(levels):
        cell = cell * 2 + (x @ plane > middle[cell >> (d - (len(middle).bit_length() - 1))])
    return cell


def first_graph(nodes: DataFrame, n: int, kind: str) -> DataFrame:
    picked = nodes.select("q").where(F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(1 << 30)) < max(1, int((1 << 30) * min(1.0, SAMPLE / max(1, n))))).limit(2 * SAMPLE).collect()
    sample = decoded([r["q"] for r in picked], kind) if picked else np.zeros((0, 1), np.float32)
    trees = trees_of(sample, n, TREES, LEAF)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = decoded(b.column(1).to_pylist(), kind)
            for t, levels in enumerate(trees):
                yield pa.RecordBatch.from_arrays([pa.array(cells_of(x, levels) + (t << 48)), b.column(0), b.column(1)], names=["leaf", "node", "q"])

    def nearest(table: pa.Table) -> pa.Table:
        u, x = table.column("node").to_numpy(), decoded(table.column("q").to_pylist(), kind)
        k, out = min(K, len(u) - 1), []
        near = nearness(x)
        for lo in range(0, len(u) if k else 0, 512):
            s = near[lo : lo + 512]
            s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
            j = np.argpartition(-s, k - 1, axis=1)[:, :k]
            out.append(_lists(np.repeat(u[lo : lo + 512], k), u[j].ravel(), np.take_along_axis(s, j, 1).ravel(), k))
        empty = pa.schema([("u", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float32()))]).empty_table()
        return pa.Table.from_batches(out).cast(empty.schema) if out else empty

    placed = shared.keep(nodes.select("node", "q").mapInArrow(place, "leaf long, node long, q binary"), "leaves")
    # leaves are counted so that one that a cluster fills is dealt to parts of bounded size
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * LEAF)).cast("int").alias("parts"))
    dealt = placed.join(sizes, "leaf").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    return merged(dealt.select("leaf", "part", "node", "q").groupBy("leaf", "part").applyInArrow(nearest, LISTS))


def merged(lists: DataFrame) -> DataFrame:
    """One list of the K nearest from all lists of a node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            n = t.column("ids").combine_chunks().value_lengths().to_numpy()
            yield _lists(np.repeat(t.column("u").to_numpy(), n), t.column("ids").combine_chunks().flatten().to_numpy(), t.column("scores").combine_chunks().flatten().to_numpy(), K)

    return shared.keep(regroup(lists, "u").mapInArrow(work, LISTS), "graph")


def descend(graph: DataFrame, nodes: DataFrame, turn: int, kind: str) -> DataFrame:
    """A round of NN-descent: neighbours of a pivot, forward and backward, meet at it."""
    out = graph.select(F.col("u").alias("p"), F.explode("ids").alias("m"))
    both = out.union(out.select("m", "p")).distinct()
    rank = F.row_number().over(Window.partitionBy("p").orderBy(F.xxhash64("p", "m", F.lit(turn))))
    met = both.withColumn("r", rank).where(F.col("r") <= MEET)
    none = F.lit(float("-inf")).cast("float")
    worst = graph.select(F.col("u").alias("m"), F.when(F.size("scores") < K, none).otherwise(F.element_at("scores", -1)).alias("worst"))
    told = nodes.select(F.col("node").alias("m"), "q").join(worst, "m", "left").withColumn("worst", F.coalesce("worst", none))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            p, m, worst = (table.column(c).to_numpy() for c in ("p", "m", "worst"))
            x = decoded(table.column("q").to_pylist(), kind)
            step = max(1, min(512, (4 << 20) // (MEET * x.shape[1])))
            heads = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            counts = np.diff(np.r_[heads, len(p)])
            for lo in range(0, len(heads), step):
                h, c = heads[lo : lo + step], counts[lo : lo + step]
                here = np.arange(MEET)[None, :] < c[:, None]
                row = np.minimum(h[:, None] + np.arange(MEET), len(p) - 1)
                s = nearness(x[row])
                s[~(here[:, :, None] & here[:, None, :])] = -np.inf
                s[:, np.arange(MEET), np.arange(MEET)] = -np.inf
                # of equally near ones the smaller id displaces the larger
                s[s < worst[row][:, :, None]] = -np.inf
                j = np.argpartition(-s, OFFERS - 1, axis=2)[:, :, :OFFERS]
                v = np.take_along_axis(s, j, 2)
                a, b, o = np.nonzero(v > -np.inf)
                if len(a):
                    yield _lists(m[row[a, b]], m[row[a, j[a, b, o]]], v[a, b, o], MEET * OFFERS)

    offers = regroup(met.join(told, "m").select("p", "m", "worst", "q"), "p").mapInArrow(meet, LISTS)
    return merged(graph.union(offers))


def changed(old: DataFrame, new: DataFrame) -> float:
    """The share of entries of the new lists that the old ones did not have."""
    both = new.join(old.select("u", F.col("ids").alias("had")), "u", "left")
    got, total = both.agg(F.sum(F.size(F.array_except("ids", F.coalesce("had", F.array().cast("array<long>"))))), F.sum(F.size("ids"))).first()
    return (got or 0) / max(1, total or 0)


def blurred(graph: DataFrame, k: int, width: int) -> float:
    """The share of full lists in which rounding of codes may take a node past the last for one of the k nearest."""
    kth, last = -F.element_at("scores", min(k, K)).cast("double"), -F.element_at("scores", -1).cast("double")
    # two codes differ from what they stand for by an error of variance 1/6 a component, whose square varies by 7/180
    error = F.sqrt(last * 4 / 6 + width * 7 / 180)
    return graph.where(F.size("scores") == K).agg(F.avg((last - kth < SHARP * error).cast("int"))).first()[0] or 0.0


def settled_graph(nodes: DataFrame, n: int, k: int) -> tuple[DataFrame, DataFrame, str]:
    """The first graph, improved by rounds of descent until hardly an entry changes, on the coarsest codes that tell its nodes
    apart; these codes and their kind."""
    middle, half = ranges(nodes)
    for kind in KINDS:
        fine, codes = kind == KINDS[-1], coded(nodes, middle, half, kind)
        graph, turn, share = first_graph(codes, n, kind), 0, 1.0
        if fine or blurred(graph, k, len(middle)) <= BLURRED:
            while turn < ROUNDS or share > SETTLED:
                last, graph = graph, descend(graph, codes, turn, kind)
                turn += 1
                if turn >= ROUNDS:
                    share = changed(last, graph)
                shared.forget(last)
            if fine or blurred(graph, k, len(middle)) <= BLURRED:
                break
        shared.forget(graph)
        shared.forget(codes)
    return graph, codes, kind


def advance(batches: Iterator[pa.RecordBatch], ef: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Pools after a round: rows without w are the pools, of which the first STEP open entries close; the others are reached."""
    for table in whole_groups(batches):
        old = table.filter(pc.is_null(table.column("w"))).combine_chunks()
        new = table.filter(pc.is_valid(table.column("w"))).combine_chunks()
        u, flat = old.column("u").to_numpy(), [old.column(c).combine_chunks() for c in ("ids", "scores", "open")]
        n = flat[0].value_lengths().to_numpy()
        ids, scores, open_ = (x.flatten().to_numpy(zero_copy_only=False) for x in flat)
        before = np.cumsum(open_) - open_
        head = np.r_[0, np.cumsum(n)][:-1]
        open_ = open_ & (before - np.repeat(np.r_[before, 0][head], n) >= STEP)
        q, pool = decoded(old.column("q").to_pylist(), kind), np.repeat(np.arange(len(u)), n)
        if new.num_rows:
            own = np.searchsorted(u, new.column("u").to_numpy())
            x = decoded(new.column("x").to_pylist(), kind) - q[own]
            ids, pool, open_ = np.r_[ids, new.column("w").to_numpy()], np.r_[pool, own], np.r_[open_, np.ones(len(own), bool)]
            scores = np.r_[scores, -np.einsum("ij,ij->i", x, x)]
        by = np.lexsort((ids, -scores, pool))
        ids, scores, open_, pool = ids[by], scores[by], open_[by], pool[by]
        edges = np.searchsorted(pool, np.arange(len(u) + 1))
        near = np.arange(len(pool)) - edges[pool] < ef
        at = pa.array(np.r_[0, np.cumsum(np.minimum(np.diff(edges), ef))].astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(x[near], t)) for x, t in ((ids, pa.int64()), (scores, pa.float32()), (open_, pa.bool_()))]
        yield pa.RecordBatch.from_arrays([old.column("u").combine_chunks(), old.column("q").combine_chunks(), *lists], names=["u", "q", "ids", "scores", "open"])


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, kind: str, ef: int = EF) -> DataFrame:
    """u, ids: for each query node the nearest nodes found, nearest first."""
    state = "u long, q binary, ids array<long>, scores array<float>, open array<boolean>"
    start = queries.join(nodes.select("node", "q"), "node").join(graph, F.col("node") == F.col("u"), "left").select(F.col("node").alias("u"), "q", F.coalesce("ids", F.array().cast("array<long>")).alias("ids"), F.coalesce("scores", F.array().cast("array<float>")).alias("scores"), F.coalesce(F.transform("ids", lambda x: F.lit(True)), F.array().cast("array<boolean>")).alias("open"))
    # a pool is sorted, so its first STEP open entries are the nearest ones
    now = shared.keep(start, "pools")
    while True:
        front = now.select("u", F.explode(F.slice(F.filter(F.arrays_zip("ids", "open"), lambda z: z["open"]), 1, STEP)).alias("z")).select("u", F.col("z.ids").alias("v"))
        if not shared.has_rows(front):
            return now.select("u", "ids")
        reached = front.join(graph.select(F.col("u").alias("v"), "ids"), "v").select("u", F.explode("ids").alias("w")).where("u != w").distinct()
        # what a pool has needs no measuring again
        known = now.select("u", F.explode("ids").alias("w"))
        seen = reached.join(known, ["u", "w"], "left_anti").join(nodes.select(F.col("node").alias("w"), F.col("q").alias("x")), "w").select("u", "w", "x")
        rows = now.select("u", F.lit(None).cast("long").alias("w"), F.lit(None).cast("binary").alias("x"), "q", "ids", "scores", "open").unionByName(seen, allowMissingColumns=True)

        last, now = now, shared.keep(regroup(rows, "u").mapInArrow(lambda b: advance(b, ef, kind), state), "pools")
        shared.forget(last)


def nearest_neighbours(vectors: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by every."""
    rows = shared.keep(scaled(usable(vectors, vec_id, embedding).groupBy("vec_id").agg(F.min("e").alias("e"))), "vectors")
    order = F.row_number().over(Window.partitionBy("e").orderBy("vec_id"))
    # k+1 ids of a node are all that its neighbours, or one of its own rows, can ask for
    firsts = rows.withColumn("r", order).where(F.col("r") <= k + 1).groupBy("e").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    nodes = shared.keep(firsts.select(F.element_at("members", 1).alias("node"), "e", "members"), "nodes")
    asked = shared.keep(rows.where(F.col("vec_id") % every == 0).join(nodes.select("node", "e"), "e").select("vec_id", "node"), "queries")
    n = nodes.count()
    graph, codes, kind = settled_graph(nodes, n, k)
    found = search(graph, codes, asked.select("node").distinct(), kind, EF + EF_A_LEVEL * depth_of(n, LEAF))
    # a query's own node counts: other rows may hold the same vector
    pairs = found.select("u", F.explode(F.concat(F.array("u"), F.slice("ids", 1, RERANK))).alias("v"))
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own = nodes.select(F.col("node").alias("u"), F.col("e").alias("a"))
    told = pairs.join(nodes.select(F.col("node").alias("v"), F.col("e").alias("b"), "members"), "v").join(own, "u")
    scored = told.select("u", F.explode("members").alias("vec_id"), (square("a", "b") / (F.sqrt(square("a", "a")) * F.sqrt(square("b", "b")))).alias("score"))
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    tops = scored.withColumn("r", best("u")).where(F.col("r") <= k + 1).drop("r")
    out = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("u")).join(tops, "u").where("query_id != vec_id")
    return out.withColumn("rank", best("query_id")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The same from every pair of a query and a row, in blocks, to measure recall on."""
    rows = scaled(usable(vectors, "vec_id", "embedding").groupBy("vec_id").agg(F.min("e").alias("e")))
    asked = rows.where(F.col("vec_id") % every == 0).collect()
    if not asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ids, q = np.array([r["vec_id"] for r in asked]), np.array([r["e"] for r in asked])
    size = np.sqrt((q * q).sum(axis=1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            s = (q @ x.T) / (size[:, None] * np.sqrt((x * x).sum(axis=1)))
            s[ids[:, None] == v[None, :]] = -np.inf
            j = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
            score = np.take_along_axis(s, j, 1).ravel()
            real = np.isfinite(score)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, j.shape[1])[real]), pa.array(v[j].ravel()[real]), pa.array(score[real])], names=["query_id", "vec_id", "score"])

    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.mapInArrow(work, "query_id long, vec_id long, score double").withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
