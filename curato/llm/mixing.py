"""Mixing overlapping sources to target weights by min-cost flow.

Sources overlap where they hold equal texts: a text's membership is the set of sources that have it. Documents are added up by
membership pattern, so the flow network has a node for each pattern and each source and does not grow with the documents. A
pattern's words go to the quotas of its sources, to each no more than MOST_USES times the words of its documents there. The r-th
use of a pattern's different texts costs (r-1)**2, whichever source it is for, so repetition is convex and shared out before
anything repeats more than it must. Dijkstra's distances and blocking flows over the arcs of least cost solve it on the driver,
in whole words. Of the documents of a pattern in a source, its cell, each is taken flow // words times and the rest of the flow
comes from documents in the order of a seeded hash of their text, which begins in each cell where the cell of the pattern's
source before it ends, so that sources share out a pattern's texts and don't take the same ones.

That order is never sorted as a whole: words are added up by 12 bits of the text's place, the slice in which a cell's rest runs
out is added up by 12 bits of a hash of the document, and only documents of one such slice of a slice are ranked. Each cell then
takes the one document more that comes nearest to what is missing.

Defined results: a null or empty text has no words, belongs to its own source only and is taken 0 times; a null source is a
source of its own and comes last; a null doc_id is hashed as the empty string. Rows that repeat a doc_id, a text and a source are
taken alike. No words at all: targets and takes are 0. An empty table gives an empty table. Other columns are kept by
mixed_documents() and ignored by the digest.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curato.llm import shared

WEIGHTS, SHARE, MOST_USES, SEED = (3, 1, 2), 1.5, 2, 17
SLICE_BITS = 12


def words_of(text: Column) -> Column:
    r"""Number of `[^\x20\x09-\x0D]+`; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """total shared by weight; what passes most times a source's size is shared again among the others."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * unit >= most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ -= full
    return out


def use_costs(words: int, most: int) -> list[tuple[int, int]]:
    """(words, cost) of each further use of so many words, up to most words in all; past the eighth, uses double in one step."""
    out, r, step = [], 0, 1
    while most > 0 and words > 0:
        step = step if r < 8 else 2 * step
        # the middle use of a step stands for all of it
        out.append((min(most, words * step), (r + (step - 1) // 2) ** 2))
        most, r = most - words * step, r + step
    return out


def min_cost_flow(supply: list[int], members: list[list[int]], rooms: list[list[int]], quotas: list[int]) -> list[list[int]]:
    """flow[p][i]: words of pattern p for its source members[p][i], at most rooms[p][i].

    Arcs: start -> pattern for each use of its words, at its cost; pattern -> source; source -> end with the quota. Dijkstra over
    reduced costs finds the least distances; then all flow of that distance is pushed level by level before the next search.
    """
    np_, start, end = len(supply), 0, 1 + len(supply) + len(quotas)
    heads: list[list[int]] = [[] for _ in range(end + 1)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, c: int, w: int) -> int:
        for x, y, r, k in ((a, b, c, w), (b, a, 0, -w)):
            heads[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(k)
        return len(to) - 2

    for p, s in enumerate(supply):
        for words, price in use_costs(s, sum(rooms[p])):
            arc(start, 1 + p, words, price)
    between = [[arc(1 + p, 1 + np_ + j, rooms[p][i], 0) for i, j in enumerate(members[p])] for p in range(np_)]
    for j, q in enumerate(quotas):
        arc(1 + np_ + j, end, q, 0)
    potential = [0] * (end + 1)
    while True:
        far: list[float] = [float("inf")] * (end + 1)
        far[start], queue = 0, [(0, start)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in heads[x]:
                if room[e] and (n := d + cost[e] + potential[x] - potential[to[e]]) < far[to[e]]:
                    far[to[e]] = n
                    heapq.heappush(queue, (n, to[e]))
        if far[end] == float("inf"):
            return [[room[e ^ 1] for e in es] for es in between]
        # nodes farther than the end keep its distance, so reduced costs stay at 0 and above
        potential = [p + min(f, far[end]) for p, f in zip(potential, far, strict=True)]
        while _push(heads, to, room, cost, potential, start, end):
            pass


def _push(heads, to, room, cost, potential, start: int, end: int) -> bool:
    """Sends what arcs of reduced cost 0 carry by shortest ways in arcs; False if no way is left."""
    free = lambda x, e: room[e] and cost[e] + potential[x] == potential[to[e]]
    level, front = {start: 0}, [start]
    while front and end not in level:
        front = list({to[e]: None for x in front for e in heads[x] if free(x, e) and to[e] not in level})
        level |= dict.fromkeys(front, max(level.values()) + 1)
    if end not in level:
        return False
    at = dict.fromkeys(level, 0)
    way: list[int] = []
    x = start
    while True:
        if x == end:
            least = min(room[e] for e in way)
            for e in way:
                room[e] -= least
                room[e ^ 1] += least
            cut = next(i for i, e in enumerate(way) if not room[e])
            x = to[way[cut] ^ 1]
            way = way[:cut]
            continue
        while at[x] < len(heads[x]):
            e = heads[x][at[x]]
            if free(x, e) and level.get(to[e], -1) == level[x] + 1:
                break
            at[x] += 1
        if at[x] < len(heads[x]):
            way.append(heads[x][at[x]])
            x = to[way[-1]]
        elif x == start:
            return True
        else:
            e = way.pop()
            x = to[e ^ 1]
            at[x] += 1


def with_patterns(rows: DataFrame) -> DataFrame:
    """rows (at, size, source, h: hash of the text) with own and pattern: the source, and all that hold the text, null last."""
    own = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    named = rows.withColumn("own", own)
    several = named.where("size > 0").groupBy("h", "size").agg(F.sort_array(F.collect_set("own")).alias("pattern")).where("size(pattern) > 1")
    # written, so that Spark can split the join at a text that a large part of all rows has
    return named.join(shared.keep(several, "several"), ["h", "size"], "left").withColumn("pattern", F.coalesce("pattern", F.array("own")))


def mix_sources(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, uses: int = MOST_USES, seed: int = SEED) -> tuple[DataFrame, dict]:
    """rows (at, size, source, h) with a column taken (words); and the plan: names, sizes and targets of the sources.

    Weights repeat over the sources in order of code points, null last.
    """
    spark = rows.sparkSession
    known = shared.keep(with_patterns(rows), "patterns")
    key = lambda pattern: tuple((x["none"], x["name"]) for x in pattern)
    # as many rows as kinds of membership and their sources
    words = {(key(r["pattern"]), (r["own"]["none"], r["own"]["name"])): int(r["w"]) for r in known.groupBy("pattern", "own").agg(F.sum("size").alias("w")).collect()}
    single = {key(r["pattern"]): int(r["u"]) for r in known.groupBy("pattern", "h", "size").agg(F.lit(1).alias("one")).groupBy("pattern").agg(F.sum("size").alias("u")).collect()}
    names = sorted({own for _, own in words})
    at = {x: i for i, x in enumerate(names)}
    sizes = [sum(w for (_, own), w in words.items() if own == x) for x in names]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(sizes), uses)
    order = sorted(single)
    members = [[x for x in p if (p, x) in words] for p in order]
    flow = min_cost_flow([single[p] for p in order], [[at[x] for x in m] for m in members], [[uses * words[p, x] for x in m] for p, m in zip(order, members, strict=True)], [round(g) for g in goal])
    table, told = [], []
    for p, m, f in zip(order, members, flow, strict=True):
        shift = 0.0
        for x, own_flow in zip(m, f, strict=True):
            w = words[p, x]
            times, rest = divmod(own_flow, w) if w else (0, 0)
            table.append((list(p), x, len(table), times, rest, int(shift * (1 << SLICE_BITS)) % (1 << SLICE_BITS)))
            told.append((len(table) - 1, times, rest))
            shift += rest / w if w else 0.0
    plan = {"names": [None if none else name for none, name in names], "sizes": sizes, "targets": goal}
    kind = "struct<none:boolean,name:string>"
    cells = spark.createDataFrame(table, f"pattern array<{kind}>, own {kind}, cell int, times long, rest long, shift int")
    h = F.xxhash64(F.coalesce(F.col("at").cast("string"), F.lit("")), "h", "size", F.lit(seed))
    top = lambda c: F.shiftrightunsigned(c, 64 - SLICE_BITS).cast("int")
    # the tables below have a row a cell; broadcasting them is bounded by the kinds of membership
    placed = known.join(F.broadcast(cells.drop("times", "rest")), ["pattern", "own"]).withColumn("k", h)
    placed = placed.withColumn("s1", F.pmod(top(F.xxhash64("h", F.lit(seed))) - F.col("shift"), F.lit(1 << SLICE_BITS))).withColumn("s2", top("k"))
    cut = shared.keep(placed.select("at", "size", "source", F.col("h").alias("text_hash"), "cell", "k", "s1", "s2"), "cells")
    told = spark.createDataFrame(told, "cell int, times long, rest long")

    def runs_out(sliced: DataFrame, slice_: str, left: str) -> DataFrame:
        """For each cell: the slice in which its words pass left, and what is left before that slice."""
        before = F.coalesce(F.sum("w").over(Window.partitionBy("cell").orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sliced.groupBy("cell", slice_, left).agg(F.sum("size").alias("w")).withColumn("before", before)
        return sums.where(f"before <= {left} and before + w > {left}").select("cell", F.col(slice_).alias(f"{slice_}_end"), (F.col(left) - F.col("before")).alias(f"{left}_"))

    first = shared.keep(runs_out(cut.join(F.broadcast(told), "cell"), "s1", "rest"), "slice")
    second = shared.keep(runs_out(cut.join(F.broadcast(first), "cell").where("s1 = s1_end"), "s2", "rest_"), "slice")
    ends = told.join(F.broadcast(first), "cell", "left").join(F.broadcast(second), "cell", "left").select("cell", "times", "s1_end", "s2_end", F.col("rest__").alias("last"))
    placed = cut.join(F.broadcast(ends), "cell")
    inside = (F.col("s1") < F.col("s1_end")) | ((F.col("s1") == F.col("s1_end")) & (F.col("s2") < F.col("s2_end")))
    edge = (F.col("s1") == F.col("s1_end")) & (F.col("s2") == F.col("s2_end"))
    # the slice of a slice in which words run out has one document in 16 million, or of a text's copies one in 4096
    fits = placed.where(edge).withColumn("sum", F.sum("size").over(Window.partitionBy("cell").orderBy("k", "size"))).withColumn("fits", F.col("sum") <= F.col("last"))
    fits = shared.keep(fits.select("cell", "k", "size", "fits"), "edge")
    missing = ends.join(fits.where("fits").groupBy("cell").agg(F.sum("size").alias("got")), "cell", "left").select("cell", (F.col("last") - F.coalesce("got", F.lit(0))).alias("gap"))
    picked = fits.where("fits").select("cell", "k").distinct()
    spare = placed.where(~inside & (F.col("size") > 0) & F.col("s1_end").isNotNull()).join(F.broadcast(picked), ["cell", "k"], "left_anti")
    nearest = spare.join(F.broadcast(missing), "cell").groupBy("cell").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "k", "gap")).alias("m")).where("m.off < m.gap")
    more = picked.union(shared.keep(nearest.select("cell", F.col("m.k").alias("k")), "extra")).distinct().withColumn("more", F.lit(1))
    once = F.when(inside & F.col("s1_end").isNotNull() & ~F.coalesce(edge, F.lit(False)), 1).otherwise(0)
    out = placed.withColumn("once", once).join(F.broadcast(more), ["cell", "k"], "left")
    taken = F.col("size") * (F.col("times") + F.greatest("once", F.coalesce("more", F.lit(0))))
    return out.select("at", "size", "source", F.col("text_hash").alias("h"), taken.alias("taken")), plan


def _rows(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    own = docs[text].cast("string")
    return docs.select(docs[doc_id].alias("at"), words_of(own).alias("size"), docs[source].cast("string").alias("source"), text_hash(own).alias("h"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    rows = shared.keep(_rows(docs, "doc_id", "text", "source"), "sizes")
    out, plan = mix_sources(rows)
    told = docs.sparkSession.createDataFrame([(n, s, float(t)) for n, s, t in zip(plan["names"], plan["sizes"], plan["targets"], strict=True)], "name string, source_size long, target double")
    # a row a source
    return out.join(F.broadcast(told), out["source"].eqNullSafe(told["name"])).select(F.col("at").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it: rows taken 0 times go, rows taken twice repeat, rows without words stay."""
    rows = shared.keep(_rows(docs, doc_id, text, source), "sizes")
    out, _ = mix_sources(rows)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(1)
    a, n, c, b, m, d, u = (shared.free_name(docs, f"__{x}") for x in ("at", "hash", "source", "own_at", "own_hash", "own_source", "uses"))
    keyed = docs.withColumns({a: docs[doc_id], n: text_hash(docs[text].cast("string")), c: docs[source].cast("string")})
    uses = out.select("at", "h", "source", times.alias("uses")).distinct().where("uses > 0").toDF(b, m, d, u)
    both = keyed.join(uses, F.col(a).eqNullSafe(F.col(b)) & (F.col(n) == F.col(m)) & F.col(c).eqNullSafe(F.col(d)))
    return both.withColumn(u, F.explode(F.sequence(F.lit(1), F.col(u)))).select(*[F.col(f"`{c}`") for c in docs.columns])
