"""Knowledge-graph operators over edges(src, rel, dst) and nodes(id, type).

Paths grow by one join a hop, bounded by hops; iterative ones checkpoint each round and stop when nothing changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curato.operators.nearness import erased, stored, written


def build(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G-01, X5, X6: nodes keyed by id and type, with mentions; distinct edges. triples(head, head_type, relation, tail, tail_type)."""
    ends = triples.select(F.col("head").alias("id"), F.col("head_type").alias("type")).unionByName(triples.select(F.col("tail").alias("id"), F.col("tail_type").alias("type")))
    nodes = ends.groupBy("id", "type").agg(F.count(F.lit(1)).alias("mentions"))
    return nodes, triples.select(F.col("head").alias("src"), F.col("relation").alias("rel"), F.col("tail").alias("dst")).distinct()


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A-13: counts of node types and of relations."""
    return nodes.groupBy(F.lit("node").alias("kind"), F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n")).unionByName(edges.groupBy(F.lit("relation").alias("kind"), F.col("rel").alias("name")).agg(F.count(F.lit(1)).alias("n")))


def both_ways(edges: DataFrame) -> DataFrame:
    """J-11, U-02: out and in edges of each node, with their direction."""
    out = edges.select(F.col("src").alias("id"), "rel", F.col("dst").alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("dst").alias("id"), "rel", F.col("src").alias("other"), F.lit("in").alias("direction")))


def neighbours(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """G-03, G-16: out-neighbours of the starts (id)."""
    return edges.join(starts.select(F.col("id").alias("src")), "src").select("src", "rel", "dst")


def paths(edges: DataFrame, starts: DataFrame, hops: int, ends: DataFrame | None = None) -> DataFrame:
    """G-04, G-06, G-15: simple paths of 1 to so many hops from the starts, to the ends if given: nodes, rels, hops."""
    now = starts.select(F.array("id").alias("nodes"), F.array().cast("array<string>").alias("rels"))
    found = None
    for hop in range(1, hops + 1):
        grown = now.withColumn("src", F.element_at("nodes", -1)).join(edges, "src").where(~F.array_contains("nodes", F.col("dst")))
        now = grown.select(F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("rels", F.array("rel")).alias("rels"))
        step = now.withColumn("hops", F.lit(hop))
        found = step if found is None else found.unionByName(step)
    if ends is not None:
        found = found.withColumn("id", F.element_at("nodes", -1)).join(ends.select("id"), "id", "left_semi").drop("id")
    return found


def best_paths(edges: DataFrame, asked: DataFrame, weights: dict[str, float], k: int = 10, hops: int = 5, other: float = 0.5) -> DataFrame:
    """G-07, Q-08: start, end, rank, score, nodes, rels: for each asked (start, end) the k simple paths of the best score, .7 of the mean
    weight of the relations + .3 / (1 + hops), of equal ones the first as text.

    Paths grow by a join a hop. Fewest hops from each node to the ends, found first, leave out what can't arrive any more, and
    a path is dropped once the best score it can still reach, with the largest weight on all hops that are left, is below the
    k-th best that its question has. Of what has arrived only k rows a question stay.
    """
    asked = stored(asked.select("start", "end").where("start != end").distinct())
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    left = distances(back, asked.select(F.col("end").alias("id")), hops).select(F.col("start").alias("end"), F.col("at").alias("dst"), F.col("d").alias("left"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("rel")], F.lit(other)) if weights else F.lit(other)
    steps = stored(edges.select("src", "rel", "dst", weight.alias("w")).distinct())
    top = steps.agg(F.max("w")).first()[0] or 0.0
    score = lambda total, n: F.round(0.7 * total / n + 0.3 / (1 + n), 9)
    now = asked.select("start", "end", F.col("start").alias("src"), F.array("start").alias("nodes"), F.array().cast("array<string>").alias("rels"), F.lit(0.0).alias("total"))
    found = None
    order = Window.partitionBy("start", "end").orderBy(F.desc("score"), F.concat_ws(">", F.transform("nodes", lambda n: n.cast("string"))), F.concat_ws(">", "rels"))
    for hop in range(1, hops + 1):
        grown = now.join(steps, "src").where(~F.array_contains("nodes", F.col("dst"))).join(left, ["end", "dst"]).where(F.col("left") + hop <= hops)
        grown = grown.select("start", "end", F.col("dst").alias("src"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("rels", F.array("rel")).alias("rels"), (F.col("total") + F.col("w")).alias("total"), "left")
        grown = stored(grown)
        arrived = grown.where("left = 0").select("start", "end", score(F.col("total"), hop).alias("score"), "nodes", "rels")
        met = arrived if found is None else found.drop("rank").unionByName(arrived)
        found = stored(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        worst = found.where(F.col("rank") == k).select("start", "end", F.col("score").alias("worst"))
        # the mean weight may rise with more hops and the other part falls, so all lengths that are left are tried
        ends = [F.when(F.col("left") + hop <= n, score(F.col("total") + top * (n - hop), n)) for n in range(hop + 1, hops + 1)]
        if not ends:
            break
        bound = F.greatest(*ends) if len(ends) > 1 else ends[0]
        now = grown.where("left > 0").join(worst, ["start", "end"], "left").where(F.col("worst").isNull() | (bound >= F.col("worst"))).drop("worst", "left")
    return found.select("start", "end", "rank", "score", "nodes", "rels")


def explained(nodes: Column, rels: Column) -> Column:
    """G-06, G-07: a path as text."""
    return F.concat(F.element_at(nodes, 1).cast("string"), F.array_join(F.transform(rels, lambda r, i: F.concat(F.lit(" -["), r, F.lit("]-> "), F.element_at(nodes, i + 2).cast("string"))), ""))


def distances(edges: DataFrame, starts: DataFrame, cutoff: int | None = 5) -> DataFrame:
    """G-05, A-33: fewest hops from each start to each node, up to a cutoff if there is one."""
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("at")).distinct()
    seen = stored(front.withColumn("d", F.lit(0)))
    links = edges.select("src", "dst").distinct()
    front, d = seen, 0
    while cutoff is None or d < cutoff:
        d += 1
        new = front.join(links, front["at"] == links["src"]).select("start", F.col("dst").alias("at")).distinct().join(seen.select("start", "at"), ["start", "at"], "left_anti")
        front = stored(new.withColumn("d", F.lit(d)))
        if front.isEmpty():
            break
        seen = stored(seen.unionByName(front))
    return seen


def ego(edges: DataFrame, centre: DataFrame, radius: int) -> DataFrame:
    """G-08, K-07: edges among nodes within so many hops, either way, of the centre (id)."""
    undirected = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("rel", F.lit(""))
    inside = distances(undirected, centre, radius).select("at").distinct()
    return edges.join(inside.select(F.col("at").alias("src")), "src", "left_semi").join(inside.select(F.col("at").alias("dst")), "dst", "left_semi")


def degree_centrality(edges: DataFrame) -> DataFrame:
    """G-09: parallel edges count, so it can pass 1."""
    d = both_ways(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return d.join(d.agg(F.count(F.lit(1)).alias("n")), F.lit(True)).select("id", "degree", (F.col("degree") / F.greatest(F.lit(1), F.col("n") - 1)).alias("centrality"))


def eigenvector(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """G-10: power iteration on the simple graph, scaled by the largest value each round."""
    links = stored(edges.select("src", "dst").where("src != dst").distinct())
    now = stored(links.select(F.col("src").alias("id")).union(links.select("dst")).distinct().withColumn("x", F.lit(1.0)))
    for _ in range(rounds):
        sums = links.join(now, links["src"] == now["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("s"))
        new = now.join(sums, "id", "left").select("id", (F.col("x") + F.coalesce("s", F.lit(0.0))).alias("x"))
        now = stored(new.join(new.agg(F.max("x").alias("m")), F.lit(True)).select("id", (F.col("x") / F.col("m")).alias("x")))
    return now


def betweenness(edges: DataFrame, sources: DataFrame, cutoff: int | None = 5) -> DataFrame:
    """G-10: share of shortest paths between a source and a node that pass through a third, summed, for these sources.

    Counts of shortest paths grow level by level and dependencies shrink level by level, as joins over (source, node);
    with all nodes as sources and no cutoff it is exact.
    """
    links = stored(edges.select("src", "dst").where("src != dst").distinct())
    level = stored(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("sigma"), F.lit(0).alias("d")))
    levels = [level]
    seen, d = level, 0
    while cutoff is None or d < cutoff:
        d += 1
        new = level.join(links, level["v"] == links["src"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma")).join(seen.select("s", "v"), ["s", "v"], "left_anti")
        level = stored(new.withColumn("d", F.lit(d)))
        if level.isEmpty():
            break
        levels.append(level)
        seen = stored(seen.unionByName(level))
    total = None
    deeper = levels[-1].select("s", "v", "sigma", F.lit(0.0).alias("delta"))
    for upper in reversed(levels[:-1]):
        w = deeper.select("s", F.col("v").alias("w"), F.col("sigma").alias("sw"), "delta")
        back = upper.join(links, upper["v"] == links["src"]).select("s", "v", "sigma", F.col("dst").alias("w")).join(w, ["s", "w"])
        gain = back.groupBy("s", "v").agg(F.sum(F.col("sigma") / F.col("sw") * (1 + F.col("delta"))).alias("delta"))
        deeper = stored(upper.select("s", "v", "sigma").join(gain, ["s", "v"], "left").select("s", "v", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        part = deeper.where("s != v").select("v", "delta")
        total = part if total is None else total.unionByName(part)
    if total is None:
        return links.select(F.col("src").alias("id"), F.lit(0.0).alias("betweenness")).limit(0)
    return total.groupBy(F.col("v").alias("id")).agg(F.sum("delta").alias("betweenness"))


def closeness(dist: DataFrame) -> DataFrame:
    """G-10: of each node by distances to it, weighed by the share of nodes that reach it."""
    n = dist.agg(F.countDistinct("at").alias("n"))
    per = dist.where("d > 0").groupBy(F.col("at").alias("id")).agg(F.sum("d").alias("total"), F.count(F.lit(1)).alias("r"))
    return per.join(n, F.lit(True)).select("id", (F.col("r") / F.col("total") * F.col("r") / F.greatest(F.lit(1), F.col("n") - 1)).alias("closeness"))


def neighbourhoods(edges: DataFrame, lg: int = 12, rounds: int = 64, settled: float = 0.0) -> DataFrame:
    """G-13, A-33, G-10 at size: id, reach: how many nodes reach it in at most 0, 1, 2 and so on hops, by HyperLogLog.

    Each node holds a sketch of the nodes that reach it, of at most 2^lg bytes, and each round takes the union with those of the
    nodes before it: one join and one partial aggregation on the edges, whatever the number of pairs. Ends when no round adds more
    than a share `settled` of the pairs, or after `rounds` hops. The relative standard error of a count is 1.04 / 2^(lg / 2),
    1.6 % at 12, and counts of some hundred are nearly exact. Edges with a null end are none; loops and repeats add nothing.
    """
    links = stored(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src != dst").distinct())
    every = edges.select(F.col("src").alias("id")).union(edges.select("dst")).where("id IS NOT NULL").distinct()
    # keys of one kind for all types of ids
    now = every.groupBy("id").agg(F.hll_sketch_agg(F.col("id").cast("string"), lg).alias("sketch")).withColumn("reach", F.array(F.lit(1).cast("long")))
    now = stored(now)
    before = float(now.count())
    for _ in range(rounds):
        told = links.join(now.select(F.col("id").alias("src"), "sketch"), "src").select(F.col("dst").alias("id"), "sketch", F.lit(None).cast("array<bigint>").alias("reach"))
        met = now.unionByName(told).groupBy("id").agg(F.hll_union_agg("sketch").alias("sketch"), F.max("reach").alias("reach"))
        # an estimate may waver; a node never loses what reached it
        met = met.withColumn("n", F.greatest(F.hll_sketch_estimate("sketch"), F.element_at("reach", -1)))
        new = stored(met.select("id", "sketch", F.concat("reach", F.array("n")).alias("reach")))
        pairs = float(new.agg(F.sum(F.element_at("reach", -1))).first()[0] or 0)
        if pairs <= before * (1 + settled):
            break
        now, before = new, pairs
    return now.select("id", "reach")


def sketched_lengths(reach: DataFrame, share: float = 0.9) -> DataFrame:
    """G-13, A-33: pairs, avg_path_length, diameter (the most hops that add a pair) and effective_diameter (hops that hold a share of
    the pairs, between two numbers in proportion) of neighbourhoods. No pair: one row with 0 pairs and nulls."""
    level = reach.select(F.posexplode("reach").alias("d", "n")).groupBy("d").agg((F.sum("n") - F.count(F.lit(1))).alias("n"))
    # a row a hop
    hops = level.agg(F.sort_array(F.collect_list(F.struct("d", "n"))).alias("h")).select(F.transform("h", lambda x: x["n"].cast("double")).alias("n")).withColumn("all", F.coalesce(F.element_at("n", F.when(F.size("n") > 0, -1)), F.lit(0.0)))
    gains = F.transform(F.slice("n", 2, F.greatest(F.lit(0), F.size("n") - 1)), lambda x, i: (i + 1) * (x - F.element_at("n", i + 1)))
    over = F.filter(F.transform("n", lambda x, i: F.when(x >= share * F.col("all"), i)), lambda i: i.isNotNull())[0]
    low, high = F.element_at("n", over), F.element_at("n", over + 1)
    made = hops.withColumn("over", over).select(
        F.col("all").cast("long").alias("pairs"), F.when(F.col("all") > 0, F.aggregate(gains, F.lit(0.0), lambda s, x: s + x) / F.col("all")).alias("avg_path_length"),
        F.when(F.col("all") > 0, F.size("n") - 1).alias("diameter"), F.when(F.col("all") > 0, F.when(over == 0, 0.0).otherwise(over - 1 + (share * F.col("all") - low) / (high - low))).alias("effective_diameter"),
    )
    return made


def sketched_closeness(reach: DataFrame) -> DataFrame:
    """G-10: as closeness, of neighbourhoods, for nodes that others reach."""
    n = reach.agg(F.count(F.lit(1)).alias("n"))
    far = F.aggregate(F.transform(F.slice("reach", 2, F.size("reach")), lambda x, i: (i + 1) * (x - F.element_at("reach", i + 1))), F.lit(0).cast("long"), lambda s, x: s + x)
    per = reach.select("id", (F.element_at("reach", -1) - 1).alias("r"), far.alias("total")).where("r > 0")
    return per.join(n, F.lit(True)).select("id", (F.col("r") / F.col("total") * F.col("r") / F.greatest(F.lit(1), F.col("n") - 1)).alias("closeness"))


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """G-11, X15: label propagation; a node takes its neighbours' commonest label, of equal ones the smallest."""
    links = stored(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct())
    now = stored(links.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
    for _ in range(rounds):
        votes = links.join(now, links["dst"] == now["id"]).groupBy(F.col("src").alias("id"), "label").agg(F.count(F.lit(1)).alias("n"))
        new = stored(votes.groupBy("id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label")))
        if new.exceptAll(now).isEmpty():
            break
        now = new
    return now


def connected(edges: DataFrame) -> DataFrame:
    """G-13: id, component: the smallest node reached, ignoring directions; labels jump to their label's label each round."""
    links = stored(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    now = stored(links.select(F.col("src").alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        near = links.join(now, links["dst"] == now["id"]).groupBy(F.col("src").alias("id")).agg(F.min("component").alias("m"))
        step = now.join(near, "id", "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"))
        up = step.select(F.col("id").alias("component"), F.col("component").alias("higher"))
        new = stored(step.join(up, "component", "left").select("id", F.coalesce("higher", "component").alias("component")))
        if new.exceptAll(now).isEmpty():
            return new
        now = new


def properties(edges: DataFrame) -> DataFrame:
    """G-13: nodes, edges, density, self loops and triangles."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    simple = edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    up = upward(simple.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(simple.select("b", "a")))
    closed = triangles(up).agg(F.count(F.lit(1)).alias("triangles"))
    one = ends.agg(F.countDistinct("id").alias("nodes")).join(edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops")), F.lit(True)).join(closed, F.lit(True))
    return one.withColumn("density", F.col("edges") / F.greatest(F.lit(1), F.col("nodes") * (F.col("nodes") - 1)))


def upward(links: DataFrame) -> DataFrame:
    """a, b: each link once, from the end of smaller (degree, id), so that out-degrees are at most the root of twice the links."""
    degree = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    both = links.join(degree.toDF("src", "ks"), "src").join(degree.toDF("dst", "kd"), "dst")
    return stored(both.where((F.col("ks") < F.col("kd")) | ((F.col("ks") == F.col("kd")) & (F.col("src") < F.col("dst")))).select(F.col("src").alias("a"), F.col("dst").alias("b")))


def triangles(up: DataFrame) -> DataFrame:
    """a, b, c of each triangle once: only the wedge at its end of smallest degree is joined, so a hub doesn't make all pairs of its neighbours."""
    return up.toDF("a", "b").join(up.toDF("a", "c"), "a").where("b != c").join(up.toDF("b", "c"), ["b", "c"])


def folded(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the same neighbours as one: the first id of each such class and its size m, and the links between those.

    links(src, dst) hold both ways and no loops. Classes are found by a hash of the neighbours and then verified link by link; a
    node whose hash alone is equal stays on its own. Nodes of one class have the same distance to any other node, and 2 to each other.
    """
    marks = links.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("dst")).alias("x"))
    said = marks.join(marks.groupBy("n", "x").agg(F.min("src").alias("rep")), ["n", "x"]).where("src != rep").select("src", "rep", "n")
    agreed = links.join(said, "src").join(links.toDF("rep", "dst"), ["rep", "dst"]).groupBy("src", "rep", "n").agg(F.count(F.lit(1)).alias("same")).where("same = n")
    twins = stored(links.select("src").distinct().join(agreed.select("src", "rep"), "src", "left").select("src", F.coalesce("rep", "src").alias("rep")))
    first = twins.where("src = rep").select("src")
    return stored(twins.groupBy(F.col("rep").alias("id")).agg(F.count(F.lit(1)).alias("m"))), stored(links.join(first, "src").join(first.toDF("dst"), "dst").select("src", "dst"))


def path_lengths(edges: DataFrame, parts: int | None = None, held: int = 20_000_000) -> DataFrame:
    """G-13: diameter and avg_path_length of the undirected graph, null if it is not connected.

    Breadth-first levels of all nodes, those of the same neighbours as one (`folded`), whose pairs count as many as they stand for.
    Shares of the nodes start after one another, as many as keep a share's pairs under `held`, and of each level only its sum stays:
    either way a level's neighbours are on it, the one before or the next, so two levels are all that is held on disk.
    """
    spark = edges.sparkSession
    links = stored(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct())
    sizes, small = folded(links)
    kept, n, twins = sizes.agg(F.count(F.lit(1)), F.sum("m"), F.sum(F.col("m") * (F.col("m") - 1))).first()
    # a level of nodes of one class: two hops
    most, total, pairs = (2, 2 * twins, twins) if twins else (0, 0, 0)
    parts = parts or max(1, -(-kept * kept // held))
    for part in range(parts):
        before, front, d = None, written(sizes.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).select(F.col("id").alias("start"), F.col("id").alias("at"))), 0
        while True:
            d += 1
            new = front.join(small, front["at"] == small["src"]).select("start", F.col("dst").alias("at")).distinct().join(front, ["start", "at"], "left_anti")
            new = written(new if before is None else new.join(before, ["start", "at"], "left_anti"))
            if before is not None:
                erased(before)
            before, front = front, new
            met = new.join(sizes.toDF("start", "ms"), "start").join(sizes.toDF("at", "ma"), "at").agg(F.sum(F.col("ms") * F.col("ma"))).first()[0]
            if not met:
                break
            most, total, pairs = max(most, d), total + d * met, pairs + met
        erased(before)
        erased(front)
    joined = pairs and pairs == n * (n - 1)
    return spark.createDataFrame([(most, total / pairs) if joined else (None, None)], "diameter int, avg_path_length double")


def clustering(edges: DataFrame) -> DataFrame:
    """G-13: the mean over nodes of the share of pairs of their neighbours that are neighbours; nodes with one neighbour have 0.
    """
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    links = stored(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct())
    degree = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    per = triangles(upward(links)).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    share = F.when(F.col("k") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0)
    return ids.join(degree, "id", "left").join(per, "id", "left").agg(F.avg(share).alias("clustering_coefficient"))


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G-14: nodes without edges."""
    return nodes.join(both_ways(edges).select("id").distinct(), "id", "left_anti")


def hubs(degree: DataFrame, between: DataFrame, k: int = 10) -> DataFrame:
    """G-12: .4 of the degree centrality and .6 of the betweenness, the k best."""
    both = degree.join(between, "id", "left").select("id", (0.4 * F.col("centrality") + 0.6 * F.coalesce("betweenness", F.lit(0.0))).alias("score"))
    return both.orderBy(F.desc("score"), "id").limit(k)


def catalog(nodes: DataFrame) -> DataFrame:
    """G-18: alias to canonical id; of several the one with a bracket, then the longest, then the first. nodes(id, aliases)."""
    named = nodes.select("id", F.explode(F.concat(F.array(F.col("id").cast("string")), "aliases")).alias("alias")).where("alias != ''")
    text = F.col("id").cast("string")
    return named.groupBy(F.lower("alias").alias("alias")).agg(F.max_by("id", F.struct(text.contains("("), F.length(text), -F.crc32(text))).alias("id"))


def search(nodes: DataFrame, edges: DataFrame, word: str, k: int) -> DataFrame:
    """G-17: nodes whose id or type holds the word, by degree."""
    d = both_ways(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    hit = F.lower(F.col("id").cast("string")).contains(word.lower()) | F.lower("type").contains(word.lower())
    return nodes.where(hit).join(d, "id", "left").select("id", "type", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), "id").limit(k)


def evidence(edges: DataFrame, centres: DataFrame, most: int = 30) -> DataFrame:
    """G-19, D-08: up to so many distinct triples around each centre (id), numbered E1, E2 and so on."""
    from curato.operators.tables import newest

    around = both_ways(edges).join(centres.select("id"), "id", "left_semi").distinct()
    first = newest(around, "id", [F.col("direction").desc(), F.col("rel"), F.col("other")], most)
    return first.withColumn("eid", F.concat(F.lit("E"), F.row_number().over(Window.partitionBy("id").orderBy(F.col("direction").desc(), "rel", "other"))))


def support(claims: DataFrame, bank: DataFrame) -> DataFrame:
    """Q-07, J-13: for each claim (aid, cid, head, relation, tail, evidence_ids) whether cited evidence (aid, eid, head, relation, tail) says it."""
    cited = claims.select("aid", "cid", "head", "relation", "tail", F.explode_outer("evidence_ids").alias("eid"))
    same = bank.withColumn("hit", F.lit(1))
    told = cited.join(same, ["aid", "eid", "head", "relation", "tail"], "left")
    return told.groupBy("aid", "cid").agg(F.max(F.coalesce("hit", F.lit(0))).alias("supported"))


def confidence(claim: Column, evidence_: Column, entity: Column, overlap: Column, info: Column) -> Column:
    """Q-07: .40, .22, .16, .08 and .14 of the five parts, between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.40 * claim + 0.22 * evidence_ + 0.16 * entity + 0.08 * overlap + 0.14 * info))


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.85, "high").when(c >= 0.6, "medium").otherwise("low")


def information(n: Column, relations: Column, support_: Column, overlap: Column, referenced: Column, meta: Column) -> Column:
    """Q-07: how well evidence carries an answer of several aspects."""
    raw = 0.30 * F.least(F.lit(1.0), n / 6.0) + 0.15 * F.least(F.lit(1.0), relations / F.greatest(F.lit(1), n) * 1.5) + 0.25 * support_ + 0.15 * overlap + 0.15 * referenced
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw * (1 - 0.35 * F.least(F.lit(1.0), meta))))


def candidates(triples: DataFrame, species: str | None = None) -> DataFrame:
    """G-22: triples as candidates for questions, one JSON line each."""
    cols = ["head", "head_type", "relation", "tail", "tail_type"]
    return triples.select(F.to_json(F.struct(*cols, F.lit(species).alias("species"))).alias("value"))


def full_analysis(nodes: DataFrame, edges: DataFrame, k: int = 20) -> dict[str, DataFrame]:
    """G-20: the tables of a graph report, each of them lazy."""
    from curato.operators.tables import top_counts

    return {"statistics": statistics(nodes, edges), "properties": properties(edges), "degrees": degree_centrality(edges).orderBy(F.desc("degree"), "id").limit(k), "relations": top_counts(edges, "rel", k), "isolates": isolates(nodes, edges)}
