"""Question tasks from a knowledge graph: evidence around chosen nodes (G-19) and the choice of nodes itself (G-23).

edges(src, rel, dst). Rows with a null end or relation are no evidence. All choices are by md5 of a seed and the row, so reruns agree.
Only centres that are still short of evidence go on to the next step, and each step keeps a bounded number of rows of a node, so a hub
is one key of a ranked window, whose limit Spark applies before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curato.operators.nearness import stored
from curato.operators.tables import newest

TRIPLE = ["head", "relation", "tail"]


def drawn(seed: str, *parts: str | Column) -> Column:
    """A fixed pseudo-random order, as text."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def _short(centres: DataFrame, bank: DataFrame, least: int) -> DataFrame:
    """Centres (id) with fewer rows than least, and how many they have (n)."""
    held = bank.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return centres.select("id").join(held, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)


def _added(bank: DataFrame, more: DataFrame, most: int) -> DataFrame:
    """bank and more, each triple and direction once at its earliest step, the first `most` of a centre."""
    both = bank.unionByName(more).groupBy("id", *TRIPLE, "direction").agg(F.min("step").alias("step"))
    return stored(newest(both, "id", _order(), most))


def _order() -> list[Column]:
    return [F.col("step"), F.col("direction").desc(), F.col("relation"), F.col("head"), F.col("tail")]


def some_paths(edges: DataFrame, n: int, seed: str) -> DataFrame:
    """place, triples: n drawn paths of two hops that don't return, or of one where nothing follows; places from 0."""
    first = edges.where("src != dst").orderBy(drawn(seed, "src", "rel", "dst"), "src", "rel", "dst").limit(n)
    first = stored(first.select("src", "rel", F.col("dst").alias("mid"), drawn(seed, "src", "rel", "dst").alias("lot")))
    after = edges.select(F.col("src").alias("mid"), F.col("rel").alias("rel2"), F.col("dst").alias("end"), drawn(seed, "src", "rel", "dst").alias("lot2")).where("mid != end")
    # an edge to each end, and two ends of a node, of which one at most is where a path came from
    ends = after.join(first.select("mid").distinct(), "mid", "left_semi").groupBy("mid", "end").agg(F.min(F.struct("lot2", "rel2")).alias("x")).select("mid", "end", "x.*")
    follow = newest(ends, "mid", [F.col("lot2"), F.col("rel2"), F.col("end")], 2)
    met = first.join(follow, "mid", "left").where("end IS NULL OR end != src")
    gone = first.join(met, ["src", "rel", "mid"], "left_anti").select("*", F.lit(None).cast("string").alias("rel2"), F.lit(None).cast(first.schema["src"].dataType).alias("end"), F.lit(None).cast("string").alias("lot2"))
    best = met.unionByName(gone).groupBy("lot", "src", "rel", "mid").agg(F.min(F.struct("lot2", "rel2", "end")).alias("next"))
    one = F.struct(F.col("src").alias("head"), F.col("rel").alias("relation"), F.col("mid").alias("tail"))
    two = F.struct(F.col("mid").alias("head"), F.col("next.rel2").alias("relation"), F.col("next.end").alias("tail"))
    paths = best.select("lot", "src", F.when(F.col("next.end").isNull(), F.array(one)).otherwise(F.array(one, two)).alias("triples"))
    # at most n rows
    return paths.agg(F.sort_array(F.collect_list(F.struct("lot", "src", "triples"))).alias("all")).select(F.posexplode("all").alias("place", "x")).select("place", "x.triples")


def evidence_bank(edges: DataFrame, centres: DataFrame, most: int = 30, least: int = 6, seed: str = "", paths: int = 16, pool: DataFrame | None = None) -> DataFrame:
    """G-19: id, eid, head, relation, tail, direction, step: at most `most` triples for each centre (id).

    Step 0: an edge to each out-neighbour, its first relation. Centres with fewer than `least` triples go on: step 1 adds all
    their edges, out and in, up to `most` each way; step 2, the second hop, adds drawn edges out of the nodes met, until there are
    `least`; step 3 adds one of `paths` drawn paths of the graph. Centres without any edge have that path alone; an empty graph
    gives no rows. pool: the drawn paths, where some_paths has told them before. Evidence is numbered E1, E2 and so on by step, out before in, relation, head and tail.
    """
    edges = edges.select("src", "rel", "dst").where("src IS NOT NULL AND rel IS NOT NULL AND dst IS NOT NULL").distinct()
    centres = centres.select("id").where("id IS NOT NULL").distinct()
    out = edges.join(centres.select(F.col("id").alias("src")), "src", "left_semi")
    near = out.groupBy(F.col("src").alias("id"), F.col("dst").alias("tail")).agg(F.min("rel").alias("relation"))
    bank = near.select("id", F.col("id").alias("head"), "relation", "tail", F.lit("out").alias("direction"), F.lit(0).alias("step"))
    bank = stored(newest(bank, "id", _order(), most))

    short = _short(centres, bank, least).select("id")
    ways = []
    for way, end in (("out", "src"), ("in", "dst")):
        own = edges.select(F.col(end).alias("id"), F.col("src").alias("head"), F.col("rel").alias("relation"), F.col("dst").alias("tail"), F.lit(way).alias("direction"), F.lit(1).alias("step"))
        ways.append(newest(own.join(short, "id", "left_semi"), "id", _order(), most))
    bank = _added(bank, ways[0].unionByName(ways[1]), most)

    short = _short(centres, bank, least)
    here = bank.join(short.select("id"), "id", "left_semi")
    met = here.select("id", F.explode(F.array("head", "tail")).alias("via")).where("id != via").distinct()
    lot = drawn(seed, "head", "relation", "tail")
    beyond = edges.select(F.col("src").alias("head"), F.col("rel").alias("relation"), F.col("dst").alias("tail"))
    # a centre lacks at most `least` triples and holds fewer than `least`, so twice as many of each node are enough
    beyond = newest(beyond.join(met.select(F.col("via").alias("head")).distinct(), "head", "left_semi").withColumn("lot", lot), "head", [F.col("lot"), F.col("relation"), F.col("tail")], 2 * least)
    second = met.join(beyond, met["via"] == beyond["head"]).select("id", *TRIPLE, "lot").join(here.select("id", *TRIPLE).distinct(), ["id", *TRIPLE], "left_anti")
    ranked = second.withColumn("__r", F.row_number().over(Window.partitionBy("id").orderBy("lot", *TRIPLE))).where(F.col("__r") <= least)
    ranked = ranked.join(short, "id").where(F.col("__r") <= least - F.col("n"))
    bank = _added(bank, ranked.select("id", *TRIPLE, F.lit("out").alias("direction"), F.lit(2).alias("step")), most)

    pool = stored(some_paths(edges, paths, seed)) if pool is None else pool
    total = pool.count()
    if total:
        taken = F.pmod(F.conv(F.substring(drawn(seed, "id"), 1, 8), 16, 10).cast("long"), F.lit(total)).cast("int")
        lent = _short(centres, bank, least).withColumn("place", taken).join(pool, "place").select("id", F.explode("triples").alias("t")).select("id", "t.*")
        lent = lent.join(bank.select("id", *TRIPLE).distinct(), ["id", *TRIPLE], "left_anti")
        bank = _added(bank, lent.select("*", F.lit("out").alias("direction"), F.lit(3).alias("step")), most)
    number = F.row_number().over(Window.partitionBy("id").orderBy(*_order()))
    return bank.select("id", F.concat(F.lit("E"), number).alias("eid"), *TRIPLE, "direction", "step")


def allowed_entities(bank: DataFrame, edges: DataFrame, k: int = 25) -> DataFrame:
    """G-19: id, place, entity: what an answer about a centre may name, the first max(12, k + 8) of: itself, k out-neighbours (in the
    order of relation and end), then heads and tails of its evidence by number. bank as from evidence_bank; places from 1."""
    centres = bank.select("id").distinct()
    near = edges.where("rel IS NOT NULL AND dst IS NOT NULL").join(centres.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("id"), F.col("dst").alias("entity")).agg(F.min("rel").alias("rel"))
    row = Window.partitionBy("id").orderBy("rel", "entity")
    near = near.withColumn("b", F.row_number().over(row)).where(F.col("b") <= k).select("id", "entity", F.lit(1).alias("a"), "b", F.lit(0).alias("c"))
    own = centres.select("id", F.col("id").alias("entity"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))
    said = bank.select("id", F.substring("eid", 2, 9).cast("int").alias("b"), F.posexplode(F.array("head", "tail")).alias("c", "entity")).select("id", "entity", F.lit(2).alias("a"), "b", "c")
    first = own.unionByName(near).unionByName(said).groupBy("id", "entity").agg(F.min(F.struct("a", "b", "c")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("at"))).where(F.col("place") <= max(12, k + 8)).select("id", "place", "entity")


def centres_by_type(nodes: DataFrame, kind: str, words: list[str], top: int = 20, otherwise: int = 3, seed: str = "") -> DataFrame:
    """kind, id, lot: nodes (id, type) of those of the `top` commonest types that hold a word; where none does, of the first `otherwise` types."""
    common = nodes.where("type IS NOT NULL").groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(top)
    ranked = common.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "type"))).alias("all")).select(F.posexplode("all").alias("at", "x")).select("at", "x.type")
    holds = F.lit(False)
    for w in words:
        holds = holds | F.lower("type").contains(w.lower())
    any_ = ranked.agg(F.coalesce(F.max(holds), F.lit(False)).alias("any"))
    types = ranked.join(any_, F.lit(True)).where(F.when(F.col("any"), holds).otherwise(F.col("at") < otherwise)).select("type")
    return _lots(nodes.join(types, "type", "left_semi"), kind, seed)


def centres_by_keyword(nodes: DataFrame, kind: str, keyword: str, seed: str = "") -> DataFrame:
    """kind, id, lot: nodes whose id holds the keyword, in any case."""
    return _lots(nodes.where(F.lower(F.col("id").cast("string")).contains(keyword.lower())), kind, seed)


def centres_by_degree(edges: DataFrame, kind: str) -> DataFrame:
    """kind, id, lot: nodes with edges, those with most first, then by id as text."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return ends.select(F.lit(kind).alias("kind"), "id", F.concat(F.lpad((F.lit(10**15) - F.col("n")).cast("string"), 16, "0"), F.lit("|"), F.col("id").cast("string")).alias("lot"))


def _lots(nodes: DataFrame, kind: str, seed: str) -> DataFrame:
    return nodes.where("id IS NOT NULL").select("id").distinct().select(F.lit(kind).alias("kind"), "id", drawn(seed, F.lit(kind), "id").alias("lot"))


def tasks(edges: DataFrame, candidates: DataFrame, wanted: int = 10, need: int = 6, seed: str = "", most: int = 30, least: int = 6, paths: int = 16) -> DataFrame:
    """G-23: kind, rank, and the evidence of each task's centre, as evidence_bank tells it.

    Of each kind the first `wanted` candidates (kind, id, lot) by lot and id that have an out-neighbour and evidence of `need`
    triples become tasks. Evidence is gathered for a batch of candidates of each kind that isn't full yet; those that fail
    are replaced from the next batch, of twice the size, until the kind is full or has no more candidates. So work follows the
    tasks wanted and the share of candidates that fail, and rounds the logarithm of the candidates.
    """
    edges = edges.select("src", "rel", "dst").where("src IS NOT NULL AND rel IS NOT NULL AND dst IS NOT NULL").distinct()
    pool = stored(some_paths(edges, paths, seed))
    bank = lambda centres: evidence_bank(edges, centres, most, least, seed, pool=pool)
    starts = edges.select(F.col("src").alias("id")).distinct()
    left = candidates.join(starts, "id", "left_semi").select("kind", "lot", "id").distinct()
    order = [F.col("lot"), F.col("id")]
    got = after = None
    size = wanted
    while True:
        batch = left
        if after is not None:
            batch = left.join(after, "kind").where((F.col("lot") > F.col("last.lot")) | ((F.col("lot") == F.col("last.lot")) & (F.col("id") > F.col("last.id")))).drop("last")
        batch = stored(newest(batch, "kind", order, size))
        if batch.isEmpty():
            break
        fit = bank(batch).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need)
        passed = batch.join(fit.select("id"), "id", "left_semi").select("kind", "lot", "id")
        got = stored(newest(passed if got is None else got.unionByName(passed), "kind", order, wanted))
        full = got.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= wanted)
        after = stored(batch.groupBy("kind").agg(F.max(F.struct("lot", "id")).alias("last")).join(full, "kind", "left_anti"))
        size *= 2
    if got is None:
        got = left.limit(0)
    ranked = stored(got.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).select("kind", "rank", "id"))
    return ranked.join(bank(ranked), "id")
