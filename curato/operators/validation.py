"""Q-07: judging structured answers against a knowledge graph, from tables.

answers(aid, centre, aspects array<string>), claims(aid, cid, head, relation, tail, evidence_ids array<string>), bank(aid, eid, head,
relation, tail): the evidence of an answer; allowed(aid, entity): entities an answer may name; edges(src, rel, dst): the graph,
whose nodes next to an answer's centre are its neighbours. White space in names counts as one blank, and at their ends not at all.

Each part is a join on keys of an answer and a sum by answer: claimed entities meet the allowed ones, cited evidence meets the bank,
claimed entities meet the centre's edges. An answer's rows are as many as its claims; a centre with many edges is a key of the edges,
whose distinct ends are counted with partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curato.operators import graph as g
from curato.operators.nearness import erased, written

# Aspects that count, and relations that say something about the answer itself.
ASPECTS = ["gene_function", "regulation", "phenotype", "species", "pathway"]
META_RELATIONS = [
    "needs_more_context_for", "insufficient_information_for", "cannot_determine_from_available_information", "cannot_be_inferred_from_available_information",
    "unknown_from_available_information", "no_supported_claims_for",
]
META_PARTS = ["context", "insufficient", "cannot", "unknown"]
LEAST_ASPECTS, LEAST_CONFIDENCE = 3, 0.6
#: Answers from which on shares of them are judged one after another.
MANY, SHARES = 500_000, 6


def name(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))


def _placed(runs: Column, n: int) -> Column:
    return F.transform(runs, lambda w, i: F.struct(i.alias("place"), F.lit(n).alias("n"), w.alias("alias")))


def link_entities(texts: DataFrame, catalog: DataFrame, longest: int = 6) -> DataFrame:
    """aid, entity, place: entities (G-18: alias, id) that a text (aid, text) names, the longest alias at a place first, none inside another.

    Word runs of up to `longest` words are joined with the aliases, so aliases are an equi-join however many there are; the
    runs that are left for a text are taken from left to right. Aliases of more words are not found.
    """
    told = texts.select("aid", F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}_()-]+"), "").alias("words"))
    grown, all_ = F.col("words"), []
    for n in range(1, longest + 1):
        # runs of n words are those of n - 1 with the word that follows; at the end of a text none does
        grown = grown if n == 1 else F.zip_with(grown, F.slice("words", n, F.greatest(F.lit(0), F.size("words") - n + 1)), lambda x, y: F.concat(x, F.lit(" "), y))
        all_.append(_placed(grown, n))
    runs = told.select("aid", F.explode(F.concat(*all_)).alias("r")).select("aid", "r.*").where("alias IS NOT NULL")
    hits = runs.join(catalog.select("alias", "id"), "alias").groupBy("aid", "place").agg(F.max(F.struct("n", "id")).alias("hit"))
    own = hits.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("place", (F.col("place") + F.col("hit.n")).alias("end"), F.col("hit.id").alias("entity")))).alias("all"))
    kind = own.schema["all"].dataType.elementType.simpleString()
    start = F.struct(F.lit(0).alias("free"), F.array().cast(f"array<{kind}>").alias("kept"))
    taken = F.aggregate("all", start, lambda s, x: F.when(x["place"] >= s["free"], F.struct(x["end"].alias("free"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s), lambda s: s["kept"])
    return own.select("aid", F.explode(taken).alias("x")).select("aid", "x.entity", "x.place")


def judged_claims(claims: DataFrame, bank: DataFrame, allowed: DataFrame) -> DataFrame:
    """Each claim with its names tidied, whether it is about the answer itself (meta), and a status: supported, unsupported, meta,
    invalid_entity, bad_claim_format or missing_evidence; ends and outside: how many entities it names, and of them not allowed."""
    tidy = claims.select("aid", "cid", name("head").alias("head"), name("relation").alias("relation"), name("tail").alias("tail"), F.filter(F.coalesce("evidence_ids", F.array().cast("array<string>")), lambda e: F.trim(e) != "").alias("ids"))
    said = F.lower("relation")
    loose = (F.col("tail") == "") & (F.size("ids") == 0) & said.rlike("|".join(META_PARTS))
    tidy = tidy.withColumn("meta", said.isin(META_RELATIONS) | loose)
    entities = allowed.select("aid", name("entity").alias("end")).where("end != ''").distinct().withColumn("known", F.lit(1))
    ends = tidy.select("aid", "cid", F.explode(F.filter(F.array("head", "tail"), lambda e: e != "")).alias("end")).join(entities, ["aid", "end"], "left")
    ends = ends.groupBy("aid", "cid").agg(F.count(F.lit(1)).alias("ends"), F.count_if(F.col("known").isNull()).alias("outside"))
    cited = tidy.select("aid", "cid", "head", "relation", "tail", F.explode("ids").alias("eid"))
    banked = bank.select("aid", "eid", *[name(c).alias(f"e_{c}") for c in ("head", "relation", "tail")])
    same = (F.col("head") == F.col("e_head")) & (F.col("relation") == F.col("e_relation")) & (F.col("tail") == F.col("e_tail"))
    hits = cited.join(banked, ["aid", "eid"]).groupBy("aid", "cid").agg(F.max(same.cast("int")).alias("hit"))
    has = entities.select("aid").distinct().withColumn("limited", F.lit(True))
    rows = tidy.join(ends, ["aid", "cid"], "left").join(hits, ["aid", "cid"], "left").join(has, "aid", "left").fillna({"ends": 0, "outside": 0, "hit": 0, "limited": False})
    status = (
        F.when(F.col("meta"), "meta").when(F.col("limited") & (F.col("outside") > 0), "invalid_entity").when((F.col("head") == "") | (F.col("relation") == "") | (F.col("tail") == ""), "bad_claim_format")
        .when(F.size("ids") == 0, "missing_evidence").when(F.col("hit") == 1, "supported").otherwise("unsupported")
    )
    return rows.withColumn("status", status).drop("hit")


def validate(answers: DataFrame, claims: DataFrame, bank: DataFrame, allowed: DataFrame, edges: DataFrame, least_aspects: int = LEAST_ASPECTS, least: float = LEAST_CONFIDENCE, shares: int | None = None) -> DataFrame:
    """aid, aspect_count, entity, referenced, overlap, support, information, confidence, level, passed of every answer.

    Without claims support is .5; without allowed entities entity is .8, and .5 where none is claimed; without neighbours
    overlap is .7. An answer of too few aspects doesn't pass whatever its confidence.

    Joins deal an answer's rows out some twenty times, so many answers go in shares by a hash of aid, each written before the next
    begins: the shuffle files of one share are on disk at a time. What needs the graph's links is made before, once.
    """
    links = edges.select(name("src").alias("centre"), name("dst").alias("end")).where("end != ''").distinct()
    centred = answers.select("aid", name("centre").alias("centre"))
    named = claims.select("aid", F.explode(F.array(name("head"), name("tail"))).alias("end")).where("end != ''").distinct()
    shares = shares or (SHARES if answers.count() >= MANY else 1)
    kept = written if shares > 1 else lambda df, _: df
    links = kept(links, "links")
    sizes = kept(links.groupBy("centre").agg(F.count(F.lit(1)).alias("neighbours")), "sizes")

    def meet(n: DataFrame) -> DataFrame:
        return kept(n.join(centred, "aid").join(links, ["centre", "end"]).groupBy("aid").agg(F.count(F.lit(1)).alias("met")), "met")

    if shares == 1:
        return _judged_answers(answers, claims, bank, allowed, meet(named), sizes, least_aspects, least)
    # all links are dealt out for each part of the names, so these are halves only
    halves = [meet(named.where(F.pmod(F.xxhash64("aid"), F.lit(2)) == half)) for half in range(2)]
    met = halves[0].union(halves[1])
    erased(links)
    told = None
    for share in range(shares):
        # a null aid has a hash as well
        own = [t.where(F.pmod(F.xxhash64("aid"), F.lit(shares)) == share) for t in (answers, claims, bank, allowed, met)]
        part = written(_judged_answers(*own, sizes, least_aspects, least), "answers")
        told = part if told is None else told.union(part)
    erased(met)
    erased(sizes)
    return told


def _judged_answers(answers: DataFrame, claims: DataFrame, bank: DataFrame, allowed: DataFrame, met: DataFrame, sizes: DataFrame, least_aspects: int, least: float) -> DataFrame:
    judged = judged_claims(claims, bank, allowed)
    scored = judged.withColumn("score", F.when(F.col("status") == "meta", 0.5).when(F.col("status") == "supported", 1.0).otherwise(0.0))
    per = scored.groupBy("aid").agg(
        F.count(F.lit(1)).alias("claims"), F.avg("score").alias("support"), F.count_if("meta").alias("metas"), F.sum("ends").alias("ends"), F.sum("outside").alias("outside"),
        F.count_if(~F.col("meta") & (F.size("ids") == 0)).alias("uncited"),
    )
    banked = bank.select("aid", "eid", *[name(c).alias(c) for c in ("head", "relation", "tail")])
    whole = banked.select("aid", "eid", ((F.col("head") != "") & (F.col("relation") != "") & (F.col("tail") != "")).alias("whole"))
    cited = judged.where("NOT meta").select("aid", F.explode("ids").alias("eid")).distinct().join(whole, ["aid", "eid"], "left")
    cited = cited.groupBy("aid").agg(F.count(F.lit(1)).alias("cited"), F.count_if(~F.coalesce("whole", F.lit(False))).alias("failing"))
    held = banked.groupBy("aid").agg(F.count_distinct("eid").alias("evidence"), F.count_distinct(F.nullif("relation", F.lit(""))).alias("relations"))
    limited = allowed.where(name("entity") != "").select("aid").distinct().withColumn("any_allowed", F.lit(True))
    aspects = F.array_distinct(F.filter(F.transform(F.coalesce("aspects", F.array().cast("array<string>")), lambda a: F.lower(F.trim(a))), lambda a: a.isin(ASPECTS)))
    all_ = answers.select("aid", name("centre").alias("centre"), F.size(aspects).alias("aspect_count"))
    for part, key in ((per, "aid"), (cited, "aid"), (held, "aid"), (met, "aid"), (limited, "aid"), (sizes, "centre")):
        all_ = all_.join(part, key, "left")
    all_ = all_.fillna(0, ["claims", "metas", "ends", "outside", "uncited", "cited", "failing", "evidence", "relations", "met", "neighbours"])
    entity = F.when(F.col("any_allowed").isNull(), 0.8).when(F.col("ends") == 0, 0.5).otherwise(1 - F.col("outside") / F.greatest(F.lit(1), F.col("ends")))
    referenced = F.greatest(F.lit(0.0), 1 - (F.col("failing") + F.col("uncited")) / F.greatest(F.lit(1), F.col("cited") + F.col("uncited")))
    overlap = F.when(F.col("neighbours") == 0, 0.7).otherwise(F.least(F.lit(1.0), 2 * F.col("met") / F.greatest(F.lit(1), F.col("neighbours"))))
    parts = all_.select("aid", "aspect_count", "evidence", "relations", entity.alias("entity"), referenced.alias("referenced"), overlap.alias("overlap"), F.coalesce("support", F.lit(0.5)).alias("support"), (F.col("metas") / F.greatest(F.lit(1), F.col("claims"))).alias("meta"))
    parts = parts.withColumn("information", g.information(*[F.col(c) for c in ("evidence", "relations", "support", "overlap", "referenced", "meta")]))
    told = parts.withColumn("confidence", g.confidence(*[F.col(c) for c in ("support", "referenced", "entity", "overlap", "information")]))
    passed = (F.col("aspect_count") >= least_aspects) & (F.col("confidence") >= least)
    return told.select("aid", "aspect_count", "entity", "referenced", "overlap", "support", "information", "confidence", g.confidence_level(F.col("confidence")).alias("level"), passed.alias("passed"))
