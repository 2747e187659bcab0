r"""How the sources of a language differ in their words: divergences of all pairs of sources, and each source's own terms.

Terms are matches of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` (runs of ASCII letters and of all characters past ASCII), with A-Z
lower-cased. A language keeps the terms that at least LEAST of its documents hold. Every source of the language, and the language
itself, gives each kept term a smoothed share p = 1 + floor(SCALE * (count + 2) / (N + 2 V)); two shares p, q of a term diverge
by floor((p - q)^2 / (p + q)). Counts are multiplied as decimals, so all arithmetic is exact beyond 64 bits too.

Plain relational steps: matches are exploded once (they are what lies between the matches of the opposite pattern, which Spark cuts
out in a tenth of the time of listing them; the empty strings at the ends of a text go), each document's distinct ones behind all of its matches, and counted by
language, source and term (partial sums before the shuffle, so a frequent word is as cheap as any). That table is written down.
Kept terms are crossed with the language's groups, which makes zeros dense. A language may hold nearly all terms, so the crossing
is an equi-join on language and slice, in which the short table of groups stands once a slice. Pairs of sources come from a
self-join on language and term, each pair once, as the divergence is the same both ways. The ten best terms of a group are
cut before the shuffle (Spark's window group limit), so no task sorts a group's whole vocabulary.

Size: the dense table has a row a kept term and source of its language, the self-join as many more as half the sources.

Defined results: null text, language and source are ''. A group without terms has counts of 0, hence equal shares. A language that
keeps no term gives its pairs with value 0 and no terms; a language of one source gives no pairs. Repeated rows count as
documents of their own. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curato.llm import shared

TERM, BETWEEN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, BEST, SCALE = 10, 10, 1_000_000_000


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, its occurrences n, and documents that hold it."""
    rows = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(to) for c, to in ((lang, "lang"), (source, "source"), (text, "text"))])
    matches = rows.select("lang", "source", F.split(F.translate("text", UPPER, LOWER), BETWEEN).alias("all"))
    each = matches.select("lang", "source", F.size("all").alias("many"), F.posexplode(F.concat("all", F.array_distinct("all"))).alias("at", "term")).where("term <> ''")
    again = F.col("at") >= F.col("many")
    return each.groupBy("lang", "source", "term").agg(F.count_if(~again).alias("n"), F.count_if(again).alias("documents"))


def share(count, total, kept):
    """The smoothed share of a term."""
    wide = lambda x: f"CAST({x} AS DECIMAL(28, 0))"
    return F.expr(f"1 + ({wide(SCALE)} * ({count} + 2)) div {wide(f'({total} + 2 * {kept})')}")


def divergence(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def shares(groups: DataFrame, counts: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """A row for each kept term and group of its language: lang, source, term, n, p and the language's p; and the kept terms."""
    spark = counts.sparkSession
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("documents").alias("documents")).where(F.col("documents") >= least).drop("documents")
    kept = shared.keep(kept, "terms")
    told = shared.keep(counts.drop("documents").join(kept.select("lang", "term"), ["lang", "term"], "left_semi"), "kept")
    of_lang = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("v"))
    of_group = told.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    slices = shared.partitions(spark)
    sized = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang").fillna(0, ["total"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    dense = kept.withColumn("slice", F.pmod(F.hash("term"), F.lit(slices))).join(sized, ["lang", "slice"]).join(told, ["lang", "source", "term"], "left").fillna(0, ["n"])
    return dense.select("lang", "source", "term", "n", share("n", "total", "v").alias("p"), share("lang_n", "lang_total", "v").alias("lang_p")), kept


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, best: int = BEST) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of the language (part pair) and the group's own terms (part term)."""
    groups = shared.keep(docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(to) for c, to in ((lang, "lang"), (source, "source"))]).distinct(), "groups")
    dense, _ = shares(groups, shared.keep(term_counts(docs, text, lang, source), "counts"), least)
    dense = shared.keep(dense, "dense")
    one, two = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    sums = one.join(two, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(divergence("p", "q")).alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    others = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item")
    pairs = others.join(both, ["lang", "source", "item"], "left").fillna(0, ["value"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    own = dense.where("n > 0 AND p > lang_p").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence("p", "lang_p").alias("value"))
    terms = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return pairs.unionByName(terms)


def oracle_sql() -> str:
    """The same in DuckDB's SQL."""
    share_of = lambda n, total: f"(1 + {SCALE}::HUGEINT * ({n} + 2) // ({total} + 2 * v))::BIGINT"
    f = lambda p, q: f"(({p} - {q}) * ({p} - {q}) // ({p} + {q}))"
    return f"""
WITH rows_ AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
groups AS (SELECT DISTINCT lang, source FROM rows_),
counts AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM rows_) GROUP BY ALL),
holding AS (SELECT lang, term, count(*) AS documents FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM rows_) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::BIGINT AS lang_n FROM counts JOIN holding USING (lang, term) WHERE documents >= {LEAST} GROUP BY ALL),
of_lang AS (SELECT lang, sum(lang_n)::BIGINT AS lang_total, count(*) AS v FROM kept GROUP BY lang),
filled AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON g.lang = k.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
totals AS (SELECT lang, source, sum(n)::BIGINT AS total FROM filled GROUP BY ALL),
dense AS (SELECT lang, source, term, n, {share_of('n', 'total')} AS p, {share_of('lang_n', 'lang_total')} AS lang_p
    FROM filled JOIN totals USING (lang, source) JOIN of_lang USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum({f('a.p', 'b.p')})::BIGINT AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
told AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
    UNION ALL SELECT lang, source, 'term', term, {f('p', 'lang_p')} FROM dense WHERE n > 0 AND p > lang_p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM told)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM ranked WHERE part = 'pair' OR rank <= {BEST}"""
