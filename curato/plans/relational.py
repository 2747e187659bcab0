"""Queries of joins, aggregations, windows, sets, samples, rule filters and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curato.functions import judging as j
from curato.functions import patterns as W
from curato.functions import rules as r
from curato.functions import scores as s
from curato.functions import text as t
from curato.functions import values as v
from curato.operators import annotation as an
from curato.operators import tables as o
from curato.plans.base import QA_SQL, Catalog, Tables

STRIPPED = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
HITS = lambda c, patterns: "(" + " + ".join(f"len(regexp_extract_all({c}, '{p}'))" for p in patterns) + ")"
ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
COUNT = lambda c, words: "(" + " + ".join(f"contains({c}, '{w}')::INT" for w in words) + ")"
catalog = Catalog()
query = catalog.query
#: Events as annotation results: the user's item, the kind of event as configuration.
RESULTS = "results AS (SELECT user_id AS item, event_type AS config, value, ts, event_id FROM events)"


def results(x: Tables) -> DataFrame:
    return x.events.select(F.col("user_id").alias("item"), F.col("event_type").alias("config"), "value", "ts", "event_id")


def configs(x: Tables) -> DataFrame:
    return x.events.select(F.col("event_type").alias("config")).distinct()


def items(x: Tables) -> DataFrame:
    return x.customer.select(F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("dataset"))


ITEMS = "items AS (SELECT c_custkey AS item, c_mktsegment AS dataset FROM customer)"


@query("a01_completion", f"""WITH {RESULTS}, {ITEMS}, nc AS (SELECT count(DISTINCT config) AS n_configs FROM results), ni AS (SELECT count(DISTINCT item) AS n_items FROM items),
per AS (SELECT item, count(DISTINCT config) AS n FROM results WHERE item IN (SELECT item FROM items) GROUP BY item),
d AS (SELECT count(*) FILTER (n > 0) AS any_config, count(*) FILTER (n = n_configs) AS all_configs FROM per, nc)
SELECT n_items, n_configs, any_config, all_configs, any_config / n_items AS union_rate, all_configs / n_items AS intersection_rate FROM ni, nc, d""")
def _(x: Tables) -> DataFrame:
    return an.completion(results(x), configs(x), items(x))


@query("a01_coverage", f"WITH {RESULTS}, {ITEMS} SELECT config, count(*) AS n, count(DISTINCT item) AS covered, count(DISTINCT item) / (SELECT count(DISTINCT item) FROM items) AS coverage FROM results GROUP BY config")
def _(x: Tables) -> DataFrame:
    """A-01, A-11."""
    return an.coverage(results(x), items(x))


@query("a02_score_stats", f"WITH {RESULTS} SELECT config, count(*) AS n, count(value) AS n_valid, avg(value) AS mean, min(value) AS least, max(value) AS most FROM results GROUP BY config")
def _(x: Tables) -> DataFrame:
    return an.score_stats(results(x), "value")


@query("a02_score_histogram", f"WITH {RESULTS}, c AS (SELECT config, floor(value / 20)::BIGINT AS value, count(*) AS n FROM results GROUP BY ALL) SELECT config, value, n, n / sum(n) OVER (PARTITION BY config) AS share, row_number() OVER (PARTITION BY config ORDER BY n DESC, value) = 1 AS is_mode FROM c")
def _(x: Tables) -> DataFrame:
    """A-02 to A-04, A-32."""
    return an.distribution(results(x), F.floor(F.col("value") / 20))


@query("a03_choices", "WITH z AS (SELECT event_type AS config, unnest([event_type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END]) AS option FROM events) SELECT config, option, count(*) AS n FROM z GROUP BY ALL")
def _(x: Tables) -> DataFrame:
    return an.choices(results(x).withColumn("options", F.array("config", F.when(F.col("value") > 50, "high").otherwise("low"))), "options")


@query("a05_binary", "SELECT lang AS config, count(*) AS n, count(*) FILTER (toxic = 1) AS n_true, count(*) FILTER (toxic = 0) AS n_false, count(*) FILTER (toxic = 1) / count(*) AS true_ratio, count(*) FILTER (toxic = 1) / nullif(count(toxic), 0) AS valid_ratio FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def _(x: Tables) -> DataFrame:
    joined = x.documents.select("doc_id", F.col("lang").alias("config")).join(x.labels, "doc_id", "left")
    return an.binary_stats(joined.withColumn("value", F.col("toxic") == 1), "value")


@query("a06_text_stats", "SELECT lang, count(*) AS n, avg(length(text)) AS mean_chars, max(length(text)) AS max_chars, min(length(text)) AS min_chars, avg(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS mean_words FROM documents GROUP BY lang")
def _(x: Tables) -> DataFrame:
    return an.text_stats(x.documents, "lang", "text")


@query("a07_notes", "SELECT source, count(*) AS n, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM documents GROUP BY source")
def _(x: Tables) -> DataFrame:
    return an.notes(x.documents, "source", "lang").select("source", "n", F.array_join("notes", ",").alias("langs"))


@query("a08_progress", f"""WITH {RESULTS}, {ITEMS}, need AS (SELECT 'purchase' AS config UNION ALL SELECT 'view'),
h AS (SELECT dataset, item, count(DISTINCT config) FILTER (config IN ('purchase', 'view')) AS have FROM items JOIN results USING (item) GROUP BY ALL),
d AS (SELECT dataset, count(*) AS done FROM h WHERE have >= 2 GROUP BY dataset)
SELECT i.dataset, count(DISTINCT item) AS n_items, coalesce(max(done), 0) AS done, coalesce(max(done), 0) / count(DISTINCT item) AS progress FROM items i LEFT JOIN d ON i.dataset = d.dataset GROUP BY i.dataset""")
def _(x: Tables) -> DataFrame:
    """A-08, A-09, F-26."""
    required = items(x).select("dataset").distinct().withColumn("config", F.explode(F.array(F.lit("purchase"), F.lit("view"))))
    return an.progress(results(x), required, items(x))


@query("a10_counts", "SELECT 'documents' AS tbl, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'labels', count(*) FROM labels")
def _(x: Tables) -> DataFrame:
    """A-10, A-34."""
    one = lambda n: getattr(x, n).agg(F.lit(n).alias("tbl"), F.count(F.lit(1)).alias("n"))
    return one("documents").unionByName(one("events")).unionByName(one("labels"))


@query("a12_grouped", "SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_nationkey), ',') AS names FROM nation GROUP BY n_regionkey")
def _(x: Tables) -> DataFrame:
    return an.grouped_list(x.nation, "n_regionkey", "n_nationkey", "n_name").select("n_regionkey", F.array_join("items", ",").alias("names"))


@query("a15_quality_stats", "WITH v AS (SELECT value AS s FROM events) SELECT count(*) AS n, round_even(avg(s), 2) AS mean, max(s) AS most, min(s) AS least, count(*) FILTER (s >= 90) AS excellent, count(*) FILTER (s >= 75 AND s < 90) AS good, count(*) FILTER (s >= 60 AND s < 75) AS acceptable, count(*) FILTER (s < 60) AS poor, round_even(count(*) FILTER (s >= 60) / count(s) * 100, 2) AS pass_rate FROM v")
def _(x: Tables) -> DataFrame:
    return an.quality_stats(x.events, "value")


@query("a16_verification", "WITH v AS (SELECT (quality * 2 + toxic) * 1.5 AS total FROM labels) SELECT count(*) AS n, count(*) FILTER (total > 0) AS n_valid, count(*) FILTER (total >= 3) / count(*) AS passing_rate, avg(total) FILTER (total > 0) AS mean_total, count(*) FILTER (total >= 3) AS passing, count(*) - count(*) FILTER (total >= 3) AS failing FROM v")
def _(x: Tables) -> DataFrame:
    v = x.labels.select(((F.col("quality") * 2 + F.col("toxic")) * 1.5).alias("total"))
    return an.verification_report(v, "total", F.col("total") >= 3)


@query("a17_diversity", f"WITH {QA_SQL}, z AS (SELECT count(*) AS n, count(DISTINCT lang) AS methods, count(DISTINCT source) AS categories, count(DISTINCT q) AS seeds, avg(length(q)) AS mean_chars FROM qa) SELECT *, round_even((methods / 8 * 0.4 + categories / seeds * 0.3 + seeds / n * 0.3) * 100, 2) AS score FROM z")
def _(x: Tables) -> DataFrame:
    return an.diversity(x.qa(), "lang", "source", "q", "q", 8)


@query("a18_two_level", "SELECT lang, source, count(*) AS n, (grouping(lang) * 2 + grouping(source))::BIGINT AS level FROM documents GROUP BY ROLLUP (lang, source)")
def _(x: Tables) -> DataFrame:
    """A-18, A-24, A-26, A-29."""
    return an.two_level(x.documents, "lang", "source")


@query("a19_length_buckets", "SELECT count(*) AS n, avg(n_chars) AS mean, max(n_chars) AS most, min(n_chars) AS least, count(*) FILTER (n_chars < 1000) AS short, count(*) FILTER (n_chars >= 1000 AND n_chars < 3000) AS medium, count(*) FILTER (n_chars >= 3000) AS long FROM documents")
def _(x: Tables) -> DataFrame:
    return an.length_buckets(x.documents, "n_chars")


@query("a22_log_totals", "SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_ok, sum(user_id)::BIGINT AS tokens, avg(value) AS mean_seconds, count(*) FILTER (event_type <> 'error') / count(*) AS success_rate FROM events")
def _(x: Tables) -> DataFrame:
    """A-22, A-23, A-35, R-08."""
    return an.log_totals(x.events, F.col("event_type") != "error", "user_id", "value")


@query("a25_tag_rate", "SELECT avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS rate FROM events")
def _(x: Tables) -> DataFrame:
    return an.tag_rate(x.events.withColumn("tags", F.array("event_type")), "tags", "purchase")


@query("a27_cache_stats", "SELECT event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last, sum(length(props))::BIGINT AS bytes FROM events GROUP BY event_type")
def _(x: Tables) -> DataFrame:
    return x.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.sum(F.length("props")).alias("bytes"))


@query("a28_top_words", "WITH w AS (SELECT unnest(regexp_split_to_array(text, '[\\s，。！？、；：]+')) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE length(word) > 1 AND lower(word) NOT IN ('the', 'and', 'of') GROUP BY word ORDER BY n DESC, word LIMIT 5")
def _(x: Tables) -> DataFrame:
    return an.top_words(x.documents, "text", ("the", "and", "of"))


@query("a30_null_counts", "SELECT 'doc_id' AS \"column\", count(*) AS rows, count(*) FILTER (doc_id IS NULL) AS nulls FROM labels UNION ALL SELECT 'quality', count(*), count(*) FILTER (quality IS NULL) FROM labels UNION ALL SELECT 'toxic', count(*), count(*) FILTER (toxic IS NULL) FROM labels")
def _(x: Tables) -> DataFrame:
    return an.null_counts(x.labels)


@query("j01_left_outer", "SELECT o_orderkey, coalesce(c_name, '-') AS creator FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def _(x: Tables) -> DataFrame:
    people = x.customer.where("c_acctbal > 0").select("c_custkey", "c_name")
    return x.orders.join(people, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.lit("-")).alias("creator"))


@query("j02_link_table", "SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def _(x: Tables) -> DataFrame:
    return x.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(x.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(x.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("j03_unseen", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(x: Tables) -> DataFrame:
    """J-03, D-11, D-12, R-01, R-02, S-27, S-30."""
    return o.unseen(x.documents.select("doc_id"), x.labels, "doc_id")


@query("j04_seen", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(x: Tables) -> DataFrame:
    return o.seen_only(x.documents.select("doc_id"), x.labels, "doc_id")


@query("j05_either_key", "SELECT e.event_id, coalesce(a.c_name, b.c_name) AS c_name FROM events e LEFT JOIN customer a ON e.event_id = a.c_custkey LEFT JOIN customer b ON e.user_id = b.c_custkey")
def _(x: Tables) -> DataFrame:
    """J-05, S-09."""
    return o.lookup_either(x.events.select("event_id", "user_id"), x.customer.select("c_custkey", "c_name"), ("event_id", "c_custkey"), ("user_id", "c_custkey"), "c_name").select("event_id", "c_name")


@query("s10_found_files", """WITH f AS (SELECT DISTINCT concat('data/', source, '/', lang, '/', doc_id % 50, '.md') AS file FROM documents),
q AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat(' data/src', page_id % 4, '/en/', page_id % 50, '.md ') WHEN 1 THEN concat('./Data\\src', page_id % 4, '//en/./', page_id % 50, '.md') WHEN 2 THEN concat('/old/src', page_id % 4, '/de/', page_id % 50, '.md') WHEN 3 THEN concat('x/', page_id % 60, '.md') WHEN 4 THEN concat(page_id % 60, '.json') END AS path FROM pages),
u AS (SELECT DISTINCT file AS p, file, true AS own FROM f UNION ALL SELECT DISTINCT path, NULL, false FROM q WHERE path IS NOT NULL), t AS (SELECT *, regexp_replace(regexp_replace(lower(trim(p)), '[/\\\\]+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g') AS tidy FROM u), s AS (SELECT *, list_filter(string_split(tidy, '/'), lambda w: w <> '') AS w FROM t),
k AS (SELECT p, file, own, 0 AS rule, 0 AS n, trim(p) AS k FROM s UNION ALL SELECT p, file, own, 1, 0, tidy FROM s UNION ALL SELECT p, file, own, 2, n, array_to_string(w[-n:], '/') FROM s, range(2, 9) r(n) WHERE n <= len(w)
UNION ALL SELECT p, file, own, 3, 0, w[-1] FROM s UNION ALL SELECT p, file, own, 4, 0, regexp_replace(w[-1], '(.)\\.[^.]*$', '\\1') FROM s),
b AS (SELECT a.p AS path, i.file, ['exact', 'tidied', 'tail', 'name', 'stem'][a.rule + 1] AS rule FROM k a JOIN k i USING (rule, n, k) WHERE NOT a.own AND i.own QUALIFY row_number() OVER (PARTITION BY a.p ORDER BY a.rule, -a.n, i.file) = 1)
SELECT page_id, file, rule FROM q LEFT JOIN b USING (path)""")
def _(x: Tables) -> DataFrame:
    """S-10."""
    files = x.documents.select(F.expr("concat('data/', source, '/', lang, '/', doc_id % 50, '.md')").alias("file"))
    paths = """CASE page_id % 6 WHEN 0 THEN concat(' data/src', page_id % 4, '/en/', page_id % 50, '.md ') WHEN 1 THEN concat('./Data\\\\src', page_id % 4, '//en/./', page_id % 50, '.md')
        WHEN 2 THEN concat('/old/src', page_id % 4, '/de/', page_id % 50, '.md') WHEN 3 THEN concat('x/', page_id % 60, '.md') WHEN 4 THEN concat(page_id % 60, '.json') END"""
    return o.find_files(x.pages.select("page_id", F.expr(paths).alias("path")), files).select("page_id", "file", "rule")


@query("j06_retrieval", """WITH d AS (SELECT doc_id AS did, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'))) AS w FROM documents),
q AS (SELECT item_id AS qid, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'))) AS w FROM benchmark), n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT w, ln((max(n) + 1) / (count(*) + 0.5)) AS idf FROM d, n WHERE w <> '' GROUP BY w),
sc AS (SELECT qid, did, round(sum(idf), 6) AS score FROM q JOIN idf USING (w) JOIN d USING (w) GROUP BY qid, did)
SELECT qid, did, score FROM sc QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) <= 5""")
def _(x: Tables) -> DataFrame:
    """J-06, S-26."""
    return o.retrieve(x.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("q")), x.documents.select(F.col("doc_id").alias("did"), F.col("text").alias("d"))).select("qid", "did", "score")


@query("j07_nested", "SELECT o_orderkey, array_to_string(list(l_linenumber::VARCHAR || ':' || l_returnflag ORDER BY l_returnflag, l_linenumber::VARCHAR), ',') AS anns FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') GROUP BY o_orderkey")
def _(x: Tables) -> DataFrame:
    """J-07, K-11, J-12."""
    res = x.lineitem.select(F.col("l_orderkey").alias("item"), F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), "l_returnflag").alias("value"), F.col("l_returnflag").alias("config"))
    told = an.nested_export(res, x.orders.select(F.col("o_orderkey").alias("item")), res.where("config in ('A', 'R')").select("config").distinct())
    return told.select(F.col("item").alias("o_orderkey"), F.array_join(F.transform("annotations", lambda a: a["value"]), ",").alias("anns"))


@query("j09_keywords", "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS word FROM documents), k(word, label) AS (VALUES ('the', 'en'), ('and', 'en'), ('der', 'de'), ('und', 'de'), ('les', 'fr'), ('que', 'es')) SELECT doc_id, label, count(*) AS hits FROM w JOIN k USING (word) GROUP BY ALL")
def _(x: Tables) -> DataFrame:
    """J-09, C-13 to C-15, S-19, S-31."""
    words = x.spark.createDataFrame([("the", "en"), ("and", "en"), ("der", "de"), ("und", "de"), ("les", "fr"), ("que", "es")], "word string, label string")
    return o.keyword_hits(x.documents, "doc_id", "text", words)


@query("j14_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS rank FROM orders")
def _(x: Tables) -> DataFrame:
    """J-14, W-01."""
    return o.rank_in(x.orders, "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("j15_orphans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def _(x: Tables) -> DataFrame:
    """J-15, M-06, M-03."""
    return o.orphans(x.lineitem, x.orders.where("o_orderstatus = 'O'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("j16_models", "SELECT doc_id, unnest(['m1', 'm2', 'm3']) AS model FROM labels")
def _(x: Tables) -> DataFrame:
    return o.spread(x.labels.select("doc_id"), ["m1", "m2", "m3"])


@query("j17_variants", "SELECT doc_id, unnest(generate_series(1, (quality + toxic)::BIGINT))::INT AS variant FROM labels")
def _(x: Tables) -> DataFrame:
    return o.variants(x.labels, F.col("quality") + F.col("toxic")).select("doc_id", "variant")


@query("w03_fill_down", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events")
def _(x: Tables) -> DataFrame:
    """W-03, S-25."""
    e = x.events.select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("filled"))
    return o.fill_down(e, "filled", "user_id", "at").select("event_id", "filled")


@query("w05_recent", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS recent FROM events")
def _(x: Tables) -> DataFrame:
    """W-05, L-13."""
    return o.recent_count(x.events, "event_type", ["ts", "event_id"]).select("event_id", "recent")


@query("l13_least_used", "SELECT event_id, ['clear', 'deepen', 'extend', 'vary', 'why'][(row_number() OVER (ORDER BY ts, event_id) - 1) % 1001 % 5 + 1] AS strategy FROM events")
def _(x: Tables) -> DataFrame:
    """L-13: five strategies come in turn, and begin again once the window of 1,000 is full; other numbers are tested against the loop."""
    return o.least_used(x.events, ["ts", "event_id"], ["why", "vary", "clear", "extend", "deepen"]).select("event_id", "strategy")


@query("w06_smoothed", "WITH z AS (SELECT user_id, (event_type <> 'error')::INT AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, round(0.5 * pow(0.9, max(n)) + sum(0.1 * pow(0.9, n - i) * x), 9) AS mean FROM z GROUP BY user_id")
def _(x: Tables) -> DataFrame:
    """W-06."""
    return o.smoothed(x.events.withColumn("ok", (F.col("event_type") != "error").cast("int")).withColumn("at", F.struct("ts", "event_id")), "user_id", "at", "ok").withColumn("mean", F.round("mean", 9))


@query("w07_context", """WITH p AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)), h AS (SELECT doc_id, i, unnest(range(-5, 6)) AS o FROM p WHERE word = 'the')
SELECT h.doc_id, h.i::BIGINT AS i, string_agg(p.word, ' ' ORDER BY p.i) AS around FROM h JOIN p ON p.doc_id = h.doc_id AND p.i = h.i + h.o GROUP BY h.doc_id, h.i""")
def _(x: Tables) -> DataFrame:
    """W-07: five words on either side."""
    return o.in_context(x.documents, "doc_id", "text", "the", 5).select("doc_id", "i", "around")


@query("w10_swap", "SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 7 WHEN 7 THEN 3 ELSE n_nationkey END AS place FROM nation")
def _(x: Tables) -> DataFrame:
    return o.swap(x.nation.select("n_nationkey", F.col("n_nationkey").alias("place")), "n_nationkey", "place", 3, 7)


@query("w11_latest", "SELECT user_id, max_by(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id")
def _(x: Tables) -> DataFrame:
    """W-11, R-06."""
    return x.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("l01_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(x: Tables) -> DataFrame:
    """L-01, L-17, L-19."""
    return o.page(x.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 40, 20)


@query("l02_newest", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 3")
def _(x: Tables) -> DataFrame:
    """L-02, L-04, L-18, L-07."""
    return o.newest(x.events, "user_id", [F.desc("ts"), F.col("event_id")], 3).select("event_id")


@query("l03_top_counts", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 20")
def _(x: Tables) -> DataFrame:
    return o.top_counts(x.lineitem, "l_partkey", 20)


@query("l05_quota", """WITH z AS (SELECT doc_id, source, CASE WHEN n_chars < 800 THEN 'easy' WHEN n_chars < 3000 THEN 'medium' ELSE 'hard' END AS level FROM documents),
m AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source, level ORDER BY doc_id) > CASE level WHEN 'medium' THEN 12 ELSE 4 END THEN 1 ELSE 0 END AS first FROM z)
SELECT doc_id FROM m QUALIFY row_number() OVER (PARTITION BY source ORDER BY first, doc_id) <= 20""")
def _(x: Tables) -> DataFrame:
    """L-05, L-06, L-07, W-04."""
    level = F.when(F.col("n_chars") < 800, "easy").when(F.col("n_chars") < 3000, "medium").otherwise("hard")
    return o.quota_sample(x.documents.select("doc_id", "source", level.alias("level")), "source", "level", ["doc_id"], 20, {"easy": 1, "medium": 3, "hard": 1}).select("doc_id")


@query("l08_hash_sample", "SELECT doc_id FROM documents ORDER BY md5(concat(doc_id, ':42')), doc_id LIMIT 50")
def _(x: Tables) -> DataFrame:
    """L-08 to L-10, S-06, S-15."""
    return o.hash_sample(x.documents.select("doc_id"), "doc_id", 50, "42")


@query("l12_assigned", "WITH z AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat(doc_id, ':7')), doc_id) AS r FROM documents) SELECT doc_id, CASE WHEN r <= 200 THEN 'choice' WHEN r <= 300 THEN 'truth' ELSE 'fill' END AS kind FROM z WHERE r <= 400")
def _(x: Tables) -> DataFrame:
    return o.assign_types(x.documents.select("doc_id"), "doc_id", {"choice": 200, "truth": 100, "fill": 100}, "7")


@query("u01_union", "SELECT event_id, event_type, NULL AS extra FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, event_type, 'x' FROM events WHERE event_type = 'click'")
def _(x: Tables) -> DataFrame:
    """U-01, U-02, S-29."""
    e = x.events.select("event_id", "event_type")
    return e.where("event_type = 'view'").unionByName(e.where("event_type = 'click'").withColumn("extra", F.lit("x")), allowMissingColumns=True)


@query("u03_sets", "SELECT user_id, 'both' AS part FROM (SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'click') UNION ALL SELECT user_id, 'only' FROM (SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'click')")
def _(x: Tables) -> DataFrame:
    """U-03, U-04."""
    a, b = (x.events.where(F.col("event_type") == k).select("user_id") for k in ("view", "click"))
    return a.intersect(b).withColumn("part", F.lit("both")).union(a.subtract(b).withColumn("part", F.lit("only")))


@query("u05_replace", "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IN (1, 2, 3, 4)) UNION ALL SELECT doc_id, 9 FROM labels WHERE doc_id IN (1, 2, 3, 4)")
def _(x: Tables) -> DataFrame:
    """U-05, M-01."""
    links = x.labels.select("doc_id", "quality")
    return o.replace_links(links, links.withColumn("quality", F.lit(9)), "doc_id", 1, 2, 3, 4)


@query("m01_upsert", "SELECT doc_id, quality FROM labels WHERE toxic = 0 UNION ALL SELECT doc_id, 5 FROM labels WHERE toxic = 1")
def _(x: Tables) -> DataFrame:
    """M-01, M-04, R-05, K-14."""
    return o.upsert(x.labels.select("doc_id", "quality"), x.labels.where("toxic = 1").select("doc_id", F.lit(5).alias("quality")), "doc_id")


@query("m02_claim", "SELECT n_nationkey, CASE WHEN n_nationkey = 4 THEN 'me' WHEN n_nationkey % 2 = 1 THEN 'you' END AS owner FROM nation")
def _(x: Tables) -> DataFrame:
    n = x.nation.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 1, "you").alias("owner"))
    return o.claim(o.claim(n, "n_nationkey", "owner", "me", 4), "n_nationkey", "owner", "me", 5)


@query("m03_cascade", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey END AS l_suppkey FROM lineitem WHERE l_partkey % 7 > 0")
def _(x: Tables) -> DataFrame:
    lines = o.cascade_delete(x.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_partkey", x.lineitem.where("l_partkey % 7 = 0"), "l_partkey")
    return o.set_null(lines, "l_suppkey", x.supplier.where("s_suppkey % 5 = 0").unionByName(x.lineitem.where("l_suppkey % 5 = 0").select(F.col("l_suppkey").alias("s_suppkey")), allowMissingColumns=True), "s_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("m05_migrate", "SELECT o_orderkey, c_custkey AS owner_id, o_totalprice::DECIMAL(18,2) AS price FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(x: Tables) -> DataFrame:
    """M-05: a column is mapped to an id and another gets a new type."""
    return x.orders.join(x.customer.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.col("c_custkey").alias("owner_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))


#: English wording tests over documents; the CJK lists are tested on made texts.
@query("f01_wording", "SELECT doc_id, regexp_matches(text, '(?i)\\bwe (find|found|show|demonstrate|observe)\\b|\\bour (results|study|work)\\b|\\bin this (paper|thesis|study)\\b') AS study, regexp_matches(lower(text), 'affiliation|corresponding author|co-author|coauthor|author list|author order|author contribution|contributing authors|first author|co[- ]author|author\\(s\\)') AS author, FALSE AS forbidden, FALSE AS refers FROM documents")
def _(x: Tables) -> DataFrame:
    """F-01 to F-03, F-08."""
    return x.documents.select("doc_id", r.study_dependent("text", "thesis").alias("study"), r.author_related("text").alias("author"), r.has_forbidden_phrase("text").alias("forbidden"), r.refers_to_text("text").alias("refers"))


MARKS = "(length(q) - length(regexp_replace(q, '\\d+[\\.、]', '', 'g')))"




@query("f04_numbered", f"""WITH {QA_SQL}, z AS (SELECT doc_id, concat(q, CASE doc_id % 5 WHEN 0 THEN ' 1、a 2、b 3、c' WHEN 1 THEN ' 1、' || repeat('x', 30) || ' 2、b' WHEN 2 THEN '已知：' ELSE '' END) AS q FROM qa),
n AS (SELECT doc_id, q, {HITS('q', r.MARKS.split('|'))} AS n, regexp_split_to_array(q, '{r.MARKS}') AS parts FROM z)
SELECT doc_id, CASE WHEN length(q) > 250 THEN 'too_long' WHEN n > 2 THEN 'too_many_marks' WHEN n > 0 AND len(list_filter(parts[2:len(parts) - 1], lambda p: length({STRIPPED('p')}) > 20)) > 0 THEN 'long_item' WHEN {ANY('q', W.REDUNDANT_GUIDES)} THEN 'redundant_guide' END AS fault FROM n""")
def _(x: Tables) -> DataFrame:
    added = F.when(F.col("doc_id") % 5 == 0, " 1、a 2、b 3、c").when(F.col("doc_id") % 5 == 1, F.concat(F.lit(" 1、"), F.lit("x" * 30), F.lit(" 2、b"))).when(F.col("doc_id") % 5 == 2, "已知：").otherwise("")
    return x.qa().select("doc_id", F.concat("q", added).alias("q")).select("doc_id", r.numbered_question_fault("q").alias("fault"))


@query("f05_conditions", f"""WITH {QA_SQL}, m AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('如果水，如果光，', q) WHEN 1 THEN concat(q, 'a；b；c：d：e') WHEN 2 THEN concat('已知：', q, '；b；c') WHEN 3 THEN concat('若水，', q, '1、a。b。c。d。') WHEN 4 THEN concat(q, '当水时，综合这些信息') ELSE q END AS q FROM qa),
c AS (SELECT doc_id, q, {HITS('q', W.CONDITION_PATTERNS)} AS conditions, len(regexp_extract_all(q, '[；;]')) AS semicolons FROM m),
n AS (SELECT *, semicolons + len(regexp_extract_all(q, '[：:]')) AS marks, len(regexp_extract_all(q, '[①-⑳]')) + len(regexp_extract_all(q, '\\d+[\\.、]')) + semicolons AS items FROM c)
SELECT doc_id, CASE WHEN conditions > 1 THEN 'conditions' WHEN marks > 3 THEN 'separators' WHEN regexp_matches({STRIPPED('q')}, '^(如果|假设|当|若|倘若|已知|基于|根据)') AND (conditions > 0 OR marks > 2) THEN 'starts_with_condition' WHEN items > 3 THEN 'items'
    WHEN {HITS('q', W.GUIDE_PATTERNS)} > 2 THEN 'guides' WHEN len(regexp_split_to_array(q, '[。！？]')) > 4 AND (conditions > 0 OR items > 2) THEN 'dense' WHEN {ANY('q', W.SUMMARY_PHRASES)} AND (conditions > 0 OR items > 2) THEN 'summary' END AS fault FROM n""")
def _(x: Tables) -> DataFrame:
    made = F.expr("CASE doc_id % 6 WHEN 0 THEN concat('如果水，如果光，', q) WHEN 1 THEN concat(q, 'a；b；c：d：e') WHEN 2 THEN concat('已知：', q, '；b；c') WHEN 3 THEN concat('若水，', q, '1、a。b。c。d。') WHEN 4 THEN concat(q, '当水时，综合这些信息') ELSE q END")
    return x.qa().select("doc_id", made.alias("q")).select("doc_id", r.condition_fault("q").alias("fault"))


@query("f06_unmentioned")
def _(x: Tables) -> DataFrame:
    """F-06, F-07; tested on made texts."""
    return x.qa().select("doc_id", r.names_unmentioned("q", "a").alias("unmentioned"), r.restates_question("q", "a").alias("restates"))


@query("f09_skip_sections", f"""WITH {QA_SQL} SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'keyword' WHEN length({STRIPPED('a')}) < 100 THEN 'short' WHEN regexp_matches({STRIPPED('a')}, '^[ATCGNatcgn\\s]+$') THEN 'sequence' WHEN {" + ".join(f"regexp_matches(a, '{p}')::INT" for p in W.REFERENCE_LINES)} > 2 THEN 'references' END AS fault FROM qa""")
def _(x: Tables) -> DataFrame:
    return x.qa().select("doc_id", r.skip_paper_section(F.when(F.col("doc_id") % 10 == 0, "References").otherwise("Results"), "a").alias("fault"))


@query("f10_thesis_sections")
def _(x: Tables) -> DataFrame:
    """F-10, F-11; tested on made texts."""
    return an.funnel(x.qa().select(r.skip_thesis_section("q", "a").alias("reason")), "reason")


@query("f12_issues", f"""WITH {QA_SQL}, z AS (SELECT regexp_replace(q, '^\\s+|\\s+$', '', 'g') AS q, regexp_replace(a, '^\\s+|\\s+$', '', 'g') AS a FROM qa),
i AS (SELECT CASE WHEN q = '' OR a = '' THEN 'empty_content' WHEN length(q) < 10 THEN 'question_too_short' WHEN length(a) < 20 THEN 'answer_too_short' WHEN length(q) > 500 THEN 'question_too_long' WHEN length(a) > 5000 THEN 'answer_too_long'
    WHEN len(list_filter(regexp_split_to_array(a, '\\s+'), lambda w: w <> '')) < 5 THEN 'answer_too_brief' ELSE 'kept' END AS reason FROM z) SELECT reason, count(*) AS n FROM i GROUP BY reason""")
def _(x: Tables) -> DataFrame:
    """F-12, A-20, Q-10."""
    return an.funnel(x.qa().select(r.quality_issue("q", "a").alias("reason")), "reason")


@query("f13_basic", f"WITH {QA_SQL}, z AS (SELECT doc_id, regexp_replace(q, '^\\s+|\\s+$', '', 'g') AS q, regexp_replace(a, '^\\s+|\\s+$', '', 'g') AS a FROM qa) SELECT doc_id, length(q) >= 6 AND length(a) >= 20 AND length(a) <= 4000 AS ok, CASE WHEN regexp_matches(q, '[？?]$') THEN q ELSE concat(q, '?') END AS asked FROM z")
def _(x: Tables) -> DataFrame:
    return x.qa().select("doc_id", r.basic_checks("q", "a").alias("ok"), r.with_question_mark("q").alias("asked"))


@query("f14_dialogues", """WITH z AS (SELECT conv_id, trim(regexp_replace(coalesce(min_by(text, turn) FILTER (role = 'user'), ''), '\\s+', ' ', 'g')) AS u, trim(regexp_replace(coalesce(min_by(text, turn) FILTER (role = 'assistant'), ''), '\\s+', ' ', 'g')) AS a,
    bool_or(role = 'user') AND bool_or(role = 'assistant') AS ok FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN NOT ok THEN 'schema:missing_user_or_assistant' WHEN length(u) < 2 THEN 'len:user_too_short' WHEN length(a) < 2 THEN 'len:assistant_too_short' WHEN length(u) > 2000 THEN 'len:user_too_long' WHEN length(a) > 6000 THEN 'len:assistant_too_long' END AS fault FROM z""")
def _(x: Tables) -> DataFrame:
    told = x.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))
    return told.select("conv_id", r.dialogue_fault("messages").alias("fault"))


@query("f15_validation", "SELECT doc_id, array_to_string(list_filter([CASE WHEN lang = '' OR lang IS NULL THEN 'missing:lang' END, CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 200 THEN 'short:text' END], lambda e: e IS NOT NULL), ',') AS errors FROM documents")
def _(x: Tables) -> DataFrame:
    return x.documents.select("doc_id", F.array_join(r.record_errors(["lang"], {"text": 200}), ",").alias("errors"))


@query("f17_triples", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'generic_relation' WHEN l_returnflag = 'A' THEN 'relation' WHEN l_linestatus = 'O' THEN 'node_type' END AS fault FROM lineitem")
def _(x: Tables) -> DataFrame:
    """F-17, F-18, A-14."""
    rel = F.when(F.col("l_returnflag") == "N", "related_to").when(F.col("l_returnflag") == "A", "odd").otherwise("binds")
    return x.lineitem.select("l_orderkey", "l_linenumber", r.triple_fault(rel, F.lit("gene"), F.when(F.col("l_linestatus") == "O", "other").otherwise("gene"), ["binds"], ["gene"]).alias("fault"))


ADDED = "CASE doc_id % 4 WHEN 0 THEN '为什么' WHEN 1 THEN '是否研究模型' WHEN 2 THEN '基因 5%' ELSE '' END"


@query("f20_retrieval_need", f"""WITH {QA_SQL}, z AS (SELECT doc_id, concat({ADDED}, q) AS q, a FROM qa UNION ALL SELECT -1 - doc_id, concat({ADDED}, q), 'a short answer' FROM qa), y AS (SELECT *, concat(q, a) AS b FROM z),
w AS (SELECT *, {COUNT('b', [w for ws in j.RETRIEVAL_WORDS.values() for w in ws])} AS words, {ANY('q', j.OPEN_QUESTIONS)} AS open, {ANY('b', j.CONCEPT_WORDS)} AS concept FROM y),
s AS (SELECT *, least(words * 3, 30) + CASE WHEN open THEN 15 ELSE 0 END - CASE WHEN {ANY('q', j.CLOSED_QUESTIONS)} THEN 5 ELSE 0 END + CASE WHEN length(a) > 800 THEN 20 WHEN length(a) > 200 THEN 10 ELSE 0 END + CASE WHEN concept THEN 15 ELSE 0 END
    + CASE WHEN regexp_matches(b, '\\p{{N}}') THEN 5 ELSE 0 END + CASE WHEN contains(b, '%') OR contains(b, '百分') THEN 3 ELSE 0 END + CASE WHEN {ANY('b', j.UNITS)} THEN 2 ELSE 0 END + CASE WHEN length(q) > 50 THEN 5 WHEN length(q) > 30 THEN 3 ELSE 0 END AS score FROM w)
SELECT doc_id, score::INT AS score, CASE WHEN length(q) < 5 THEN FALSE WHEN length(a) > 2000 THEN TRUE WHEN length(a) < 50 AND NOT (open OR words >= 3 OR concept) THEN FALSE ELSE score >= 25 END AS needed FROM s""")
def _(x: Tables) -> DataFrame:
    """F-20: all questions with their answers, and once more with a short one."""
    z = x.qa().select("doc_id", F.concat(F.expr(ADDED), "q").alias("q"), "a")
    z = z.union(z.select(-1 - F.col("doc_id"), "q", F.lit("a short answer")))
    return z.select("doc_id", j.retrieval_score("q", "a").alias("score"), j.needs_retrieval("q", "a").alias("needed"))


@query("f22_search", "SELECT doc_id FROM documents WHERE contains(text, 'the') AND lang = 'en'")
def _(x: Tables) -> DataFrame:
    """F-16, F-19, F-21, F-22, F-24."""
    return r.search(x.documents, {"text": "the", "source": None}, {"lang": "en", "source": None}).select("doc_id")


@query("f23_open_tasks", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND (c_mktsegment = 'BUILDING' OR c_nationkey = 3)")
def _(x: Tables) -> DataFrame:
    tasks = x.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, "me").alias("who"), F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")).alias("cat"))
    return r.open_tasks(tasks, "who", "cat", "BUILDING").select("c_custkey")


RELATIONS = "CASE event_id % 6 WHEN 0 THEN ' Does not affect ' WHEN 1 THEN 'is NOT required by' WHEN 2 THEN 'unknown_from_available_information' WHEN 3 THEN 'insufficient data' WHEN 4 THEN 'binds' ELSE NULL END"


@query("f28_claims", f"WITH z AS (SELECT event_id, {RELATIONS} AS rel FROM events) SELECT event_id, coalesce(event_id % 6 = 2 OR (event_id % 6 = 3 AND event_id % 4 = 0), FALSE) AS meta, CASE WHEN event_id % 6 < 2 OR event_id % 5 = 0 THEN 'negative' WHEN event_id % 5 = 1 THEN 'unknown' ELSE 'positive' END AS polarity FROM z")
def _(x: Tables) -> DataFrame:
    e = F.col("event_id")
    ids = F.when(e % 2 == 0, F.array(F.lit(" "), F.lit(None).cast("string"))).otherwise(F.array(F.lit("E1")))
    given = F.when(e % 5 == 0, "Negative").when(e % 5 == 1, "unknown").when(e % 5 == 2, "pos").when(e % 5 == 3, "odd")
    return x.events.select("event_id", j.meta_claim(F.expr(RELATIONS), F.when(e % 4 != 0, "t"), ids).alias("meta"), j.polarity(F.expr(RELATIONS), given).alias("polarity"))


#: Letters beyond ASCII as underscores, so that a boundary of a word is where it is for Unicode.
PLAIN = "regexp_replace(q, '[^\\x00-\\x7f\\p{P}\\p{S}\\p{Z}\\p{C}]', '_', 'g')"


@query("f29_suspicious", f"WITH {QA_SQL} SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all({PLAIN}, '\\b([A-Z][A-Za-z0-9\\-]{{2,}})\\b', 1)), lambda t: NOT (contains(lower(source), lower(t)) OR contains(lower(t), lower(source)))))::INT AS n FROM qa")
def _(x: Tables) -> DataFrame:
    return x.qa().select("doc_id", F.size(r.suspicious_tokens("q", F.array("source"))).alias("n"))


@query("f30_html_text", """WITH z AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS body FROM z""")
def _(x: Tables) -> DataFrame:
    return x.pages.select("page_id", t.html_text("html").alias("body"))


@query("q01_scores")
def _(x: Tables) -> DataFrame:
    """Q-01; tested against a plain implementation."""
    return x.qa().select("doc_id", s.qa_score("q", "a").alias("r")).select("doc_id", "r.total_score", "r.quality_level", "r.dimension_scores.*")


POINTS = {
    "question": f"CASE WHEN length(regexp_replace(q, '^\\s+|\\s+$', '', 'g')) > 5 THEN 5 ELSE 0 END + CASE WHEN {ANY('q', j.DEPENDENT_WORDS)} THEN 0 ELSE 5 END + CASE WHEN {ANY('q', j.PATENT_TOPICS)} THEN 5 ELSE 0 END + CASE WHEN length(q) BETWEEN 10 AND 100 THEN 5 WHEN length(q) BETWEEN 5 AND 150 THEN 3 ELSE 0 END",
    "answer": f"CASE WHEN length(a) >= 50 THEN 5 WHEN length(a) >= 20 THEN 3 ELSE 0 END + CASE WHEN {ANY('a', j.PATENT_VERBS)} THEN 5 ELSE 0 END + CASE WHEN contains(a, '。') THEN 5 ELSE 0 END + CASE WHEN {ANY('a', W.FORBIDDEN_PHRASES)} THEN 0 ELSE 5 END + CASE WHEN {ANY('a', j.SUBJECTIVE_WORDS)} THEN 0 ELSE 5 END",
    "relevance": f"CASE WHEN len(theirs) = 0 THEN 0 WHEN overlap >= 0.3 THEN 10 WHEN overlap >= 0.2 THEN 7 WHEN overlap >= 0.1 THEN 5 ELSE 2 END + CASE WHEN {ANY('a', j.PATENT_TERMS)} THEN 0 ELSE 5 END + 5",
    "match": "CASE WHEN suffix(q, '?') THEN 3 ELSE 0 END + CASE WHEN len(keys) = 0 THEN 0 WHEN ratio >= 0.5 THEN 7 WHEN ratio >= 0.3 THEN 5 WHEN ratio >= 0.1 THEN 3 ELSE 0 END + CASE " + " ".join(f"WHEN {ANY('q', asks)} THEN CASE WHEN {ANY('a', says)} THEN 5 ELSE 0 END" for asks, says in j.ANSWER_KINDS) + " ELSE 0 END",
    "completeness": f"CASE WHEN length(a) >= 200 THEN 5 WHEN length(a) >= 100 THEN 3 WHEN length(a) >= 50 THEN 1 ELSE 0 END + 3 + CASE WHEN len(list_filter(string_split(a, '。'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g') <> '')) >= 3 THEN 3 WHEN len(list_filter(string_split(a, '。'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g') <> '')) >= 2 THEN 2 ELSE 0 END + CASE WHEN {ANY('a', j.ORDER_WORDS)} THEN 1 ELSE 0 END",
}
WORDS = lambda c: f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"


@query("q02_patent", f"""WITH {QA_SQL}, m AS (SELECT doc_id, concat(q, CASE doc_id % 4 WHEN 0 THEN '如何?' WHEN 1 THEN '的优势' ELSE '' END) AS q, concat(a, CASE doc_id % 3 WHEN 0 THEN '。首先通过。发明' WHEN 1 THEN '。可能提高' ELSE '' END) AS a, q AS source FROM qa),
l AS (SELECT *, list_distinct({WORDS('lower(a)')}) AS own, list_distinct({WORDS('lower(source)')}) AS theirs, list_filter({WORDS('q')}, lambda w: length(w) > 1) AS keys FROM m),
r AS (SELECT *, CASE WHEN len(own) = 0 THEN 0 ELSE len(list_intersect(own, theirs)) / len(own) END AS overlap, len(list_filter(keys, lambda w: contains(a, w))) / greatest(len(keys), 1) AS ratio FROM l),
p AS (SELECT doc_id, {', '.join(f'({c}) AS {n}' for n, c in POINTS.items())} FROM r), t AS (SELECT *, question + answer + relevance + match + completeness AS total FROM p)
SELECT *, CASE WHEN total >= 90 THEN '优秀' WHEN total >= 80 THEN '良好' WHEN total >= 70 THEN '中等' WHEN total >= 60 THEN '及格' ELSE '不及格' END AS level FROM t""")
def _(x: Tables) -> DataFrame:
    ask, say = F.expr("CASE doc_id % 4 WHEN 0 THEN '如何?' WHEN 1 THEN '的优势' ELSE '' END"), F.expr("CASE doc_id % 3 WHEN 0 THEN '。首先通过。发明' WHEN 1 THEN '。可能提高' ELSE '' END")
    z = x.qa().select("doc_id", F.concat("q", ask).alias("x"), F.concat("a", say).alias("y"), "q")
    return z.select("doc_id", j.patent_quality("x", "y", "q", F.array(F.lit("one"))).alias("r")).select("doc_id", "r.*")


@query("q03_heuristic", f"""WITH {QA_SQL}, z AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')), lambda w: regexp_full_match(w, '[a-z]+')) AS x, list_filter(list_distinct(regexp_extract_all(lower(a), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')), lambda w: regexp_full_match(w, '[a-z]+')) AS y, length(a) AS n FROM qa)
SELECT doc_id, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE greatest(0, least(1, 0.35 + 0.4 * len(list_intersect(x, y)) / greatest(1, len(x)) + 0.25 * (1 - exp(-n / 180.0)))) END::DOUBLE AS score FROM z""")
def _(x: Tables) -> DataFrame:
    """Q-03, Q-04 (with one scorer the blend is the heuristic itself), D-10."""
    return x.qa().select("doc_id", s.heuristic_score("q", "a").alias("score"))


@query("q08_paths", "SELECT o_orderkey, 0.7 * (o_totalprice + 1.0) / 2 + 0.3 / (1 + o_orderkey % 4) AS score FROM orders")
def _(x: Tables) -> DataFrame:
    return x.orders.select("o_orderkey", s.path_score(F.array("o_totalprice", F.lit(1.0)), F.col("o_orderkey") % 4).alias("score"))


@query("q09_paper_funnel")
def _(x: Tables) -> DataFrame:
    """Q-09, Q-12; the counts sum to all rows."""
    one = lambda name, c: an.funnel(x.qa().select(c.alias("reason")), "reason").withColumn("funnel", F.lit(name))
    return one("paper", r.paper_reject("q", "a")).unionByName(one("patent", r.patent_reject("q", "a")))


TRIMMED = "regexp_replace(t, '^\\s+|\\s+$', '', 'g')"
BOUND = lambda p: p.replace("\\b", "(?:^|$|[^\\p{L}\\p{N}\\p{M}_])")


@query("c16_intents", f"""WITH z AS (SELECT conv_id, turn, role, concat(text, CASE turn % 5 WHEN 0 THEN ' Who are you?' WHEN 1 THEN ' 你叫什么名字' WHEN 2 THEN ' what are your limitations' WHEN 3 THEN ' 物种' ELSE '' END) AS t FROM conversations)
SELECT conv_id, turn, role, CASE {" ".join(f"WHEN regexp_matches(lower(t), '{BOUND(p).replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in j.INTENT_PATTERNS)} {" ".join(f"WHEN {ANY('t', ws)} THEN '{n}'" for n, ws in j.INTENT_WORDS)} ELSE 'general' END AS intent FROM z""")
def _(x: Tables) -> DataFrame:
    """C-16."""
    made = F.concat("text", F.expr("CASE turn % 5 WHEN 0 THEN ' Who are you?' WHEN 1 THEN ' 你叫什么名字' WHEN 2 THEN ' what are your limitations' WHEN 3 THEN ' 物种' ELSE '' END"))
    return x.conversations.select("conv_id", "turn", "role", j.intent(made).alias("intent"))


@query("c17_question_kinds", f"""WITH z AS (SELECT concat(CASE turn % 4 WHEN 0 THEN ' 如何' WHEN 1 THEN '什么是' ELSE '' END, text, CASE turn % 3 WHEN 0 THEN '的区别' WHEN 1 THEN '概念' ELSE '' END) AS t FROM conversations WHERE role = 'user')
SELECT CASE {" ".join(f"WHEN starts_with({TRIMMED}, '{w}') THEN '{w}'" for w in W.STARTERS)} ELSE '其他' END AS starter, CASE {" ".join(f"WHEN {ANY('t', ws)} THEN '{n}'" for n, ws in W.QUESTION_TYPES)} ELSE '其他' END AS kind, count(*) AS count FROM z GROUP BY ALL""")
def _(x: Tables) -> DataFrame:
    """C-17."""
    made = F.concat(F.expr("CASE turn % 4 WHEN 0 THEN ' 如何' WHEN 1 THEN '什么是' ELSE '' END"), "text", F.expr("CASE turn % 3 WHEN 0 THEN '的区别' WHEN 1 THEN '概念' ELSE '' END"))
    z = x.conversations.where("role = 'user'").select(made.alias("t"))
    return z.groupBy(t.starter("t").alias("starter"), t.question_type("t").alias("kind")).count()


@query("d01_exact", """WITH z AS (SELECT doc_id, source, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents) SELECT h, min(doc_id) AS doc_id, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(*) AS copies FROM z GROUP BY h""")
def _(x: Tables) -> DataFrame:
    """D-01, A-21, A-31, X1: the first of equal texts, with the sources of all."""
    z = x.documents.select("doc_id", "source", F.md5(t.squeeze("text")).alias("h"))
    return o.merged_sources(z, "h", "doc_id", "source", "doc_id").select("h", "doc_id", F.array_join("sources", ",").alias("sources"), "copies")


@query("d02_token_set", f"WITH {QA_SQL}, z AS (SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(q), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+'), lambda w: w <> ''))), ' ')) AS h FROM qa) SELECT min(doc_id) AS doc_id FROM z GROUP BY h")
def _(x: Tables) -> DataFrame:
    """D-02, W-02."""
    return o.keep_first(x.qa().select("doc_id", t.token_set_hash("q").alias("h")), ["h"], ["doc_id"]).select("doc_id")


@query("d03_normalised", f"WITH {QA_SQL}, z AS (SELECT doc_id, regexp_replace(trim(regexp_replace(lower(q), '\\s+', ' ', 'g')), '[，。、“”‘’…：:;；.!?？]+', ' ', 'g') AS k FROM qa) SELECT min(doc_id) AS doc_id FROM z GROUP BY k")
def _(x: Tables) -> DataFrame:
    """D-03, D-07, D-08."""
    return o.keep_first(x.qa().select("doc_id", t.normalize_for_duplicates("q").alias("k")), ["k"], ["doc_id"]).select("doc_id")


@query("e01_pricing", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def _(x: Tables) -> DataFrame:
    """An extension over the order tables."""
    return x.lineitem.where("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("e02_region_sales", "SELECT r_name, year(o_orderdate)::INT AS y, sum(l_extendedprice) AS sales FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def _(x: Tables) -> DataFrame:
    """An extension over the order tables."""
    j = x.lineitem.join(x.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(x.customer, F.col("o_custkey") == F.col("c_custkey")).join(x.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(x.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", F.year("o_orderdate").alias("y")).agg(F.sum("l_extendedprice").alias("sales"))


@query("x00_corpus_overview", "SELECT lang, source, count(*) AS n, sum(length(text))::BIGINT AS chars, count(DISTINCT md5(text)) AS distinct_texts FROM documents GROUP BY lang, source")
def overview(x: Tables) -> DataFrame:
    """Documents, characters and distinct texts by language and source."""
    return x.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.countDistinct(F.md5("text")).alias("distinct_texts"))


@query("p75_reply_items", "SELECT event_id, concat('q', user_id) AS question, event_type AS answer FROM events")
def _(x: Tables) -> DataFrame:
    """P-75, P-76, Q-06, T-11, T-12."""
    reply = F.concat(F.lit('Here:\n```json\n[{"question": "q'), "user_id", F.lit('", "answer": "'), "event_type", F.lit('"}, {"question": ""}]\n```'))
    return x.events.select("event_id", F.explode(v.qa_items(reply)).alias("i")).select("event_id", "i.question", "i.answer")


@query("q11_numbered_cap", "WITH z AS (SELECT doc_id, source, doc_id % 3 = 0 AS numbered FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source, numbered ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM z) SELECT doc_id FROM r WHERE NOT numbered OR r <= floor(n * 0.1)")
def _(x: Tables) -> DataFrame:
    """Q-11: numbered questions make up a tenth of a group's rows at most; the first ones stay."""
    return o.capped(x.documents.select("doc_id", "source", (F.col("doc_id") % 3 == 0).alias("numbered")), "source", "numbered", ["doc_id"], 0.1).select("doc_id")
