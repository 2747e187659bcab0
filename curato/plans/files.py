"""Queries of sources, sinks and resumable state: tables are written by a sink, read back by a source and compared with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curato.functions import udfs
from curato.operators import chunking as ch
from curato.operators import tables as o
from curato.plans.base import Catalog, Tables
from curato.session import shared_folder
from curato.sources import readers, writers
from curato.streaming import flows

catalog = Catalog()
query = catalog.query


def scratch(x: Tables) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(x.spark)}/query-{uuid.uuid4().hex}"


def paths_of(folder: str, told: DataFrame) -> list[str]:
    """Files that a sink told; one a partition."""
    return sorted(r["path"] for r in told.select("path").collect())


@query("s02_theses", "SELECT doc_id AS id, coalesce(CASE WHEN doc_id % 3 > 0 THEN source END, CASE WHEN doc_id % 2 = 0 THEN lang END, 'proquest_papers') AS source FROM documents WHERE (doc_id % 3 > 0 AND source IN ('src1', 'src2')) OR doc_id % 5 > 0")
def _(x: Tables) -> DataFrame:
    """S-02."""
    path = scratch(x)
    made = x.documents.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("label"), F.when(F.col("doc_id") % 5 > 0, F.col("text")).alias("text"))
    writers.json_out(made, path)
    good, _ = readers.good_and_bad(readers.json_lines(x.spark, path, "id long, source string, label string, text string"))
    return readers.theses(good, ["SRC1", "src2"]).select("id", "source")


@query("s04_whole_json", "SELECT c_custkey AS id, c_name AS name FROM customer")
def _(x: Tables) -> DataFrame:
    """S-03, S-04: files that are one list each, of objects, over several lines."""
    path = scratch(x)
    lists = x.customer.groupBy("c_nationkey").agg(F.to_json(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))).alias("j"))
    lists.select("c_nationkey", F.replace("j", F.lit("},{"), F.lit("},\n{")).alias("value")).write.partitionBy("c_nationkey").text(path)
    return readers.json_files(x.spark, path, "id long, name string", recursive=True).select("id", "name")


@query("s05_file_range", "SELECT event_id FROM events WHERE event_id % 5 IN (1, 2)")
def _(x: Tables) -> DataFrame:
    """S-05: the second and third of five files."""
    path = scratch(x)
    writers.json_out(x.events.select("event_id", F.concat(F.lit("f"), F.col("event_id") % 5).alias("name")), path, by="name")
    rows = x.spark.read.schema("event_id long, name string").json(path).withColumnRenamed("name", "file_name")
    return readers.file_range(rows, 2, 3).select("event_id")


@query("s06_allowed_files", "SELECT event_id FROM events WHERE event_type IN ('click', 'error')")
def _(x: Tables) -> DataFrame:
    """S-06, S-07."""
    path = scratch(x)
    writers.json_out(x.events.select("event_id", "event_type"), path, by="event_type")
    rows = x.spark.read.schema("event_id long, event_type string").json(path).withColumnRenamed("event_type", "file_name")
    return readers.allowed_files(rows, x.spark.createDataFrame([("click",), ("error",), ("none",), ("click",)], "name string")).select("event_id")


@query("s08_whole_texts", "SELECT n_nationkey, concat('# ', n_name, chr(10), chr(10), 'region ', n_regionkey) AS text FROM nation")
def _(x: Tables) -> DataFrame:
    """S-08: a Markdown file each."""
    path = scratch(x)
    x.nation.select(F.concat(F.lit("# "), "n_name", F.lit("\n\nregion "), "n_regionkey").alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(path)
    texts = readers.whole_texts(x.spark, path)
    return texts.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("long").alias("n_nationkey"), F.rtrim("text", F.lit("\n")).alias("text"))


@query("s12_latin_triples", "SELECT concat('É', n_name) AS head, 'naît en' AS relation, concat('r', n_regionkey) AS tail FROM nation")
def _(x: Tables) -> DataFrame:
    """S-12: the other dialect of headings in Latin-1."""
    path = scratch(x)
    made = x.nation.select(F.concat(F.lit("É"), "n_name").alias("Subject"), F.lit("naît en").alias("Relation"), F.concat(F.lit("r"), "n_regionkey").alias("Object"), F.lit("book 1").alias("source"))
    made.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.triples(x.spark, path).select("head", "relation", "tail")


@query("s14_streamed_triples", "SELECT s_name AS source, s_nationkey::VARCHAR AS target FROM supplier")
def _(x: Tables) -> DataFrame:
    """S-14: files of triples as a stream, run to its end."""
    path = scratch(x)
    writers.csv_out(x.supplier.select(F.col("s_name").alias("source"), F.lit("in").alias("relationship"), F.col("s_nationkey").alias("target")).repartition(2), f"{path}/in")
    rows = x.spark.readStream.schema("source string, relationship string, target string").option("header", True).option("maxFilesPerTrigger", 1).csv(f"{path}/in")
    flows.run(rows.select("source", "target"), f"{path}/out", f"{path}/state").awaitTermination()
    return x.spark.read.parquet(f"{path}/out")


@query("s15_sample", "SELECT 25::BIGINT AS n, 25::BIGINT AS whole")
def _(x: Tables) -> DataFrame:
    """S-11, S-15: the row limit of a sample."""
    path = scratch(x)
    writers.csv_out(x.customer.select(F.col("c_name").alias("source"), F.lit("in").alias("relationship"), F.col("c_nationkey").alias("target")), path)
    rows = readers.triples(x.spark, path, limit=25)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("head").startswith("Customer") & (F.col("relation") == "in")).alias("whole"))


@query("s16_sheet_questions", "SELECT concat('What of ', n_name, '?') AS question, CASE WHEN n_regionkey > 0 THEN concat('r', n_regionkey) ELSE '' END AS category, n_name AS sub_category FROM nation WHERE n_nationkey % 4 > 0")
def _(x: Tables) -> DataFrame:
    """S-16, K-09: workbooks by the sink, read by headings that only resemble what is asked."""
    made = x.nation.select(F.col("n_nationkey").cast("string").alias("n"), F.when(F.col("n_nationkey") % 4 > 0, F.concat(F.lit("What of "), "n_name", F.lit("?"))).otherwise("n?"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit(" r"), "n_regionkey")), "n_name")
    folder = scratch(x)
    files = writers.sheets_out(made.repartition(3), folder, ["No.", "Seed Question", "类别", "Sub_Category <1>"])
    return readers.sheet_questions(readers.sheets(x.spark, paths_of(folder, files))).select("question", "category", "sub_category")


@query("s18_id_list", """WITH z AS (SELECT n_nationkey AS k, concat('papers/', n_regionkey, '/PMC', n_nationkey % 10, '.pdf') AS x, CASE WHEN n_nationkey % 3 = 0 THEN concat('PMC', n_nationkey % 10) WHEN n_nationkey % 3 = 1 THEN concat('D', n_nationkey % 4, '.x.md') END AS y FROM nation WHERE n_nationkey <> 7 UNION ALL SELECT 7, NULL, 'only\\here.txt'),
t AS (SELECT k, CASE WHEN x IS NULL THEN 'here' ELSE concat('PMC', k % 10) END AS id, CASE WHEN x IS NULL THEN 'only/here.txt' ELSE x END AS rel_path, CASE WHEN x IS NOT NULL AND k % 3 = 1 THEN concat('D', k % 4, '.x') END AS alt_id FROM z)
SELECT id, alt_id, arg_min(rel_path, k) AS rel_path FROM t GROUP BY id, alt_id""")
def _(x: Tables) -> DataFrame:
    """S-17, S-18."""
    k = F.col("n_nationkey")
    cells = x.nation.where("n_nationkey <> 7").select(k.cast("string").alias("k"), F.concat(F.lit("papers/"), "n_regionkey", F.lit("/PMC"), k % 10, F.lit(".pdf")), F.when(k % 3 == 0, F.concat(F.lit("PMC"), k % 10)).when(k % 3 == 1, F.concat(F.lit("D"), k % 4, F.lit(".x.md")))).toDF("k", "x", "y")
    cells = cells.union(x.spark.createDataFrame([("7", None, "only\\here.txt")], cells.schema))
    folder = scratch(x)
    rows = readers.sheets(x.spark, paths_of(folder, writers.sheets_out(cells.coalesce(2), folder))).where("row > 0")
    cell = lambda i: F.get("cells", F.lit(i))
    return readers.id_list(rows.select(cell(0).cast("int").alias("at"), cell(1).alias("a"), cell(2).alias("b")), "a", "b", "at").select("id", "alt_id", "rel_path")


@query("s20_ratios", "SELECT lang, count(*) AS documents, CASE lang WHEN 'en' THEN 0.5::DOUBLE WHEN 'de' THEN 0.25::DOUBLE WHEN 'pt br' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS share, floor((SELECT count(*) FROM documents) * CASE lang WHEN 'en' THEN 0.5::DOUBLE WHEN 'de' THEN 0.25::DOUBLE WHEN 'pt br' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END)::BIGINT AS wanted FROM documents GROUP BY lang")
def _(x: Tables) -> DataFrame:
    """S-20: a small configuration file, read on the driver, against the documents of each language and all of them."""
    shares = x.spark.createDataFrame(list(readers.ratios("# shares\nratios:\nen: 2\nde: 1.0\npt br: 1\n").items()), "lang string, share double")
    have = x.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"))
    told = have.join(shares, "lang", "left").join(have.agg(F.sum("documents").alias("all_")), F.lit(True))
    return told.select("lang", "documents", F.coalesce("share", F.lit(0.0)).alias("share"), F.floor(F.col("all_") * F.coalesce("share", F.lit(0.0))).alias("wanted"))


UPLOAD = "CASE WHEN turn = 0 THEN concat('{\"__type__\": \"dataset\", \"name\": \"set ', conv_id, '\"}') WHEN role = 'user' THEN concat('{\"question\": \"q', turn, '\", \"answer\": \"a', conv_id, '\", \"topic\": \"', role, '\"}') ELSE '{\"note\": 1}' END"


@query("s21_headed_uploads", "SELECT conv_id, concat('set ', conv_id) AS dataset, turn, concat('q', turn) AS question, concat('a', conv_id) AS answer, role AS topic, row_number() OVER (ORDER BY conv_id, turn) AS id FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) WHERE role = 'user' AND turn > 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0)")
def _(x: Tables) -> DataFrame:
    """S-21, S-23: files with a header record each, whose questions get ids over all files."""
    lines = x.conversations.select("conv_id", "turn", "role").distinct().select(F.col("conv_id").cast("string").alias("file_name"), (F.col("turn") + 1).alias("line"), F.expr(UPLOAD).alias("value"))
    heads, rows = readers.with_header(lines)
    named = rows.join(heads, "file_name").select(F.col("file_name").cast("long").alias("conv_id"), F.col("name").alias("dataset"), (F.col("line") - 1).alias("turn"), "question", "answer", F.col("extra")["topic"].alias("topic"))
    return o.numbered(named, ["conv_id", "turn"], "id")


@query("s22_append", "SELECT 'good' AS kind, count(*) AS n FROM events WHERE event_id % 7 > 0 AND event_id % 11 > 0 UNION ALL SELECT 'bad', count(*) FROM events WHERE event_id % 7 = 0 UNION ALL SELECT 'all', count(*) FILTER (event_id % 7 > 0 AND event_id % 11 > 0) + (SELECT count(*) FROM nation) FROM events")
def _(x: Tables) -> DataFrame:
    """S-22, K-01: rows with faults are told apart, the good ones join what is there; blank lines are no rows."""
    old, new = scratch(x), scratch(x)
    writers.json_out(x.nation.select(F.col("n_nationkey").alias("event_id"), F.col("n_name").alias("event_type")), old)
    line = F.when(F.col("event_id") % 7 == 0, '{"event_id": ').when(F.col("event_id") % 11 == 0, "").otherwise(F.to_json(F.struct("event_id", "event_type")))
    x.events.select(line.alias("value")).write.text(new)
    good, bad = readers.good_and_bad(readers.json_lines(x.spark, new, "event_id long, event_type string").cache())
    writers.json_out(good.select("event_id", "event_type"), old, mode="append")
    whole = readers.json_lines(x.spark, old, "event_id long, event_type string")
    return good.agg(F.lit("good").alias("kind"), F.count(F.lit(1)).alias("n")).union(bad.agg(F.lit("bad"), F.count(F.lit(1)))).union(whole.agg(F.lit("all"), F.count(F.lit(1))))


@query("s28_dialogues", "SELECT conv_id, array_to_string(list(concat(role, ': ', text) ORDER BY turn, role, text), chr(10)) AS said, count(*)::INT AS n FROM conversations GROUP BY conv_id")
def _(x: Tables) -> DataFrame:
    """S-28, K-17: nested dialogues, written and read back."""
    path = scratch(x)
    told = x.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))
    writers.json_out(told, path)
    read = readers.json_lines(x.spark, path, "conv_id long, messages array<struct<role:string,content:string>>")
    return read.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("said"), F.size("messages").alias("n"))


@query("s29_merged_batches", "SELECT CASE WHEN event_id % 2 = 0 THEN 'one' ELSE 'two' END AS batch, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE event_id % 13 > 0 GROUP BY ALL")
def _(x: Tables) -> DataFrame:
    """S-29: two folders, of which only lines that parse are merged, counted by folder."""
    folders = {"one": scratch(x), "two": scratch(x)}
    for i, path in enumerate(folders.values()):
        x.events.where(F.col("event_id") % 2 == i).select(F.when(F.col("event_id") % 13 == 0, "{broken").otherwise(F.to_json(F.struct("event_id"))).alias("value")).write.text(path)
    parts = [readers.good_and_bad(readers.json_lines(x.spark, p, "event_id long"))[0].withColumn("batch", F.lit(n)) for n, p in folders.items()]
    return parts[0].unionByName(parts[1]).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("s31_keyword_workbook", "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS word FROM documents), k(word, label) AS (VALUES ('the', 'en'), ('and', 'en'), ('der', 'de'), ('und', 'de'), ('les', 'fr'), ('que', 'fr')) SELECT doc_id, label, count(*) AS hits FROM w JOIN k USING (word) GROUP BY ALL")
def _(x: Tables) -> DataFrame:
    """S-19, S-31, C-13: a workbook of keyword lists becomes a table that words meet."""
    folder = scratch(x)
    book = x.spark.createDataFrame([("en", "The, and;AND"), ("de", "der、und，"), ("fr", " les ,que")], "label string, words string")
    rows = readers.sheets(x.spark, paths_of(folder, writers.sheets_out(book.coalesce(1), folder))).where("row > 0").select(F.get("cells", F.lit(0)).alias("label"), F.get("cells", F.lit(1)).alias("words"))
    return o.keyword_hits(x.documents, "doc_id", "text", readers.keyword_table(rows, "label", "words"))


@query("s32_articles", "SELECT c_custkey::VARCHAR AS id, c_name AS title, concat('in ', c_mktsegment, ' & <so>') AS abstract FROM customer")
def _(x: Tables) -> DataFrame:
    """S-32: files of one set of articles each."""
    path = scratch(x)
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    body = F.concat(tag("PMID", F.col("c_custkey").cast("string")), tag("Article", F.concat(tag("ArticleTitle", F.col("c_name")), tag("Abstract", tag("AbstractText", F.concat(F.lit("in "), "c_mktsegment", F.lit(" &amp; &lt;so&gt;")))))))
    rows = x.customer.select("c_nationkey", tag("PubmedArticle", tag("MedlineCitation", body)).alias("a"))
    sets = rows.groupBy("c_nationkey").agg(tag("PubmedArticleSet", F.array_join(F.collect_list("a"), "\n")).alias("value"))
    sets.write.partitionBy("c_nationkey").text(path)
    return readers.articles(x.spark, path)


@query("s33_allow_list", "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 2) SELECT event_id FROM events WHERE event_type IN (SELECT event_type FROM c)")
def _(x: Tables) -> DataFrame:
    """S-33: names from a saved report of counts; the two largest are allowed."""
    path = scratch(x)
    counts = x.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    writers.json_out(counts.agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counts")), path)
    names = readers.allow_list(x.spark.read.schema("counts map<string,long>").json(path), "counts", 2)
    return x.events.join(names.select(F.col("name").alias("event_type")), "event_type", "left_semi").select("event_id")


@query("k03_batches", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'batches', 3")
def _(x: Tables) -> DataFrame:
    """K-02, K-03, K-19: each micro-batch is a part of the master table and a snapshot of its own."""
    path = scratch(x)
    x.events.select("event_id", "event_type").repartition(3).write.parquet(f"{path}/in")
    rows = flows.read_files(x.spark, f"{path}/in", "event_id long, event_type string", files=1)

    def work(df: DataFrame, i: int) -> None:
        writers.json_out(df, f"{path}/batches/batch={i}")

    flows.each_batch(rows, work, f"{path}/state", "append").awaitTermination()
    master = x.spark.read.schema("event_id long, event_type string, batch int").json(f"{path}/batches")
    return master.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).union(master.agg(F.lit("batches"), F.countDistinct("batch")))


@query("k04_group_files", "SELECT lang, count(*) AS n, count(*) FILTER (source = 'src1') AS of_src1 FROM documents GROUP BY lang")
def _(x: Tables) -> DataFrame:
    """K-04, K-12, K-15: a folder of JSON lines for each group."""
    path = scratch(x)
    writers.json_out(x.documents.select("doc_id", "source", "lang"), path, by="lang")
    return x.spark.read.schema("doc_id long, source string, lang string").json(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "src1").alias("of_src1"))


@query("k09_unmatched", "SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::VARCHAR AS l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def _(x: Tables) -> DataFrame:
    """K-09, J-04: rows without a match, as workbooks."""
    lost = o.orphans(x.lineitem, x.orders.where("o_orderstatus = 'O'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")
    folder = scratch(x)
    rows = readers.sheets(x.spark, paths_of(folder, writers.sheets_out(lost, folder)))
    return rows.where("row > 0").select(F.get("cells", F.lit(0)).alias("l_orderkey"), F.get("cells", F.lit(1)).alias("l_linenumber"))


@query("k10_report", "SELECT unnest(['# Corpus', '', '## Languages', '', '| lang | n |', '| --- | --- |'] || (SELECT list(concat('| ', lang, ' | ', n, ' |') ORDER BY lang) FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang))) AS line")
def _(x: Tables) -> DataFrame:
    """K-10: a Markdown report, written as text and read back."""
    text = writers.markdown("Corpus", {"Languages": x.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang")})
    path = scratch(x)
    writers.text_out(x.spark.createDataFrame([(text.rstrip("\n"),)], "value string"), path)
    return x.spark.read.text(path).select(F.col("value").alias("line"))


@query("k11_flat_export", "SELECT conv_id::VARCHAR AS conv_id, concat('[', array_to_string(list(turn::VARCHAR ORDER BY turn), ','), ']') AS turns FROM conversations GROUP BY conv_id")
def _(x: Tables) -> DataFrame:
    """K-11: nested columns as JSON in CSV."""
    path = scratch(x)
    writers.csv_out(x.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns")), path)
    return x.spark.read.option("header", True).option("escape", '"').csv(path)


@query("k13_seed_export", "SELECT o_orderkey::VARCHAR AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS asked_on, CASE WHEN o_orderkey % 2 = 0 THEN '是' ELSE '否' END AS verified FROM orders")
def _(x: Tables) -> DataFrame:
    """K-13."""
    path = scratch(x)
    writers.csv_out(writers.seed_export(x.orders.select("o_orderkey", F.col("o_orderdate").alias("asked_on"), (F.col("o_orderkey") % 2 == 0).alias("verified")), "asked_on", "verified"), path)
    return x.spark.read.option("header", True).csv(path)


LOG_SQL = "e AS (SELECT concat('f', event_id % 300) AS file, event_type, event_id, CASE WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS state FROM events WHERE event_type IN ('purchase', 'error'))"


def event_log(x: Tables) -> DataFrame:
    done = F.col("event_type") == "purchase"
    return x.events.where("event_type in ('purchase', 'error')").select(F.concat(F.lit("f"), F.col("event_id") % 300).alias("file"), F.when(done, "completed").otherwise("failed").alias("state"), F.when(~done, F.concat(F.lit("e"), "user_id")).alias("error"), F.col("event_id").alias("at"))


@query("r03_progress", f"WITH {LOG_SQL}, l AS (SELECT file, max(event_id) FILTER (state = 'completed') AS done, max(event_id) AS last FROM e GROUP BY file) SELECT l.file, CASE WHEN done IS NOT NULL THEN 'completed' ELSE 'failed' END AS state, CASE WHEN done IS NULL THEN concat('e', v.user_id) END AS error, coalesce(done, last) AS at FROM l JOIN events v ON v.event_id = l.last")
def _(x: Tables) -> DataFrame:
    """R-03: what each file has come to, by a log that is appended to."""
    path = scratch(x)
    for half in (0, 1):
        writers.json_out(event_log(x).where(F.col("at") % 2 == half), path, mode="append")
    return flows.progress(x.spark.read.schema("file string, state string, error string, at long").json(path))


@query("r01_pending", f"WITH {LOG_SQL} SELECT DISTINCT concat('f', event_id % 300) AS file FROM events WHERE concat('f', event_id % 300) NOT IN (SELECT file FROM e WHERE state = 'completed')")
def _(x: Tables) -> DataFrame:
    """R-01, R-02, R-03."""
    return flows.pending(x.events.select(F.concat(F.lit("f"), F.col("event_id") % 300).alias("file")).distinct(), event_log(x))


@query("r04_quota", "WITH t AS (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) AS total, (SELECT sum(n_chars) // 3 FROM documents) AS quota FROM documents), a AS (SELECT doc_id, 1 AS run FROM t WHERE total <= quota), s AS (SELECT min(doc_id) AS at FROM t WHERE total > quota), u AS (SELECT d.doc_id, sum(n_chars) OVER (ORDER BY d.doc_id) AS total, (SELECT sum(n_chars) // 3 FROM documents) AS quota FROM documents d, s WHERE d.doc_id >= s.at) SELECT doc_id, run FROM a UNION ALL SELECT doc_id, 2 FROM u WHERE total <= quota")
def _(x: Tables) -> DataFrame:
    """R-04: a run stops where its quota is used up; the next one goes on from the file that is in the state."""
    path, docs = scratch(x), x.documents.select("doc_id", "n_chars")
    quota = docs.agg(F.sum("n_chars")).first()[0] // 3
    first, state = flows.until_quota(docs, "doc_id", "n_chars", quota)
    writers.json_out(state, path)
    second, _ = flows.until_quota(docs, "doc_id", "n_chars", quota, x.spark.read.schema("last_file long").json(path))
    return first.select("doc_id", F.lit(1).alias("run")).union(second.select("doc_id", F.lit(2)))


@query("r06_cache", "WITH n AS (SELECT user_id AS project, event_type AS language, arg_max(value, event_id) AS report, max(event_id) AS updated FROM events GROUP BY ALL) SELECT project, language, report, updated FROM n UNION ALL SELECT c_custkey, 'click', c_acctbal, -1 FROM customer WHERE (c_custkey, 'click') NOT IN (SELECT (project, language) FROM n)")
def _(x: Tables) -> DataFrame:
    """R-06, W-11: of new reports the last of a project and language replaces the one that is there."""
    old = x.customer.select(F.col("c_custkey").alias("project"), F.lit("click").alias("language"), F.col("c_acctbal").alias("report"), F.lit(-1).cast("long").alias("updated"))
    new = x.events.select(F.col("user_id").alias("project"), F.col("event_type").alias("language"), F.col("value").alias("report"), F.col("event_id").alias("updated"))
    new = new.groupBy("project", "language").agg(F.max_by("report", "updated").alias("report"), F.max("updated").alias("updated"))
    return o.upsert(old, new, "project", "language")


@query("r09_statistics", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY ALL")
def _(x: Tables) -> DataFrame:
    """R-09: statistics of each period, by a stream of files run to its end."""
    path = scratch(x)
    x.events.select("event_type", "value", F.col("ts").cast("timestamp").alias("ts")).repartition(2).write.parquet(f"{path}/in")
    rows = flows.read_files(x.spark, f"{path}/in", "event_type string, value double, ts timestamp", files=1)
    told = flows.windowed(rows, "ts", "3650 days", "1 day", None, "event_type")
    flows.each_batch(told, lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{path}/out"), f"{path}/state").awaitTermination()
    last = x.spark.read.parquet(f"{path}/out").groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("mean", "batch").alias("mean"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean")


@query("m02_claims", "WITH r AS (SELECT event_id % 400 AS k, concat('u', user_id) AS who, ts FROM events), w AS (SELECT k, min(struct_pack(t := ts, who := who)).who AS who FROM r GROUP BY k) SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'old' END, who) AS owner FROM customer LEFT JOIN w ON c_custkey = k")
def _(x: Tables) -> DataFrame:
    """M-02: of many claims of a task the earliest wins, and none takes one that has an owner."""
    tasks = x.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "old").alias("owner"))
    asks = x.events.select((F.col("event_id") % 400).alias("c_custkey"), F.concat(F.lit("u"), "user_id").alias("who"), F.col("ts").alias("at"))
    return o.claim_all(tasks, "c_custkey", "owner", asks)


@query("x03_strategies", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('UP ', upper(event_type)) ELSE concat('echo: ', event_type) END AS reply FROM events")
def _(x: Tables) -> DataFrame:
    """X-03: strategies by name; each row goes to its own."""
    known = flows.Services()
    known.register("upper", lambda prompts: [f"UP {p.upper()}" for p in prompts])
    e = x.events.select("event_id", "event_type")
    return known.ask(e.where("event_id % 2 = 0"), "upper", "event_type").union(known.ask(e.where("event_id % 2 <> 0"), "echo", "event_type")).select("event_id", "reply")


@query("x04_functions", "WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang) SELECT lang, round(-sum(n / total * ln(n / total)), 9) AS spread, (SELECT sum(greatest(1, ceil(length(text) / 1000.0)))::BIGINT FROM documents d WHERE d.lang = c.lang AND text IS NOT NULL) AS pieces FROM c JOIN t USING (lang) GROUP BY lang")
def _(x: Tables) -> DataFrame:
    """X-04: an aggregate and a table function that users can call in SQL."""
    udfs.register(x.spark)
    x.documents.createOrReplaceTempView("__docs")
    spread = x.spark.sql("SELECT lang, round(counts_entropy(n), 9) AS spread FROM (SELECT lang, source, count(*) AS n FROM __docs GROUP BY lang, source) GROUP BY lang")
    pieces = x.spark.sql("SELECT lang, count(*) AS pieces FROM __docs, LATERAL text_pieces(text, 1000) GROUP BY lang")
    return spread.join(pieces, "lang")


@query("t10_chapters", "SELECT c_custkey, 0 AS pos, '绪论' AS title, length(c_name)::INT AS length FROM customer UNION ALL SELECT c_custkey, 1, '方法', (length(c_mktsegment) + length(c_custkey::VARCHAR) + 7)::INT FROM customer")
def _(x: Tables) -> DataFrame:
    """T-05, T-10: chapters of a book without a table of contents, on the level of its first one, with lengths."""
    made = x.customer.select("c_custkey", F.concat(F.lit("# 绪论\n"), "c_name", F.lit("\n\n# 方法\n"), "c_mktsegment", F.lit("\n## 小节\n"), F.col("c_custkey").cast("string")).alias("text"))
    return ch.sections(made, "c_custkey", "text", ch.book_chapters).select("c_custkey", "pos", "title", "length")


@query("t06_fallback", """WITH z AS (SELECT c_custkey, repeat(concat(c_name, ' '), 3) AS a, repeat(concat(c_mktsegment, ' '), 20) AS b, repeat(concat(c_custkey, ' '), 60) AS c FROM customer)
SELECT c_custkey, 0 AS pos, CASE WHEN length(trim(a)) < 50 THEN '段落 2' ELSE '段落 1 / 段落 2' END AS title, 'paragraph' AS method, (CASE WHEN length(trim(a)) < 50 THEN 0 ELSE length(trim(a)) + 2 END + length(trim(b)))::INT AS length FROM z UNION ALL SELECT c_custkey, 1, '段落 4', 'paragraph', length(trim(c))::INT FROM z""")
def _(x: Tables) -> DataFrame:
    """T-06, T-07: paragraphs of a text without heads; those that are too short go, and a small one joins its successor."""
    again = lambda c, n: F.repeat(F.concat(F.col(c).cast("string"), F.lit(" ")), F.lit(n))
    made = x.customer.select("c_custkey", F.concat_ws("\n\n", again("c_name", 3), again("c_mktsegment", 20), F.lit("short"), again("c_custkey", 60)).alias("text"))
    return ch.sections(made, "c_custkey", "text", ch.thesis_sections).select("c_custkey", "pos", "title", "method", "length")
