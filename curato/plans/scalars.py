"""Queries of the scalar functions: cleaning, normalising, hashing, languages, estimates and quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curato.functions import judging as j
from curato.functions import patterns as W
from curato.functions import scores as s
from curato.functions import text as t
from curato.functions import values as v
from curato.plans.base import QA_SQL, Catalog, Tables, all_replaced

catalog = Catalog()
query = catalog.query
STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
SQUEEZE = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
IMAGE, LINK, SPACES, LINES = ("!\\[[^\\]]*?\\]\\([^\\)]*?\\)", " "), ("\\[([^\\]]+)\\]\\([^\\)]+\\)", "\\1"), ("[ \\t]{2,}", " "), ("\\n{3,}", "\n\n")
MATH = (("\\$\\$[^$]+\\$\\$", " "), ("\\$[^$]+\\$", " "))
TABLE, RULE, CODE = ("(?m)^\\s*\\|.*\\|\\s*$", " "), ("(?m)^[\\s\\-\\:\\|]+$", " "), ("(?s)```.*?```", " ")
#: Pages as Markdown with some of everything that cleaning removes.
MARKED = "concat('# Title ', page_id, chr(10), '![a](b.png) <b>', url, '</b> [', url, '](http://x) $x_1$ $$y$$', chr(10), '| a | b |', chr(10), '```code', chr(10), '```  ', html, chr(10), chr(10), chr(10), chr(10), 'end')"


def marked(x: Tables) -> DataFrame:
    return x.pages.select("page_id", F.expr(MARKED.replace("chr(10)", "'\\n'")).alias("m"))


def cleaned(name: str, fn, *steps: tuple[str, str]) -> None:
    sql = f"SELECT page_id, {STRIP(all_replaced('m', *steps))} AS cleaned FROM (SELECT page_id, {MARKED} AS m FROM pages)"
    query(name, sql)(lambda x: marked(x).select("page_id", fn("m").alias("cleaned")))


cleaned("p01_clean_markdown", t.clean_markdown, IMAGE, ("(?i)<img[^>]*?>", " "), ("<[^>]+>", " "), LINK, *MATH, TABLE, RULE, CODE, LINES, SPACES)
cleaned("p02_clean_patent", t.clean_markdown_patent, IMAGE, ("<[^>]+>", " "), LINK, *MATH, CODE, LINES, SPACES)
cleaned("p03_clean_book", t.clean_book, IMAGE, ("<(/?su[bp])([^>]*)>", "\x01\\1\\2\x02"), ("<[^>]+>", " "), ("\x01", "<"), ("\x02", ">"), LINK, TABLE, LINES, SPACES)


@query("p04_clean_thesis", "SELECT doc_id, regexp_replace(replace(text, chr(13), ''), '^\\s+|\\s+$', '', 'g') AS cleaned FROM documents")
def _(x: Tables) -> DataFrame:
    return x.documents.select("doc_id", t.clean_thesis_effective("text").alias("cleaned"))


@query("p04_clean_thesis_full", f"""SELECT page_id, length({all_replaced("concat('Figure 3 shows <i>', url, '</i> as in [12] and (2019a), $x$ end')", ("<[^>]+>", " "), ("(?i)(Figure|Table|Fig\\.)\\s*\\d+([：:])?", "图表"), ("\\$[^$]+\\$", "公式"), ("\\[\\s*\\d+\\s*\\]", "[参考文献]"), ("\\(\\s*\\d{4}[a-z]?\\s*\\)", "(年份)"), SPACES)}) AS n FROM pages""")
def _(x: Tables) -> DataFrame:
    return x.pages.select("page_id", F.length(t.clean_thesis(F.concat(F.lit("Figure 3 shows <i>"), "url", F.lit("</i> as in [12] and (2019a), $x$ end")))).alias("n"))


NORMALS = {
    "p05_sanitize": (t.sanitize_phrases, STRIP(all_replaced("text", ("\\n+", " "), ("\\s{2,}", " "), ("([，。；：])[，。；：]+", "\\1"), ("^[，；：、\\s]+", "")))),
    "p06_graph_text": (t.clean_graph_text, f"CASE WHEN lower({SQUEEZE('text')}) NOT IN ('nan', '') THEN {SQUEEZE('text')} END"),
    "p07_squeeze": (t.squeeze, SQUEEZE("text")),
    "p08_controls": (t.normalize_controls, SQUEEZE("regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')")),
    "p09_duplicate_key": (t.normalize_for_duplicates, f"regexp_replace({SQUEEZE('lower(text)')}, '[，。、“”‘’…：:;；.!?？]+', ' ', 'g')"),
    "p10_entity_key": (t.entity_key, all_replaced(SQUEEZE("lower(text)"), ("[`''\"“”‘’]", ""), ("[_\\-]+", " "), ("\\s*\\(\\s*", "("), ("\\s*\\)\\s*", ")"))),
}
for _name, (_fn, _sql) in NORMALS.items():
    query(_name, f"SELECT doc_id, {_sql} AS out FROM documents")(lambda x, f=_fn: x.documents.select("doc_id", f("text").alias("out")))

#: Headings made of sections, numbers and words of documents.
HEADS = "concat((doc_id % 7) + 1, CASE WHEN doc_id % 3 > 0 THEN concat('.', doc_id % 5 + 1) ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN ' Results and Discussion (' ELSE ' Materials and Methods (' END, source, ')  ', doc_id)"
CLEAN_HEAD = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '^[0-9]+(\\.[0-9]+)*\\s+', ''), '\\s+[0-9]+\\s*$', ''), '[（(]([^）)]*)[）)]', '\\1', 'g'), '\\s+', ' ', 'g'))"


@query("p11_headings", f"""WITH x AS (SELECT doc_id, {HEADS} AS h FROM documents)
SELECT doc_id, {CLEAN_HEAD} AS title, (length(regexp_extract(h, '^([0-9]+(\\.[0-9]+)*)', 1)) - length(replace(regexp_extract(h, '^([0-9]+(\\.[0-9]+)*)', 1), '.', '')) + 1)::INT AS level,
    regexp_extract(regexp_replace(h, '\\s+', '', 'g'), '^([0-9]+(\\.[0-9]+)*)', 1) AS number, {all_replaced('h', ('^[0-9]+(\\.[0-9]+)*\\s+', ''), ('\\s+[0-9]+\\s*$', ''), ('[^a-zA-Z0-9]', ''))} AS core, FALSE AS symbols_only,
    CASE WHEN doc_id % 2 = 0 THEN 'Results & Discussion' ELSE 'Materials & Methods' END AS section,
    CASE WHEN doc_id % 2 = 0 THEN '结果' ELSE '方法' END AS kind, doc_id % 2 = 1 AS is_method, doc_id % 2 = 0 AS is_result, TRUE AS reasoning FROM x""")
def _(x: Tables) -> DataFrame:
    """P-11 to P-17."""
    h = x.documents.select("doc_id", F.expr(HEADS).alias("h"))
    return h.select("doc_id", t.clean_title("h", True).alias("title"), t.heading_level("h").cast("int").alias("level"), j.numeric_prefix("h").alias("number"), j.core_title("h").alias("core"), t.only_numbers_and_symbols("h").alias("symbols_only"), t.main_section("h").alias("section"), t.section_type("h", F.lit("")).alias("kind"), t.is_method("h").alias("is_method"), t.is_result("h").alias("is_result"), t.suits_reasoning("h").alias("reasoning"))


@query("p18_languages", """SELECT doc_id, CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' WHEN regexp_matches(text, '[éèêàùçïîôûÉÈÊÀÙÇÏÎÔÛ]') OR regexp_matches(lower(text), 'remerciements|résumé|resume|jury d|avant-propos|préface') THEN 'fr' ELSE 'en' END AS lang_found,
    CASE WHEN text = '' THEN 'other' WHEN length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / length(text) > 0.5 THEN 'en' ELSE 'other' END AS patent_lang, regexp_matches(text, '[㐀-鿿豈-﫿]') AS cjk FROM documents""")
def _(x: Tables) -> DataFrame:
    """P-18 to P-20."""
    return x.documents.select("doc_id", t.language("text").alias("lang_found"), t.patent_language("text").alias("patent_lang"), t.has_cjk("text").alias("cjk"))


@query("p21_tokens", """SELECT doc_id, (len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3)::DOUBLE AS w, floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3)::INT AS by_words,
    floor(length(text) / 3.5)::INT AS by_chars, greatest(1, length(text) // 4)::INT AS effective FROM documents""")
def _(x: Tables) -> DataFrame:
    return x.documents.select("doc_id", (F.size(t.words_of("text")) * 1.3).alias("w"), t.tokens_by_words("text").alias("by_words"), t.tokens_by_chars("text").alias("by_chars"), t.tokens_effective("text").alias("effective"))


@query("p22_model_tokens")
def _(x: Tables) -> DataFrame:
    """Counts of a tokenizer where its vocabulary is at hand, else P-21."""
    return x.documents.select("doc_id", v.model_tokens("text").alias("n_tokens"))


@query("p23_cost", "SELECT event_id, (value / 1e6 * 0.5 + user_id / 1e6 * 1.5) AS cost FROM events")
def _(x: Tables) -> DataFrame:
    return x.events.select("event_id", t.cost("value", "user_id", F.lit(0.5), F.lit(1.5)).alias("cost"))


@query("p24_hashes", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, substr(sha256(text), 1, 8) AS short, sha256(concat('salt', text)) AS salted, substr(md5(text), 1, 8) AS id FROM documents")
def _(x: Tables) -> DataFrame:
    h = t.hashes("text")
    return x.documents.select("doc_id", *[h[k].alias(k) for k in ("md5", "sha1", "sha256", "short")], t.salted_hash("text", "salt").alias("salted"), t.short_id("text").alias("id"))


@query("p24_keyed_hashes")
def _(x: Tables) -> DataFrame:
    return x.documents.select("doc_id", v.keyed_hashes("text", "key").alias("h")).select("doc_id", "h.*")


@query("p26_pair_hash", f"WITH {QA_SQL} SELECT doc_id, md5(concat({STRIP('q')}, '|||', {STRIP('a')})) AS pair_hash FROM qa")
def _(x: Tables) -> DataFrame:
    return x.qa().select("doc_id", t.pair_hash("q", "a").alias("pair_hash"))


@query("p27_token_set", f"WITH {QA_SQL} SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(q), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+'), lambda w: w <> ''))), ' ')) AS h FROM qa")
def _(x: Tables) -> DataFrame:
    return x.qa().select("doc_id", t.token_set_hash("q").alias("h"))


SIM = """tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(q), '[a-z0-9]+')) AS tok FROM qa),
bits AS (SELECT doc_id, i, sum(CASE WHEN (('0x' || substr(md5(tok), CASE WHEN i < 32 THEN 25 ELSE 17 END, 8))::BIGINT >> (i % 32)) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM tok, range(64) AS r(i) GROUP BY doc_id, i),
sim AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << i) END ELSE 0 END)::BIGINT AS h FROM bits GROUP BY doc_id)"""


@query("p28_simhash", f"WITH {QA_SQL}, {SIM} SELECT qa.doc_id, coalesce(h, 0) AS h, bit_count(xor(coalesce(h, 0), 255::BIGINT))::INT AS to_255 FROM qa LEFT JOIN sim ON qa.doc_id = sim.doc_id")
def _(x: Tables) -> DataFrame:
    """P-28, P-29."""
    return x.qa().select("doc_id", t.simhash(t.simhash_tokens("q")).alias("h")).select("doc_id", "h", t.hamming("h", F.lit(255).cast("long")).cast("int").alias("to_255"))


@query("p30_snowflake", "SELECT event_id, (epoch_us(ts) // 1000 - 1288834974657) * 4194304 + (user_id % 32) * 131072 + (event_id % 32) * 4096 + event_id % 4096 AS id, epoch_us(ts) // 1000 AS ms, user_id % 32 AS datacenter, event_id % 4096 AS sequence FROM events")
def _(x: Tables) -> DataFrame:
    made = x.events.select("event_id", t.snowflake(v.epoch_ms("ts"), F.col("user_id") % 32, F.col("event_id") % 32, F.col("event_id") % 4096).alias("id"))
    return made.select("event_id", "id", t.snowflake_parts("id").alias("p")).select("event_id", "id", "p.ms", "p.datacenter", "p.sequence")


@query("p31_stable_choice", "SELECT doc_id, ['a', 'b', 'c', 'd', 'e'][('0x' || substr(sha256(source), 1, 8))::BIGINT % 5 + 1] AS pick FROM documents")
def _(x: Tables) -> DataFrame:
    return x.documents.select("doc_id", t.stable_choice(list("abcde"), "source").alias("pick"))


@query("p32_protect", "SELECT doc_id, replace(replace(text, 'Apache', '__NAME_0__'), 'the', '__NAME_1__') AS hidden, text AS back FROM documents")
def _(x: Tables) -> DataFrame:
    names = ["the", "Apache"]
    return x.documents.select("doc_id", t.protect("text", names).alias("hidden")).select("doc_id", "hidden", t.restore("hidden", names).alias("back"))


@query("p34_think", f"WITH {QA_SQL} SELECT doc_id, {STRIP('q')} AS think, {STRIP('a')} AS answer, {STRIP('q')} AS cited FROM qa")
def _(x: Tables) -> DataFrame:
    """P-33 to P-35."""
    raw = x.qa().select("doc_id", F.concat(F.lit("<think> "), "q", F.lit(" </think>\n"), "a").alias("r"), F.concat(F.lit("x <cited>"), "q", F.lit("</cited>")).alias("c"))
    return raw.select("doc_id", t.split_think("r").alias("s"), F.coalesce(t.tagged("c", "cited"), F.lit("")).alias("cited")).select("doc_id", "s.think", "s.answer", "cited")


@query("p36_judge_scores", "SELECT doc_id, (quality * 4 + 1)::DOUBLE AS accuracy, (toxic + 3)::DOUBLE AS relevance, round_even((quality * 4 + 1 + toxic + 3 + 3.5 + 4) / 4, 1)::DOUBLE AS total FROM labels")
def _(x: Tables) -> DataFrame:
    said = F.concat(F.lit("准确性: "), F.col("quality") * 4 + 1, F.lit("\n相关性: "), F.col("toxic") + 3, F.lit("\n完整性: 3.5\n清晰度: 4"))
    return x.labels.select("doc_id", t.judge_scores(said).alias("s")).select("doc_id", "s.accuracy", "s.relevance", "s.total")


@query("p37_numbered_pairs", f"WITH {QA_SQL}, z AS (SELECT doc_id, concat('which ', regexp_replace(q, '[QA]', '', 'g')) AS x, concat('since ', regexp_replace(a, '[QA]', '', 'g')) AS y FROM qa) SELECT doc_id, {STRIP('x')} AS question, {STRIP('y')} AS answer FROM z UNION ALL SELECT doc_id, {STRIP('y')}, {STRIP('x')} FROM z")
def _(x: Tables) -> DataFrame:
    z = x.qa().select("doc_id", *[F.concat(F.lit(w), F.coalesce(F.regexp_replace(c, "[QA]", ""), F.lit(""))).alias(to) for w, c, to in (("which ", "q", "x"), ("since ", "a", "y"))])
    said = F.concat(F.lit("Q1: "), "x", F.lit("\nA1: "), "y", F.lit("\nQ2: "), "y", F.lit("\nA2: "), "x")
    return z.select("doc_id", F.explode(t.numbered_pairs(said)).alias("p")).select("doc_id", "p.question", "p.answer")


@query("p38_citation", "SELECT c_custkey, concat(CASE WHEN c_custkey % 2 = 0 THEN 'A, B, C, et al.' ELSE 'A, B' END, '. ', c_name, '. ', c_mktsegment, ', 2020') AS cite FROM customer")
def _(x: Tables) -> DataFrame:
    return x.customer.select("c_custkey", t.citation(F.when(F.col("c_custkey") % 2 == 0, "A, B, C, D").otherwise("A, B"), "c_name", "c_mktsegment", F.lit(2020)).alias("cite"))


@query("p39_context", f"WITH {QA_SQL} SELECT doc_id, concat('[1] ', substr(q, 1, 800), chr(10), chr(10), '[2] ', substr(a, 1, 800)) AS ctx FROM qa")
def _(x: Tables) -> DataFrame:
    return x.qa().select("doc_id", t.context(F.array("q", "a")).alias("ctx"))


@query("p40_filename", "SELECT page_id, regexp_replace(url, '[<>:\"/\\\\|?*]', '_', 'g') AS name, concat('Source ', url, ' of ', page_id, '.') AS prompt FROM pages")
def _(x: Tables) -> DataFrame:
    """P-40, P-41."""
    return x.pages.select("page_id", t.safe_filename("url").alias("name"), t.template("Source {url} of {id}.", url="url", id="page_id").alias("prompt"))


@query("p43_reasoning_text", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE concat(event_type, ' ', user_id) END AS cot FROM events")
def _(x: Tables) -> DataFrame:
    shapes = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.struct(F.col("event_type").alias("content")).alias("reasoning")))).otherwise(F.to_json(F.struct(F.array(F.col("event_type"), F.col("user_id").cast("string")).alias("reasoning_content"))))
    return x.events.select("event_id", v.reasoning_text(shapes).alias("cot"))


@query("p50_dates", "SELECT o_orderkey, o_orderdate::DATE AS d, strftime(o_orderdate, '%Y-%m-%d') AS iso, concat_ws('-', year(o_orderdate), month(o_orderdate)) AS published FROM orders")
def _(x: Tables) -> DataFrame:
    """P-50 to P-52: either date format."""
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return x.orders.select("o_orderkey", v.parse_date(raw).alias("d"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), v.published(F.year("o_orderdate"), F.month("o_orderdate"), F.lit(None)).alias("published"))


@query("p53_rates", "SELECT user_id, count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0) AS per_second FROM events GROUP BY user_id")
def _(x: Tables) -> DataFrame:
    return x.events.groupBy("user_id").agg(v.rate(F.count(F.lit(1)), F.min("ts"), F.max("ts")).alias("per_second"))


@query("p54_quotas", """SELECT doc_id, CASE WHEN n_chars < 100 THEN 0 WHEN n_chars < 200 THEN 1 WHEN n_chars < 2000 THEN 2 ELSE least(40, n_chars // 2000 + 1) END::INT AS per_chunk,
    greatest(80, least(300, round_even((doc_id % 20) * 15 * least(1.4, greatest(0.75, sqrt(greatest(n_chars, 1) / 120000))), 0)))::INT AS per_thesis FROM documents""")
def _(x: Tables) -> DataFrame:
    """P-54, P-55."""
    return x.documents.select("doc_id", s.chunk_quota("n_chars").alias("per_chunk"), s.thesis_quota("n_chars", F.col("doc_id") % 20).alias("per_thesis"))


@query("p56_stages", f"""WITH {QA_SQL}, z AS (SELECT *, ['easy', 'medium', 'hard'][doc_id % 3 + 1] AS d, len(list_filter(string_split(a, chr(10)), lambda l: trim(l) <> '')) AS n FROM qa)
SELECT doc_id, CASE WHEN d = 'easy' AND n <= 3 THEN 1 WHEN d IN ('easy', 'medium') AND n > 3 AND n <= 5 THEN 2 ELSE 3 END::INT AS stage, CASE WHEN doc_id % 2 = 0 THEN d WHEN length(q) < 40 THEN 'easy' WHEN length(q) < 80 THEN 'medium' ELSE 'hard' END AS difficulty FROM z""")
def _(x: Tables) -> DataFrame:
    """P-56, P-57."""
    d = F.element_at(F.array(*[F.lit(w) for w in ("easy", "medium", "hard")]), (F.col("doc_id") % 3 + 1).cast("int"))
    return x.qa().select("doc_id", s.curriculum_stage(d, "a").alias("stage"), s.difficulty(F.when(F.col("doc_id") % 2 == 0, d).otherwise("?"), "q").alias("difficulty"))


EFFORT = " + ".join(f"contains(x, '{w}')::INT" for w in j.COMPLEX_WORDS)


@query("p58_effort", f"""WITH {QA_SQL}, z AS (SELECT doc_id, concat(q, CASE WHEN doc_id % 4 = 0 THEN '方案设计与评估' WHEN doc_id % 4 = 1 THEN '机制' ELSE '' END) AS x, CASE WHEN doc_id % 3 = 0 THEN '方案设计' ELSE 'other' END AS sub FROM qa),
b AS (SELECT doc_id, sub, length({STRIP('x')}) AS n, ({EFFORT}) >= 3 AS hard FROM z), e AS (SELECT doc_id, sub, CASE WHEN n < 25 THEN 'minimal' WHEN n < 60 THEN CASE WHEN hard THEN 'medium' ELSE 'low' END WHEN n < 120 THEN CASE WHEN hard AND n > 80 THEN 'high' ELSE 'medium' END ELSE 'high' END AS base FROM b)
SELECT doc_id, CASE WHEN sub = '方案设计' AND base = 'minimal' THEN 'low' WHEN sub = '方案设计' AND base = 'low' THEN 'medium' ELSE base END AS effort FROM e""")
def _(x: Tables) -> DataFrame:
    """P-58."""
    made = F.concat("q", F.when(F.col("doc_id") % 4 == 0, "方案设计与评估").when(F.col("doc_id") % 4 == 1, "机制").otherwise(""))
    return x.qa().select("doc_id", j.think_effort(made, F.when(F.col("doc_id") % 3 == 0, "方案设计").otherwise("other")).alias("effort"))


TERMS = " + ".join(f"contains(t, '{w}')::INT" for w in dict.fromkeys(W.TECHNICAL))


@query("p59_complexity", f"""WITH {QA_SQL}, z AS (SELECT doc_id, lower(concat(q, ' ', a)) AS t FROM qa), p AS (SELECT doc_id, t, length(t) AS n, list_transform(regexp_split_to_array(t, '[.!?。！？]'), lambda x: length(x)) AS parts FROM z),
c AS (SELECT doc_id, greatest(1, least(5, round_even(least(5, ({TERMS}) / greatest(n / 10, 1) * 100) * 0.3 + least(5, list_sum(parts) / greatest(1, len(parts)) / 30) * 0.2 + least(5, n / 1000) * 0.2
    + least(5, len(regexp_extract_all(t, '\\d+\\.?\\d*%?')) / 10) * 0.15 + least(5, len(regexp_extract_all(t, '[α-ωΑ-ΩΣμ→℃±]')) / 20) * 0.15, 0)))::INT AS complexity FROM p)
SELECT doc_id, complexity, CASE WHEN complexity <= 3 THEN 'medium' ELSE 'hard' END AS difficulty FROM c""")
def _(x: Tables) -> DataFrame:
    """P-59, P-60."""
    z = x.qa().select("doc_id", s.complexity("q", "a").alias("complexity"))
    return z.withColumn("difficulty", s.fit_difficulty("complexity", F.array(F.lit("medium"), F.lit("hard")), F.lit(2), F.lit(None).cast("string")))


@query("p61_json_nulls", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('{\"a\":', user_id, '}') ELSE concat('{\"a\":', user_id, ',\"b\":[1]}') END AS j FROM events")
def _(x: Tables) -> DataFrame:
    b = F.when(F.col("event_id") % 2 == 1, F.lit("[1,null]")).otherwise(F.lit("null"))
    return x.events.select("event_id", v.without_nulls(F.concat(F.lit('{"a":'), "user_id", F.lit(',"b":'), b, F.lit("}"))).alias("j"))


@query("p62_record_text", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN concat(event_type, chr(10), 'x') ELSE user_id::VARCHAR END AS body FROM events")
def _(x: Tables) -> DataFrame:
    """P-62: text by priority of paths; lists are joined by line breaks."""
    raw = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("text")))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.array("event_type", F.lit("x")).alias("content")))).otherwise(F.to_json(F.struct(F.struct(F.col("user_id").cast("string").alias("text")).alias("data"))))
    return x.events.select("event_id", v.record_text(raw, ["$.text", "$.content", "$.data.text"]).alias("body"))


@query("p63_first_array", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'plant' WHEN 1 THEN 'animal' ELSE 'microbe' END AS kind FROM events")
def _(x: Tables) -> DataFrame:
    some, none = F.array(F.lit("g")), F.array().cast("array<string>")
    at = lambda i: F.when(F.col("event_id") % 3 == i, some).otherwise(none)
    return x.events.select("event_id", v.first_filled([("plant", at(0)), ("animal", at(1)), ("microbe", at(2))]).alias("kind"))


@query("p64_json_found", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(x: Tables) -> DataFrame:
    """P-64, P-65: JSON inside fences, behind text, or cut short."""
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("so "), "props", F.lit(" done"))).otherwise(F.expr("substr(props, 1, length(props) - 1)"))
    return x.events.select("event_id", F.get_json_object(v.find_json(raw), "$.k").alias("k"))


@query("p66_json_documents", "SELECT event_id, event_type AS title, user_id::VARCHAR AS body FROM events")
def _(x: Tables) -> DataFrame:
    raw = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("title"), F.col("user_id").cast("string").alias("text"))).alias("documents")))
    return x.events.select("event_id", F.explode(v.json_documents(raw)).alias("d")).select("event_id", "d.title", F.col("d.text").alias("body"))


@query("p68_tag_prefix", "SELECT doc_id, array_to_string(list_distinct([source]), ',') AS cats FROM documents")
def _(x: Tables) -> DataFrame:
    tags = F.array(F.concat(F.lit("EXP_CAT:"), "source"), F.lit("other"), F.concat(F.lit("EXP_CAT: "), "source"))
    return x.documents.select("doc_id", F.array_join(v.prefixed(tags, "EXP_CAT:"), ",").alias("cats"))


@query("p69_first_messages", "SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS u, min_by(text, turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id")
def _(x: Tables) -> DataFrame:
    """P-69, P-70."""
    return x.conversations.groupBy("conv_id").agg(v.first_message("role", "turn", "text", "user").alias("u"), v.first_message("role", "turn", "text", "assistant").alias("a"))


@query("p71_inherited", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), c_mktsegment) AS config FROM orders JOIN customer ON o_custkey = c_custkey")
def _(x: Tables) -> DataFrame:
    """P-71, P-72: a dataset's own configuration, else its project's."""
    return x.orders.join(x.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("O")), "c_mktsegment").alias("config"))


@query("p67_annotation_values", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN floor(value)::INT::VARCHAR WHEN 1 THEN event_type WHEN 2 THEN CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END ELSE concat(event_type, ',x') END AS simple FROM events")
def _(x: Tables) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in ("score", "category", "binary", "choice")]), (F.col("event_id") % 4 + 1).cast("int"))
    raw = F.to_json(F.struct(F.expr("cast(floor(value) as int)").alias("score"), F.col("event_type").alias("category"), (F.col("user_id") % 2 == 0).alias("binary"), F.array("event_type", F.lit("x")).alias("choice")))
    return x.events.select("event_id", v.simple_value(kind, raw).alias("simple"))


@query("p73_running_mean", "SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events")
def _(x: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return x.events.select("event_id", F.avg("value").over(w).alias("running"))
