"""Topical classifiers: keyword rules, BM25 over sentences, weighted patterns, and a cascade with a trained model behind a gate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curato.functions.text import C, any_of, col, count_words_in, first_rule
from curato.operators.chunking import sentences

# Fixed values.
CORE = ["agriculture", "farming", "crops", "farm", "farmers", "livestock", "wheat", "corn", "rice", "soybean", "vegetables", "fruits", "农业", "作物", "种植", "收获", "土壤", "灌溉", "施肥", "农作物", "畜牧业", "养殖"]
CONCEPTS = ["农业", "agriculture", "种植", "cultivation", "收获", "harvesting", "作物", "crop", "畜牧", "livestock", "渔业", "fishery", "林业", "forestry"]
TECHNICAL_TERMS = ["基因", "gene", "育种", "breeding", "施肥", "fertilizer", "灌溉", "irrigation", "农药", "pesticide", "土壤", "soil"]
DOUBTFUL = ["system", "stem", "operation", "price", "production", "food"]
OTHER_CONTEXTS = ["computer", "software", "digital", "electronic", "algorithm", "financial", "economic", "business", "corporate", "company", "commercial", "industrial", "manufacturing", "market", "investment", "stock", "bank", "real estate", "property", "entrepreneur", "cell", "therapy", "surgery", "medical", "hospital", "pharmaceutical", "drug", "treatment", "clinic", "media", "film", "television", "entertainment", "music", "movie", "broadcasting", "publishing", "food industry", "food company", "food market", "food service", "production facility", "production process", "production system"]
SPECIES = [("大豆", ["大豆", "soybean"]), ("水稻", ["水稻", "rice"]), ("小麦", ["小麦", "wheat"]), ("玉米", ["玉米", "corn", "maize"]), ("油菜", ["油菜", "rapeseed", "canola"]), ("畜禽", ["畜禽", "livestock", "animal"]), ("合成生物技术", ["合成", "生物技术", "synthetic"])]
IDENTITY = ["我究竟是", "我的身份", "我的角色", "我是谁", "我应该是", "我的定位", "作为.*专家", "作为.*助手", "我的职责", "我的使命"]
METACOGNITION = ["我之所以", "我的思考", "我认为", "我选择", "我判断", "我理解", "我的推理", "我的分析", "元认知", "过程解释", "我的方法"]
DATA_ANALYSIS = ["分析", "检测", "测序", "解读", "评估", "鉴定", "预测", "重测序", "转录组", "基因组", "GWAS", "QTL", "SNP", "表达量", "差异表达", "富集分析", "结构变异", "SV"]
K1, B, MEAN_WORDS = 1.2, 0.75, 100


def broad(c: C, words: list[str], core: list[str], excluded: list[str]) -> Column:
    """C-02: fewer than three excluded words, and a core word or two others."""
    t = F.lower(col(c))
    return (count_words_in(t, excluded) < 3) & (any_of(t, core) | (count_words_in(t, [w for w in words if len(w) > 2]) >= 2))


def strict(c: C, words: list[str], excluded: list[str]) -> Column:
    """C-03, C-04: a core word, and one word that holds no excluded word."""
    t = F.lower(col(c))
    good = [w for w in words if not any(e in w for e in excluded)]
    return any_of(t, CORE) & (count_words_in(t, good) >= 1)


def production(c: C, words: list[str], crops: list[str], contexts: list[str], excluded: list[str]) -> Column:
    """C-05: a word or crop, a context of production, one excluded word at most."""
    t = F.lower(col(c))
    return (count_words_in(t, [*words, *crops]) >= 1) & any_of(t, contexts) & (count_words_in(t, excluded) <= 1)


def keyword(c: C, words: list[str], excluded: list[str], least: int = 2) -> Column:
    """C-06: no excluded word; enough words, and a core concept, twice as many words, or a technical term."""
    t = F.lower(col(c))
    n = count_words_in(t, [w.lower() for w in words])
    gone = any_of(t, excluded) if excluded else F.lit(False)
    return ~gone & (n >= least) & (any_of(t, CONCEPTS) | (n >= 2 * least) | any_of(t, TECHNICAL_TERMS))


def bm25(df: DataFrame, key: str, text: str, keywords: list[str], excluded: list[str]) -> DataFrame:
    """C-01: key, score: the best score of a keyword in a sentence; 0 for texts with an excluded context.

    A sentence's words are counted where they are: only the terms that it has leave the row, and no other word is shuffled. A
    keyword's terms are added up. A doubtful term with words of another field within five words of it makes its keyword worth
    nothing in that sentence; sentences without a doubtful term are not looked at for that.
    """
    spark = df.sparkSession
    idf = math.log(len(keywords) + 1) + 1
    of = [(k, t) for k in keywords for t in k.lower().split()]
    terms = sorted({t for _, t in of})
    doubtful = [t for t in DOUBTFUL if t in terms]
    parts = df.where(~any_of(F.lower(text), excluded) if excluded else F.lit(True)).select(key, F.posexplode(sentences(text)).alias("pos", "s")).select(key, "pos", F.lower("s").alias("s"))
    # a sentence without any term is left before its words are looked at
    found = parts.where(any_of("s", terms)).select(key, "pos", "s", F.filter(F.regexp_extract_all("s", F.lit(r"\b([a-z]+)\b"), 1), lambda w: F.length(w) >= 2).alias("w"))
    hits = found.select(key, "pos", "s", F.size("w").alias("n"), F.filter("w", lambda w: w.isin(*terms)).alias("h")).where("size(h) > 0")
    if doubtful:
        words = F.split("s", r"\s+")
        at = lambda t: F.array_position("all", t).cast("int")
        near = lambda t: (at(t) > 0) & any_of(F.array_join(F.slice("all", F.greatest(F.lit(1), at(t) - 5), F.least(at(t) - 1, F.lit(5)) + 6), " "), OTHER_CONTEXTS)
        hits = hits.withColumn("all", F.when(F.arrays_overlap("h", F.array(*[F.lit(t) for t in doubtful])), words))
        veto = F.array_compact(F.array(*[F.when(near(F.lit(t)), F.lit(t)) for t in doubtful]))
        hits = hits.withColumn("veto", F.when(F.col("all").isNotNull(), veto).otherwise(F.array().cast("array<string>")))
    else:
        hits = hits.withColumn("veto", F.array().cast("array<string>"))
    tf = F.transform(F.array_distinct("h"), lambda t: F.struct(t.alias("term"), F.size(F.filter("h", lambda w: w == t)).alias("tf"), F.array_contains("veto", t).alias("bad")))
    met = hits.select(key, "pos", "n", F.explode(tf).alias("t")).select(key, "pos", "n", "t.*").join(F.broadcast(spark.createDataFrame(of, "keyword string, term string").distinct()), "term")
    worth = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("n") / MEAN_WORDS)) * idf
    if all(len(k.split()) == 1 for k in keywords):
        per = met.where("not bad").select(key, worth.alias("score"))
    else:
        per = met.groupBy(key, "pos", "keyword").agg(F.sum(worth).alias("score"), F.max("bad").alias("bad")).where("not bad")
    best = per.groupBy(key).agg(F.max("score").alias("score"))
    return df.select(key).join(best, key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"))


def species(name: C) -> Column:
    """C-09: by words of a file name or text."""
    return first_rule([(any_of(F.lower(col(name)), w), n) for n, w in SPECIES], "未知")


def category(q: C) -> Column:
    """C-10: struct of category and sub-category; patterns are matched literally."""
    kinds = [(IDENTITY, "自我认知", "身份与角色定位"), (METACOGNITION, "自我认知类语料", "元认知与过程解释"), (DATA_ANALYSIS, "场景化任务与指令遵循类语料", "数据分析与解读")]
    pick = lambda i, otherwise: first_rule([(any_of(q, k[0]), k[i]) for k in kinds], otherwise)
    return F.struct(pick(1, "核心知识问答").alias("category"), pick(2, "物种特异性知识问答").alias("sub_category"))


def weighted(c: C, table: dict[str, list[tuple[str, float]]], floor: float = 0.0, priors: dict[str, float] | None = None) -> Column:
    """C-11, C-12, C-14: the kind whose patterns weigh most, the first of equal ones; null under the floor."""
    t = F.lower(col(c))
    scores = [F.struct(sum((F.when(t.rlike(p), w).otherwise(0.0) for p, w in ps), F.lit((priors or {}).get(k, 0.0))).alias("w"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, ps) in enumerate(table.items())]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return F.when(best["w"] > floor, best["k"])


def any_positive(df: DataFrame, group: str, positive: Column) -> DataFrame:
    """C-08: a file stays if any record of it is positive."""
    return df.groupBy(group).agg(F.bool_or(positive).alias("keep"))


def cascade(gated: DataFrame, labelled: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """C-07: key, probability. Rows that a cheap gate has passed meet a model trained on labelled rows: hashed words and logistic
    regression, on the first 512 characters and on the whole text, of which the larger counts. The rest never reaches it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    steps = [RegexTokenizer(inputCol="x", outputCol="w", pattern=r"\W+"), HashingTF(inputCol="w", outputCol="f", numFeatures=4096, binary=True), LogisticRegression(featuresCol="f", labelCol="y", regParam=0.1, maxIter=20)]
    model = Pipeline(stages=steps).fit(labelled.select(F.coalesce(text, F.lit("")).alias("x"), F.col(label).cast("double").alias("y")))
    both = gated.select(key, F.explode(F.array(F.substring(F.coalesce(text, F.lit("")), 1, 512), F.coalesce(text, F.lit("")))).alias("x"))
    return model.transform(both).groupBy(key).agg(F.max(vector_to_array("probability")[1]).alias("probability"))
