"""Judgements by fixed word lists: reasoning effort, need of retrieval, claims, intents, quality of patent answers, titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from curato.functions import patterns as W
from curato.functions.text import C, any_of, col, first_rule, replace_all, strip, words_of

# Fixed values.
COMPLEX_WORDS = ["方案", "设计", "评估", "监管", "标准", "策略", "框架", "比较", "优劣", "原理", "机制", "模型", "联合", "多因素"]
RETRIEVAL_WORDS = {
    "science": ["研究", "实验", "分析", "理论", "模型", "假设", "论文", "文献", "期刊", "数据", "统计", "结果", "发现", "观察", "测量", "验证", "结论"],
    "technique": ["技术", "方法", "手段", "工具", "设备", "仪器", "工艺", "流程", "步骤", "操作", "实施", "应用", "技术路线", "实施方案", "操作规程"],
    "mechanism": ["机制", "原理", "机理", "原因", "为什么", "如何", "怎么", "怎样", "如何实现", "如何进行", "如何提高", "影响因子", "作用机制", "调控机制"],
    "comparison": ["比较", "对比", "区别", "差异", "不同", "优势", "劣势", "优缺点", "利弊", "效果", "效能", "性能", "效率", "评估", "评价", "判断", "选择", "推荐"],
    "trend": ["最新", "前沿", "进展", "发展", "趋势", "未来", "预测", "展望", "方向", "创新", "突破", "革新", "新进展", "新方法", "新技术", "新成果"],
    "farming": ["育种", "品种", "产量", "品质", "抗性", "适应性", "种植", "栽培", "管理", "施肥", "灌溉", "病虫害", "遗传", "基因组", "表型", "育种值", "选择指数", "转基因", "基因编辑", "分子标记", "辅助选择"],
    "statistics": ["显著性", "p值", "方差", "标准差", "置信区间", "相关性", "回归", "预测模型", "机器学习", "深度学习", "人工智能", "算法", "模型"],
}
OPEN_QUESTIONS = ["为什么", "如何", "怎么", "怎样", "什么", "哪些", "哪个", "如何实现", "如何进行", "如何提高", "为什么选择", "为什么采用", "怎么解决", "怎样优化", "如何改善", "如何处理"]
CLOSED_QUESTIONS = ["是否", "能不能", "可不可以", "有没有", "是不是", "会不会", "需不需要", "要不要"]
CONCEPT_WORDS = ["分子", "基因", "蛋白", "细胞", "代谢", "信号", "转录", "翻译", "表达", "调控", "网络", "通路", "系统", "模型", "框架", "体系", "机制"]
UNITS = ["kg", "g", "吨", "亩", "公顷", "米", "cm", "mm"]
META_RELATIONS = [
    "needs_more_context_for", "insufficient_information_for", "cannot_determine_from_available_information", "cannot_be_inferred_from_available_information",
    "unknown_from_available_information", "no_supported_claims_for",
]
NEGATIVE_RELATIONS = [
    "was not identified as", "is not identified as", "was not detected as", "is not detected as", "does not affect", "do not affect", "not associated with",
    "is not associated with", "was not associated with", "no association with", "not correlated with", "is not correlated with", "was not correlated with",
    "not required for", "is not required for", "was not required for", "not involved in", "is not involved in", "was not involved in", "not expressed in",
    "is not expressed in", "was not expressed in", "not overlapping with de in",
]
NEGATED_VERBS = ["identified", "associated", "affect", "required", "involved", "expressed", "detected", "overlapping"]
#: Intents in order: patterns over small letters.
INTENT_PATTERNS = [
    ("identity", r"\bwho are you\b|\bidentity\b|introduce yourself"), ("name", r"\bwhat('?s| is) your name\b|\bcall you\b"), ("capability", r"\bwhat can you do\b|\bcapabilit"),
    ("coverage", r"\bspecies\b|\bcover\b|\bscope\b"), ("difference", r"\bdifferent\b|\bgeneral ai\b|\bgeneric\b"), ("training", r"\btrained\b|\btraining data\b|\bdata sources\b"),
    ("limits", r"\blimitations?\b|\bcan't\b|\bcannot\b"), ("metacog", r"\buncertain\b|\bnot sure\b|\bdon't know\b"),
]
INTENT_WORDS = [
    ("identity", ["你是谁", "身份", "自我介绍", "介绍一下你"]), ("name", ["你叫", "称呼", "名字"]), ("capability", ["能力", "能做", "帮我"]), ("coverage", ["物种", "覆盖", "支持哪些"]),
    ("difference", ["不同", "优势", "通用AI"]), ("training", ["训练", "数据", "来源"]), ("limits", ["局限", "做不到", "边界"]), ("metacog", ["不知道", "不确定"]),
]
DEPENDENT_WORDS = ["根据", "从", "基于", "该", "此", "上述", "文中", "文本中"]
PATENT_TOPICS = ["原理", "机制", "方法", "技术", "系统", "装置", "设备", "应用", "优势", "效果"]
PATENT_VERBS = ["通过", "实现", "采用", "基于", "利用", "达到", "提高", "降低", "控制", "检测"]
SUBJECTIVE_WORDS = ["我认为", "我觉得", "可能", "也许", "大概"]
PATENT_TERMS = ["专利", "权利要求", "发明", "实施例", "说明书"]
PATENT_STOPS = ["的", "了", "在", "是", "和", "与", "或", "等", "及", "为", "有", "可", "能", "会"]
#: Kinds of questions in order: words of the question, words that an answer of the kind has.
ANSWER_KINDS = [
    (["原理", "机制", "如何", "为什么"], ["原理", "机制", "通过", "实现", "基于"]), (["应用", "用途", "用于", "适用"], ["用于", "应用", "适用", "场景"]),
    (["方法", "如何", "怎么", "怎样"], ["步骤", "方法", "流程", "操作"]), (["优势", "好处", "特点", "特征"], ["优势", "提高", "改善", "效果"]),
]
ORDER_WORDS = ["首先", "其次", "然后", "此外", "另外", "同时", "因此", "所以"]
PATENT_LEVELS = [(90, "优秀"), (80, "良好"), (70, "中等"), (60, "及格")]


def text(c: C) -> Column:
    return F.coalesce(col(c), F.lit(""))


def total(parts) -> Column:
    return reduce(lambda x, y: x + y, parts, F.lit(0))


def points(*rules: tuple[Column, int]) -> Column:
    """What the first rule that holds is worth, else 0."""
    out = F.lit(0)
    for test, worth in reversed(rules):
        out = F.when(test, worth).otherwise(out)
    return out


def think_effort(q: C, sub_category: C | None = None) -> Column:
    """P-58: minimal, low, medium or high, by length, and one step more for three complex words or a category of designs."""
    x, sub = strip(text(q)), F.lit("") if sub_category is None else text(sub_category)
    n, hard = F.length(x), total(x.contains(w).cast("int") for w in COMPLEX_WORDS) >= 3
    base = F.when(n < 25, "minimal").when(n < 60, F.when(hard, "medium").otherwise("low")).when(n < 120, F.when(hard & (n > 80), "high").otherwise("medium")).otherwise("high")
    return F.when(any_of(sub, ["设计", "评估"]) & (base == "minimal"), "low").when(any_of(sub, ["设计", "评估"]) & (base == "low"), "medium").otherwise(base)


def retrieval_score(q: C, a: C) -> Column:
    """F-20: points for words (a word of two lists counts twice), kind of question, length, concepts, numbers and units."""
    x, y = text(q), text(a)
    both, n, m = F.concat(x, y), F.length(x), F.length(y)
    words = total(both.contains(w).cast("int") for ws in RETRIEVAL_WORDS.values() for w in ws)
    numbers = points((both.rlike(r"\p{N}"), 5)) + points((both.contains("%") | both.contains("百分"), 3)) + points((any_of(both, UNITS), 2))
    kind = points((any_of(x, OPEN_QUESTIONS), 15)) - points((any_of(x, CLOSED_QUESTIONS), 5))
    return F.least(words * 3, F.lit(30)) + kind + points((m > 800, 20), (m > 200, 10)) + points((any_of(both, CONCEPT_WORDS), 15)) + numbers + points((n > 50, 5), (n > 30, 3))


def needs_retrieval(q: C, a: C) -> Column:
    """F-20: 25 points; never for a question under five characters, always for an answer over 2000, and for one under 50 only if
    the question is open, or there are three words of the lists or a concept."""
    x, y = text(q), text(a)
    both = F.concat(x, y)
    words = total(both.contains(w).cast("int") for ws in RETRIEVAL_WORDS.values() for w in ws)
    apt = any_of(x, OPEN_QUESTIONS) | (words >= 3) | any_of(both, CONCEPT_WORDS)
    return F.when(F.length(x) < 5, False).when(F.length(y) > 2000, True).when((F.length(y) < 50) & ~apt, False).otherwise(retrieval_score(q, a) >= 25)


def meta_claim(relation: C, tail: C, evidence_ids: C) -> Column:
    """F-28: a claim about the evidence and not about the matter."""
    rel, some = F.lower(strip(text(relation))), F.exists(F.coalesce(col(evidence_ids), F.array().cast("array<string>")), lambda e: strip(F.coalesce(e, F.lit(""))) != "")
    return rel.isin(META_RELATIONS) | ((strip(text(tail)) == "") & ~some & any_of(rel, ["context", "insufficient", "cannot", "unknown"]))


def polarity(relation: C, given: C) -> Column:
    """F-28: negative by the relation's words, else what was given, positive if it is none of the known ones."""
    rel, told = F.lower(strip(text(relation))), F.lower(strip(text(given)))
    negative = rel.isin(NEGATIVE_RELATIONS) | (rel.contains("not") & any_of(rel, NEGATED_VERBS))
    return F.when(negative | (told == "negative"), "negative").when(told == "unknown", "unknown").otherwise("positive")


def intent(user: C) -> Column:
    """C-16: what a user's turn asks for: English patterns first, then Chinese words."""
    low = F.lower(text(user))
    return first_rule([*((low.rlike(p), n) for n, p in INTENT_PATTERNS), *((any_of(text(user), ws), n) for n, ws in INTENT_WORDS)], "general")


def patent_quality(q: C, a: C, section: C, deep_analysis: C | None = None, reasoning_steps: C | None = None, cot: C | None = None, forbidden: list[str] = W.FORBIDDEN_PHRASES) -> Column:
    """Q-02: struct of question (20), answer (25), relevance (20), match (15), completeness (20), total and level.

    forbidden: phrases that an answer must not have; a patent pipeline passes its own list.
    """
    x, y, s = text(q), text(a), text(section)
    size = lambda c: F.lit(0) if c is None else F.coalesce(F.size(col(c)), F.lit(0))
    n, m, deep, stops = F.length(x), F.length(y), size(deep_analysis), F.array(*[F.lit(w) for w in PATENT_STOPS])
    question = points((F.length(strip(x)) > 5, 5)) + points((~any_of(x, DEPENDENT_WORDS), 5)) + points((any_of(x, PATENT_TOPICS), 5)) + points(((n >= 10) & (n <= 100), 5), ((n >= 5) & (n <= 150), 3))
    answer = points((m >= 50, 5), (m >= 20, 3)) + points((any_of(y, PATENT_VERBS), 5)) + points((y.contains("。"), 5)) + points((~any_of(y, forbidden), 5)) + points((~any_of(y, SUBJECTIVE_WORDS), 5))
    own, theirs = (F.array_except(F.array_distinct(words_of(F.lower(t))), stops) for t in (y, s))
    overlap = F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, theirs)) / F.greatest(F.size(own), F.lit(1)))
    relevance = F.when(F.size(theirs) > 0, F.when(overlap >= 0.3, 10).when(overlap >= 0.2, 7).when(overlap >= 0.1, 5).otherwise(2)).otherwise(0) + points((~any_of(y, PATENT_TERMS), 5)) + points((deep > 0, 5))
    keys = F.filter(words_of(x), lambda w: (F.length(w) > 1) & ~F.array_contains(stops, w))
    ratio = F.size(F.filter(keys, lambda w: y.contains(w))) / F.greatest(F.size(keys), F.lit(1))
    fits = F.lit(0)
    for asks, says in reversed(ANSWER_KINDS):
        fits = F.when(any_of(x, asks), points((any_of(y, says), 5))).otherwise(fits)
    match = points((x.endswith("？") | x.endswith("?"), 3)) + F.when(F.size(keys) > 0, points((ratio >= 0.5, 7), (ratio >= 0.3, 5), (ratio >= 0.1, 3))).otherwise(0) + fits
    parts = F.size(F.filter(F.split(y, "。"), lambda p: strip(p) != ""))
    completeness = points((m >= 200, 5), (m >= 100, 3), (m >= 50, 1)) + points((deep >= 2, 5), (deep >= 1, 3)) + points((parts >= 3, 3), (parts >= 2, 2))
    completeness = completeness + points((size(reasoning_steps) > 0, 3)) + points((strip(F.lit("") if cot is None else text(cot)) != "", 3)) + points((any_of(y, ORDER_WORDS), 1))
    all_points = question + answer + relevance + match + completeness
    level = first_rule([(all_points >= least, name) for least, name in PATENT_LEVELS], "不及格")
    named = {"question": question, "answer": answer, "relevance": relevance, "match": match, "completeness": completeness, "total": all_points, "level": level}
    return F.struct(*[v.alias(k) for k, v in named.items()])


def bare_title(c: C) -> Column:
    return replace_all(strip(c), (r"^#+\s*", ""), (r"^>>\s*", ""))


def numeric_prefix(c: C) -> Column:
    """P-13: the number of a heading: '1.2' at its start, '3-1' behind Chinese letters, or '第一章'; null without one."""
    t = bare_title(c)
    found = [F.regexp_extract(F.regexp_replace(t, r"(?U)\s+", ""), r"^([0-9]+(?:\.[0-9]+)*)", 1), F.regexp_extract(t, r"[一-龥]+\s*([0-9]+-[0-9]+)", 1), F.regexp_extract(t, "^(第[一二三四五六七八九十百千万0-9]+[章节])", 1)]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])


def core_title(c: C) -> Column:
    """P-13: letters and digits of a heading without its numbers, page and names at the end."""
    return replace_all(
        bare_title(c), (r"^[0-9]+\s+[0-9]+(?:\.[0-9]+)*\s+", ""), (r"^[一-龥]+\s*[0-9]+-[0-9]+\s+", ""), (r"^[0-9]+(?:\.[0-9]+)*\s+", ""), (r"^第[一二三四五六七八九十百千万0-9]+[章节]\s+", ""),
        (r"\s*\([0-9]+\)\s*$", ""), (r"\s+[0-9]+\s*$", ""), (r"\s+[一-龥]+(?:/[0-9]+)?\s*$", ""), (r"\s+/[0-9]+\s*$", ""), (r"\s+[0-9]+\s*$", ""), (r"[^一-龥a-zA-Z0-9]", ""),
    )
