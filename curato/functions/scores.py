"""Scores of questions and answers, as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from curato.functions import patterns as W
from curato.functions.rules import has_forbidden_phrase, study_dependent
from curato.functions.text import C, any_of, col, count_words_in, first_rule, once, similarity_tokens, soft_relevance, strip

WEIGHTS = {"length_score": 0.10, "completeness_score": 0.15, "logic_score": 0.20, "clarity_score": 0.15, "academic_score": 0.15, "reasoning_score": 0.25}
NO_STEPS = "array<string>"


def steps_or_empty(c: C | None) -> Column:
    empty = F.array().cast(NO_STEPS)
    return empty if c is None else F.coalesce(col(c), empty)


def text_or_empty(c: C | None) -> Column:
    return F.lit("") if c is None else F.coalesce(col(c), F.lit(""))


def ladder(value: Column, *steps: tuple[Column, float], otherwise: float = 0.0) -> Column:
    """What the first step that holds is worth."""
    out = F.lit(float(otherwise))
    for test, worth in reversed(steps):
        out = F.when(test, F.lit(float(worth))).otherwise(out)
    return out


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def sentences(c: Column, pattern: str = "[。！？]") -> Column:
    return F.filter(F.transform(F.split(c, pattern), strip), lambda s: s != "")


def length_score(q: Column, a: Column) -> Column:
    n, m = F.length(q), F.length(a)
    x = F.when((n >= 8) & (n <= 60), 100.0).when((n > 60) & (n <= 120), 90.0).when((n > 120) & (n <= 200), 80.0).otherwise(F.greatest(F.lit(0.0), 100 - F.abs(n - 80) * 0.5))
    y = F.when((m >= 60) & (m <= 220), 100.0).when((m > 220) & (m <= 500), 92.0).when((m > 500) & (m <= 900), 85.0).otherwise(F.greatest(F.lit(0.0), 100 - F.abs(m - 320) * 0.06))
    return (x + y) / 2


def completeness_score(q: Column, a: Column, steps: Column) -> Column:
    n = F.size(steps)
    out = 100 + once(soft_relevance(q, a), lambda rel: ladder(rel, (rel < 0.08, -35), (rel < 0.15, -20), (rel < 0.25, -10))) + ladder(n, (n == 0, 0), (n < 3, -20), (n > 10, -10), otherwise=8)
    return clamp(out - 10 * count_words_in(a, W.VAGUE))


def logic_score(a: Column, steps: Column, cot: Column) -> Column:
    chain = F.when(F.size(steps) > 0, F.array_join(steps, "\n")).otherwise(cot)
    return clamp(100 + once(F.size(sentences(a)), lambda n: ladder(n, (n < 2, -20), (n > 10, -8))) + F.when((chain != "") & ~any_of(chain, W.CONNECTORS), -12.0).otherwise(0.0))


def clarity_score(q: Column, a: Column) -> Column:
    long_ = lambda c, n: F.size(F.filter(sentences(c), lambda s: F.length(s) > n))
    marks = sum(((q.contains(m) | a.contains(m)).cast("int") for m in W.SUSPECT_MARKS), F.lit(0))
    return clamp(100.0 - 8 * long_(q, 120) - 5 * long_(a, 180) - 10 * marks)


def academic_score(q: Column, a: Column) -> Column:
    out = F.lit(100.0)
    for worth, words in W.PENALTIES.values():
        out = out - worth * sum(((q.contains(w) | a.contains(w)).cast("int") for w in words), F.lit(0))
    n = count_words_in(a, W.ACADEMIC)
    return clamp(out + F.when(n >= 3, 8.0).when(n == 0, -8.0).otherwise(0.0))


def reasoning_score(steps: Column, cot: Column, conclusion: Column) -> Column:
    n, m, k = F.size(steps), F.size(sentences(cot, "[。！？\n]")), F.length(conclusion)
    mean = F.aggregate(steps, F.lit(0), lambda s, x: s + F.length(x)) / F.greatest(F.lit(1), n)
    out = 100 + F.when(n > 0, ladder(n, (n < 3, -25), (n > 9, -10), otherwise=8) + ladder(mean, (mean < 12, -18), (mean > 100, -8))).otherwise(0.0)
    out = out + F.when(cot != "", ladder(m, (m < 3, -10), (m > 12, -8))).otherwise(0.0) + F.when(k > 0, ladder(k, (k < 10, -8), (k > 140, -4))).otherwise(0.0)
    return F.when((n == 0) & (cot == ""), 0.0).otherwise(clamp(out))


def qa_score(q: C, a: C, steps: C | None = None, cot: C | None = None, conclusion: C | None = None) -> Column:
    """Q-01: struct of the total, the level, six dimensions, issues and suggestions."""
    x, y, s, c, k = text_or_empty(q), text_or_empty(a), steps_or_empty(steps), text_or_empty(cot), text_or_empty(conclusion)
    parts = {
        "length_score": length_score(x, y), "completeness_score": completeness_score(x, y, s), "logic_score": logic_score(y, s, c),
        "clarity_score": clarity_score(x, y), "academic_score": academic_score(x, y), "reasoning_score": reasoning_score(s, c, k),
    }
    n, m = F.length(x), F.length(y)
    issues = [
        F.when(n < 8, "问题过短").when(n > 220, "问题过长"), F.when(m < 30, "答案过短").when(m > 1200, "答案过长"), F.when(has_forbidden_phrase(x) | has_forbidden_phrase(y), "存在违禁短语"),
        F.when(study_dependent(x) | study_dependent(y), "存在研究依赖表达"), F.when(F.size(s) == 0, None).when(F.size(s) < 3, "推理步骤不足").when(F.size(s) > 10, "推理步骤过多"),
    ]
    advice = lambda total: [
        F.when(total < 60, "建议重新生成或进行失败回收再生成"), F.when(total < 75, "建议检查：是否存在模糊指代/学术违规口吻/推理链不连贯"),
        F.when((F.size(s) == 0) & (total > 80), "可考虑启用推理链生成以提升深度"), F.when(total >= 90, "质量优秀，可直接使用"),
    ]

    def told(own: Column) -> Column:
        """The result from the six dimensions, which are computed once."""
        total = reduce(lambda t, n: t + own[n] * WEIGHTS[n], WEIGHTS, F.lit(0.0))
        return F.struct(
            F.bround(total, 2).alias("total_score"), quality_level(total).alias("quality_level"), F.struct(*[F.bround(own[k], 2).alias(k) for k in parts]).alias("dimension_scores"),
            F.array_compact(F.array(*issues)).alias("issues"), F.array_compact(F.array(*advice(total))).alias("suggestions"),
        )

    return once(F.struct(*[v.cast("double").alias(k) for k, v in parts.items()]), told)


def quality_level(total: Column) -> Column:
    return first_rule([(total >= 90, "优秀"), (total >= 75, "良好"), (total >= 60, "可接受")], "较差")


def heuristic_score(q: C, a: C) -> Column:
    """Q-03: .35 + .4 of the overlap + .25 (1 - e^(-length/180)); 0 without tokens on a side."""
    x, y = F.array_distinct(similarity_tokens(q)), F.array_distinct(similarity_tokens(a))
    overlap = F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(x))
    score = 0.35 + 0.4 * overlap + 0.25 * (1 - F.exp(-F.length(col(a)) / 180.0))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def gate_score(heuristic: Column, consistency: Column | None = None, judge: Column | None = None, weights: tuple[float, float] = (0.5, 0.5)) -> Column:
    """Q-04: blend of the scorers that are given, with weights made to sum to 1 over them."""
    parts = [(w, c) for w, c in zip(weights, (consistency, judge), strict=True) if c is not None]
    left = max(0.0, 1.0 - sum(w for w, _ in parts))
    total = sum(w for w, _ in parts) + left
    return F.bround(F.least(F.lit(1.0), reduce(lambda s, p: s + p[1] * (p[0] / total), parts, heuristic * (left / total))), 3)


def path_score(weights: C, hops: C) -> Column:
    """Q-08: .7 of the mean weight + .3 / (1 + hops)."""
    mean = F.aggregate(col(weights), F.lit(0.0), lambda s, w: s + w) / F.greatest(F.lit(1), F.size(col(weights)))
    return 0.7 * mean + 0.3 / (1 + col(hops))


def complexity(q: C, a: C) -> Column:
    """P-59: 1 to 5, by terms, sentence length, length, numbers and symbols."""
    t = F.lower(F.concat(text_or_empty(q), F.lit(" "), text_or_empty(a)))
    n = F.length(t)
    parts = F.split(t, r"[.!?。！？]")
    mean = F.aggregate(parts, F.lit(0), lambda s, x: s + F.length(x)) / F.greatest(F.size(parts), F.lit(1))
    up = lambda x: F.least(F.lit(5.0), x)
    score = (
        up(count_words_in(t, W.TECHNICAL) / F.greatest(n / 10, F.lit(1.0)) * 100) * 0.3 + up(mean / 30) * 0.2 + up(n / 1000) * 0.2
        + up(F.regexp_count(t, F.lit(r"\d+\.?\d*%?")) / 10) * 0.15 + up(F.regexp_count(t, F.lit("[α-ωΑ-ΩΣμ→℃±]")) / 20) * 0.15
    )
    return F.greatest(F.lit(1), F.least(F.lit(5), F.bround(score).cast("int")))


def chunk_quota(length: C, most: int = 40) -> Column:
    """P-54: questions for a chunk of so many characters."""
    n = F.coalesce(col(length), F.lit(0))
    return F.when(n < 100, 0).when(n < 200, 1).when(n < 2000, 2).otherwise(F.least(F.lit(most), F.floor(n / 2000) + 1)).cast("int")


def thesis_quota(length: C, chunks: C, floor: int = 80, cap: int = 300, per_chunk: int = 15) -> Column:
    """P-55: chunks x 15, by the root of the length over 120,000 between .75 and 1.4; 80 to 300."""
    factor = F.least(F.lit(1.4), F.greatest(F.lit(0.75), F.sqrt(F.greatest(col(length), F.lit(1)) / 120000)))
    return F.when(col(chunks) == 0, floor).otherwise(F.greatest(F.lit(floor), F.least(F.lit(cap), F.bround(col(chunks) * per_chunk * factor)))).cast("int")


def curriculum_stage(difficulty: C, cot: C) -> Column:
    """P-56."""
    d = F.lower(strip(F.coalesce(col(difficulty), F.lit("medium"))))
    n = F.size(F.filter(F.split(text_or_empty(cot), "\n"), lambda s: strip(s) != ""))
    return F.when((d == "easy") & (n <= 3), 1).when(d.isin("easy", "medium") & (n > 3) & (n <= 5), 2).otherwise(3)


def difficulty(given: C, q: C) -> Column:
    """P-57: by the question's length unless given."""
    n = F.length(col(q))
    return F.when(F.lower(col(given)).isin("easy", "medium", "hard"), F.lower(col(given))).when(n < 40, "easy").when(n < 80, "medium").otherwise("hard")


def fit_difficulty(complexity_: C, suitable: C, level: C, base: C) -> Column:
    """P-60: the base where a strategy suits it, else by the seed's complexity."""
    has = lambda d: F.array_contains(col(suitable), d)
    first, last = F.element_at(col(suitable), 1), F.element_at(col(suitable), -1)
    low = F.when((col(level) == 1) & has("easy"), "easy").otherwise(first)
    high = F.when(has("hard"), "hard").when((col(level) <= 2) & has("medium"), "medium").otherwise(last)
    return F.when(F.array_contains(col(suitable), col(base)), col(base)).when(col(complexity_) <= 2, low).when(col(complexity_) == 3, F.when(has("medium"), "medium").otherwise(first)).otherwise(high)
