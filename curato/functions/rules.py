"""Predicates and first-match rule cascades over questions, answers, sections and dialogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curato.functions import patterns as W
from curato.functions.text import C, any_of, col, first_rule, has_cjk, matches_any, normalize_controls, sanitize_phrases, strip, words_of


def safe(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def study_dependent(c: C, kind: str = "book") -> Column:
    """F-01: wording that depends on a study; kind: book, paper or thesis."""
    lists = {"book": W.STUDY_BOOK, "paper": W.STUDY_PAPER, "thesis": W.STUDY_THESIS}
    found = matches_any(c, lists[kind], "(?iu)" if kind == "thesis" else "")
    # all wordings but a thesis's are Chinese
    return safe(found if kind == "thesis" else col(c).rlike("[一-鿿]") & found)


def has_forbidden_phrase(c: C) -> Column:
    """F-02."""
    return safe(any_of(c, W.FORBIDDEN_PHRASES))


def author_related(c: C) -> Column:
    """F-03."""
    return safe(any_of(F.lower(col(c)), W.AUTHOR_WORDS) | matches_any(F.lower(col(c)), W.AUTHOR_PATTERNS))


MARKS = r"[①-⑳]|\d+[\.、]|[a-zA-Z][\.、]"


def numbered_question_fault(c: C) -> Column:
    """F-04: why a numbered question can't be accepted, or null."""
    n = sum((F.regexp_count(col(c), F.lit(p)) for p in MARKS.split("|")), F.lit(0))
    parts = F.split(col(c), MARKS)
    inner = F.when(F.size(parts) > 2, F.slice(parts, F.lit(2), F.size(parts) - 2)).otherwise(F.array().cast("array<string>"))
    rules = [(F.length(col(c)) > 250, "too_long"), (n > 2, "too_many_marks"), ((n > 0) & F.exists(inner, lambda p: F.length(strip(p)) > 20), "long_item"), (any_of(c, W.REDUNDANT_GUIDES), "redundant_guide")]
    return first_rule(rules, None)


def condition_fault(c: C) -> Column:
    """F-05: why a question has too many conditions, or null."""
    total = lambda ps: sum((F.regexp_count(col(c), F.lit(p)) for p in ps), F.lit(0))
    conditions, semicolons = total(W.CONDITION_PATTERNS), F.regexp_count(col(c), F.lit("[；;]"))
    marks = semicolons + F.regexp_count(col(c), F.lit("[：:]"))
    items = F.regexp_count(col(c), F.lit("[①-⑳]")) + F.regexp_count(col(c), F.lit(r"\d+[\.、]")) + semicolons
    rules = [
        (conditions > 1, "conditions"), (marks > 3, "separators"),
        (strip(c).rlike("^(如果|假设|当|若|倘若|已知|基于|根据)") & ((conditions > 0) | (marks > 2)), "starts_with_condition"),
        (items > 3, "items"), (total(W.GUIDE_PATTERNS) > 2, "guides"),
        ((F.size(F.split(col(c), "[。！？]")) > 4) & ((conditions > 0) | (items > 2)), "dense"),
        (any_of(c, W.SUMMARY_PHRASES) & ((conditions > 0) | (items > 2)), "summary"),
    ]
    return first_rule(rules, None)


SPECIES = r"([A-Z][a-z]+\s+[a-z]+(?:\s+cv\.\s+[A-Z][a-z]+)?|cv\.\s+[A-Z][a-z]+)"
GENE = r"([A-Z][a-z0-9]+[-_]?[A-Z]?[a-z0-9]*\s+基因|基因\s+[A-Z][a-z0-9]+[-_]?[A-Z]?[a-z0-9]*)"


def names_unmentioned(q: C, a: C) -> Column:
    """F-06: the answer names a species or gene, and the question names neither it nor any other."""
    asked = F.lower(col(q))
    species = F.exists(F.regexp_extract_all(col(a), F.lit(SPECIES), 1), lambda s: (F.length(F.trim(s)) > 3) & ~asked.contains(F.lower(F.split(s, r"\s+")[0])))
    genes = F.exists(F.regexp_extract_all(col(a), F.lit(GENE), 1), lambda g: (F.length(strip(F.regexp_replace(g, "基因", ""))) > 2) & ~asked.contains(F.lower(strip(F.regexp_replace(g, "基因", "")))))
    return safe((species & ~col(q).rlike(SPECIES)) | (genes & ~col(q).rlike(GENE)))


def restates_question(q: C, a: C) -> Column:
    """F-07: a numbered question whose names the answer repeats, shorter than 1.5 questions and without reasoning."""
    cleaned = F.regexp_replace(F.regexp_replace(col(q), r"[①-⑳]\s*|[1-9][\.、]\s*|已知[：:]\s*", ""), r"(基于|根据).*信息[，,]?\s*", "")
    words = ["酵母", "植物", "动物", "细胞", "胞质", "yeast", "plant", "animal", "cell", "耐热", "解聚", "蛋白", "机制", "heat", "thermal", "protein", "mechanism"]
    entities = lambda t: F.array_distinct(F.concat(F.transform(F.regexp_extract_all(t, F.lit(r"\b([A-Z][a-z]*\d+)\b"), 1), F.lower), F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.lower(t).contains(w))))
    phrases = lambda t: F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"([A-Z][a-z]+\s+\d+|[A-Z][a-z]+)"), 1), F.lower))
    overlap = lambda x, y: F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(x))
    reasoning = ["推理", "因此", "所以", "结论", "依据", "逻辑", "因为", "由于", "reasoning", "therefore", "thus", "conclusion", "because", "due to", "基于", "根据", "通过", "可以得出", "可以推断"]
    numbered = col(q).rlike(r"[①-⑳]|[1-9][\.、]|已知[：:]|基于.*信息|根据.*信息")
    x, p = entities(cleaned), phrases(cleaned)
    return safe(numbered & (F.size(x) > 0) & (overlap(x, entities(col(a))) > 0.8) & (F.length(col(a)) < F.length(col(q)) * 1.5) & ~any_of(a, reasoning) & (overlap(p, phrases(col(a))) > 0.7))


def refers_to_text(c: C) -> Column:
    """F-08."""
    return safe(col(c).rlike(W.REFERENCE_TEXT))


def skip_paper_section(name: C, text: C, least: int = 100) -> Column:
    """F-09: why a paper's section is skipped, or null."""
    body = strip(text)
    refs = sum((col(text).rlike(p).cast("int") for p in W.REFERENCE_LINES), F.lit(0))
    return first_rule([(any_of(F.lower(col(name)), W.SKIP_SECTIONS), "keyword"), (F.length(body) < least, "short"), (body.rlike(r"^[ATCGNatcgn\s]+$"), "sequence"), (refs > 2, "references")], None)


#: Ordered rules for sections of a thesis: name, words of the title that skip it.
THESIS_SKIPS = [
    ("references", ["references", "bibliography", "参考文献"]), ("acknowledgements", ["acknowledg", "致谢", "remerciements"]), ("contents", ["contents", "目录", "table des matières"]),
    ("lists", ["list of figures", "list of tables", "图目录", "表目录"]), ("appendix", ["appendix", "appendices", "附录", "annexe"]), ("declaration", ["declaration", "statement of originality", "声明"]),
    ("biography", ["curriculum vitae", "biograph", "作者简介", "个人简历"]), ("publications", ["publications", "发表论文", "攻读学位期间"]), ("funding", ["funding", "financial obligation", "基金"]),
]


def skip_thesis_section(name: C, text: C, least: int = 50) -> Column:
    """F-10: the rule by which a thesis section is skipped, or null: words of its title, then its length, then its contents."""
    title, body = F.lower(col(name)), strip(text)
    letters = F.regexp_count(body, F.lit(r"[\p{L}]"))
    rules = [(any_of(title, words), rule) for rule, words in THESIS_SKIPS]
    rules += [(F.length(body) < least, "short"), (body.rlike(r"^[ATCGNatcgn\s]+$"), "sequence"), (letters / F.greatest(F.lit(1), F.length(body)) < 0.3, "symbols")]
    rules += [(F.regexp_count(body, F.lit(r"(?m)^\s*\[\d+\]")) >= 5, "reference_list"), (F.regexp_count(body, F.lit(r"(?m)\.{4,}\s*\d+\s*$")) >= 5, "toc_lines")]
    return first_rule([(safe(t), n) for t, n in rules], None)


def numbered_section(c: C) -> Column:
    """F-11."""
    return safe(strip(c).rlike(r"^([IVX]+|[A-Z]|\d+|[a-z])\."))


def subsection(c: C, level: C) -> Column:
    """F-11."""
    return safe((col(level) >= 3) | strip(c).rlike(r"(?i)^\([a-z0-9]+\)") | ((F.length(strip(c)) < 50) & numbered_section(c)))


SCIENCE = """gene family expression sequence structure promoter analysis characterization cloning identification isolation purification function study research
investigation evaluation stress response regulation wheat maize rice genetic physiological environmental factors concentration acrylamide potato products""".split()


def paper_title(c: C, level: C | None = None) -> Column:
    """F-11: a heading that is the paper's own title."""
    t, n = F.lower(col(c)), F.length(col(c))
    standard = ["introduction", "abstract", "background", "summary", "method", "materials", "result", "discussion", "conclusion", "reference", "acknowledg"]
    hits = sum((t.contains(k).cast("int") for k in SCIENCE), F.lit(0))
    sized = (n > 30) & (n < 300)
    long_first = (col(level) == 1) & (n > 50) if level is not None else F.lit(False)
    return safe(~any_of(t, standard) & (long_first | (sized & ((col(c).contains(":") & (hits >= 2)) | (hits >= 3)))))


def quality_issue(q: C, a: C, seed: C | None = None, least: tuple[int, int] = (10, 20), most: tuple[int, int] = (500, 5000), banned: tuple[str, ...] = ()) -> Column:
    """F-12: the first issue of a question and answer, or null."""
    x, y = strip(q), strip(a)
    rules = [
        ((F.coalesce(x, F.lit("")) == "") | (F.coalesce(y, F.lit("")) == ""), "empty_content"), (F.length(x) < least[0], "question_too_short"), (F.length(y) < least[1], "answer_too_short"),
        (F.length(x) > most[0], "question_too_long"), (F.length(y) > most[1], "answer_too_long"),
        *([(any_of(y, list(banned)), "banned_phrases")] if banned else []), *([(x == col(seed), "duplicate_question")] if seed is not None else []), (F.size(words_of(y)) < 5, "answer_too_brief"),
    ]
    return first_rule(rules, None)


def basic_checks(q: C, a: C, least: tuple[int, int] = (6, 20), most: int = 4000, banned: tuple[str, ...] = (), placeholders: tuple[str, ...] = (r"\bTODO\b", r"\[.*?placeholder.*?\]", "待补充")) -> Column:
    """F-13."""
    x, y = strip(q), strip(a)
    ok = (F.length(x) >= least[0]) & (F.length(y) >= least[1]) & (F.length(y) <= most)
    if banned:
        ok &= ~any_of(F.lower(F.concat_ws(" ", x, y)), [b.lower() for b in banned])
    return safe(ok & ~matches_any(x, list(placeholders), "(?i)") & ~matches_any(y, list(placeholders), "(?i)"))


def with_question_mark(q: C) -> Column:
    """F-13: a question mark is added where none ends the question."""
    x = strip(q)
    return F.when(x.rlike("[？?]$"), x).otherwise(F.concat(x, F.when(has_cjk(x), "？").otherwise("?")))


def first_of_role(messages: C, role: str) -> Column:
    """P-69, P-70: content of the first message of a role; messages are structs of role and content."""
    return F.filter(col(messages), lambda m: m["role"] == role)[0]["content"]


def dialogue_fault(messages: C, least: tuple[int, int] = (2, 2), most: tuple[int, int] = (2000, 6000), system: bool = False) -> Column:
    """F-14: why a dialogue is refused, or null."""
    u, a = F.coalesce(first_of_role(messages, "user"), F.lit("")), F.coalesce(first_of_role(messages, "assistant"), F.lit(""))
    has = lambda role: F.exists(col(messages), lambda m: m["role"] == role)
    x, y = F.length(normalize_controls(u)), F.length(normalize_controls(a))
    rules = [
        (F.coalesce(F.size(col(messages)) < 1, F.lit(True)), "schema:messages_not_list"), (~(has("user") & has("assistant")), "schema:missing_user_or_assistant"),
        *([(~has("system"), "schema:missing_system")] if system else []), (matches_any(u, W.INJECTION, "(?i)"), "safety:prompt_injection"),
        (x < least[0], "len:user_too_short"), (y < least[1], "len:assistant_too_short"), (x > most[0], "len:user_too_long"), (y > most[1], "len:assistant_too_long"),
    ]
    return first_rule(rules, None)


def record_errors(required: list[str], least: dict[str, int]) -> Column:
    """F-15: what is wrong with a record: missing fields and texts that are too short."""
    out = [F.when(F.coalesce(col(c).cast("string"), F.lit("")) == "", F.lit(f"missing:{c}")) for c in required]
    out += [F.when(F.length(strip(c)) < n, F.lit(f"short:{c}")) for c, n in least.items()]
    return F.array_compact(F.array(*out))


def triple_fault(relation: C, head_type: C, tail_type: C, relations: list[str] | None = None, types: list[str] | None = None, generic: tuple[str, ...] = ("related_to", "associated_with")) -> Column:
    """F-17, F-18: the first list a triple fails, or null; a list that is None allows all."""
    rules = [(F.lower(col(relation)).isin(*generic), "generic_relation")]
    rules += [(~col(relation).isin(*relations), "relation")] if relations is not None else []
    rules += [(~(col(head_type).isin(*types) & col(tail_type).isin(*types)), "node_type")] if types is not None else []
    return first_rule(rules, None)


def search(df: DataFrame, contains: dict[str, str | None] = {}, equals: dict[str, object] = {}) -> DataFrame:  # noqa: B006
    """F-22, F-24: filters for the parameters that are given."""
    for c, v in contains.items():
        df = df if v is None else df.where(F.col(c).contains(v))
    for c, v in equals.items():
        df = df if v is None else df.where(F.col(c) == F.lit(v))
    return df


def open_tasks(df: DataFrame, annotator: str, category: str, species: str) -> DataFrame:
    """F-23: rows that nobody has, of no category or this one."""
    return df.where(F.col(annotator).isNull() & (F.col(category).isNull() | (F.col(category) == species)))


def all_done(required: C, done: C) -> Column:
    """F-26: every required item is done."""
    return F.size(F.array_except(col(required), col(done))) == 0


def suspicious_tokens(c: C, allowed: C) -> Column:
    """F-29: names in a text that no allowed entity contains, and that contain none."""
    tokens = F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"\b([A-Z][A-Za-z0-9\-]{2,})\b"), 1))
    return F.filter(tokens, lambda t: ~F.exists(col(allowed), lambda e: F.lower(e).contains(F.lower(t)) | F.lower(t).contains(F.lower(e))))


def paper_reject(q: C, a: C) -> Column:
    """Q-09: the first rule of the funnel that a raw question and answer fail, or null."""
    x, y = strip(q), strip(a)
    cx, cy = sanitize_phrases(x), sanitize_phrases(y)
    either = lambda f, m, n: f(m) | f(n)
    rules = [
        (F.coalesce((F.length(x) < 8) | (F.length(y) < 20), F.lit(True)), "short"), (either(lambda t: study_dependent(t, "paper"), x, y), "study_dependent"), (either(has_forbidden_phrase, x, y), "forbidden_phrase"),
        (names_unmentioned(x, y), "unmentioned_name"), (numbered_question_fault(cx).isNotNull(), "numbered"), (condition_fault(cx).isNotNull(), "conditions"),
        (restates_question(x, y), "restates"), (either(refers_to_text, cx, cy), "refers_to_text"), (either(author_related, cx, cy), "author"),
    ]
    return first_rule(rules, None)


def patent_reject(q: C, a: C) -> Column:
    """Q-12."""
    return first_rule([(F.coalesce(F.length(strip(q)) < 8, F.lit(True)), "question"), (F.coalesce(F.length(strip(a)) < 20, F.lit(True)), "answer")], None)


