"""Scalar functions over text, as Catalyst expressions. Null text gives null, unless a function says otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from curato.functions import patterns as W

C = str | Column


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_all(c: C, *steps: tuple[str, str]) -> Column:
    out = col(c)
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return out


def strip(c: C) -> Column:
    """Without blanks of any script at either end."""
    return replace_all(c, (r"(?U)^\s+|\s+$", ""))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where the value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def any_of(c: C, words: list[str]) -> Column:
    """Whether one of the literal words occurs: one alternation, tried only where a word's first character stands."""
    every = "|".join(re.escape(w) for w in words)
    firsts = "".join(sorted({re.escape(w[0]) for w in words if w}))
    return col(c).rlike(f"(?=[{firsts}])(?:{every})" if all(words) else every)


def matches_any(c: C, patterns: list[str], flags: str = "") -> Column:
    return col(c).rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def count_words_in(c: C, words: list[str]) -> Column:
    """How many of the words occur at least once."""
    return sum((col(c).contains(w).cast("int") for w in dict.fromkeys(words)), F.lit(0))


def words_of(c: C) -> Column:
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")


IMAGE, LINK, SPACES, LINES = (r"!\[[^\]]*?\]\([^\)]*?\)", " "), (r"\[([^\]]+)\]\([^\)]+\)", "$1"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")
MATH = ((r"\$\$[^$]+\$\$", " "), (r"\$[^$]+\$", " "))
TABLE, RULE, CODE = (r"(?m)^\s*\|.*\|\s*$", " "), (r"(?m)^[\s\-\:\|]+$", " "), (r"(?s)```.*?```", " ")


def clean_markdown(c: C) -> Column:
    """P-01: images, tags, links to their text, formulas, tables, code, runs of blanks."""
    return strip(replace_all(c, IMAGE, (r"(?i)<img[^>]*?>", " "), (r"<[^>]+>", " "), LINK, *MATH, TABLE, RULE, CODE, LINES, SPACES))


def clean_markdown_patent(c: C) -> Column:
    """P-02: as P-01, without the rules for tables."""
    return strip(replace_all(c, IMAGE, (r"<[^>]+>", " "), LINK, *MATH, CODE, LINES, SPACES))


def clean_book(c: C) -> Column:
    """P-03: as P-01, without formulas and code; sub and sup tags stay."""
    return F.coalesce(strip(replace_all(c, IMAGE, (r"<(?!sub|sup|/sub|/sup)[^>]+>", " "), LINK, TABLE, LINES, SPACES)), F.lit(""))


def clean_thesis(c: C) -> Column:
    """P-04: names placeholders for figures, formulas, citations and years; heading lines stay as they are."""
    body = lambda x: replace_all(
        x, (r"!\[[^\]]*?\]\([^\)]*?\)", "[图片]"), (r"<(?!sub|sup|/sub|/sup)[^>]+>", " "), LINK, (r"^\s*\|.*\|\s*$", " "), (r"(图|表)\s*\d+([：:])?", "图表"),
        (r"(?i)(Figure|Table|Fig\.)\s*\d+([：:])?", "图表"), (r"\\\[.*?\\\]", "公式"), (r"\$[^$]+\$", "公式"), (r"\[\s*\d+\s*\]", "[参考文献]"), (r"\(\s*\d{4}[a-z]?\s*\)", "(年份)"), SPACES,
    )
    whole = replace_all(c, (r"(?s)\\begin\{equation\}.*?\\end\{equation\}", "公式"))
    lines = F.transform(F.split(whole, "\n"), lambda x: F.when(x.rlike(r"^#{1,6}\s+.+$"), x).otherwise(body(x)))
    return F.coalesce(strip(replace_all(F.array_join(lines, "\n"), LINES)), F.lit(""))


def clean_thesis_effective(c: C) -> Column:
    """P-04 as it runs in the end: carriage returns go."""
    return F.coalesce(strip(F.replace(col(c), F.lit("\r"), F.lit(""))), F.lit(""))


def sanitize_phrases(c: C) -> Column:
    """P-05: line breaks and runs of blanks to one blank, runs of punctuation to their first, none at the start."""
    return strip(replace_all(c, (r"\n+", " "), (r"(?U)\s{2,}", " "), ("([，。；：])[，。；：]+", "$1"), (r"(?U)^[，；：、\s]+", "")))


def clean_graph_text(c: C) -> Column:
    """P-06: null for missing, one blank for runs of blanks and control characters."""
    out = F.trim(replace_all(c, (r"(?U)[\s\x00-\x1f]+", " ")))
    return F.when(~F.lower(out).isin("nan", ""), out)


def squeeze(c: C) -> Column:
    """P-07: one blank for runs of blanks, none at the ends; null is empty."""
    return F.coalesce(F.trim(replace_all(c, (r"(?U)\s+", " "))), F.lit(""))


def normalize_controls(c: C) -> Column:
    """P-08: no control characters, one blank for runs of blanks."""
    return squeeze(replace_all(c, (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")))


def normalize_for_duplicates(c: C) -> Column:
    """P-09: lower case, one blank for runs of blanks, and for runs of punctuation."""
    return replace_all(squeeze(F.lower(col(c))), ("[，。、“”‘’…：:;；.!?？]+", " "))


def entity_key(c: C) -> Column:
    """P-10: lower case without quotes; underscores and hyphens are blanks; no blanks at brackets."""
    return replace_all(squeeze(F.lower(col(c))), ("[`'\"“”‘’]", ""), (r"[_\-]+", " "), (r"\s*\(\s*", "("), (r"\s*\)\s*", ")"))


def clean_title(c: C, drop_number: bool = False) -> Column:
    """P-11: without '>>', page number, what follows dots, and brackets around text."""
    out = strip(replace_all(strip(c), (r"^>>\s*", "")))
    if drop_number:
        out = strip(replace_all(strip(replace_all(out, (r"^[0-9]+(?:\.[0-9]+)*\s+", ""))), (r"^([0-9]+(?:\.[0-9]+)*)([^\d\s])", "$2")))
    for step in ((r"\s+[0-9]+\s*$", ""), (r"[．…]+.*$", ""), (r"[（(]([^）)]*)[）)]", "$1"), (r"\s+", " ")):
        out = strip(replace_all(out, step))
    return out


def heading_level(c: C) -> Column:
    """P-12: 1 for '1', 2 for '1.1' and so on; null without a number."""
    number = F.regexp_extract(strip(c), r"^([0-9]+(?:\.[0-9]+)*)", 1)
    return F.when(number != "", F.regexp_count(number, F.lit(r"\.")) + 1)


def only_numbers_and_symbols(c: C) -> Column:
    """P-14: a line without a letter of any script."""
    return F.coalesce(~strip(c).rlike(r"\p{L}"), F.lit(True))


def bare_section(c: C) -> Column:
    bare = strip(replace_all(c, (r"(?i)^[IVX]+\.\s*", ""), (r"^\d+\.\s*", ""), (r"^[A-Z]\.\s*", "")))
    return F.when(bare == "", strip(c)).otherwise(bare)


def main_section(c: C) -> Column:
    """P-15: the canonical section that a title names; null if it names none."""
    t = F.lower(bare_section(c))
    has = t.contains
    rules = [
        (has("introduction"), "Introduction"), (has("abstract"), "Abstract"), (has("background"), "Background"), (has("summary"), "Summary"),
        (has("materials") & has("method"), "Materials & Methods"), (has("results") & has("discussion"), "Results & Discussion"), (has("results"), "Results"),
        (has("discussion"), "Discussion"), (has("conclusion") | has("concluding remarks"), "Conclusion"), (has("method"), "Methods"),
    ]
    return first_rule(rules, None)


def first_rule(rules: list[tuple[Column, str]], otherwise: str | None) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for test, name in reversed(rules):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def section_type(title: C, content: C) -> Column:
    """P-16: kind of a section from words of its text."""
    t = F.lower(F.concat_ws("\n", col(title), col(content)))
    rules = [("方法", ["实验方法", "method", "materials and methods"]), ("结果", ["实验结果", "results", "数据表"]), ("讨论", ["讨论", "discussion", "分析"]), ("结论", ["结论", "conclusion", "总结"]), ("引言", ["引言", "introduction", "背景"])]
    return first_rule([(any_of(t, w), n) for n, w in rules], "其他")


def is_method(c: C) -> Column:
    """P-17."""
    return any_of(F.lower(col(c)), W.METHOD_WORDS)


def is_result(c: C) -> Column:
    """P-17."""
    return any_of(F.lower(col(c)), W.RESULT_WORDS)


def suits_reasoning(c: C) -> Column:
    """P-17: all sections but abstract, conclusion and summary."""
    return ~any_of(F.lower(col(c)), ["abstract", "conclusion", "summary"])


def language(c: C) -> Column:
    """P-18: zh by script, fr by accents or words, else en."""
    return F.when(col(c).rlike("[一-鿿]"), "zh").when(col(c).rlike(W.FRENCH_LETTERS) | any_of(F.lower(col(c)), W.FRENCH_WORDS), "fr").otherwise("en")


def patent_language(c: C) -> Column:
    """P-19: zh by more than half of the characters or a mark, en by more than half, else other."""
    n = F.length(col(c))
    share = lambda p: F.regexp_count(col(c), F.lit(p)) / n
    return F.when(F.coalesce(n, F.lit(0)) == 0, "other").when((share("[一-龥]") > 0.5) | any_of(c, W.PATENT_MARKS), "zh").when(share("[a-zA-Z]") > 0.5, "en").otherwise("other")


def has_cjk(c: C) -> Column:
    """P-20."""
    return F.coalesce(col(c).rlike("[㐀-鿿豈-﫿]"), F.lit(False))


def tokens_by_words(c: C) -> Column:
    """P-21: words times 1.3."""
    return F.coalesce((F.size(words_of(c)) * 1.3).cast("int"), F.lit(0))


def tokens_by_chars(c: C, per: float = 3.5) -> Column:
    """P-21: characters by 3.5."""
    return F.coalesce((F.length(col(c)) / per).cast("int"), F.lit(0))


def tokens_effective(c: C) -> Column:
    """P-21: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.coalesce(F.length(col(c)), F.lit(0)) / 4)).cast("int")


def cost(prompt: C, completion: C, prompt_price: C, completion_price: C) -> Column:
    """P-23: of tokens at prices for a million."""
    return col(prompt) / 1e6 * col(prompt_price) + col(completion) / 1e6 * col(completion_price)


def hashes(c: C) -> dict[str, Column]:
    """P-24: md5, sha1, sha256, sha512 and a short hash."""
    return {"md5": F.md5(col(c)), "sha1": F.sha1(col(c)), "sha256": F.sha2(col(c), 256), "sha512": F.sha2(col(c), 512), "short": F.substring(F.sha2(col(c), 256), 1, 8)}


def salted_hash(c: C, salt: str) -> Column:
    """P-24: sha256 of salt and text."""
    return F.sha2(F.concat(F.lit(salt), col(c)), 256)


def pair_hash(q: C, a: C) -> Column:
    """P-26: md5 of question and answer."""
    return F.md5(F.concat(strip(q), F.lit("|||"), strip(a)))


def short_id(c: C) -> Column:
    """P-26: the first eight digits of md5."""
    return F.substring(F.md5(col(c)), 1, 8)


def token_set_hash(c: C) -> Column:
    """P-27: md5 of the sorted distinct words, whatever their order and punctuation."""
    words = F.array_sort(F.array_distinct(words_of(replace_all(F.lower(col(c)), (r"(?U)[^\w\s]", "")))))
    return F.md5(F.array_join(words, " "))


def simhash_tokens(c: C) -> Column:
    """P-28: words of ASCII letters and digits, and pairs of neighbouring CJK characters."""
    none = F.array().cast("array<string>")
    next_to = lambda han: F.transform(F.sequence(F.lit(1), F.size(han) - 1), lambda i: F.concat(F.element_at(han, i), F.element_at(han, i + 1)))
    pairs = once(F.regexp_extract_all(col(c), F.lit("([一-鿿])"), 1), lambda han: F.when(F.size(han) > 1, next_to(han)).otherwise(none))
    # most texts hold two CJK characters somewhere or none at all
    return F.concat(F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z0-9]+)"), 1), F.when(has_cjk_pair(c), pairs).when(col(c).isNotNull(), none))


def has_cjk_pair(c: C) -> Column:
    return col(c).rlike("(?s)[一-鿿].*?[一-鿿]")


def simhash(tokens: C) -> Column:
    """P-28: bit i is set if more tokens have bit i of their md5 set than not; 0 without tokens.

    Repeated tokens weigh as often as they occur. A token's low 64 bits are two halves of 32, so all stays in longs.
    """
    half = lambda t, at: F.conv(F.substring(F.md5(t), at, 8), 16, 10).cast("long")
    values = F.transform(col(tokens), lambda t: F.struct(half(t, 17).alias("hi"), half(t, 25).alias("lo")))

    def bits(v: Column) -> Column:
        ones = lambda part, i: F.aggregate(v, F.lit(0), lambda n, x: n + F.shiftright(x[part], i).bitwiseAND(F.lit(1)).cast("int"))
        out = F.lit(0).cast("long")
        for i in range(64):
            many = ones("lo" if i < 32 else "hi", i % 32) * 2 > F.size(v)
            out = out.bitwiseOR(F.when(many, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    return once(values, bits)


def hamming(a: C, b: C) -> Column:
    """P-29."""
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def snowflake_parts(c: C, epoch_ms: int = 1288834974657) -> Column:
    """P-30: time, datacenter, worker and sequence of a 64-bit id of 41, 5, 5 and 12 bits."""
    part = lambda by, bits: F.shiftright(col(c), by).bitwiseAND(F.lit((1 << bits) - 1))
    return F.struct((F.shiftright(col(c), 22) + epoch_ms).alias("ms"), part(17, 5).alias("datacenter"), part(12, 5).alias("worker"), part(0, 12).alias("sequence"))


def snowflake(ms: C, datacenter: C, worker: C, sequence: C, epoch_ms: int = 1288834974657) -> Column:
    """P-30: the id of these parts."""
    left = lambda c, by: F.shiftleft(col(c).cast("long"), by)
    return F.shiftleft(col(ms).cast("long") - epoch_ms, 22).bitwiseOR(left(datacenter, 17)).bitwiseOR(left(worker, 12)).bitwiseOR(col(sequence).cast("long"))


def stable_choice(items: list[str], key: C) -> Column:
    """P-31: an item that only the key decides."""
    at = F.conv(F.substring(F.sha2(col(key), 256), 1, 8), 16, 10).cast("long") % len(items)
    return F.element_at(F.array(*[F.lit(x) for x in items]), (at + 1).cast("int"))


def protect(c: C, names: list[str]) -> Column:
    """P-32: names become placeholders."""
    out = col(c)
    for i, n in enumerate(sorted(names, key=len, reverse=True)):
        out = F.replace(out, F.lit(n), F.lit(f"__NAME_{i}__"))
    return out


def restore(c: C, names: list[str]) -> Column:
    """P-32: placeholders become names."""
    out = col(c)
    for i, n in enumerate(sorted(names, key=len, reverse=True)):
        out = F.replace(out, F.lit(f"__NAME_{i}__"), F.lit(n))
    return out


def split_think(c: C) -> Column:
    """P-34: thoughts inside the first <think> block, and the answer without it."""
    return F.struct(strip(F.regexp_extract(col(c), r"(?s)<think>(.*?)</think>", 1)).alias("think"), strip(replace_all(c, (r"(?s)<think>.*?</think>", ""))).alias("answer"))


def tagged(c: C, tag: str) -> Column:
    """P-35: what stands between a tag's marks; null without it."""
    return F.nullif(strip(F.regexp_extract(col(c), rf"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))


def judge_scores(c: C) -> Column:
    """P-36: four scores and their mean, to one digit half to even; 0 for a missing one."""
    one = lambda word: F.coalesce(F.nullif(F.regexp_extract(col(c), rf"{word}:\s*([0-9.]+)", 1), F.lit("")).cast("double"), F.lit(0.0))
    a, r, m, l = (one(w) for w in ("准确性", "相关性", "完整性", "清晰度"))  # noqa: E741
    return F.struct(a.alias("accuracy"), r.alias("relevance"), m.alias("completeness"), l.alias("clarity"), F.bround((a + r + m + l) / 4, 1).alias("total"))


def numbered_pairs(c: C) -> Column:
    """P-37: questions and answers of 'Q1: .. A1: ..' blocks."""
    part = lambda i: F.transform(F.regexp_extract_all(col(c), F.lit(r"(?s)Q\d*[:：]\s*(.*?)\s*A\d*[:：]\s*(.*?)(?=\s*Q\d*[:：]|\s*$)"), i), strip)
    return F.arrays_zip(part(1).alias("question"), part(2).alias("answer"))


def citation(authors: C, title: C, journal: C, year: C) -> Column:
    """P-38: three authors at most, then 'et al.'."""
    names = F.split(col(authors), r",\s*")
    short = F.when(F.size(names) > 3, F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.lit(", et al."))).otherwise(F.array_join(names, ", "))
    return F.concat_ws(". ", short, col(title), F.concat_ws(", ", col(journal), col(year).cast("string")))


def context(docs: C, n: int = 5, chars: int = 800) -> Column:
    """P-39: the first n documents (array of strings), each cut, numbered and joined."""
    return F.array_join(F.transform(F.slice(col(docs), 1, n), lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(d, 1, chars))), "\n\n")


def safe_filename(c: C) -> Column:
    """P-40."""
    return strip(replace_all(c, (r'[<>:"/\\|?*\x00-\x1f]', "_")))


def template(pattern: str, **values: C) -> Column:
    """P-41, P-42: {name} replaced by the column of that name."""
    out = F.lit(pattern)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(col(v).cast("string"), F.lit("")))
    return out


def html_text(c: C) -> Column:
    """F-30: page text without scripts, styles, comments and tags; the commonest entities are resolved."""
    bare = replace_all(c, (r"(?is)<(script|style)\b.*?</\1\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"<[^>]+>", " "))
    for mark, by in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(mark), F.lit(by))
    return squeeze(bare)


def starter(c: C) -> Column:
    """C-17: how a question begins."""
    return first_rule([(strip(c).startswith(s), s) for s in W.STARTERS], "其他")


def question_type(c: C) -> Column:
    """C-17: kind of a question by its words."""
    return first_rule([(any_of(c, w), n) for n, w in W.QUESTION_TYPES], "其他")


def similarity_tokens(c: C) -> Column:
    """CJK characters and lower-case ASCII words, repeats kept."""
    return F.concat(F.regexp_extract_all(col(c), F.lit("([一-鿿])"), 1), F.regexp_extract_all(F.lower(col(c)), F.lit(r"\b([a-z]+)\b"), 1))


def core_keywords(c: C) -> Column:
    """D-10: distinct runs of CJK and words of three letters and more, without stop words."""
    both = F.concat(F.regexp_extract_all(col(c), F.lit("([一-鿿]{2,})"), 1), F.regexp_extract_all(F.lower(col(c)), F.lit(r"\b([a-z]{3,})\b"), 1))
    return F.array_except(F.array_distinct(both), F.array(*[F.lit(w) for w in W.STOPWORDS]))


def soft_relevance(q: C, a: C) -> Column:
    """Share of the question's distinct SimHash tokens that the answer has."""
    share = lambda x: F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.array_intersect(x, simhash_tokens(a))) / F.greatest(F.lit(1), F.size(x)))
    return once(F.array_distinct(simhash_tokens(q)), share)
