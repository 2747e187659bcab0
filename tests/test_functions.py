"""Scalar functions and chunkers on made texts, CJK included."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from curato.functions import rules as r
from curato.functions import scores as s
from curato.functions import text as t
from curato.functions import values as v
from curato.operators import chunking as ch
from curato.operators import nearness as nr


def one(spark, made, **cols):
    return spark.range(1).select(*[F.lit(x).alias(k) for k, x in cols.items()]).select(made.alias("x")).first().x


@pytest.mark.parametrize(
    "fn, text, out",
    [
        (t.clean_markdown, "![a](b) <b>x</b> [link](u)\n$$a$$ $b$\n| a | b |\n```code```\n\n\n\nend", "x link\n \n \n \n\nend"),
        (t.clean_book, "H<sub>2</sub>O <i>x</i>", "H<sub>2</sub>O x"), (t.sanitize_phrases, "，甲。；：乙\n\n丙", "甲。乙 丙"), (t.squeeze, "　a \t\n b　", "a b"),
        (t.normalize_controls, "a\x00b\r\n c", "ab c"), (t.entity_key, " 'Foo'_Bar ( x ) ", "foo bar(x)"), (t.clean_title, ">> 绪论 …… 12", "绪论"), (t.heading_level, "1.2.3 x", 3),
        (t.main_section, "II. Materials and Methods", "Materials & Methods"), (t.language, "这是", "zh"), (t.language, "été", "fr"), (t.patent_language, "本发明 claims", "zh"), (t.has_cjk, "abc", False),
        (t.tokens_by_words, "a b c d", 5), (t.tokens_effective, "", 1), (t.starter, " 如何种植", "如何"), (t.question_type, "原因何在", "原因型"), (t.only_numbers_and_symbols, "1.2 — 3", True),
        (t.html_text, "<p>a&amp;b</p><script>x<y</script><!-- c -->d", "a&b d"),
        (r.has_forbidden_phrase, "本研究表明", True), (r.study_dependent, "根据该研究", True), (r.author_related, "The Corresponding Author", True), (r.refers_to_text, "给定文本中", True),
        (r.numbered_question_fault, "问 1、甲 2、乙 3、丙", "too_many_marks"), (r.condition_fault, "如果水，如果光，会怎样？", "conditions"), (r.condition_fault, "水稻如何生长？", None),
    ],
)
def test_scalar(spark, fn, text, out):
    got = one(spark, fn("c"), c=text)
    assert re.sub(r"\s+", " ", got).strip() == re.sub(r"\s+", " ", out).strip() if fn is t.clean_markdown else got == out


def test_null_text(spark):
    cols = [f(F.lit(None).cast("string")) for f in (t.clean_markdown, t.clean_book, t.squeeze, t.language, t.tokens_by_words, t.html_text, r.has_forbidden_phrase, r.condition_fault)]
    spark.range(1).select(*cols).collect()


def plain_simhash(text):
    han = re.findall("[一-鿿]", text)
    tokens = re.findall("[a-z0-9]+", text.lower()) + ["".join(p) for p in zip(han, han[1:], strict=False)]
    counts = [0] * 64
    for tok in tokens:
        h = int(hashlib.md5(tok.encode()).hexdigest(), 16)
        counts = [c + (1 if h >> i & 1 else -1) for i, c in enumerate(counts)]
    out = sum(1 << i for i, c in enumerate(counts) if c > 0)
    return out - (1 << 64) if out >> 63 else out


@pytest.mark.parametrize("text", ["", "one", "水稻基因 gene x1", "the quick brown fox the"])
def test_simhash(spark, text):
    assert one(spark, t.simhash(t.simhash_tokens("c")), c=text) == plain_simhash(text)
    rows = nr.simhashes(spark.createDataFrame([(7, text)], "k long, c string").select("k", t.simhash_tokens("c").alias("w")), "k", "w").collect()
    assert [(r.id, r.h) for r in rows] == [(7, plain_simhash(text))]


def test_keep_first_chain(spark):
    items = spark.createDataFrame([(i,) for i in range(6)], "id long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 5)], "a long, b long")
    assert sorted(x.id for x in nr.keep_first_alike(items, pairs).collect()) == [0, 2, 4]


def test_simhash_dedup_is_the_loop(spark):
    values = [0, 1, 3, 1 << 40, (1 << 40) | 7, 0b1111111, -1, -2, 0]
    df = spark.createDataFrame(list(enumerate(values)), "id long, h long")
    kept = []
    for i, h in enumerate(values):
        if all(((h ^ values[j]) & (2**64 - 1)).bit_count() > 6 for j in kept):
            kept.append(i)
    assert sorted(x.id for x in nr.dedup_simhash(df).collect()) == kept


def test_json_found(spark):
    for text, out in [("```json\n{\"a\": 1}\n```", '{"a": 1}'), ('x {"a": [1, 2', '{"a": [1, 2]}'), ("none", None), ('{"a": 1,}', '{"a": 1}')]:
        assert v.best_json(text) == out


def test_similarity():
    assert nr.similarity(["a", "b"], ["a", "b"]) == 1.0
    assert nr.similarity([], ["a"]) == 0.0
    assert abs(nr.similarity(["a", "b", "c"], ["a", "x", "c"]) - (0.5 * 2 / 3 + 0.5 * 2 * 2 / 6)) < 1e-12


def test_qa_score(spark):
    got = one(spark, s.qa_score("q", "a"), q="水稻的基因调控机制是什么？", a="水稻的基因调控机制包括转录调控。该机制是重要的原理与方法。")
    assert got["dimension_scores"]["reasoning_score"] == 0.0 and got["issues"] == ["答案过短"]
    assert got["dimension_scores"]["length_score"] == pytest.approx((100 + 100 - (320 - 29) * 0.06) / 2, abs=0.02)


BODY = "word " * 40


def test_paper_sections():
    text = f"# A study of gene expression in wheat under stress conditions over years\n## Introduction\n{BODY}\n### 1.1 Aim\n{BODY}\n## Results\n{BODY}\n## References\n{BODY}"
    assert [(x[0], x[2]) for x in ch.paper_sections(text)] == [("Introduction", 2), ("Results", 2)]
    assert ch.paper_sections("short") == []
    assert [x[0] for x in ch.paper_sections("a summary " + BODY)] == ["Abstract"]


def test_thesis_sections():
    assert [x[3] for x in ch.thesis_sections(f"# One\n{BODY}\n# Two\n{BODY}")] == ["markdown", "markdown"]
    assert [x[3] for x in ch.thesis_sections("第一章 绪论\n" + "水" * 120 + "\n第二章 方法\n" + "稻" * 120)] == ["chinese"] * 2
    assert {x[3] for x in ch.thesis_sections("水稻生长。" * 400)} == {"smart_fallback"}
    assert ch.thesis_sections("") == []


def test_book_chapters():
    text = "目录\n第一章 绪论 1\n第二章 方法 9\n\n第一章 绪论\n甲\n第二章 方法\n乙"
    assert [(x[0], x[1]) for x in ch.book_chapters(text)] == [("第一章 绪论", "甲"), ("第二章 方法", "乙")]
    assert ch.book_chapters("no headings") == []
    assert ch.book_chapters("no headings", "whole")[0][3] == "whole"


def test_quotas():
    from curato.operators.tables import quotas

    assert quotas(10, {"a": 1, "b": 1, "c": 1}) == {"a": 4, "b": 3, "c": 3}
    assert sum(quotas(7, {"a": 0.5, "b": 0.3, "c": 0.2}).values()) == 7
