"""Operators without SQL against plain Python: graphs, near-duplicates, scores, state and spreadsheets on small made tables."""

import collections
import itertools
import math
import random
import re

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from curato.functions import judging as j
from curato.functions import patterns as W
from curato.functions import rules as r
from curato.functions import scores as s
from curato.operators import classify as cl
from curato.operators import graph as g
from curato.operators import nearness as nr
from curato.operators import tables as o
from curato.plans import relational, scalars, structures
from curato.sources import readers, writers
from curato.streaming import flows


def directed(seed, n=14, m=30):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), "r", rng.randrange(n)) for _ in range(m)})


def brandes(links):
    out = collections.defaultdict(set)
    for a, _, b in links:
        if a != b:
            out[a].add(b)
    nodes = {x for a, _, b in links for x in (a, b)}
    total = dict.fromkeys(nodes, 0.0)
    for source in nodes:
        order, before, paths, far = [], collections.defaultdict(list), collections.Counter({source: 1}), {source: 0}
        queue = collections.deque([source])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        gain = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in before[w]:
                gain[v] += paths[v] / paths[w] * (1 + gain[w])
            if w != source:
                total[w] += gain[w]
    return total


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness(spark, seed):
    links = directed(seed)
    edges = spark.createDataFrame(links, "src long, rel string, dst long")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    want = brandes(links)
    got = {x.id: x.betweenness for x in g.betweenness(edges, nodes, None).collect()}
    assert all(got.get(v, 0.0) == pytest.approx(want[v]) for v in want) and sum(want.values()) > 5


def test_closeness_and_eigenvector(spark):
    links = directed(3)
    edges = spark.createDataFrame(links, "src long, rel string, dst long")
    nodes = sorted({x for a, _, b in links for x in (a, b)})
    far = {}
    for source in nodes:
        seen, front, d = {source: 0}, {source}, 0
        while front:
            d += 1
            front = {b for a, _, b in links if a in front} - seen.keys()
            seen |= dict.fromkeys(front, d)
        far[source] = seen
    ids = spark.createDataFrame([(n,) for n in nodes], "id long")
    got = {x.id: x.closeness for x in g.closeness(g.distances(edges, ids, None)).collect()}
    for v in nodes:
        ds = [f[v] for u, f in far.items() if v in f and u != v]
        if ds:
            assert got[v] == pytest.approx(len(ds) / sum(ds) * len(ds) / (len(nodes) - 1))
    at = {n: i for i, n in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, _, b in links:
        if a != b:
            m[at[b], at[a]] = 1
    x = np.ones(len(nodes))
    for _ in range(30):
        x = x + m @ x
        x /= x.max()
    assert {e.id: e.x for e in g.eigenvector(edges).collect()} == pytest.approx(dict(zip(nodes, x, strict=True)))


def test_communities(spark):
    links = directed(5, 20, 30)
    near = collections.defaultdict(set)
    for a, _, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    label = {v: v for v in near}
    for _ in range(5):
        votes = {v: collections.Counter(label[w] for w in ws) for v, ws in near.items()}
        new = {v: min(c, key=lambda x, c=c: (-c[x], x)) for v, c in votes.items()}
        if new == label:
            break
        label = new
    got = {x.id: x.label for x in g.communities(spark.createDataFrame(links, "src long, rel string, dst long"), 5).collect()}
    assert got == label


def test_path_lengths_and_clustering(spark):
    links = [(1, "r", 2), (2, "r", 3), (3, "r", 1), (3, "r", 4), (4, "r", 5), (5, "r", 5), (2, "s", 1)]
    edges = spark.createDataFrame(links, "src long, rel string, dst long")
    for parts in (1, 3):
        told = g.path_lengths(edges, parts).first()
        assert told.diameter == 3 and told.avg_path_length == pytest.approx((4 * 1 + 1 + 3 * 2 + 2 * 3) / 10 + 0, abs=1) and told.avg_path_length == pytest.approx(17 / 10)
    assert g.clustering(edges).first()[0] == pytest.approx((1 + 1 + 1 / 3) / 5)
    apart = edges.union(spark.createDataFrame([(8, "r", 9)], edges.schema))
    assert g.path_lengths(apart).first().diameter is None


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6))
    x[n // 2 :] = x[: n - n // 2] + 0.3 * rng.normal(size=(n - n // 2, 6))
    return [(i, [float(v) for v in row], int(i % 2)) for i, row in enumerate(x)]


def cosine(a, b):
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


@pytest.mark.parametrize("members", [1000, 7])
def test_embedding_pairs_and_dedup(spark, members):
    rows = vectors(60, 1)
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if cosine(a[1], b[1]) >= 0.8}
    got = [(x.a, x.b) for x in nr.cosine_pairs(df.select("id", "v"), 0.8, members=members).collect()]
    assert sorted(got) == sorted(want) and len(want) > 10
    kept = []
    for i, v, label in rows:
        if not any(label == k[2] and cosine(v, k[1]) >= 0.8 for k in kept):
            kept.append((i, v, label))
    assert sorted(x.id for x in nr.dedup_embeddings(df, 0.8, "label").collect()) == [k[0] for k in kept]
    asked = df.where("id % 10 = 0").select(F.col("id").alias("qid"), "v")
    near = sorted((x.qid, x.rank, x.id) for x in nr.similar_items(df.select("id", "v"), asked, 3, members).collect())
    assert near == sorted((q[0], n, i) for q in rows if q[0] % 10 == 0 for n, (_, i) in enumerate(sorted((-cosine(q[1], v), i) for i, v, _ in rows)[:3], 1))


def test_hamming_pairs(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(20)]
    for h in list(values):
        for bits in (1, 3, 6, 7):
            values.append(h ^ sum(1 << b for b in rng.sample(range(64), bits)))
    signed = [h - (1 << 64) if h >> 63 else h for h in values]
    df = spark.createDataFrame(list(enumerate([*signed, signed[0]])), "id long, h long")
    first = {}
    for i, h in enumerate([*values, values[0]]):
        first.setdefault(h, i)
    want = {(a, b) for (x, a), (y, b) in itertools.combinations(first.items(), 2) if (x ^ y).bit_count() <= 6} | {(0, len(values))}
    got = [(x.a, x.b) for x in nr.hamming_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == {(min(p), max(p)) for p in want}


@pytest.mark.parametrize("least", [0.5, 0.7, 1.0])
def test_keyword_pairs(spark, least):
    rng = random.Random(7)
    rows = [(i, rng.sample("the a of gene rice wheat leaf root stem crop soil water".split(), rng.randrange(0, 7))) for i in range(60)]
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if x and y and len(set(x) & set(y)) >= max(len(x), len(y)) * least}
    got = [(x.a, x.b) for x in nr.keyword_pairs(spark.createDataFrame(rows, "id long, words array<string>"), least).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_similarity_is_the_table(spark):
    rng = random.Random(2)
    for _ in range(200):
        x, y = ([rng.choice("abcd") for _ in range(rng.randrange(0, 9))] for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for k, b in enumerate(y):
                table[i + 1][k + 1] = table[i][k] + 1 if a == b else max(table[i][k + 1], table[i + 1][k])
        want = (0.5 * len(set(x) & set(y)) / max(1, len(set(x))) + table[-1][-1] / (len(x) + len(y))) if x and y else 0.0
        assert nr.similarity(x, y) == pytest.approx(want)


BUSINESS = """Shelly Gauna is a well-known business professional and entrepreneur from Detroit, Michigan. She has been recognized for her work in food production industry
development and has helped numerous companies establish their presence in the market."""
FARMING = """Modern agricultural techniques include irrigation systems, crop rotation, and sustainable farming practices. Farmers use various methods to improve soil fertility and
increase crop yields. Food production has become more efficient with the introduction of mechanized farming equipment."""


def plain_bm25(text, keywords, excluded):
    if any(w in text.lower() for w in excluded):
        return 0.0
    best = 0.0
    for sentence in (x.strip() for x in re.split("[.!?;]+", text)):
        if len(sentence) <= 10:
            continue
        low = sentence.lower()
        words = [w for w in re.findall(r"\b([a-z]+)\b", low) if len(w) >= 2]
        every = re.split(r"\s+", low)
        for k in keywords:
            score, bad = 0.0, False
            for term in set(k.lower().split()):
                tf = words.count(term)
                if not tf:
                    continue
                score += tf / (tf + 1.2 * (1 - 0.75 + 0.75 * len(words) / 100)) * (math.log(len(keywords) + 1) + 1)
                if term in cl.DOUBTFUL and term in every:
                    at = every.index(term)
                    bad |= any(c in " ".join(every[max(0, at - 5) : at + 6]) for c in cl.OTHER_CONTEXTS)
            if not bad:
                best = max(best, score)
    return best


@pytest.mark.parametrize("keywords", [["irrigation", "crop", "farming", "food"], ["food production", "crop rotation", "soil"], ["production", "system"]])
def test_bm25(spark, keywords):
    texts = [BUSINESS, FARMING, "", None, "The food industry is large; food production facilities matter.", "crop crop crop rotation of the crop in cell culture", FARMING + " license"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {x.id: x.score for x in cl.bm25(df, "id", "text", keywords, ["license"]).collect()}
    assert got == pytest.approx({i: plain_bm25(t, keywords, ["license"]) if t else 0.0 for i, t in enumerate(texts)})


def one(spark, made, **cols):
    return spark.range(1).select(*[F.lit(x).alias(k) for k, x in cols.items()]).select(made.alias("x")).first().x


def plain_score(q, a):
    """The six dimensions without steps of reasoning."""
    clamp = lambda x: max(0.0, min(100.0, x))
    parts = lambda t, p="[。！？]": [x.strip() for x in re.split(p, t) if x.strip()]
    n, m = len(q), len(a)
    x = 100 if 8 <= n <= 60 else 90 if 60 < n <= 120 else 80 if 120 < n <= 200 else max(0, 100 - abs(n - 80) * 0.5)
    y = 100 if 60 <= m <= 220 else 92 if 220 < m <= 500 else 85 if 500 < m <= 900 else max(0, 100 - abs(m - 320) * 0.06)
    tokens = lambda t: re.findall("[a-z0-9]+", t.lower()) + ["".join(p) for p in itertools.pairwise(re.findall("[一-鿿]", t))]
    own = set(tokens(q))
    rel = len(own & set(tokens(a))) / len(own) if own else 0.0
    complete = clamp(100 - (35 if rel < 0.08 else 20 if rel < 0.15 else 10 if rel < 0.25 else 0) - 10 * sum(w in a for w in W.VAGUE))
    logic = clamp(100 - (20 if len(parts(a)) < 2 else 8 if len(parts(a)) > 10 else 0))
    clarity = clamp(100 - 8 * sum(len(p) > 120 for p in parts(q)) - 5 * sum(len(p) > 180 for p in parts(a)) - 10 * sum(k in q or k in a for k in W.SUSPECT_MARKS))
    academic = 100 - sum(worth * sum(w in q or w in a for w in words) for worth, words in W.PENALTIES.values())
    hits = sum(w in a for w in W.ACADEMIC)
    academic = clamp(academic + (8 if hits >= 3 else -8 if hits == 0 else 0))
    return {"length_score": (x + y) / 2, "completeness_score": complete, "logic_score": logic, "clarity_score": clarity, "academic_score": academic, "reasoning_score": 0.0}


def test_scores(spark):
    rng = random.Random(11)
    bits = ["水稻的机制", "基因调控。", "本文", "相关", "如图所示", "...", "rice gene ", "leaf ", "原理与方法。", "为什么？", "x" * 130, "等等", "。" , "非常重要的"]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randrange(0, 8))), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 14)))) for _ in range(150)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, q string, a string")
    for x in df.select("i", s.qa_score("q", "a").alias("r")).collect():
        want = plain_score(*rows[x.i])
        assert x.r.dimension_scores.asDict() == pytest.approx(want, abs=0.0051), rows[x.i]
        assert x.r.total_score == pytest.approx(sum(s.WEIGHTS[k] * v for k, v in want.items()), abs=0.0051)


def test_complexity(spark):
    rng = random.Random(5)
    bits = ["gene ", "protein ", "12.5% ", "α → β ", "a short one. ", "long words without end ", "代谢", "通路。"]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randrange(0, 9))), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 40)))) for _ in range(80)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, q string, a string")
    for x in df.select("i", s.complexity("q", "a").alias("c")).collect():
        t = f"{rows[x.i][0]} {rows[x.i][1]}".lower()
        parts = re.split("[.!?。！？]", t)
        score = 0.3 * min(5, sum(w in t for w in dict.fromkeys(W.TECHNICAL)) / max(len(t) / 10, 1) * 100) + 0.2 * min(5, sum(map(len, parts)) / max(1, len(parts)) / 30) + 0.2 * min(5, len(t) / 1000)
        score += 0.15 * min(5, len(re.findall(r"\d+\.?\d*%?", t)) / 10) + 0.15 * min(5, len(re.findall("[α-ωΑ-ΩΣμ→℃±]", t)) / 20)
        assert abs(x.c - max(1, min(5, score))) <= 0.5 + 1e-9


@pytest.mark.parametrize(
    "q, a, unmentioned, restates",
    [
        ("哪个物种结合？", "Oryza sativa binds it.", True, False), ("Does Oryza sativa bind?", "Oryza sativa binds.", False, False), ("Does Zea mays bind?", "Oryza sativa binds.", False, False),
        ("哪个基因？", "Hsp101 基因。", True, False), ("1、HSP101 and yeast Alpha?", "HSP101 yeast Alpha", False, True), ("1、HSP101 and yeast Alpha?", "HSP101 yeast Alpha because", False, False), (None, None, False, False),
    ],
)
def test_names(spark, q, a, unmentioned, restates):
    assert one(spark, r.names_unmentioned(F.col("q").cast("string"), F.col("a").cast("string")), q=q, a=a) is unmentioned
    assert one(spark, r.restates_question(F.col("q").cast("string"), F.col("a").cast("string")), q=q, a=a) is restates


@pytest.mark.parametrize(
    "text, number, core",
    [
        ("第一章 贾昕晔 (123)", "第一章", "贾昕晔"), ("1.1 Title of it ……… 12", "1.1", "Titleofit"), ("# >>实验3-1 常用样品的制备", "3-1", "常用样品的制备"), ("0011 1 绪论 张三/5", "00111", "绪论"), ("plain", None, "plain"), (None, None, None),
    ],
)
def test_titles(spark, text, number, core):
    c = F.col("c").cast("string")
    assert one(spark, j.numeric_prefix(c), c=text) == number and one(spark, j.core_title(c), c=text) == core


def test_funnels(spark, sf):
    """Each row is in one place of each funnel, and what a rule takes fails that rule."""
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = relational.catalog.plans["q09_paper_funnel"](spark, sf).collect()
    assert {x.funnel: sum(y.n for y in rows if y.funnel == x.funnel) for x in rows} == {"paper": n, "patent": n}
    made = [("短", "x", "short"), ("根据本研究，水稻如何生长发育？", "水稻生长发育的机制包括很多方面的调控过程，如此等等。", "study_dependent"), ("如果水，如果光，会怎样影响水稻生长？", "水稻生长发育的机制包括很多方面的调控过程，如此等等。", "conditions"), ("水稻的作者单位是什么地方？", "水稻生长发育的机制包括很多方面的调控过程，如此等等。", "author")]
    for q, a, reason in made:
        assert one(spark, r.paper_reject("q", "a"), q=q, a=a) == reason


def test_smoothed(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").collect()
    mean = collections.defaultdict(lambda: 0.5)
    for x in rows:
        mean[x.user_id] = mean[x.user_id] * 0.9 + 0.1 * (x.event_type != "error")
    got = {x.user_id: x.mean for x in relational.catalog.plans["w06_smoothed"](spark, sf).collect()}
    assert got == pytest.approx(dict(mean))


def test_key_sentences(spark, sf):
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for x in structures.catalog.plans["l16_key_sentences"](spark, sf).collect():
        parts = [p.strip() for p in re.split(r"(?<=[。！？.!?])\s*", docs[x.doc_id] or "") if p.strip()]
        worth = sorted((-(sum(w in p.lower() for w in ("the", "der")) + 1 - 0.5 * i / len(parts)), i) for i, p in enumerate(parts))
        best = sorted(i for _, i in worth[: max(1, math.ceil(len(parts) * 0.6))])
        assert x.n == len(" ".join(parts[i] for i in best)[:4000]), x.doc_id


def test_patent_tables(spark, sf):
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    plain = {i for i, t in docs.items() if t and len(t) >= 200 and "#" not in t and "<" not in t and "|" not in t and "$" not in t and "[" not in t and "```" not in t}
    rows = {x.doc_id: x for x in structures.catalog.plans["t03_patent_metadata"](spark, sf).collect()}
    assert plain and all(rows[i].abstract == rows[i].claims and rows[i].abstract >= 100 for i in plain)
    parts = [x for x in structures.catalog.plans["t02_patent"](spark, sf).collect() if x.doc_id in plain]
    by = collections.defaultdict(list)
    for x in parts:
        by[x.doc_id].append(x)
    assert set(by) == plain and all([x.pos for x in sorted(v, key=lambda x: x.pos)] == list(range(len(v))) and all(x.length >= 100 for x in v) for v in by.values())


def test_chunks_cover_the_text(spark, sf):
    for name in ("t01_paper", "t04_thesis", "t05_book"):
        rows = structures.catalog.plans[name](spark, sf).collect()
        by = collections.defaultdict(list)
        for x in rows:
            by[x.doc_id].append(x)
        assert len(by) > 100
        for v in by.values():
            assert sorted(x.pos for x in v) == list(range(len(v))) and all(x.length > 0 and x.title is not None for x in v)


def test_cascade_learns(spark):
    rng = random.Random(1)
    made = lambda good: " ".join(rng.choice(("rice wheat soil crop" if good else "stock bank price market").split() + "the of a in".split()) for _ in range(40))
    rows = [(i, made(i % 2), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string, y int")
    got = {x.id: x.probability for x in cl.cascade(df.where("id >= 100"), df.where("id < 100"), "id", "text", "y").collect()}
    assert len(got) == 100 and sum((p > 0.5) == (i % 2) for i, p in got.items()) >= 98


def test_model_tokens(spark, sf):
    from curato.functions import values as v

    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {x.doc_id: x.n_tokens for x in scalars.catalog.plans["p22_model_tokens"](spark, sf).collect()}
    assert got.keys() == docs.keys() and all((got[i] == 0) == (not docs[i]) or got[i] >= 1 for i in docs)
    assert {x.n for x in spark.createDataFrame([("a b c",), ("a b c",)], "t string").select(v.model_tokens("t").alias("n")).collect()}.__len__() == 1


def test_quota_state(spark):
    rows = [(i, (i * 7) % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "at long, cost long").repartition(3)
    state, seen = None, []
    for _ in range(9):
        fits, state = flows.until_quota(df, "at", "cost", 60, state)
        seen.append(sorted(x["at"] for x in fits.collect()))
        if not state.count():
            break
    assert [x for part in seen for x in part] == list(range(200)) and all(sum(rows[i][1] for i in part) <= 60 for part in seen)
    assert all(sum(rows[i][1] for i in part) + rows[part[-1] + 1][1] > 60 for part in seen[:-1])


def test_sheets(spark, tmp_path):
    """Cells are placed by their letters, shared and inline texts are read, all sheets of all files, and what is written comes back."""
    import zipfile

    sheet = lambda body: f'<worksheet xmlns="http://x"><sheetData>{body}</sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://x"><si><t>Question</t></si><si><r><t>wh</t></r><r><t>y so?</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet('<row><c r="B1" t="s"><v>0</v></c></row><row><c r="A2"><v>5</v></c><c r="B2" t="s"><v>1</v></c></row><row><c r="AB3" t="inlineStr"><is><t>far</t></is></c></row>'))
        z.writestr("xl/worksheets/sheet10.xml", sheet('<row><c r="A1" t="inlineStr"><is><t>类别</t></is></c></row>'))
    rows = {(x.sheet, x.row): x.cells for x in readers.sheets(spark, [str(tmp_path / "a.xlsx")]).collect()}
    assert rows == {(1, 0): [None, "Question"], (1, 1): ["5", "why so?"], (1, 2): [None] * 27 + ["far"], (10, 0): ["类别"]}
    asked = readers.sheet_questions(readers.sheets(spark, [str(tmp_path / "a.xlsx")])).collect()
    assert [(x.question, x.category, x.sheet, x.row) for x in asked] == [("why so?", "", 1, 1)]
    df = spark.createDataFrame([(1, "a & <b>", None), (2, " x ", "y")], "n long, s string, t string").coalesce(1)
    told = writers.sheets_out(df, str(tmp_path / "out"))
    back = readers.sheets(spark, [x.path for x in told.collect()]).orderBy("row").collect()
    assert [x.cells for x in back] == [["n", "s", "t"], ["1", "a & <b>", None], ["2", " x ", "y"]]


def test_numbered(spark):
    df = spark.createDataFrame([(i % 10, i) for i in range(300)], "a long, b long").repartition(7)
    got = sorted((x.n, x.a, x.b) for x in o.numbered(df, ["a", "b"], "n").collect())
    assert [(a, b) for _, a, b in got] == sorted((i % 10, i) for i in range(300)) and [n for n, _, _ in got] == list(range(1, 301))


def test_compare_tells_integers_apart(spark, sf):
    plan = lambda spark, folder: spark.range(1).select(F.lit(2**60).alias("x"))
    assert compare.difference(plan, f"SELECT {2**60}::BIGINT AS x", spark, sf) is None
    assert compare.difference(plan, f"SELECT {2**60 + 1}::BIGINT AS x", spark, sf)
