"""The training-data operators against brute force, and on nulls, empty tables, ties, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from curato.llm import chat, components, fingerprints, mixing, neardup, neighbours, packing, queries, sharding, shared, substrings, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, __score double"


def docs(spark, rows):
    """Documents with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x", 0.0) for i, t, s in rows], DOCS)


def made(n=60, seed=3):
    """Texts with copies, near copies, shared passages, empty and null ones, ties and a long one."""
    rng = random.Random(seed)
    words = lambda k: [rng.choice("alpha beta gamma delta Omega kappa sigma tau ré x it's".split(" ")) + str(rng.randrange(500)) for _ in range(k)]
    passage, out = words(40), []
    for i in range(n):
        w = words(rng.randrange(1, 90))
        if i % 4 == 1:
            w = w[:20] + passage + w[20:]
        if i % 5 == 2 and out:
            w = (rng.choice(out) or "a").split()
            if i % 2:
                w[rng.randrange(len(w))] = "CHANGED"
        out.append(rng.choice([" ", "\n", "\t "]).join(w))
    out += ["", None, "   ", "one", "ONE", " ".join(words(4000)), out[3], out[3]]
    rows = [(i, t, "ab"[i % 2] if i % 7 else None) for i, t in enumerate(out)]
    return [*rows, (3, out[3], "a"), (None, out[5], "b")]


@pytest.fixture(scope="module")
def table(spark):
    return docs(spark, made()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def test_sharding(table):
    rows = sharding.shard_records(table).collect()
    assert len(rows) == table.count()
    for r, t in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.slot)), sorted(made(), key=lambda x: (x[0] is None, x[0])), strict=True):
        raw = (t[1] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        draws = [int(hashlib.md5(f"{'' if r.doc_id is None else r.doc_id}:{s // 4}".encode()).hexdigest()[8 * (s % 4) : 8 * (s % 4) + 8], 16) for s in range(25)]
        assert r.shard == max(range(24), key=lambda s: (draws[s], -s)) and r.grown_shard == max(range(25), key=lambda s: (draws[s], -s))
    for s, own in collections.Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(own))


def test_sharding_weights(spark):
    got = sharding.rendezvous(spark.range(20_000).toDF("doc_id"), "doc_id", [1.0, 3.0, 0.0]).groupBy("shard").count().collect()
    share = {r.shard: r["count"] / 20_000 for r in got}
    assert set(share) == {0, 1} and abs(share[1] - 0.75) < 0.02


def test_warc(spark, monkeypatch):
    rows = [(1, "u", "same"), (5, "u\n", "same"), (3, None, "same"), (7, "u", None), (8, "u", ""), (9, "u", "é" * 1_300_000), (None, "u", "same"), (5, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.page_digests(pages).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 5), 3: ("revisit", 5), None: ("revisit", 5), 5: ("response", None), 7: ("revisit", 8), 8: ("response", None), 9: ("response", None)}
    assert all(r.intact for r in got.values()) and got[9].payload_bytes == 2_600_000 and got[9].payload_digest == warc.b32(hashlib.sha1(("é" * 1_300_000).encode()).digest())
    chunks = warc.archive_pages(pages).where("page_id = 9").orderBy("chunk_no").collect()
    assert [len(c.data) for c in chunks] == [1 << 20, 1 << 20, 2_600_000 - (2 << 20)] and b"".join(c.data for c in chunks).decode() == "é" * 1_300_000
    assert [c.digest_so_far for c in chunks][0] == warc.b32(hashlib.sha1(chunks[0].data).digest())
    records = warc.archive_pages(pages).where("is_last").select("record_id").collect()
    assert len(records) == len(rows) == len({r.record_id for r in records}) and all(r.record_id.startswith("<urn:uuid:") for r in records)
    monkeypatch.setattr(warc, "FEW", 0)
    assert {(r.page_id, r.record_type, r.refers_to) for r in warc.page_digests(pages).collect()} == {(r.page_id, r.record_type, r.refers_to) for r in got.values()}
    assert warc.archive_pages(pages, min_bytes=100).where("record_type = 'revisit'").count() == 0
    assert warc.page_digests(pages.limit(0)).count() == 0


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))


def test_boundaries_are_best():
    rng = np.random.default_rng(1)
    lengths, counts = np.array([1, 3, 4, 9, 12, 20]), rng.integers(1, 9, 6)
    for b in (1, 2, 3, 9):
        best = min(padding(lengths, counts, [*x, 20]) for k in range(min(b, 6)) for x in itertools.combinations(lengths[:-1].tolist(), k))
        got = packing.boundaries(lengths, counts, b)
        assert padding(lengths, counts, got) == best and len(got) <= b
    assert packing.boundaries(lengths[:0], counts[:0], 3) == [] and packing.boundaries(np.array([7]), np.array([2]), 3) == [7]


def test_boundaries_of_long_texts_are_best():
    """Against the plain recurrence, on lengths to 20,000 words with ties and gaps."""
    rng = np.random.default_rng(2)
    for n, b in ((40, 5), (150, 16), (150, 3)):
        lengths, counts = np.sort(rng.choice(20_000, n, replace=False)), rng.integers(1, 50, n) * rng.integers(0, 9, n) + 1
        many, words = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
        least = [0] + [math.inf] * n
        for _ in range(b):
            least = [0] + [min(least[i] + (many[j] - many[i]) * lengths[j - 1] - (words[j] - words[i]) for i in range(j)) for j in range(1, n + 1)]
        got = packing.boundaries(lengths, counts, b)
        assert padding(lengths, counts, got) == least[n] and len(got) <= b


def test_packing(table, empty):
    rows = packing.pack(table, budget=300).collect()
    assert len(rows) == table.count() and packing.pack(empty).count() == 0
    batches = collections.defaultdict(list)
    for r in rows:
        assert r.n_words <= r.padded_words
        batches[r.bucket, r.batch].append(r)
    for own in batches.values():
        assert sorted(r.slot for r in own) == list(range(len(own))) and (len(own) == 1 or len(own) * own[0].padded_words <= 300)
    many = collections.Counter(len((t or "").encode().split()) for _, t, _ in made())
    assert collections.Counter(r.n_words for r in rows) == many
    lengths = np.array(sorted(many))
    assert sum(r.padded_words - r.n_words for r in rows) == padding(lengths, [many[n] for n in lengths], packing.boundaries(lengths, np.array([many[n] for n in lengths]), packing.BUCKETS))


def test_chat(spark):
    calls = spark.createDataFrame([
        (1, "a", 0, "t", '{"n": 1.0, "b": [2]}', []), (1, "b", 1, "t", '{"n": "x"}', ["a"]), (1, "c", 2, "t", None, ["b", "a", "zz"]), (1, "x", 3, "u", "{}", ["y"]), (1, "y", 4, "u", "{}", ["x"]),
        (1, "a", 5, "t", "{}", []), (1, None, 6, "t", "nope", []), (2, "a", 9, "t", '{"n": NaN}', ["late"]), (2, "late", 10, "t", '{"n": 3}', []),
    ], "conv_id long, call_id string, position long, tool string, arguments string, needs array<string>")
    results = spark.createDataFrame([(1, "a", 3, "r1"), (1, "a", 4, "r2"), (1, "b", 0, "early"), (1, "q", 8, "orphan"), (1, "", 9, "u"), (2, "a", 11, "ok")], "conv_id long, call_id string, position long, content string")
    schemas = {"t": {"type": "object", "required": ["n"], "properties": {"n": {"type": "number", "minimum": 1}}}}
    rows = chat.link(calls, results, schemas).collect()
    got = {(r.conv_id, r.call_id, r.position): (r.status, r.level, r.missing, r.valid) for r in rows}
    assert got == {
        (1, "a", 0): ("linked", 0, 0, True), (1, "b", 1): ("result_before_call", 1, 0, False), (1, "c", 2): ("no_result", 2, 1, False), (1, "x", 3): ("cycle", None, 0, True), (1, "y", 4): ("cycle", None, 0, True),
        (1, "a", 5): ("repeat", None, 0, False), (1, None, 6): ("unnamed", None, 0, False), (2, "a", 9): ("linked", 1, 0, False), (2, "late", 10): ("no_result", 0, 0, True),
        (1, "a", 4): ("repeat", None, 0, True), (1, "q", 8): ("no_call", None, 0, True), (1, "", 9): ("unnamed", None, 0, True),
    }
    assert next(r.message for r in rows if r.position == 0) == '{"arguments":{"b":[2],"n":1.0},"id":"a","level":0,"name":"t","result":"r1"}'
    assert chat.link(calls.limit(0), results.limit(0), schemas).count() == 0


def plain_levels(calls, edges):
    """Longest chain below each call, None on cycles and above them."""
    needs = {c: {b for a, b in edges if a == c and b in calls} for c in calls}
    level = {}
    while True:
        ready = {c: 1 + max((level[b] for b in needs[c]), default=-1) for c in calls if c not in level and needs[c] <= level.keys()}
        if not ready:
            return {c: level.get(c) for c in calls}
        level |= ready


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_levels(spark, seed):
    """Chains, fans, edges over others, calls needed before they are made, cycles and missing needs."""
    rng = random.Random(seed)
    calls, edges, want = [], [], {}
    for conv in range(8):
        n = rng.randrange(1, 25)
        names = [f"c{i}" for i in range(n)]
        own = [(names[i], names[max(0, i - 1)]) for i in range(n) if rng.random() < 0.7 and i] + [(rng.choice(names), rng.choice([*names, "zz"])) for _ in range(rng.randrange(0, n))]
        if conv % 2:
            own = [(a, b) for a, b in own if b == "zz" or int(b[1:]) < int(a[1:])]
        calls += [(conv, c, i) for i, c in enumerate(names)]
        edges += [(conv, *e) for e in own]
        want |= {(conv, c): v for c, v in plain_levels(names, own).items()}
    got = {(r.conv_id, r.call_id): r.level for r in chat.levels(spark.createDataFrame(calls, "conv_id long, call_id string, position long"), spark.createDataFrame(edges, "conv_id long, call_id string, needs string")).collect()}
    assert got == want and None in want.values()


def test_link_conversations(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", ""), (1, 4, "assistant", None), (2, 0, "user", "alone"), (3, 1, "assistant", "orphan"), (None, None, None, None), (4, 0, "user", "a"), (4, 0, "user", "b")]
    got = sorted(((r.conv_id, r.call_id, r.status, r.tool, r.level, r.valid) for r in chat.link_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()), key=repr)
    assert got == sorted([
        (1, "0", "no_result", "setup", 0, True), (1, "1", "linked", "reply", 1, True), (1, "3", "linked", "reply", 2, False), (2, "0", "no_result", "reply", 0, True), (3, "0", "no_call", None, None, True),
        (None, "", "unnamed", "setup", None, False), (4, "0", "no_result", "reply", 0, True), (4, "0", "repeat", "reply", None, True),
    ], key=repr)


def shingles(text, lower=True):
    raw = (text or "").encode()
    w = (bytes(b + 32 if 65 <= b < 91 else b for b in raw) if lower else raw).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_fingerprints(table, empty):
    rows = fingerprints.digest(table).collect()
    order = sorted(made(), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t, _ in order]
    assert len(rows) == len(order) and fingerprints.digest(empty).count() == 0
    want = collections.Counter((i, len(t), hashlib.sha256(fingerprints.edited(t, n).encode()).hexdigest()) for (i, _, _), t, n in zip(order, texts, texts[1:] + texts[:1], strict=True))
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    by_id = {i: t or "" for i, t, _ in made()}
    prints = collections.defaultdict(set)
    for r in rows:
        prints[by_id[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values())


def test_fingerprint_estimates():
    rng = random.Random(5)
    base = [str(rng.random()) for _ in range(400)]
    texts = [" ".join(base), " ".join(base[:300] + ["z"] * 100), " ".join(base[::-1])]
    sig = fingerprints.of_texts(texts)
    x, y = shingles(texts[0]), shingles(texts[1])
    assert abs(fingerprints.likeness(sig[:1], sig[1:2])[0] - len(x & y) / len(x | y)) < 0.15 and fingerprints.likeness(sig[:1], sig[2:])[0] < 0.05


def test_near_pairs(table):
    by_id = {i: t for i, t, _ in made()}
    for r in fingerprints.near_pairs(table).collect():
        x, y = shingles(by_id[r.a], False), shingles(by_id[r.b], False)
        assert abs(r.jaccard - len(x & y) / len(x | y)) < 1e-9 and r.jaccard >= 0.75


def test_near_pairs_misses_none(spark, monkeypatch):
    """All pairs of different texts that are alike, in parts too; copies go with the first of them."""
    rng = random.Random(9)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((i, " ".join(w), "a"))
    rows += [(100 + i, rows[i][1].replace(" ", "  "), "a") for i in range(0, 70, 9)] + [(200, "", "a"), (201, None, "a"), (202, "", "a"), (1, rows[1][1] + " more", "a")]
    first = {}
    for i, t, _ in rows:
        if s := shingles(t, False):
            first[s] = min(i, first.get(s, i))
    want = [(min(p, q), max(p, q), round(len(x & y) / len(x | y), 9)) for k, (x, p) in enumerate(first.items()) for y, q in list(first.items())[:k] if len(x & y) >= 0.75 * len(x | y)]
    want += {(first[s], i, 1.0) for i, t, _ in rows if (s := shingles(t, False)) and i > first[s]}
    for members in (256, 16):
        monkeypatch.setattr(fingerprints, "MEMBERS", members)
        got = [(r.a, r.b, round(r.jaccard, 9)) for r in fingerprints.near_pairs(docs(spark, rows)).collect()]
        assert len(want) > 100 and sorted(got) == sorted(want)


def toxic_events(text, learned=()):
    c = toxicity.count_events(pa.array([text]), toxicity.Lexicon(list(learned)), toxicity.Machine())[0]
    return {e: int(n) for e, n in zip(toxicity.EVENTS, c, strict=True) if n}


def test_toxic_clauses():
    assert toxic_events("What an idiot.") == {"insult": 1}
    assert toxic_events("You are an IDIOT$$$!") == {"insult": 1, "directed_insult": 1}
    assert toxic_events("He is not stupid. You moron") == {"negated_insult": 1, "insult": 1, "directed_insult": 1}
    assert toxic_events("she said the loser left") == {"reported_insult": 1}
    assert toxic_events("I will kill you") == {"threat": 1, "directed_threat": 1}
    assert toxic_events("It will kill time") == {"threat": 1}
    assert toxic_events("") == {} and toxic_events("idiotically clownish") == {}
    assert toxic_events("CRÉTINE. idiot. idiot. idiot. idiot") == {"insult": 3}


def test_toxic_stems():
    stems = ["réeux-", "zorgle"]
    assert toxic_events("réeux Réeuxpa RÉEUXCH. préeuxa", stems) == {"stem": 2}
    assert toxic_events("zorgle zorgles not zorgle", stems) == {"stem": 1, "negated_stem": 1}
    assert toxic_events("idiot", ["idiot", "idi-"]) == {"insult": 1}


def plain_events(text):
    """The grammar once more, word by word without transducers."""
    out = collections.Counter()
    for clause in re.split(r"[.!?;\n]", text):
        kinds = [next((k for k, own in (("insult", toxicity.INSULTS), ("threat", toxicity.THREATS), ("target", toxicity.TARGETS), ("negation", toxicity.NEGATIONS), ("report", toxicity.REPORTS)) if w in own), "other") for w in re.findall(r"[^\W\d_]+", clause.lower())]
        if "insult" not in kinds and "threat" not in kinds:
            continue
        # what each transducer reads is what the one before it writes
        for marker, how, reach in (("negation", "negated", 4), ("report", "reported", 99)):
            left, row = 0, []
            for k in kinds:
                if k == marker:
                    left = reach
                    continue
                row.append(f"{how}_{k}" if left and k in ("insult", "threat") else k)
                left = max(0, left - 1)
            kinds = row
        near, used = 4, set()
        wait, left, age = None, 0, 0
        hit = {}
        for i, k in enumerate(kinds):
            if k == "target":
                if wait is not None:
                    hit[wait] = True
                wait, left = None, near
            elif k in ("insult", "threat"):
                hit[i], wait, age = left > 0, None if left > 0 else i, 0
                left = max(0, left - 1)
                if not hit[i]:
                    left = 0
            else:
                left = max(0, left - 1)
                age += 1
                if age >= near:
                    wait = None
        for family in ("insult", "threat"):
            for n, i in enumerate(i for i in hit if kinds[i] == family):
                if n < 3:
                    out[family] += 1
                    out[f"directed_{family}"] += hit[i]
        out.update(k for k in kinds if k.startswith(("negated_", "reported_")))
    caps = dict(zip(toxicity.EVENTS, toxicity.CAP.tolist(), strict=True))
    return {e: min(n, caps[e]) for e, n in out.items() if n}


def test_toxic_grammar_against_a_plain_reading():
    rng = random.Random(6)
    words = "idiot kill you not said the tree moron they never wrote hill".split()
    for _ in range(1500):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", "", ".", ","]) for _ in range(rng.randrange(1, 14)))
        assert toxic_events(text) == plain_events(text), text


def test_toxicity(spark, empty):
    rng = random.Random(2)
    plain = lambda: " ".join(rng.choice("the sun and a tree over hill by sea".split()) for _ in range(30))
    rows = [(i, plain() + (" you idiot zorgle " + plain() if i % 3 == 0 else ""), "a") for i in range(900)] + [(None, "idiot", "a"), (900, None, "a"), (901, "", "b")]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs(spark, rows), labels).collect()}
    assert len(got) == 903 and all(got[i].predicted == (i % 3 == 0) for i in range(900)) and got[900].score == got[901].score < 0.7
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(900)) and got[None].held_out is False
    assert toxicity.train(docs(spark, rows), labels).learned == ["zorgle"]
    odd = docs(spark, rows).withColumns({"events": F.lit("x"), "SCORE": F.lit(1), "__events": F.lit(2), "tid": F.lit(3), "vote": F.lit(4)})
    kept = toxicity.keep_clean(odd, labels)
    assert kept.columns == odd.columns and kept.where("doc_id % 3 = 0 and doc_id < 900").count() == 0 and kept.where("doc_id % 3 != 0").count() == 600 + 1
    assert toxicity.score_documents(empty, labels).count() == 0 and toxicity.score_documents(docs(spark, rows), labels.limit(0)).count() == 903


def test_toxicity_of_inflected_words(spark):
    """In three languages, on rows whose labels were not read; near copies of a toxic text teach nothing about its other words."""
    rng = random.Random(7)
    parts = {"fr": "eau tre ment éré oi que", "de": "ung keit schaft über lich ße", "es": "ción ado íos mente lla ñez"}
    stems = {"fr": "zéroux", "de": "gräbt", "es": "ñobal"}
    rows, labels = [], []
    for i in range(1500):
        lang = ("fr", "de", "es")[i % 3]
        syllables = parts[lang].split()
        word = lambda s=syllables: "".join(rng.choice(s) for _ in range(rng.randrange(1, 5)))
        w, toxic = [word() for _ in range(60)], int(rng.random() < 0.15)
        for _ in range(rng.randrange(2, 5) if toxic else rng.random() < 0.05):
            w[rng.randrange(60)] = stems[lang] + rng.choice(syllables)
        rows.append((i, " ".join(w), "a"))
        labels.append((i, 1, toxic))
    copied = next(t for (_, t, _), (_, _, y) in zip(rows, labels, strict=True) if y).split()
    for i in range(1500, 1900):
        w = list(copied)
        w[rng.randrange(60)] = "eautre"
        rows.append((i, " ".join(w), "a"))
        labels.append((i, 1, 1))
    made, told = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(toxicity.train(made, told).learned) == sorted(f"{s}-" for s in stems.values())
    truth = {i: y for i, _, y in labels}
    got = [(r.doc_id % 3, truth[r.doc_id], r.predicted) for r in toxicity.score_documents(made, told).collect() if r.held_out and r.doc_id < 1500]
    for lang in range(3):
        own = [(y, p) for k, y, p in got if k == lang]
        assert sum(y and p for y, p in own) >= 0.9 * sum(y for y, _ in own) and sum(p and not y for y, p in own) <= 0.02 * len(own)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcéx") for _ in range(rng.randrange(1, 9))) for _ in range(3000)), "", "x" * 5000, "a b", " " * 4000 + "end"]

    data, offsets = shared.text_buffers(pa.array(texts))
    whole = shared.word_hashes(data, offsets, True)
    raw = pa.array(["you idiot. " * 500 + "no " * 900 + "they said moron"])
    events = toxicity.count_events(raw, toxicity.Lexicon(["an-"]), toxicity.Machine())
    monkeypatch.setattr(shared, "BLOCK_BYTES", 64)
    for x, y in zip(whole, shared.word_hashes(data, offsets, True), strict=True):
        assert (x == y).all()
    assert (events == toxicity.count_events(raw, toxicity.Lexicon(["an-"]), toxicity.Machine())).all() and events.sum() > 4


def test_word_hashes_have_no_built_in_collisions():
    """Words made like the Thue-Morse sequence and its complement have equal sums under powers of any odd base."""
    t = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    hashes, _ = shared.word_hashes(*shared.text_buffers(pa.array([t + " " + t.translate({97: 98, 98: 97})])))
    assert hashes[0] != hashes[1]


def test_targets():
    assert mixing.targets([10, 10, 10], [3, 1, 2], 45, 2) == pytest.approx([20, 25 / 3, 50 / 3])
    assert mixing.targets([10, 0], [1, 1], 15, 2) == [15, 0] and mixing.targets([1, 1], [1, 1], 99, 2) == [2, 2]


def test_flow_prefers_few_repeats():
    flow = mixing.min_cost_flow([10, 10, 10], [[0], [0, 1], [1]], [[20], [20, 20], [20]], [25, 20])
    assert flow[0][0] + flow[1][0] == 25 and flow[1][1] + flow[2][0] == 20
    assert sum(max(0, sum(f) - 10) for f in flow) == 15


def test_flow_is_cheapest():
    """Against all whole flows of small networks."""
    rng = random.Random(4)
    for _ in range(60):
        n, k = rng.randrange(1, 4), rng.randrange(1, 3)
        supply = [rng.randrange(1, 4) for _ in range(n)]
        members = [sorted(rng.sample(range(k), rng.randrange(1, k + 1))) for _ in range(n)]
        rooms = [[rng.randrange(1, 5) for _ in m] for m in members]
        quotas = [rng.randrange(0, 6) for _ in range(k)]
        arcs = [(p, i) for p in range(n) for i in range(len(members[p]))]

        def price(flow, supply=supply):
            return sum((w // supply[p]) and sum(r * r * supply[p] for r in range(w // supply[p])) + (w // supply[p]) ** 2 * (w % supply[p]) for p, w in flow.items())

        best = (-1, 0)
        for amounts in itertools.product(*[range(rooms[p][i] + 1) for p, i in arcs]):
            got, by = [0] * k, collections.Counter()
            for (p, i), w in zip(arcs, amounts, strict=True):
                got[members[p][i]] += w
                by[p] += w
            if all(g <= q for g, q in zip(got, quotas, strict=True)):
                best = max(best, (sum(got), -price(by)))
        flow = mixing.min_cost_flow(supply, members, rooms, quotas)
        by = {p: sum(f) for p, f in enumerate(flow)}
        assert all(0 <= w <= r for f, room in zip(flow, rooms, strict=True) for w, r in zip(f, room, strict=True))
        assert (sum(by.values()), -price(by)) == best, (supply, members, rooms, quotas)


def test_use_costs():
    assert mixing.use_costs(10, 25) == [(10, 0), (10, 1), (5, 4)] and mixing.use_costs(0, 9) == [] and mixing.use_costs(3, 0) == []
    many = mixing.use_costs(2, 2 * 5000)
    assert sum(w for w, _ in many) == 10_000 and len(many) < 24 and [c for _, c in many] == sorted({c for _, c in many})


def test_mixing_of_overlapping_sources(spark):
    """Texts that two sources hold are shared out between them before any text repeats."""
    rng = random.Random(6)
    both = [" ".join(str(rng.random()) for _ in range(10)) for _ in range(3000)]
    rows = [(i, t, "a") for i, t in enumerate(both)] + [(10_000 + i, t, "b") for i, t in enumerate(both)]
    rows = mixing._rows(docs(spark, rows), "doc_id", "text", "source")
    out, plan = mixing.mix_sources(rows, weights=(1, 1), share=0.45)
    taken = collections.Counter()
    for r in out.where("taken > 0").collect():
        taken[r.h] += r.taken // r["size"]
    assert plan["targets"] == [13_500, 13_500] and abs(sum(taken.values()) - 2700) <= 2
    assert sum(n > 1 for n in taken.values()) <= 0.02 * len(taken)
    out, _ = mixing.mix_sources(rows, weights=(1, 0.5), share=0.75)
    told = {r.source: (r.t, r.twice) for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.count_if(F.col("taken") > F.col("size")).alias("twice")).collect()}
    assert abs(told["a"][0] - 30_000) <= 10 and abs(told["b"][0] - 15_000) <= 10


def test_mixing(table, empty):
    rows = mixing.mix_documents(table).collect()
    by = collections.defaultdict(lambda: [0, 0, 0.0, 0])
    sources = {i: s for i, _, s in made()}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        b = by[sources[r.doc_id]]
        b[0], b[1], b[2], b[3] = b[0] + r["size"], b[1] + r.taken, r.target, max(b[3], r["size"])
    assert sum(b[2] for b in by.values()) == pytest.approx(1.5 * sum(b[0] for b in by.values()))
    assert all(abs(b[1] - b[2]) <= b[3] for b in by.values())
    again = sorted((str(r.doc_id), r.taken) for r in mixing.mix_documents(table.repartition(3)).collect())
    assert again == sorted((str(r.doc_id), r.taken) for r in rows)
    odd = table.withColumns({n: F.lit(7) for n in ("uses", "__uses", "at", "__at_", "pattern", "taken")})
    assert mixing.mixed_documents(odd).columns == odd.columns
    out = mixing.mixed_documents(table)
    assert out.columns == table.columns and out.select(F.sum(mixing.words_of(F.col("text")))).first()[0] == sum(r.taken for r in rows)
    assert mixing.mix_documents(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def removed(rows, k):
    """Words left by (doc_id, text), windows compared one by one."""
    seen, out = {}, {}
    for i, t in sorted({(i, t or "") for i, t, _ in rows}, key=lambda x: (x[0] is not None, x[0] or 0)):
        w = t.encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if seen.setdefault(tuple(w[s : s + k]), (i, t, s)) != (i, t, s):
                gone[s : s + k] = [True] * k
        out[i, t] = len(w), sum(gone), b" ".join(a for a, g in zip(w, gone, strict=True) if not g)
    return out


def test_substrings(table, empty):
    want = removed(made(), 20)
    assert sum(x[1] for x in want.values()) > 200
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(table).collect())
    assert got == collections.Counter((i, *want[i, t or ""][:2], hashlib.sha256(want[i, t or ""][2]).hexdigest()) for i, t, _ in made())
    odd = table.withColumns({n: F.lit(7) for n in ("__n_words", "__n_removed", "__KEPT", "at", "tid", "opens")})
    assert substrings.without_repeats(odd).columns == odd.columns
    cut = substrings.without_repeats(table)
    assert cut.columns == table.columns and cut.count() == table.count() and substrings.digest(empty).count() == 0


def test_window_hashes_are_wide_enough(table, monkeypatch):
    """Bits grow with the windows, into a second hash; with too few, different windows would be taken for equal ones."""
    for words in (10**3, 10**8, 10**10, 2**44):
        buckets = max(substrings.LEAST_BUCKETS, words >> 20)
        first, second = substrings.hash_bytes(words, buckets)
        assert 8 * first + math.log2(buckets) <= 64 + 1e-9 and 8 * (first + second) + math.log2(buckets) >= 2 * math.log2(words) - 1 + substrings.SURE
    want = removed(made(), 20)
    want = collections.Counter((i, *want[i, t or ""][:2]) for i, t, _ in made())
    got = lambda: collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.digest(table).collect())
    monkeypatch.setattr(substrings, "hash_bytes", lambda words, buckets: (1, 4))
    assert got() == want
    monkeypatch.setattr(substrings, "hash_bytes", lambda words, buckets: (1, 0))
    assert got() != want


@pytest.mark.parametrize("n", [1, 2, 3, 127, 128, 700])
def test_superminhash_is_the_sequential_one(n):
    values = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    m = neardup.SLOTS
    want = [2**64 - 1] * m
    for v in values:
        way = list(range(m))
        for j in range(m):
            u = int(shared.mix(np.array([(int(v) + int(shared.GOLD) * (j + 1)) % 2**64], np.uint64))[0])
            k = j + ((u & 0xFFFFFFFF) * (m - j) >> 32)
            way[j], way[k] = way[k], way[j]
            want[way[j]] = min(want[way[j]], (j << 32) | (u >> 32))
    got = neardup.superminhash(np.concatenate([values, values[:0], values]), np.array([0, n, n, 2 * n]))
    assert got[0].tolist() == want == got[2].tolist() and (got[1] == neardup.FULL).all()


def classes(rows):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    key = lambda i: -(2**63) if i is None else i
    sets = [(key(i), shingles(t)) for i, t, _ in rows]
    for a, x in sets:
        for b, y in sets:
            if x and y and a < b and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    back = lambda i: None if i == -(2**63) else i
    return collections.Counter((back(a), len(x), back(root(a))) for a, x in sets)


def test_neardup(table, empty):
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(table).collect()) == classes(made())
    assert neardup.near_duplicates(empty).count() == 0
    one = neardup.one_of_each(table)
    assert one.columns == table.columns and one.count() == len({c[2] for c in classes(made())})


def test_one_of_each_group_of_an_id(spark):
    """Different texts without a doc_id, or under one that is repeated, each stay; alike ones once."""
    rng = random.Random(12)
    a, b, c, d, e = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "abcde")
    near = a + " more"
    rows = [(None, a, "a"), (None, b, "a"), (None, b, "b"), (None, near, "a"), (None, "", "a"), (5, c, "a"), (5, d, "a"), (2, c, "a"), (7, e, "a"), (7, e + " more", "a"), (8, " ", "a"), (8, " ", "a"), (8, None, "a")]
    got = sorted(((r.doc_id, r.text) for r in neardup.one_of_each(docs(spark, rows)).collect()), key=repr)
    alike = {near: a, e + " more": e, None: ""}
    want = [(None, a), (None, b), (None, ""), (5, d), (2, c), (7, e), (8, " "), (8, "")]
    assert sorted(((i, alike.get(t, t)) for i, t in got), key=repr) == sorted(want, key=repr)


def test_neardup_of_one_group(spark, monkeypatch):
    """Variants of one text, most pairs of which are not alike, still make the right components, in parts too."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((i, " ".join(w), "a"))
    monkeypatch.setattr(neardup, "MEMBERS_PER_PART", 16)
    joined = neardup.joined
    for settle_at_once in (False, True):
        if settle_at_once:
            monkeypatch.setattr(neardup, "joined", lambda b, s: joined(b, s, pairs_per_row=10**9))
        got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, rows)).collect())
        assert got == classes(rows)


@pytest.mark.parametrize("per_task", [250_000, 5])
def test_components(spark, monkeypatch, per_task):
    monkeypatch.setattr(components, "LINKS_PER_TASK", per_task)
    links = [(i, i + 1) for i in range(0, 30) if i % 10 != 9] + [(100, 3), (100, 25), (7, 7), (50, 51), (51, 50)]
    got = {r.v: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {**{i: 0 for i in range(10)}, **{i: 10 for i in range(10, 20)}, **{i: 0 for i in range(20, 30)}, 100: 0, 50: 50, 51: 50}
    assert got == want


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 300)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 16))
    x[600:] = x[:600] + 0.1 * rng.normal(size=(600, 16))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000 + i, [float(v) for v in x[50]]) for i in range(8)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [1.0, None] * 8), (3004, [math.nan] * 16), (3050, [math.inf] * 16), (None, [1.0] * 16), (3100, [1.0] * 5), (0, [float(v) for v in x[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = neighbours.nearest_neighbours(df).collect(), neighbours.brute_force(df).collect()
    hit = {(r.query_id, r.vec_id) for r in got} & {(r.query_id, r.vec_id) for r in want}
    assert len(got) == len(want) and len(hit) >= 0.9 * len(want)
    own = sorted((r.rank, r.vec_id) for r in got if r.query_id == 50)
    assert [v for _, v in own] == [2000, 2001, 2002, 2003, 2004]
    few = df.where("vec_id in (0, 50, 2000)")
    assert {(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest_neighbours(few).collect()} == {(r.query_id, r.rank, r.vec_id) for r in neighbours.brute_force(few).collect()}
    assert neighbours.nearest_neighbours(df.limit(0)).count() == 0


def test_neighbours_of_extreme_vectors(spark):
    """Components whose squares, or norms' product, leave the range of doubles; multiples have a cosine of 1."""
    base = np.random.default_rng(3).normal(size=(60, 8))
    rows = [(i, [float(v) * (1e200, 1e-200, 1.0, 1e-308)[i % 4] for v in r]) for i, r in enumerate(base)] + [(100, [float(v) * 2.0**900 for v in base[0]]), (101, [float(v) * 3 for v in base[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in neighbours.nearest_neighbours(df).collect())
    plain = {i: np.array(v) / np.abs(v).max() for i, v in rows}
    cos = lambda a, b: float(plain[a] @ plain[b] / np.sqrt(plain[a] @ plain[a]) / np.sqrt(plain[b] @ plain[b]))
    want = []
    for q in (0, 50, 100):
        best = sorted(((round(-cos(q, v), 12), v) for v in plain if v != q))[:5]
        want += [(q, n, v, -c) for n, (c, v) in enumerate(best, 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("case", ["far from the origin", "one large component", "close clusters", "closest clusters"])
def test_neighbours_that_lie_close(spark, case):
    """Distances far below one part in 127 of the unit vectors are told apart."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 32))
    if case == "far from the origin":
        x += 30
    elif case == "one large component":
        x[:, 0] *= 200
    else:
        x = rng.normal(size=(3, 32))[np.arange(900) % 3] + x * (1e-3 if case == "close clusters" else 1e-6)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = ({(r.query_id, r.vec_id) for r in out.collect()} for out in (neighbours.nearest_neighbours(df), neighbours.brute_force(df)))
    assert len(got) == len(want) == 90 and len(got & want) >= 0.95 * len(want)


@pytest.mark.parametrize("n", [40, 5000])
def test_tree_cells(n):
    """Levels past what the sample can tell go on at the medians of the last cells; leaves stay near the size asked."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(20_000, 16)).astype(np.float32)
    for levels in neighbours.trees_of(x[:n], len(x), 2, 64):
        sizes = np.bincount(neighbours.cells_of(x, levels))
        assert len(levels) == 9 and len(sizes) <= 512 and np.sort(sizes)[-5] < 64 * 12


def test_descent_goes_on_until_settled(spark, monkeypatch):
    """With many leaves two rounds leave most lists unfinished."""
    monkeypatch.setattr(neighbours, "LEAF", 24)
    monkeypatch.setattr(neighbours, "TREES", 2)
    graphs, search = [], neighbours.search
    monkeypatch.setattr(neighbours, "search", lambda graph, *rest: (graphs.append(graph), search(graph, *rest))[1])
    x = np.random.default_rng(4).normal(size=(3000, 64))
    neighbours.nearest_neighbours(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    s = x @ x.T
    np.fill_diagonal(s, -1)
    best = np.argsort(-s, axis=1)[:, : neighbours.K]
    hit = sum(len(set(r.ids) & set(best[r.u].tolist())) for r in graphs[0].collect())
    assert hit >= 0.9 * best.size


def test_queries_against_sql(spark, sf):
    import compare

    con = compare.tables(sf)
    for name, sql in queries.oracle_sql().items():
        assert compare.difference(queries.queries()[name], sql, spark, sf, con) is None, name


def test_pipeline(spark, sf):
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs_.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs_ = shared.keep(stage(spark, docs_, sf), name)
        counts.append(docs_.count())
        if name != "packing":
            assert docs_.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "near_dedup":
            assert docs_.count() == docs_.select("doc_id").distinct().count()
    assert counts[0] > counts[1] > counts[2] == counts[3] and counts[4] == counts[5]


def test_pipeline_stages_on_odd_tables(spark, sf, table, empty):
    """Nulls, repeated rows, empty and long texts, clashing columns and an empty table, in each stage on its own."""
    odd = table.withColumns({n: F.lit("x") for n in ("events", "SCORE", "__uses", "__turn", "__kept", "bucket", "batch", "pattern")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
        out = stage(spark, odd, sf)
        if name == "packing":
            assert out.count() == odd.count()
            continue
        assert out.columns == odd.columns, name
        rows, left = collections.Counter(repr(r) for r in odd.collect()), collections.Counter(repr(r) for r in out.collect())
        if name in ("toxicity", "near_dedup"):
            assert left <= rows and left, name
        if name == "toxicity":
            assert left == rows
        if name == "near_dedup":
            assert {r.text for r in out.where("doc_id is null or length(trim(coalesce(text, ''))) = 0").collect()} >= {None, "", "   "}
        if name == "substring_dedup":
            assert out.count() == odd.count() and out.where("text is null").count() == odd.where("text is null").count()
        if name == "mixing":
            assert set(left) <= set(rows) and all(left[k] >= n for k, n in rows.items() if "text=None" in k or "text=''" in k)
