"""Encoding against the sentencepiece library, periodic runs and divergences against brute force; nulls, ties, repeated rows, empty tables, extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece

from curato.llm import divergence, pieces, queries, runs

DOCS = "doc_id long, text string, lang string, source string, ids int, n long, runs string, term string, slice int"


def docs(spark, rows):
    """Documents with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, 1, 2, "x", "y", 3) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def model():
    return queries.model()


@pytest.fixture(scope="module")
def known(model):
    with open(model, "rb") as f:
        return pieces.vocabulary(f.read())


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_file=model)


def test_compatibility_is_what_merging_gives(known):
    rng, ids = random.Random(1), list(known.spines)
    for _ in range(20_000):
        a, b = known.texts[x := rng.choice(ids)], known.texts[y := rng.choice(ids)]
        assert known.kept_apart(x, y) == ([t[0] for t in known.merged(a + b)] == [a, b])


def test_one_last_token_fits(known, library):
    """Of the pieces that end a prefix exactly one is compatible with the token before it."""
    for word in ("▁" * 40 + "indivisibilities", "▁aaaaaaaaaaab", "naïvetés", "▁the▁▁▁the"):
        last = {}
        for end in range(1, len(word) + 1):
            fit = [i for i, t in known.texts.items() if word[:end].endswith(t) and (end == len(t) or known.kept_apart(last[end - len(t)], i))]
            assert len(fit) == 1
            last[end] = fit[0]
        assert known.ids_of(word)[-1] == last[len(word)]


@pytest.mark.parametrize("letters", ["ab ", "  \n\te", "abcdefghijklmnopqrstuvwxyz  .,", "aàéß漢字😀 ▁<0x>s/²5.", "  aaaat", "0123 ab,;²_\x00\x7f"])
def test_encoding_equals_the_library(known, library, letters):
    rng, ids = random.Random(letters), list(known.spines)
    for n in range(3_000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(40))) if n % 2 else "".join(known.texts[rng.choice(ids)] for _ in range(rng.randrange(12))).replace("▁", rng.choice([" ", "▁", "  "]))
        assert known.encode(t).tolist() == library.encode(t, add_bos=True, add_eos=True)
        assert "".join(known.cut(t.replace(" ", "▁"))) == t.replace(" ", "▁")


def test_encoding_of_tables(spark, model, library, monkeypatch):
    monkeypatch.setattr(pieces, "LONGEST_KEPT", 8)
    texts = ["", None, " ", "one", "two  words\n", "x" * 30_000, "漢" * 500 + " 😀", "one", "▁", "naïve " * 2_000]
    table = docs(spark, [*((i, t, "en", "s") for i, t in enumerate(texts)), (3, "again", "en", "s"), (None, "none", "en", "s")])
    given = [*texts, "again", "none"]
    want = [(x := library.encode(t or "", add_bos=True, add_eos=True), library.decode(x)) for t in given]
    got = pieces.digest(table, model).collect()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(y.encode()).hexdigest()) for x, y in want)
    assert collections.Counter(r.doc_id for r in got) == collections.Counter([*range(len(texts)), 3, None])
    encoded = pieces.encode(table, model)
    assert sorted(r.ids for r in encoded.collect()) == sorted(x for x, _ in want)
    assert sorted(r.text for r in pieces.decode(encoded, model).collect()) == sorted(y for _, y in want)
    assert pieces.digest(table.limit(0), model).count() == pieces.encode(table.limit(0), model).count() == 0


def test_other_models_are_refused(model):
    with open(model, "rb") as f:
        raw = f.read()
    # one more piece that users defined: field 1, a message of a text and kind 4
    with pytest.raises(ValueError, match="user-defined"):
        pieces.Vocabulary(raw + bytes([10, 9, 10, 5]) + b"qq5qq" + bytes([24, pieces.USER_DEFINED]))


def all_runs(c):
    """By comparing all places for every period."""
    n, out = len(c), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and c[i] == c[i + q]:
                i += 1
            if i > s and i - s + q >= max(24, 3 * q):
                out.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, length, q) for (s, length), q in out.items())


@pytest.mark.parametrize("few", [0, 16])
@pytest.mark.parametrize("at_a_time", [5, 60, 1 << 19])
def test_runs_are_all_runs(monkeypatch, few, at_a_time):
    monkeypatch.setattr(runs, "FEW", few)
    monkeypatch.setattr(runs, "PROBES", at_a_time)
    monkeypatch.setattr(runs, "CHUNK", 3)
    rng, many = random.Random(at_a_time + few), 0
    for _ in range(250):
        c: list[int] = []
        while len(c) < rng.randrange(1, 220):
            base = [rng.randrange(rng.choice((1, 2, 3, 50))) for _ in range(rng.randrange(1, 22))]
            c += (base * rng.randrange(1, 9))[: rng.randrange(1, 110)]
        got = runs.find_runs(np.array(c))
        assert got == all_runs(c)
        many += len(got)
    assert many > 150
    assert runs.find_runs(np.zeros(0, int)) == [] and runs.find_runs(np.zeros(5000, int)) == [(0, 5000, 1)]


def test_runs_of_frequent_words_take_no_square():
    c = np.concatenate([np.r_[np.zeros(24, int), i + 1] for i in range(3000)])
    assert runs.find_runs(c) == [(25 * i, 24, 1) for i in range(3000)]


def told(doc_id, text):
    """A row of the digest by the definition."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else None
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_runs_of_tables(spark):
    rng = random.Random(4)
    texts = ["", None, " \t", "a " * 30, "a b " * 12, "a b c " * 9 + "c " * 40, "é x y\x0bz\n" * 10, "a b c d e f g h " * 3, "a " * 23, "a " * 24 + "b " * 24]
    texts += [" ".join(rng.choice("abcdefgh") + str(rng.randrange(4)) for _ in range(rng.randrange(400))) for _ in range(60)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, texts[4], "en", "s"), (None, texts[5], "en", "s")]
    got = sorted((tuple(r) for r in runs.digest(docs(spark, rows)).collect()), key=repr)
    assert got == sorted((told(i, t) for i, t, *_ in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 10 and any(r[0] and r[0] > 9 and r[1] for r in got)
    assert runs.digest(docs(spark, [])).count() == 0
    found = {r.doc_id: r for r in runs.runs_of(docs(spark, rows[:10])).collect()}
    assert found[3].collapsed == "a" and [tuple(x) for x in found[4].runs] == [(0, 24, 2)] and found[4].collapsed == "a b" and found[1].n_words == 0 and found[8].runs == []


def shares_told(rows):
    """Rows of the audit by the definition."""
    rows = [((t or ""), (lang or ""), (s or "")) for _, t, lang, s in rows]
    counts, holding = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for t, lang, s in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(divergence.TERM, t)]
        counts[lang, s].update(terms)
        holding[lang].update(set(terms))
    out = []
    for lang in {lang for lang, _ in counts}:
        kept = sorted(t for t, n in holding[lang].items() if n >= 10)
        sources = sorted(s for x, s in counts if x == lang)
        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(counts[lang, s]) for s in sources}, share(sum((counts[lang, s] for s in sources), collections.Counter()))
        for s in sources:
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 10)):
                out += [(lang, s, part, x, v, i) for i, (x, v) in enumerate(sorted(items, key=lambda r: (-r[1], r[0].encode()))[:most], 1)]
    return sorted(out)


def test_divergence(spark):
    rng = random.Random(9)
    words = ["The", "the", "über", "İx", "ZÉ", "can't", "x1y", "漢", "İ", "q😀"] + [f"{c}{d}" for c in "abcdefg" for d in "rstuv"]
    rows = [(i, rng.choice([" ", "-", "\x7f", "\x00"]).join(rng.choices(words, k=rng.randrange(40))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, ""])) for i in range(240)]
    rows += [(1, None, "en", "silent"), (1, "rare only", "fr", "a"), (2, "rare", "fr", "b"), (3, "", "it", "lonely")] + [(7, "the the über", "en", "b")] * 30
    got = sorted(tuple(r) for r in divergence.audit(docs(spark, rows)).collect())
    assert got == shares_told(rows)
    assert {r[2] for r in got} == {"pair", "term"} and ("fr", "a", "pair", "b", 0, 1) in got and not [r for r in got if r[0] == "it"] and any(r[1] == "silent" for r in got)
    assert divergence.audit(docs(spark, [])).collect() == []


def test_shares_are_exact_beyond_64_bits(spark):
    big = 9 * 10**15
    counts = spark.createDataFrame([("x", "a", "t", big, 20), ("x", "b", "t", 5, 20), ("x", "b", "u", 7, 20)], "lang string, source string, term string, n long, documents long")
    dense, _ = divergence.shares(counts.select("lang", "source").distinct(), counts)
    got = {(r.source, r.term): (r.n, r.p, r.lang_p) for r in dense.collect()}
    p = lambda n, total: 1 + 10**9 * (n + 2) // (total + 4)
    assert got == {("a", "t"): (big, p(big, big), p(big + 5, big + 12)), ("a", "u"): (0, p(0, big), p(7, big + 12)), ("b", "t"): (5, p(5, 12), p(big + 5, big + 12)), ("b", "u"): (7, p(7, 12), p(7, big + 12))}
