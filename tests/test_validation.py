"""Answer validation on made answers, with parts worked out by hand, and entity linking against a plain loop."""

import random
import re

import pytest

from curato.operators import validation as va

ENDS = "aid long, cid long, head string, relation string, tail string, evidence_ids array<string>"
BANK = "aid long, eid string, head string, relation string, tail string"


@pytest.fixture(scope="module")
def made(spark):
    claims = [
        (1, 1, " gene  a", "binds", "gene b", ["E1"]), (1, 2, "gene a", "blocks", "gene b", ["E1", "E9"]), (1, 3, "gene a", "Needs_more_context_for", "x", None),
        (1, 4, "gene z", "binds", "gene b", ["E1"]), (1, 5, "", "binds", "gene b", ["E1"]), (1, 6, "gene a", "binds", "gene b", [" "]),
        (2, 1, "p", "is context", None, []), (3, 1, "p", "is context", None, ["E1"]), (4, 1, "p", "r", "q", ["E1"]),
    ]
    bank = [(1, "E1", "gene a", "binds", "gene  b"), (1, "E2", "gene a", "", "gene c"), (4, "E1", "p", "r", "q")]
    allowed = [(1, "gene a"), (1, "gene b"), (2, " "), (5, "only")]
    answers = [(1, "gene a", ["Species", "species ", "phenotype", "regulation", "colour"]), (2, None, None), (3, "nobody", []), (4, "p", list(va.ASPECTS)), (5, "p", []), (6, "p", None)]
    edges = [("gene a", "r", "gene b"), ("gene  a", "s", "gene b"), ("gene a", "r", "gene c"), ("gene a", "r", "gene d"), ("p", "r", "q")]
    tables = [(answers, "aid long, centre string, aspects array<string>"), (claims, ENDS), (bank, BANK), (allowed, "aid long, entity string"), (edges, "src string, rel string, dst string")]
    return [spark.createDataFrame(rows, schema) for rows, schema in tables]


def test_statuses(made):
    got = {(r.aid, r.cid): r.status for r in va.judged_claims(*made[1:4]).collect()}
    assert got == {
        (1, 1): "supported", (1, 2): "unsupported", (1, 3): "meta", (1, 4): "invalid_entity", (1, 5): "bad_claim_format", (1, 6): "missing_evidence", (2, 1): "meta",
        (3, 1): "bad_claim_format", (4, 1): "supported",
    }


def test_parts(made):
    got = {r.aid: r for r in va.validate(*made).collect()}
    one = got[1]
    assert (one.aspect_count, one.entity, one.support) == (3, pytest.approx(1 - 2 / 11), pytest.approx(1.5 / 6))
    # E9 is missing and one claim cites nothing, of two cited ids and that claim
    assert one.referenced == pytest.approx(1 - 2 / 3) and one.overlap == pytest.approx(2 * 1 / 3)
    raw = 0.3 * 2 / 6 + 0.15 * min(1, 1 / 2 * 1.5) + 0.25 * 0.25 + 0.15 * 2 / 3 + 0.15 * (1 - 2 / 3)
    assert one.information == pytest.approx(raw * (1 - 0.35 / 6)) and not one.passed
    assert one.confidence == pytest.approx(0.4 * 0.25 + 0.22 / 3 + 0.16 * (1 - 2 / 11) + 0.08 * 2 / 3 + 0.14 * one.information)
    assert (got[2].entity, got[2].overlap, got[2].support, got[2].referenced, got[2].aspect_count) == (0.8, 0.7, 0.5, 1.0, 0)
    assert (got[3].support, got[3].referenced) == (0.0, 0.0)
    assert got[4].passed and got[4].level == "high" and got[4].overlap == 1.0
    assert (got[5].entity, got[5].support, got[6].entity) == (0.5, 0.5, 0.8) and len(got) == 6


def test_empty_tables(made):
    assert va.validate(made[0].limit(0), *made[1:]).count() == 0
    alone = va.validate(made[0], *[t.limit(0) for t in made[1:]]).collect()
    assert len(alone) == 6 and {(r.entity, r.overlap, r.support, r.referenced) for r in alone} == {(0.8, 0.7, 0.5, 1.0)}


def test_links_take_the_longest_alias_from_the_left(spark):
    rng = random.Random(6)
    alias = {"a": 1, "a b": 2, "b c d": 3, "c": 4, "d a": 5, "β-x": 6, "a b c": 7}
    texts = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(["a", "B", "c", "d", "e", "β-x"], k=rng.randrange(30)))) for i in range(60)] + [(98, None), (99, "")]
    want = set()
    for i, t in texts:
        words, at = re.findall(r"[\w()-]+", (t or "").lower()), 0
        while at < len(words):
            n = next((n for n in (3, 2, 1) if at + n <= len(words) and " ".join(words[at : at + n]) in alias), 0)
            if n:
                want.add((i, alias[" ".join(words[at : at + n])], at))
            at += max(1, n)
    got = va.link_entities(spark.createDataFrame(texts, "aid long, text string"), spark.createDataFrame(list(alias.items()), "alias string, id long"), 3).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100
