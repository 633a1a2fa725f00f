"""Disclosing terms against a plain count of who keeps whose company."""

import math
import random
from collections import defaultdict

import pytest

from cuemill.llm import pii

from . import helpers as h


def plain_terms(texts):
    """term -> disclosure, by loops over all pairs of entities and terms."""
    n, company, holders, words = len(texts), defaultdict(int), defaultdict(list), defaultdict(int)
    for t in texts:
        spans = pii.base_spans(t)
        own = pii._terms(t, spans)
        for w in own:
            words[w] += 1
        held = {(k, t[s:e].lower()) for k, s, e in spans} | {(k,) for k, _, _ in spans} | ({("any",)} if spans else set())
        for e in held:
            holders[e].append((t, own))
            for w in own:
                company[e, w] += 1
    out = {}
    for (e, w), both in company.items():
        rate, share = len(holders[e]) / n, both / words[w]
        distinct = {t: own for t, own in holders[e] if w in own}
        if len(distinct) < 3 or rate >= 1:
            continue
        score = 1 - math.log(share) / math.log(rate)
        if len(e) == 1:
            away = 1 - share
            divergence = share * math.log(share / rate) + (away * math.log(away / (1 - rate)) if away else 0.0)
            if score < pii.KIND_GENERALISE or share <= rate or len(distinct) / share * divergence < pii.EVIDENCE:
                continue
        elif score < pii.GENERALISE:
            continue
        lead = []  # documents of which no two are near copies
        for t in sorted(distinct, key=pii._fingerprint):
            if all(5 * (len(distinct[t] & o) - 1) < 2 * (len(distinct[t] | o) - 1) for o in lead):
                lead.append(distinct[t])
        if len(lead) >= 3:
            out[w] = max(out.get(w, 0.0), score)
    return out


def corpus(seed, n=240):
    """Texts of which some name a person or use a phrase where there is an address, some at random."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(500)]
    out = []
    for k in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(20, 60))]
        if k % 12 == 0:
            p = k // 12 % 4
            w.insert(r.randrange(len(w)), f"person{p}@corp.example")
            w.insert(r.randrange(len(w)), f"Nom{p}")
        elif k % 12 == 5:
            w.insert(r.randrange(len(w)), f"10.2.3.{k}")
        if k % 12 in (0, 5) and k % 5:
            w.insert(r.randrange(len(w)), "callsign")
        if k % 50 == 7:
            w.insert(0, "callsign")
        if k % 60 == 9:
            w.insert(3, f"Nom{r.randrange(4)}")
        out.append(" ".join(w))
    return out


def found(spark, texts):
    docs = h.frame(spark, [(k, t, "en", "s", 1, 1, "", "", "", 1) for k, t in enumerate(texts)])
    return {r.term: r.disclosure for r in pii.disclosing_terms(docs, pii.store(pii.find_base(docs), "t")).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_terms_equal_a_plain_count(spark, seed):
    texts = corpus(seed)
    want = plain_terms(texts)
    got = found(spark, texts)
    assert set(got) == set(want) and all(math.isclose(got[t], want[t], rel_tol=1e-9) for t in want)
    assert "callsign" in want  # a word that goes with personal data of any kind


def test_doubling_a_table_changes_no_span(spark):
    texts = corpus(3)
    once, twice = found(spark, texts), found(spark, texts * 2)
    assert set(once) == set(twice) and all(math.isclose(once[t], twice[t], rel_tol=1e-9) for t in once)


def test_recall_on_planted_terms(spark):
    """Names that stand only with one address are found wherever they stand without it; other words are left alone."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("klmnopqrst") for _ in range(r.randint(3, 7))) for _ in range(900)]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    texts = [say(40) for _ in range(900)]
    names = [f"{a}{b}" for a in ("zu", "ve", "wi", "xa") for b in ("bar", "cal", "den", "fog", "gim")]
    for name in names:
        for _ in range(4):
            texts.append(f"{say(15)} {name} {say(9)} {name}@corp.example {say(15)}")
    docs = h.frame(spark, [(k, t, "en", "s", 1, 1, "", "", "", 1) for k, t in enumerate(texts)])
    marked = {(x.id, t.start) for x in pii.find_spans(docs).collect() for t in x.terms}
    planted = {(k, t.index(f" {n} ") + 1) for k, t in enumerate(texts) for n in names if f" {n} " in t}
    assert len(marked & planted) >= 0.9 * len(planted) and len(marked - planted) <= 0.02 * sum(len(t.split()) for t in texts[900:])
    assert not any(k < 900 for k, _ in marked)
