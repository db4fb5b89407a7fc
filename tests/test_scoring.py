import math
import random

import pytest
import regex

from spanloom.functions import pairs
from spanloom.functions.text import SENTENCE_END, TOKEN
from spanloom.plans.config import ScoringConfig, limit, stable_json
from spanloom.plans.errors import InvalidRequest

DF = {"a": 90, "gathered": 2, "word": 10, "is": 80, "kept": 8}


def verse(display, normalized=None, df=DF):
    found = list(regex.finditer(TOKEN, display))
    folded = [m[0].lower() for m in found]
    norm = normalized or folded
    starts = [k == 0 or bool(regex.search(SENTENCE_END, display[found[k - 1].end() : m.start()])) for k, m in enumerate(found)]
    return {"surface": [m[0] for m in found], "folded": folded, "normalized": norm, "df": [df.get(w, 100) for w in norm], "starts": starts}


def score(a, b, level="exact_spelling", na=None, nb=None, df=DF, threshold=5, **kw):
    config = ScoringConfig(level, token_multipliers=kw.pop("multipliers", {"a": 0}))
    return pairs.score_pair(verse(a, na, df), verse(b, nb, df), config, 100, threshold, **kw)


def test_identical():
    r = score("the gathered word", "the gathered word")
    assert r["components"]["jaccard"] == 1 and r["components"]["capitalization"] == 0.942751
    [p] = r["phrases"]
    assert (p["tokens"], p["level"]) == (["the", "gathered", "word"], "case_exact")
    assert r["reasons"] == ["shared_nonzero_token", "shared_exact_phrase"]


def test_sentence_start():
    r = score("Word is kept", "a word is kept")
    assert r["capitalization"][0]["multiplier"] == 0.25 and r["capitalization"][0]["reason"] == "different_only_sentence_start"
    assert r["phrases"][0]["level"] == "case_folded" and r["phrases"][0]["multiplier"] == 0.8


def test_levels():
    r = score("the Spirit", "the spirit", "letter_exact")
    assert r["matched_normalized"] == ["the"] and r["phrases"] == []
    r = score("Spirit", "Spirit", "letter_exact", df={"spirit": 2})
    assert r["components"]["jaccard"] == 1 and [t["document_frequency"] for t in r["rare_tokens"]] == [2]
    r = score("I shew thee", "I show thee", "normalized", ["i", "show", "thee"], ["i", "show", "thee"])
    assert [(p["level"], p["multiplier"]) for p in r["phrases"]] == [("normalized", 0.5)]


def test_weightless_words():
    r = score("a word", "a kept")
    assert r["components"]["jaccard"] == 0 and "a" in r["matched_normalized"] and r["reasons"] == []


def test_configuration():
    with pytest.raises(InvalidRequest):
        ScoringConfig(weights={"jaccard": 0.5})
    with pytest.raises(InvalidRequest):
        ScoringConfig(match_level="other")
    for bad in (0, -1, True, 1.5):
        with pytest.raises(InvalidRequest):
            limit(bad, 50)
    assert (limit(None, 50), limit(900, 50)) == (50, 500)
    assert ScoringConfig().sha256(1) == "15eef95ae377a030daca0c63a6fa7f909fdbb74b581c828bb0799cdc4e711f8d"
    assert stable_json({"b": 1.0, "a": [1, 2.5]}) == '{"a":[1,2.5],"b":1}'


def slow_phrases(a, b):
    """By trying every two places."""
    found = []
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= 2:
                found.append((n, i, j))
    found.sort(key=lambda r: (-r[0], r[1], r[2]))
    taken, ua, ub = [], set(), set()
    for n, i, j in found:
        if not any(x in ua for x in range(i, i + n)) and not any(x in ub for x in range(j, j + n)):
            ua |= set(range(i, i + n))
            ub |= set(range(j, j + n))
            taken.append((n, i, j))
    return sorted(taken, key=lambda r: r[1])


def slow_align(a, b, allowed):
    cursor, out = 0, []
    for i, t in enumerate(a):
        if t in allowed and t in b[cursor:]:
            j = b.index(t, cursor)
            out.append((i, j))
            cursor = j + 1
    return out


def test_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert pairs.disjoint(pairs.common_runs(a, b), lambda r: (-r[0], r[1], r[2])) == slow_phrases(a, b)
        allowed = set(rng.sample("abcd", 3))
        assert pairs.align(a, b, allowed) == slow_align(a, b, allowed)


def test_properties():
    rng = random.Random(6)
    for _ in range(100):
        x, y = (" ".join(rng.choice(["the", "word", "kept", "is", "Gathered"]) for _ in range(rng.randint(1, 9))) for _ in range(2))
        r, s = score(x, y, multipliers={}), score(y, x, multipliers={})
        assert math.isclose(r["components"]["jaccard"], s["components"]["jaccard"], abs_tol=2e-6)
        assert all(0 <= v <= 1 for v in r["components"].values()) and 0 <= r["score"] <= 0.95
        assert score(x, x, multipliers={})["components"]["jaccard"] == 1
