"""Whole-table searches: pairs come out of the scan that finds them, and are what single pairs give."""

import random
import re

import pyarrow as pa
import pytest

from spanloom.functions import blocks, pairs
from spanloom.operators import many
from spanloom.operators.related import rank_key
from spanloom.plans import registry
from spanloom.plans.config import ScoringConfig

SF = "/root/testdata/sf0.001"
SCANS = ["every_phrase_runs", "every_related_candidates", "every_related_rare", "every_match_level_letter_exact", "every_related_jaccard", "every_match_level_normalized", "every_weighted_dice", "every_related_filtered"]
#: Windows over what is left of a ranking are no joins.
RANKED = ["every_lexical_witnesses", "every_related_many", "every_candidate_mates", "every_related_full"]


@pytest.mark.parametrize("name", SCANS)
def test_pairs_are_not_shuffled(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and not re.search("Join|Aggregate|Window|Sort|Repartition", above)


@pytest.mark.parametrize("name", RANKED)
def test_rankings_meet_nothing_again(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan.split("MapInArrow")[0]


def test_spelled_phrases_of_versions_read_verses_only(spark):
    found = registry.queries()["exact_phrase_spelled_of_versions"](spark, SF)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.where("times < 1").count() == 0


def test_places_are_crossed_last(spark):
    plan = registry.queries()["every_proximity_axes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert re.search(r"Join (Cross|Inner), NOT \(id", joins[0]) and "Window" not in plan.split(joins[0])[0]


TEXTS = ["a b c a b c d", "", "b c a b", "a a a a", "a a", "d c b a", "x", "a b c d a b c d a b c", "c a b c", "q a b q b c"]


def batch(texts):
    rows = [{"id": k, "words": t.split()} for k, t in enumerate(texts)]
    return pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.int64()), ("words", pa.list_(pa.string()))]))


@pytest.mark.parametrize("least", [2, 3, 4])
def test_runs_of_a_block(least):
    block = blocks.Block(batch(TEXTS), "words")
    grams = blocks.Grams(block, least)
    for source in [*TEXTS, "z a b c z", "z"]:
        start, at, length = grams.runs(block.numbered(source.split()))
        got = sorted(zip(block.row[at].tolist(), length.tolist(), start.tolist(), (at - block.first[block.row[at]]).tolist()))
        a, want = source.split(), []
        for k, text in enumerate(TEXTS):
            b = text.split()
            inner = lambda i, j: i and j and a[i - 1] == b[j - 1]  # noqa: E731, B023
            want += [(k, n, i, j) for n, i, j in pairs.common_runs(a, b, least) if not inner(i, j)]
        assert got == sorted(want)


def test_an_empty_block():
    for texts in ([], [""]):
        block = blocks.Block(batch(texts), "words")
        assert not len(block.rows[block.of("a")]) and not len(blocks.Grams(block, 3).runs(block.numbered(["a", "b", "c"]))[0])


FEATURES = pa.schema([("id", pa.int64()), *((c, pa.list_(pa.string())) for c in ("surface", "folded", "normalized")), ("df", pa.list_(pa.int64())), ("starts", pa.list_(pa.bool_()))])


def verses(n, seed=3):
    """Feature rows of random verses of few words, some of them nearly equal."""
    r, rows = random.Random(seed), []
    forms = [f"w{k}" for k in range(30)] + ["it's", "it’s"]
    for k in range(n):
        length = r.choice((0, 1, 4, 9, 20))
        t = [w for w in rows[-1]["folded"] if r.random() < 0.9] if rows and r.random() < 0.3 else [forms[int(len(forms) * r.random() ** 3)] for _ in range(length)]
        surface = [w.title() if r.random() < 0.2 else w for w in t]
        norm = [w.replace("’", "'") for w in t]
        rows.append({"id": k, "surface": surface, "folded": t, "normalized": norm, "df": [3 + hash_of(w) for w in norm], "starts": [i == 0 or r.random() < 0.1 for i in range(len(t))]})
    return rows


def hash_of(word):
    return sum(map(ord, word)) % 40


@pytest.mark.parametrize("level", ["letter_exact", "exact_spelling", "normalized"])
@pytest.mark.parametrize("multipliers", [{}, {"w0": 0, "w1": 2.5, "it's": 0.5}])
def test_first_targets_are_those_of_all_scored_pairs(level, multipliers, monkeypatch):
    config = ScoringConfig(level, token_multipliers=multipliers)
    rows, layer = verses(240), many.LAYER[level]
    monkeypatch.setattr(blocks, "CELLS", 400)
    chosen = [0]
    monkeypatch.setattr(many.pairs, "common_phrases", lambda *a, f=pairs.common_phrases: chosen.__setitem__(0, chosen[0] + 1) or f(*a))
    for keep in (1, 7, 500):
        ranking, bare = many.Ranking(config, 240, 8, keep), many.Ranking(config, 240, 8, keep, evidence=False)
        chosen[0] = 0
        for k in range(0, 240, 60):
            for one in (bare, ranking):
                one.block(pa.RecordBatch.from_pylist(rows[k : k + 60], FEATURES))
                for source in rows[::20]:
                    one.meet(source)
        assert keep == 500 or chosen[0] < 2 * 12 * 239  # not every pair is scored
        for source in rows[::20]:
            met = [(t["id"], pairs.score_pair(source, t, config, 240, 8)) for t in rows if t is not source and set(t[layer]) & set(source[layer])]
            want = sorted(met, key=lambda x: rank_key(x[1], x[0]), reverse=True)[:keep]
            assert ranking.found(source) == want
            assert bare.found(source) == [(k, {"score": x["score"]}) for k, x in want]
