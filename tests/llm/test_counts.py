"""Current verses, term counts, distinctive terms and top N against brute force."""

import math
import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spanloom.llm import common, distinctive, term_counts, topn

VERSES = "verse_id bigint, corpus_version_id int, tokens array<struct<position: int, folded: string>>, normalized_tokens array<string>, loaded_at timestamp, extra string"
AT = [datetime(2031, 1, k + 1) for k in range(9)]


def test_current_verses(spark):
    rows = [
        (1, 1, None, ["Old"], AT[0], "x"),
        (1, 1, None, [" New’s ", None, "B"], AT[1], "y"),
        (1, 1, None, [" New’s ", None, "B"], AT[1], "y"),
        (2, 1, [(0, "From’Tokens")], None, None, None),
        (3, 2, None, None, AT[0], None),
        (None, 2, None, ["lost"], AT[0], None),
        (4, None, None, [], AT[0], None),
        (5, 1, None, ["null is oldest"], None, None),
        (5, 1, None, ["newer"], AT[0], None),
    ]
    got = {r.verse_id: (r.corpus_version_id, r.terms) for r in common.current_verses(spark.createDataFrame(rows, VERSES)).collect()}
    assert got == {1: (1, ["new's", "b"]), 2: (1, ["from'tokens"]), 3: (2, []), 4: (None, []), 5: (1, ["newer"])}
    assert common.current_verses(spark.createDataFrame([], VERSES)).count() == 0


def records(seed, n=300):
    rng = random.Random(seed)
    words = ["", "a", "ab", "abc", *("prefix" * 20 + str(k) for k in range(40)), *(f"w{k}" for k in range(60)), "ü", "日本"]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [(rng.choice([1, 2, None]), rng.choices(words, weights, k=rng.randint(0, 12))) for _ in range(n)] + [(1, None), (7, [])]


@pytest.mark.parametrize("capacity", [2, 5, 1024])
def test_term_counts(spark, monkeypatch, capacity):
    monkeypatch.setattr(term_counts, "CONTAINER", capacity)
    rows = records(capacity)
    tf, df = Counter(), Counter()
    for v, terms in rows:
        tf.update((v, t) for t in terms or [])
        df.update((v, t) for t in set(terms or []))
    got = term_counts.term_counts(spark.createDataFrame(rows, "version int, terms array<string>").repartition(5)).collect()
    assert {(r.version, r.term): (r.tf, r.df) for r in got} == {k: (tf[k], df[k]) for k in tf}
    assert len(got) == len(tf)


def test_trie_bursts():
    trie = term_counts.BurstTrie(3)
    words = ["", "a", "aa", "aaa", "aaaa", "ab", "b", "a" * 3000, "a" * 3001]
    for w in words * 2:
        trie.add(w, 2, 1)
    assert {p + s: tuple(e) for p, leaf in trie.leaves() for s, e in leaf.items()} == {w: (4, 2) for w in words}


def test_marks(spark):
    rows = [(k, 1, ["the", f"r{k}"] if k < 8 else ["the", "mid", "mid"]) for k in range(12)] + [(50, 2, ["only"]), (51, 3, [])]
    df = spark.createDataFrame(rows, "verse_id bigint, corpus_version_id int, terms array<string>")
    got = {(r.corpus_version_id, r.normalized): (r.total_frequency, r.document_frequency, r.rare, r.common) for r in term_counts.marked_counts(df).collect()}
    assert got[1, "the"] == (12, 12, False, True) and got[1, "mid"] == (8, 4, False, True) and got[1, "r0"] == (1, 1, True, False)
    assert got[2, "only"] == (1, 1, True, True) and len(got) == 11
    assert term_counts.marked_counts(df.limit(0)).count() == 0


def test_distinctive(spark):
    rows = [(k, 1 if k % 3 else None, terms or []) for k, (_, terms) in enumerate(records(3))]
    df = spark.createDataFrame(rows, "verse_id bigint, corpus_version_id int, terms array<string>")
    got = {(r.verse_id, r.term): r for r in distinctive.scored_terms(df).collect()}
    n = Counter(v for _, v, _ in rows)
    total = Counter()
    column, frequency = Counter(), Counter()
    for _, v, terms in rows:
        total[v] += len(terms)
        column.update((v, t) for t in terms)
        frequency.update((v, t) for t in set(terms))
    assert set(got) == {(k, t) for k, _, terms in rows for t in terms}
    for k, v, terms in rows:
        for t, tf in Counter(terms).items():
            r = got[k, t]
            assert (r.tf, r.df) == (tf, frequency[v, t])
            assert r.score == pytest.approx((1 + math.log(tf)) * (math.log((n[v] + 1) / (frequency[v, t] + 1)) + 1), abs=1e-6)
            e = len(terms) * column[v, t] / total[v]
            var = e * (1 - len(terms) / total[v]) * (1 - column[v, t] / total[v])
            assert r.residual == pytest.approx((tf - e) / math.sqrt(var))
    first = distinctive.first_terms(distinctive.scored_terms(df), F.col("score"), 3)
    for k, _, terms in rows:
        want = sorted(set(terms), key=lambda t: (-got[k, t].score, t.encode()))[:3]
        assert [r.term for r in first.where(F.col("verse_id") == k).orderBy("rank").collect()] == want if k < 12 else True


def test_single_term_has_no_residual(spark):
    df = spark.createDataFrame([(1, 1, ["x", "x"])], "verse_id bigint, corpus_version_id int, terms array<string>")
    assert distinctive.scored_terms(df).first().residual is None


@pytest.mark.parametrize("n", [0, 1, 3, 1000])
def test_top_n(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["hot"] * 6 + ["b", None, ""]), rng.choice([0.5, 1.0, 2.0, None]), k, "c") for k in range(900)]
    df = spark.createDataFrame(rows, "g string, score double, k int, last string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = topn.top_n(df, "g", [F.col("score").desc_nulls_last(), F.col("k").asc()], n).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for g in ("hot", "b", None, ""):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want += mine[:n]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_best_targets(spark):
    books = spark.createDataFrame([(1, "1 Able"), (2, "Baker")], "book_order int, name string")
    nan = float("nan")
    rows = [
        ("q", "1 Able 2:10", 0.5, AT[0]), ("q", "1 Able 2:9", 0.5, AT[0]), ("q", "Baker 1:1", 0.5, AT[0]), ("q", "1 Able 10:1", 0.5, AT[0]),
        ("q", "Baker 1:2", 0.1, AT[0]), ("q", "Baker 1:2", 0.9, AT[1]), ("q", "Baker 1:3", 0.9, AT[0]), ("q", "Baker 1:3", nan, AT[1]),
        ("q", "Baker 1:4", None, AT[3]), ("q", "Baker 1:4", 0.9, AT[2]), ("q", "nowhere", 0.5, AT[0]), ("r", "Baker 1:1", -1.0, None), ("r", "Baker 1:1", -1.0, None),
    ]
    df = spark.createDataFrame(rows, "query_reference string, target_reference string, score double, scored_at timestamp")
    got = {}
    for r in topn.best_targets(df, books, 5).orderBy("query_reference").collect():
        got.setdefault(r.query_reference, set()).add(r.target_reference)
    assert got == {"q": {"Baker 1:2", "1 Able 2:9", "1 Able 2:10", "1 Able 10:1", "Baker 1:1"}, "r": {"Baker 1:1"}}


def test_full_tries_leave():
    """However few terms a task holds, the leaves that leave add up to all counts."""
    import pyarrow as pa

    from spanloom.llm import term_counts

    rng = random.Random(4)
    rows = [(rng.choice([1, 2]), [f"t{rng.randrange(300)}" for _ in range(rng.randint(0, 20))]) for _ in range(400)]
    batches = [
        pa.record_batch([pa.array([v for v, _ in part], pa.int32()), pa.array([t for _, t in part], pa.list_(pa.string()))], names=["version", "terms"])
        for part in (rows[k : k + 40] for k in range(0, 400, 40))
    ]
    want: dict = {}
    for v, terms in rows:
        for t in terms:
            want.setdefault((v, t), [0, 0])[0] += 1
        for t in set(terms):
            want[v, t][1] += 1
    for held in (10, 1 << 19):
        got: dict = {}
        for leaf in (r for b in term_counts._count(iter(batches), held) for r in b.to_pylist()):
            for term, tf, df in zip(leaf["terms"], leaf["tf"], leaf["df"]):
                entry = got.setdefault((leaf["version"], leaf["prefix"] + term), [0, 0])
                entry[0] += tf
                entry[1] += df
        assert got == want
