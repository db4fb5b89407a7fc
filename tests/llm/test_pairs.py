"""Set pairs, spans and co-occurrence against brute force on small and awkward records."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from spanloom.llm import cooccurrence, shared_spans, similar_sets

RECORDS = "id bigint, terms array<string>"


def sets_of(rng, n, universe=40, most=14):
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.4:  # a changed copy of an earlier one
            base = list(rng.choice(rows)[1] or [])
            for _ in range(rng.randint(0, 2)):
                if base and rng.random() < 0.5:
                    base.pop(rng.randrange(len(base)))
                else:
                    base.append(f"t{rng.randrange(universe)}")
        else:
            base = [f"t{rng.randrange(universe)}" for _ in range(rng.randint(0, most))]
        rows.append((k, base))
    return rows


def brute_sets(rows, t):
    out = set()
    for (i, a), (j, b) in combinations(sorted((k, set(v)) for k, v in rows if v), 2):
        if len(a & b) >= t * len(a | b):
            out.add((i, j))
    return out


@pytest.mark.parametrize("seed, t, hot, large, many, levels", [(1, 0.75, 96, 4096, 24, 3), (2, 0.75, 3, 4, 2, 1), (3, 0.6, 16, 40, 24, 2), (4, 0.9, 12, 30, 4, 3)])
def test_similar_pairs(spark, monkeypatch, seed, t, hot, large, many, levels):
    for name, size in (("HOT", hot), ("LARGE", large), ("MANY", many), ("LEVELS", levels)):
        monkeypatch.setattr(similar_sets, name, size)
    rows = sets_of(random.Random(seed), 220)
    rows += [(900, None), (901, []), (902, ["x"]), (903, ["x", "x"]), (904, ["t1"] * 50)]
    got = similar_sets.similar_pairs(spark.createDataFrame(rows, RECORDS), t).collect()
    assert {(r.id_a, r.id_b) for r in got} == brute_sets(rows, t)
    assert len(got) == len({(r.id_a, r.id_b) for r in got}) and (902, 903) in {(r.id_a, r.id_b) for r in got}


def test_a_key_of_a_hundred_thousand_entries():
    """No task holds a hot key's entries: they leave at once, and a mark goes to the key's bucket."""
    import numpy as np
    import pyarrow as pa

    rng, n = np.random.default_rng(3), 100_000
    # twelve items each, all of one of four segments: the other three are empty in every record
    h = rng.integers(0, 1 << 62, 40 * n)
    h = h[(similar_sets.mix(h) >> np.uint64(8)) % np.uint64(4) == 0][: 12 * n // 2]
    n = len(h) // 12
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 12 * n + 1, 12), pa.int32()), pa.array(h[: 12 * n]))
    batch = pa.record_batch([pa.array(np.arange(n)), pa.array(np.zeros(n, np.int64)), lists], names=["id", "group", "items"])
    by_key, by_record = (list(similar_sets._first(0.75, 0, 8, hot, similar_sets.MANY)([batch])) for hot in (False, True))
    entries = lambda blocks, width: sum(len(k) // width for b in blocks for k in b.column("keys").to_pylist())
    assert n > 40_000 and entries(by_record, 8) > 3 * n
    rows = [r for b in by_key for r in b.to_pylist()]
    most = 0
    for bucket in range(8):
        key, *_, marks = similar_sets._read([r for r in rows if r["bucket"] == bucket])
        most = max(most, int(np.unique(key, return_counts=True)[1].max()))
        assert not np.isin(key, marks).any() or most <= similar_sets.MANY * len(by_key)
    assert most <= similar_sets.MANY * len(by_key)


def test_groups_of_the_second_round_stay_small_where_all_share_common_items():
    """Verses have common words by the dozen: groups of two hot keys grow with the table, those of a hot key and a rare item don't."""
    import numpy as np
    import pyarrow as pa

    rng, n, buckets = np.random.default_rng(5), 3000, 8
    pool = rng.integers(0, 1 << 62, 20)
    sets = [np.concatenate((rng.permutation(pool)[:17], rng.integers(0, 1 << 62, 7))) for _ in range(n)]
    sets.append(np.concatenate((sets[0][:-2], rng.integers(0, 1 << 62, 2))))  # 22 of 26 items are shared
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 24 * n + 25, 24), pa.int32()), pa.array(np.concatenate(sets)))
    batch = pa.record_batch([pa.array(np.arange(n + 1)), pa.array(np.zeros(n + 1, np.int64)), lists], names=["id", "group", "items"])
    common = np.sort(pool), np.full(20, n, np.int32), np.sort(similar_sets._lower_half(similar_sets.mix(pool)))

    def by_bucket(blocks):
        rows = [r for b in blocks for r in b.select(similar_sets._BLOCK_NAMES).to_pylist() if r["bucket"] is not None]
        return [pa.RecordBatch.from_pylist(sorted(rows, key=lambda r: r["bucket"]), schema=blocks[0].select(similar_sets._BLOCK_NAMES).schema)]

    by_key, by_record = (list(similar_sets._first(0.75, 0, buckets, hot, 24, common)([batch])) for hot in (False, True))
    found = list(similar_sets._matched(0.75, buckets, hot=96)(by_bucket(by_key)))
    told = by_bucket([*by_record, *(b.select(similar_sets._BLOCK_NAMES) for b in found)])
    twice = list(similar_sets._second(0.75, buckets, 2048, common[2])(told))
    again = list(similar_sets._matched(0.75, buckets, large=4096)(by_bucket(twice)))
    groups = Counter()
    for row in by_bucket(twice)[0].to_pylist():
        groups.update((row["bucket"], k) for k in np.frombuffer(row["keys"], np.uint32).tolist())
    assert len(groups) > 10 * n and max(groups.values()) <= 24
    pairs = {(r["id_a"], r["id_b"]) for b in [*found, *again] for r in b.to_pylist() if r["id_b"] is not None}
    assert (0, n) in pairs


@pytest.mark.parametrize("sample, listed, often", [(50, 1 << 16, 10), (50_000, 3, 1000), (1, 0, 1000)])
def test_order_of_items_changes_no_pair(spark, monkeypatch, sample, listed, often):
    for name, size in (("HOT", 3), ("MANY", 4), ("SAMPLE", sample), ("LISTED", listed), ("OFTEN", often)):
        monkeypatch.setattr(similar_sets, name, size)
    rows = sets_of(random.Random(11), 250, universe=60, most=20)
    got = {(r.id_a, r.id_b) for r in similar_sets.similar_pairs(spark.createDataFrame(rows, RECORDS)).collect()}
    assert got == brute_sets(rows, 0.75)


def test_classes_with_links(spark):
    rows = sets_of(random.Random(8), 150, universe=15, most=6)
    links = Counter(x for pair in brute_sets(rows, 0.75) for x in pair)
    got = {r.id: (r["class"], r.links) for r in similar_sets.similar_classes(spark.createDataFrame(rows, RECORDS)).collect()}
    first = {}
    for k, v in rows:
        first.setdefault(frozenset(v), k)
    assert got == {k: (first[frozenset(v)], links[k]) for k, v in rows if v}


def test_long_sets_and_copies(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(3000)]
    rows = [(1, base), (2, base[:2300]), (3, base[:2200]), *((10 + k, ["a", "b", "c", "d"]) for k in range(30)), (99, ["a", "b", "c"])]
    rng.shuffle(rows)
    got = {(r.id_a, r.id_b) for r in similar_sets.similar_pairs(spark.createDataFrame(rows, RECORDS)).collect()}
    assert got == brute_sets(rows, 0.75)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], RECORDS)
    assert similar_sets.similar_pairs(empty).count() == 0
    assert shared_spans.shared_runs(empty).count() == 0 and shared_spans.shared_coverage(empty).count() == 0
    assert cooccurrence.pairs_together(spark.createDataFrame([], "version int, terms array<string>")).count() == 0


def brute_runs(rows, least):
    out = set()
    for (i, a), (j, b) in combinations(sorted((k, v) for k, v in rows if v), 2):
        for x in range(len(a)):
            for y in range(len(b)):
                if x and y and a[x - 1] == b[y - 1]:
                    continue
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                    n += 1
                if n >= least:
                    out.add((i, j, x, y, n))
    return out


@pytest.mark.parametrize("seed, least, gram", [(1, 4, 3), (2, 4, 4), (3, 12, 10), (4, 6, 1), (5, 3, 2)])
def test_shared_runs(spark, seed, least, gram):
    rng = random.Random(seed)
    rows = []
    for k in range(60):
        base = [rng.choice("abc" if seed != 3 else "abcdefgh") for _ in range(rng.randint(0, 30))]
        if rows and rng.random() < 0.5:
            other = rng.choice(rows)[1] or []
            base = base[:5] + other[rng.randint(0, 3) :][: rng.randint(5, 30)] + base[5:8]
        rows.append((k, base))
    rows += [(70, rows[3][1]), (71, rows[3][1]), (72, None), (73, ["a"] * 20), (74, ["a"] * 20)]
    df = spark.createDataFrame(rows, RECORDS)
    got = [tuple(r[c] for c in ("id_a", "id_b", "start_a", "start_b", "n_tokens")) for r in shared_spans.shared_runs(df, least, gram).collect()]
    want = brute_runs(rows, least)
    assert set(got) == want and len(got) == len(want)
    covered = {k: set() for k, v in rows if v}
    for i, j, x, y, n in want:
        covered[i] |= set(range(x, x + n))
        covered[j] |= set(range(y, y + n))
    coverage = {r.id: (r.n_tokens, r.n_shared) for r in shared_spans.shared_coverage(df, least, gram).collect()}
    assert coverage == {k: (len(v), len(covered[k])) for k, v in rows if v}


def brute_together(rows, least, lift):
    out = {}
    for version in {v for v, _ in rows}:
        sets = [set(t or []) for v, t in rows if v == version]
        df = Counter(x for s in sets for x in s)
        both = Counter(p for s in sets for p in combinations(sorted(s), 2))
        for (a, b), c in both.items():
            if c >= least and c * len(sets) >= lift * df[a] * df[b]:
                out[version, a, b] = c
    return out


@pytest.mark.parametrize("seed, least, lift, heaviest", [(1, 2, 1.5, 1024), (2, 3, 1.0, 5), (3, 2, 2.0, 0), (4, 8, 10.0, 1024)])
def test_together(spark, monkeypatch, seed, least, lift, heaviest):
    monkeypatch.setattr(cooccurrence, "HEAVIEST", heaviest)
    monkeypatch.setattr(cooccurrence, "BLOCK", 64)
    rng = random.Random(seed)
    weights = [1 / (k + 1) for k in range(30)]
    rows = [(rng.choice([1, 2, None]), [f"t{k}" for k in rng.choices(range(30), weights, k=rng.randint(0, 9))]) for _ in range(400)]
    rows += [(1, None), (1, []), *[(2, ["rare1", "rare2", "rare1"])] * 9]
    got = cooccurrence.pairs_together(spark.createDataFrame(rows, "version int, terms array<string>"), least, lift).collect()
    assert {(r.version, r.term_a, r.term_b): r.together for r in got} == brute_together(rows, least, lift)


@pytest.mark.parametrize("name, size", [("HELD", 1), ("LISTED", 2), ("BITS", 64), ("HEAVY_SHARE", 2), ("HEAVY_SHARE", 100_000)])
def test_routes_change_no_pair(spark, monkeypatch, name, size):
    monkeypatch.setattr(cooccurrence, name, size)
    monkeypatch.setattr(cooccurrence, "BLOCK", 32)
    rng = random.Random(6)
    weights = [1 / (k + 1) for k in range(40)]
    rows = [(rng.choice([1, 2, 3, None]), [f"t{k}" for k in rng.choices(range(40), weights, k=rng.randint(0, 12))]) for _ in range(500)]
    got = cooccurrence.pairs_together(spark.createDataFrame(rows, "version int, terms array<string>"), 3, 1.2).collect()
    assert {(r.version, r.term_a, r.term_b): r.together for r in got} == brute_together(rows, 3, 1.2)


def test_light_pairs_leave_when_a_block_is_full(monkeypatch):
    import numpy as np

    monkeypatch.setattr(cooccurrence, "BLOCK", 1000)
    counter, most, total = cooccurrence._Counter(np.array([], np.int64), np.array([], np.int64)), 0, 0
    for k in range(50):
        blocks = list(counter.add(np.repeat(np.arange(4), 60), np.arange(k * 240, (k + 1) * 240)))
        total += sum(int(n.sum()) for _, _, n in blocks)
        most = max(most, counter.waits)
    assert most <= 3000 + 60 * 30 and total + sum(int(n.sum()) for _, _, n in counter.rest()) == 50 * 4 * 60 * 59 // 2


def test_lift(spark):
    rows = [(1, ["x", "y"])] * 8 + [(1, ["z"])] * 92
    [r] = cooccurrence.pairs_together(spark.createDataFrame(rows, "version int, terms array<string>")).select("*", F.round("lift", 4).alias("l")).collect()
    assert (r.term_a, r.term_b, r.together, r.df_a, r.n, r.l) == ("x", "y", 8, 8, 100, 12.5)
