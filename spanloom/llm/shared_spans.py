"""Long exact spans shared between records: compact windows over the min-hashes of token grams.

A record's grams of GRAM tokens are hashed. For a window of W = least - GRAM + 1 grams (least tokens)
the gram of least hash, the leftmost of equal ones, is its signature. All windows with the signature
at place c form one compact window (c, l, r): l and r are the ends of c's subtree in the Cartesian
tree of the hashes. Records that share a span of `least` tokens share its windows' grams, so their
signatures agree at matching places: one hash is enough for verbatim spans. Compact windows of equal
signature are joined where, laid upon each other, they overlap by W grams or more, and the diagonals
found are compared token by token.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import current_verses, read, staged
from .distinctive import CURRENT_SQL
from .similar_sets import _chunks, mix

#: Tokens a gram. The fewer, the fewer and the less selective the windows; 10 of 12 leaves three a window.
GRAM = 10


def compact_windows(sizes, items, gram: int, least: int):
    """(row, key, c, l, r) of the compact windows of at least `least` tokens of each row's items."""
    import numpy as np

    rows = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    n = len(items) - gram + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 5
    h, g = mix(items), np.zeros(n, np.uint64)
    for k in range(gram):
        g = mix(g * np.uint64(3) + h[k : n + k])
    inside = rows[:n] == rows[gram - 1 :]
    at, g = np.flatnonzero(inside), g[inside]  # the grams, and where they start
    row = rows[at]
    # Cartesian tree: the nearest gram before that is as small, and after that is smaller, in the row
    m = len(g)
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if m else np.zeros(0, np.int64)
    length = np.diff(np.append(first, m))
    lo, hi = np.repeat(first, length), np.repeat(first + length, length)
    before, after = np.arange(m) - 1, np.arange(m) + 1
    live = np.arange(m)
    while len(live):
        p = before[live]
        on = p >= lo[live]
        live, p = live[on], p[on]
        on = g[p] > g[live]
        live, p = live[on], p[on]
        before[live] = before[p]
    live = np.arange(m)
    while len(live):
        p = after[live]
        on = p < hi[live]
        live, p = live[on], p[on]
        on = g[p] >= g[live]
        live, p = live[on], p[on]
        after[live] = after[p]
    before, after = np.maximum(before, lo - 1), np.minimum(after, hi)
    wide = np.flatnonzero(after - before - 1 >= least - gram + 1)
    place = at - starts[row] if m else at
    return row[wide], g[wide].view(np.int64), place[wide], place[before[wide] + 1], place[after[wide] - 1]


def _windows(gram: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sizes = np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64)
            items = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            for lo, hi in _chunks(sizes):
                upto = int(sizes[:lo].sum())
                part = sizes[lo:hi]
                row, key, c, left, right = compact_windows(part, items[upto : upto + int(part.sum())], gram, least)
                yield pa.record_batch(
                    [pa.array(key), pa.array(ids[lo:hi][row]), *(pa.array(x.astype(np.int32)) for x in (c, left, right))],
                    names=["key", "id", "c", "l", "r"],
                )

    return run


def _runs(least: int):
    """Rows (id_a, id_b, shift, terms_a, terms_b) to the maximal runs of equal terms, b's place being a's + shift."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                a, b, d = r["terms_a"], r["terms_b"], r["shift"]
                start = max(0, -d)
                n = min(len(a) - start, len(b) - start - d)
                same = np.fromiter((x == y for x, y in zip(a[start : start + n], b[start + d : start + d + n])), bool, n)
                edge = np.diff(np.concatenate(([0], same.view(np.int8), [0])))
                for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                    if e - s >= least:
                        out.append((r["id_a"], r["id_b"], start + s, start + s + d, e - s))
            columns = zip(*out) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["id_a", "id_b", "start_a", "start_b", "n_tokens"]
            )

    return run


def text_classes(records: DataFrame) -> DataFrame:
    """records (id, terms) with a key that equal lists of terms share."""
    return records.where("size(terms) > 0").withColumn("key", F.md5(F.to_json("terms")))


def text_lists(keyed: DataFrame, least: int) -> DataFrame:
    """(key, id, terms): a row a class of equal lists of `least` terms or more, with its least id."""
    return keyed.where(F.size("terms") >= least).groupBy("key").agg(F.min("id").alias("id"), F.min("terms").alias("terms"))


def list_windows(lists: DataFrame, least: int, gram: int) -> DataFrame:
    """(key, id, c, l, r): the compact windows of lists."""
    return lists.select("id", F.transform("terms", lambda x: F.xxhash64(x)).alias("items")).mapInArrow(
        _windows(gram, least), "key bigint, id bigint, c int, l int, r int"
    )


def class_runs(keyed: DataFrame, least: int, gram: int) -> DataFrame:
    """(key_a, key_b, start_a, start_b, n_tokens): the runs between different lists of terms, each
    pair of lists in one order, and those of a list with itself, off its main diagonal, once."""
    lists = text_lists(keyed, least)
    windows = list_windows(lists, least, gram)
    a, b = (windows.withColumnsRenamed({x: f"{x}_{s}" for x in ("id", "c", "l", "r")}) for s in "ab")
    shift = F.col("c_b") - F.col("c_a")
    first, last = F.greatest(F.col("l_a"), F.col("l_b") - shift), F.least(F.col("r_a"), F.col("r_b") - shift)
    once = (F.col("id_a") < F.col("id_b")) | ((F.col("id_a") == F.col("id_b")) & (F.col("c_a") < F.col("c_b")))
    diagonals = (
        a.join(b, "key")
        .where(once & (last - first >= least - gram))
        .select("id_a", "id_b", shift.alias("shift"))
        .distinct()
    )
    for s in "ab":
        diagonals = diagonals.join(lists.select(F.col("id").alias(f"id_{s}"), F.col("terms").alias(f"terms_{s}")), f"id_{s}")
    found = diagonals.select("id_a", "id_b", "shift", "terms_a", "terms_b").mapInArrow(
        _runs(least), "id_a bigint, id_b bigint, start_a int, start_b int, n_tokens int"
    )
    for s in "ab":
        found = found.join(lists.select(F.col("id").alias(f"id_{s}"), F.col("key").alias(f"key_{s}")), f"id_{s}")
    return found.select("key_a", "key_b", "start_a", "start_b", "n_tokens")


def shared_runs(records: DataFrame, least: int = 12, gram: int = GRAM) -> DataFrame:
    """(id_a, id_b, start_a, start_b, n_tokens), id_a < id_b, of records (id, terms): every run of at
    least `least` equal terms, extendable at neither end, that starts at start_a in a and start_b in b.

    Overlapping runs are rows of their own. Records with null or fewer terms have none; ids are
    distinct. least is at least gram. Equal lists are one class while runs are searched, so copies
    cost nothing there; at the end runs between classes are joined with their members.
    """
    keyed = staged(text_classes(records))  # read by every join below
    runs = class_runs(keyed, least, gram)
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(F.size("terms")).alias("n"))
    twins = sizes.where((F.col("copies") > 1) & (F.col("n") >= least)).select(
        F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit(0).alias("start_a"), F.lit(0).alias("start_b"), F.col("n").alias("n_tokens")
    )
    members = keyed.select("key", "id")
    links = runs.unionByName(twins)
    for s in "ab":
        links = links.join(members.select(F.col("key").alias(f"key_{s}"), F.col("id").alias(f"id_{s}")), f"key_{s}")
    # within a class every two members meet twice: for a run off the main diagonal, once each way
    kept = links.where(
        (F.col("id_a") != F.col("id_b"))
        & ((F.col("key_a") != F.col("key_b")) | (F.col("start_a") != F.col("start_b")) | (F.col("id_a") < F.col("id_b")))
    )
    swap = F.col("id_a") > F.col("id_b")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return kept.select(
        *(either(f"{x}_a", f"{x}_b").alias(f"{x}_a") for x in ("id", "start")),
        *(either(f"{x}_b", f"{x}_a").alias(f"{x}_b") for x in ("id", "start")),
        "n_tokens",
    )


def _starts(gram: int, least: int):
    """Rows (id, items, windows) to (h, g, id, start): 128 bits over each span of `least` items that a window holds."""
    width = least - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            hashes: list = [[], []]
            ids, starts = [], []
            for row in batch.to_pylist():
                at = np.unique(
                    np.concatenate([np.arange(max(w["l"], w["c"] - width + 1), min(w["c"], w["r"] - width + 1) + 1) for w in row["windows"]])
                )
                items = np.array(row["items"], np.int64)
                for k, out in enumerate(hashes):
                    h, g = mix(items ^ np.int64(k * 0x5851F42D4C957F2D)), np.zeros(len(at), np.uint64)
                    for n in range(least):
                        g = mix(g * np.uint64(3) + h[at + n])
                    out.append(g.view(np.int64))
                ids.append(np.full(len(at), row["id"], np.int64))
                starts.append(at.astype(np.int32))
            kinds = (np.int64, np.int64, np.int64, np.int32)
            columns = [np.concatenate([np.zeros(0, kind), *x]) for x, kind in zip((*hashes, ids, starts), kinds)]
            for k in range(0, max(1, len(columns[0])), 1 << 16):
                yield pa.record_batch([pa.array(c[k : k + (1 << 16)]) for c in columns], names=["h", "g", "id", "start"])

    return run


def shared_starts(keyed: DataFrame, least: int, gram: int) -> DataFrame:
    """(key, start): where spans of `least` terms start that stand in another list too; linear in the terms.

    A span lies in one compact window of its list, and in one of the same signature wherever else it
    stands. Windows whose signature only one list has are left out; the spans of the others are
    counted by 128 bits of hash, never met in pairs.
    """
    lists = text_lists(keyed, least)
    items = F.transform("terms", lambda x: F.xxhash64(x)).alias("items")
    windows = list_windows(lists, least, gram)
    several = lambda df, *by: df.groupBy(*by).agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select(*by)
    kept = windows.join(several(windows, "key"), "key", "left_semi").groupBy("id").agg(F.collect_list(F.struct("c", "l", "r")).alias("windows"))
    spans = staged(lists.select("id", items).join(kept, "id").mapInArrow(_starts(gram, least), "h bigint, g bigint, id bigint, start int"))
    starts = spans.join(several(spans, "h", "g"), ["h", "g"], "left_semi")
    return starts.join(lists.select("id", "key"), "id").select("key", "start")


def shared_coverage(records: DataFrame, least: int = 12, gram: int = GRAM) -> DataFrame:
    """(id, n_tokens, n_shared, share): how many of a record's terms lie in runs shared with other records.

    Every record with terms has a row, share 0 where nothing is shared. A list with copies is shared
    whole if it is long enough; of the others, spans that stand elsewhere are united. Lists are never
    met in pairs, so that a formula in very many of them costs no more than its places.
    """
    keyed = staged(text_classes(records))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(F.size("terms")).alias("n"))
    spans = shared_starts(keyed, least, gram).select("key", "start", F.lit(least).alias("n_tokens"))
    whole = sizes.where((F.col("copies") > 1) & (F.col("n") >= least)).select("key", F.lit(0).alias("start"), F.col("n").alias("n_tokens"))
    places = (
        spans.unionByName(whole)
        .groupBy("key", "start")
        .agg(F.max("n_tokens").alias("n_tokens"))  # at most a row a term of the list
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("n_tokens")).alias("end")))).alias("spans"))
    )
    united = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc.upto, x.end).alias("upto"),
            (acc.n + F.greatest(F.lit(0), x.end - F.greatest(acc.upto, x.start))).alias("n"),
        ),
        lambda acc: acc.n,
    )
    shared = places.select("key", united.alias("n_shared"))
    return keyed.join(shared, "key", "left").select(
        "id",
        F.size("terms").alias("n_tokens"),
        F.coalesce("n_shared", F.lit(0)).alias("n_shared"),
        (F.coalesce("n_shared", F.lit(0)) / F.size("terms")).alias("share"),
    )


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_verses(read(spark, sf_dir, "scoring_verses")).select(F.col("verse_id").alias("id"), "terms")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_runs(_records(spark, sf_dir)).withColumnsRenamed({"id_a": "verse_a", "id_b": "verse_b"})


def p6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each current verse with terms is shared elsewhere."""
    return shared_coverage(_records(spark, sf_dir)).select(
        F.col("id").alias("verse_id"), "n_tokens", "n_shared", F.round("share", 6).alias("share")
    )


_RUNS_SQL = f"""
with {CURRENT_SQL}, w as (
  select verse_id, i - 1 as at, array_to_string(list_slice(terms, i, i + 11), '\x1f') as gram
  from cv, unnest(range(1, greatest(1, len(terms) - 10))) as u(i)
), m as (
  select a.verse_id as verse_a, b.verse_id as verse_b, a.at as at_a, b.at as at_b, b.at - a.at as shift
  from w a join w b on a.gram = b.gram and a.verse_id < b.verse_id
), g as (
  select *, at_a - row_number() over (partition by verse_a, verse_b, shift order by at_a) as island from m
), runs as (
  select verse_a, verse_b, min(at_a) as start_a, min(at_b) as start_b, count(*) + 11 as n_tokens
  from g group by verse_a, verse_b, shift, island
)
"""

P6_SQL = f"""{_RUNS_SQL}
select * from runs
"""

P6_COVERAGE_SQL = f"""{_RUNS_SQL}, p as (
  select distinct verse_id, unnest(range(s, s + n_tokens)) as at from (
    select verse_a as verse_id, start_a as s, n_tokens from runs union all select verse_b, start_b, n_tokens from runs)
), k as (
  select verse_id, count(*) as n_shared from p group by verse_id
)
select verse_id, len(terms) as n_tokens, coalesce(n_shared, 0) as n_shared, round(coalesce(n_shared, 0) / len(terms), 6) as share
from cv left join k using (verse_id) where len(terms) > 0
"""
