"""Items that appear together: heavy-light decomposition of pair counting.

The constants here choose routes, bounds of memory and block sizes. None changes a row of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import current_verses, read, staged, width
from .distinctive import CURRENT_SQL

#: An item is heavy in a version if it stands in more than one of HEAVY_SHARE records; the number of
#: heavy items is at most HEAVY_SHARE times a record's average number of items, and at most HEAVIEST.
HEAVY_SHARE, HEAVIEST = 400, 1024
#: Pairs that a task expands at a time.
BLOCK = 1 << 21
#: Versions whose counts a task holds at a time.
HELD = 4
#: Frequent items of all versions that are told to tasks; those of further versions go the way of light ones.
LISTED = 1 << 16
#: Bits of the map of items that are frequent enough: what it lets through by mistake costs time, no rows.
BITS = 1 << 23

#: Buckets a partition: a task adds up one at a time. Parts that an item's pairs are spread over.
BUCKETS, SPREAD = 4, 16

PAIRS = "version int, a bigint, b bigint, together bigint"
#: Pairs on their way: the first items, how many pairs each has, the second items, and the counts that
#: aren't 1 with their places.
PACKED = "bucket int, version int, firsts binary, runs binary, seconds binary, places binary, counts binary"


def _ragged_pairs(starts, lengths, most: int):
    """Blocks (i, j) of index arrays: all pairs i < j within each run of indices, at most about `most` at a time.

    Runs are [start, start + length). Position p of a run is paired with the positions after it.
    """
    import numpy as np

    firsts = np.repeat(starts, lengths) + _within(lengths)
    after = np.repeat(starts + lengths, lengths) - firsts - 1
    yield from _expand(firsts, firsts + 1, after, most)


def _expand(left, start, count, most: int):
    """Blocks (l, r): each l with r = start .. start + count - 1, in blocks of about `most` pairs."""
    import numpy as np

    ends = np.cumsum(count)
    total, at, row = int(ends[-1]) if len(ends) else 0, 0, 0
    while at < total:
        upto = max(row + 1, int(np.searchsorted(ends, at + most, "right")))
        n = count[row:upto]
        yield np.repeat(left[row:upto], n), np.repeat(start[row:upto], n) + _within(n)
        at, row = int(ends[upto - 1]), upto


def _within(lengths):
    """0 .. n - 1 for each n of lengths, one after the other."""
    import numpy as np

    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _packed(version, a, b, n, buckets: int) -> pa.RecordBatch:
    """Pairs sorted by a and b as a row a bucket."""
    import numpy as np

    mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(8)) + (b.astype(np.uint64) & np.uint64(SPREAD - 1))
    bucket = (mixed % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends, rows = np.cumsum(np.bincount(bucket, minlength=buckets)), []
    for k in range(buckets):
        mine = order[(ends[k - 1] if k else 0) : ends[k]]
        if len(mine):
            x, c = a[mine], n[mine]
            first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            more = np.flatnonzero(c != 1)
            runs = np.diff(np.append(first, len(x))).astype(np.uint32)
            rows.append((k, version, *(z.tobytes() for z in (x[first], runs, b[mine], more.astype(np.uint32), c[more]))))
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=[c.split()[0] for c in PACKED.split(", ")])


def _added(least: int):
    """Packed pairs sorted by bucket and version to (version, a, b, together) of those that reach `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def done(version, rows: list[dict]) -> Iterator[pa.RecordBatch]:
            read = lambda name, kind: [np.frombuffer(r[name], kind) for r in rows]
            a = np.concatenate([np.repeat(x, k) for x, k in zip(read("firsts", np.int64), read("runs", np.uint32))])
            b, n = np.concatenate(read("seconds", np.int64)), np.ones(len(a), np.int64)
            base = np.cumsum([0, *(len(r["seconds"]) // 8 for r in rows)])
            for at, place, count in zip(base, read("places", np.uint32), read("counts", np.int64)):
                n[at + place.astype(np.int64)] = count
            for x, y, k in _summed(a, b, n, least):
                yield pa.record_batch([pa.array([version] * len(x), pa.int32()), pa.array(x), pa.array(y), pa.array(k)], names=["version", "a", "b", "together"])

        key, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["bucket"], row["version"]) != key:
                    if held:
                        yield from done(key[1], held)
                    key, held = (row["bucket"], row["version"]), []
                held.append(row)
        if held:
            yield from done(key[1], held)

    return run


def _summed(a, b, n, least: int = 0):
    """The pairs with their sums, sorted by a and b, in blocks; those below `least` are left out."""
    import numpy as np

    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    total = np.add.reduceat(n, starts) if len(a) else n
    kept = np.flatnonzero(total >= least)
    for at in range(0, len(kept), 1 << 16):
        part = kept[at : at + (1 << 16)]
        yield a[starts[part]], b[starts[part]], total[part]


def _pair_counter(heavy: dict, there, held: int, buckets: int):
    """A mapInArrow function over (version, items) rows: the pair counts of its rows, packed.

    heavy: for a version, the sorted keys of the items that are heavy and of those left out. there: a
    broadcast bit map of the items that can be in a result at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bits = np.frombuffer(there.value, np.uint64)
        parts: dict = {}

        def out(v, blocks) -> Iterator[pa.RecordBatch]:
            for a, b, n in blocks:
                if len(a):
                    yield _packed(v, a, b, n, buckets)

        for batch in batches:
            version = batch.column(0)
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            group = version.dictionary_encode(null_encoding="encode")
            of_row = group.indices.to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            keep = _in_bits(bits, flat)
            rows, flat = rows[keep], flat[keep]
            for k, v in enumerate(group.dictionary.to_pylist()):
                if v not in parts and len(parts) >= held:
                    oldest = next(iter(parts))
                    yield from out(oldest, parts.pop(oldest).rest())
                mine = of_row[rows] == k
                part = parts.setdefault(v, _Counter(*heavy.get(v, (np.array([], np.int64),) * 2)))
                yield from out(v, part.add(rows[mine], flat[mine]))
        for v, part in parts.items():
            yield from out(v, part.rest())

    return run


def _in_bits(bits, keys):
    """Which keys have their bit in the map."""
    import numpy as np

    at = keys.astype(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _bit_map(keys: DataFrame) -> bytes:
    """The bit map of a column `key` of 64-bit hashes: BITS / 64 words at most come to the driver, whatever the data."""
    import numpy as np

    words = (
        keys.select(F.expr(f"key & {BITS - 1}L").alias("at"))
        .select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    out = np.zeros(BITS // 64, np.int64)
    for batch in words.toPandas().itertuples(index=False):
        out[batch.word] = batch.bits
    return out.tobytes()


class _Counter:
    """Counts of pairs of one version's items in a task.

    Heavy with heavy: popcounts of the intersections of bit rows. Mixed: for each light item of a
    record, its record's list of heavy items is probed. Light with light: pairs are hash-counted.
    Light and mixed pairs leave when a block of different ones is full, so that memory is bounded.
    """

    def __init__(self, heavy, omitted):
        import numpy as np

        self.heavy, self.omitted = heavy, omitted
        self.dense = np.zeros((len(heavy), len(heavy)), np.int64)
        self.waiting: list = []
        self.waits = 0

    def add(self, rows, items):
        """Counts the items of rows; yields blocks (a, b, n), a < b, that are full."""
        import numpy as np

        if len(self.omitted):
            keep = ~_in_sorted(self.omitted, items)
            rows, items = rows[keep], items[keep]
        if not len(items):
            return
        order = np.lexsort((items, rows))
        rows, items = rows[order], items[order]
        once = np.concatenate(([True], (rows[1:] != rows[:-1]) | (items[1:] != items[:-1])))
        rows, items = rows[once], items[once]
        rows = np.cumsum(np.concatenate(([0], rows[1:] != rows[:-1])))
        n = int(rows[-1]) + 1
        is_heavy = _in_sorted(self.heavy, items)
        hrow, hcol = rows[is_heavy], np.searchsorted(self.heavy, items[is_heavy])
        self._heavy_pairs(hrow, hcol, n)
        lrow, litem = rows[~is_heavy], items[~is_heavy]
        hcount = np.bincount(hrow, minlength=n)
        hstart = np.cumsum(hcount) - hcount
        for left, right in _expand(litem, hstart[lrow], hcount[lrow], BLOCK):
            other = self.heavy[hcol[right]]
            yield from self._wait(np.minimum(left, other), np.maximum(left, other))
        lcount = np.bincount(lrow, minlength=n)
        for left, right in _ragged_pairs(np.cumsum(lcount) - lcount, lcount, BLOCK):
            yield from self._wait(litem[left], litem[right])

    def _heavy_pairs(self, rows, cols, n: int) -> None:
        import numpy as np

        if len(self.heavy) < 2:
            return
        bits = np.zeros((len(self.heavy), -(-n // 64) * 64), np.uint8)
        bits[cols, rows] = 1
        words = np.packbits(bits, axis=1).view(np.uint64)
        for i in range(len(words) - 1):
            # only the words where item i stands at all
            there = np.flatnonzero(words[i])
            if len(there):
                self.dense[i, i + 1 :] += np.bitwise_count(words[i + 1 :, there] & words[i, there]).sum(axis=1, dtype=np.int64)

    def _wait(self, a, b):
        import numpy as np

        self.waiting.append((a, b, np.ones(len(a), np.int64)))
        self.waits += len(a)
        if self.waits > 2 * BLOCK:
            self._combine()
            if self.waits > BLOCK:
                yield from self.waiting
                self.waiting, self.waits = [], 0

    def _combine(self) -> None:
        """Equal pairs of what waits are added up; they are sorted then."""
        import numpy as np

        if self.waiting:
            blocks = list(_summed(*(np.concatenate(x) for x in zip(*self.waiting))))
            self.waiting = [tuple(np.concatenate(x) for x in zip(*blocks))]
            self.waits = len(self.waiting[0][0])

    def rest(self):
        """What hasn't come out yet, in blocks; a pair can come in several."""
        import numpy as np

        i, j = np.nonzero(self.dense)
        if len(i):
            yield self.heavy[i], self.heavy[j], self.dense[i, j]
        self._combine()
        yield from self.waiting


def _in_sorted(keys, values):
    import numpy as np

    if not len(keys):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return keys[at] == values


def pairs_together(records: DataFrame, least: int = 8, lift: float = 10.0) -> DataFrame:
    """(version, term_a, term_b, together, df_a, df_b, n, lift) of records (version, terms).

    Every two different terms, term_a < term_b by code point, that stand together in at least
    `least` records of a version, with together * n >= lift * df_a * df_b: at least `lift` times as
    often as chance has it. n counts all records of the version, those without terms too. Records
    with null terms count in n only. A term repeated in a record counts once.

    A term in more than n / lift records can be in no such pair (together is at most the smaller
    df), nor can one in fewer than `least`. Those are left out before any pair is formed: the former
    by a list of LISTED at most (further ones are left out at the end), the latter by
    a bit map of fixed size over the hashes of the others; nothing else is left out. Terms are
    64-bit hashes until the end.
    """
    records = staged(records.select("version", F.array_distinct("terms").alias("terms")))  # read three times
    size = records.groupBy(F.col("version").alias("version_n")).agg(F.count(F.lit(1)).alias("n"))
    keyed = records.where("terms is not null").select("version", "terms")
    df = staged(
        keyed.select("version", F.explode("terms").alias("term"))
        .groupBy("version", "term")
        .agg(F.count(F.lit(1)).alias("df"))
        .where(F.col("df") >= least)
        .withColumn("key", F.xxhash64("term"))
        .join(F.broadcast(size), F.col("version").eqNullSafe(F.col("version_n")))  # a row a version
        .drop("version_n")
    )
    frequent = df.where(F.col("df") * HEAVY_SHARE > F.col("n"))
    there = records.sparkSession.sparkContext.broadcast(_bit_map(df.where(F.col("df") * lift <= F.col("n"))))
    items = keyed.select("version", F.transform("terms", lambda t: F.xxhash64(t)).alias("items"))
    parts = width(records.sparkSession)
    packed = items.mapInArrow(_pair_counter(_heavy(frequent, lift), there, HELD, parts * BUCKETS), PACKED)
    by_bucket = packed.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket", "version")
    counted = by_bucket.mapInArrow(_added(least), PAIRS)

    def side(s: str) -> DataFrame:
        return df.select(
            F.col("version").alias(f"version_{s}"),
            F.col("key").alias(s),
            F.col("term").alias(f"term_{s}"),
            F.col("df").alias(f"df_{s}"),
            *([F.col("n")] if s == "a" else []),
        )

    joined = counted
    for s in "ab":
        joined = joined.join(side(s), s).where(F.col("version").eqNullSafe(F.col(f"version_{s}")))
    chance = F.col("df_a").cast("double") * F.col("df_b")
    swap = F.col("term_a") > F.col("term_b")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return joined.where(F.col("together") * F.col("n") >= lift * chance).select(
        "version",
        either("term_a", "term_b").alias("term_a"),
        either("term_b", "term_a").alias("term_b"),
        "together",
        either("df_a", "df_b").alias("df_a"),
        either("df_b", "df_a").alias("df_b"),
        "n",
        (F.col("together") * F.col("n") / chance).alias("lift"),
    )


def _heavy(frequent: DataFrame, lift: float) -> dict:
    """{version: (sorted keys of heavy items, sorted keys of left-out items)}: at most LISTED, of the largest versions."""
    import numpy as np

    by: dict = {}
    first = frequent.orderBy(F.desc("n"), "version", F.desc("df"), "key").limit(LISTED)
    for r in first.select("version", "key", "df", (F.col("df") * lift > F.col("n")).alias("out")).toLocalIterator():
        by.setdefault(r.version, ([], []))[r.out].append((-r.df, r.key))
    return {
        v: tuple(np.array(sorted(k for _, k in sorted(x)[: len(x) if out else HEAVIEST]), np.int64) for out, x in enumerate(both))
        for v, both in by.items()
    }


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    verses = current_verses(read(spark, sf_dir, "scoring_verses"))
    return pairs_together(verses.select(F.col("corpus_version_id").alias("version"), "terms")).select(
        F.col("version").alias("corpus_version_id"),
        "term_a",
        "term_b",
        "together",
        "df_a",
        "df_b",
        F.round("lift", 4).alias("lift"),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pairs(spark, sf_dir).select("corpus_version_id", "term_a", "term_b")


_PAIRS_SQL = f"""
with {CURRENT_SQL}, n as (
  select version, count(*) as n from cv group by version
), t as (
  select distinct verse_id, version, unnest(terms) as term from cv
), d as (
  select version, term, count(*) as df from t group by version, term
), k as (
  select t.*, df, n from t join d using (version, term) join n using (version) where df >= 8
), p as (
  select a.version, a.term as term_a, b.term as term_b, count(*) as together,
    any_value(a.df) as df_a, any_value(b.df) as df_b, any_value(a.n) as n
  from k a join k b on a.verse_id = b.verse_id and a.term < b.term group by a.version, a.term, b.term
)
"""

P5_PAIRS_SQL = f"""{_PAIRS_SQL}
select version as corpus_version_id, term_a, term_b, together, df_a, df_b,
  round(together * n / (cast(df_a as double) * df_b), 4) as lift
from p where together >= 8 and together * n >= 10 * df_a * df_b
"""

P5_SQL = f"""{_PAIRS_SQL}
select version as corpus_version_id, term_a, term_b from p where together >= 8 and together * n >= 10 * df_a * df_b
"""
