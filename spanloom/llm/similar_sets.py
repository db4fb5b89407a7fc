"""All similar pairs of set-valued records: pigeonhole partitioning with one-deletion signatures.

Two sets of s <= l items with Jaccard similarity t or more differ in at most
H = (s + l) (1 - t) / (1 + t) items. The universe of items is split into m segments by a hash, m
depending on a class of lengths. Were fewer than two segments of such a pair to differ in one item
or none, the others would differ in two or more: 2 (m - 1) > H if m >= H / 2 + 2 (rounded down), a
contradiction; so at least two segments of a similar pair agree but for at most one item, that is,
the segment of one, whole or less one item, equals the whole segment of the other. Each segment is
therefore a group key, whole and with each one of its items deleted.

A key that many records share (a segment that is empty, or holds only very common items) is hot.
Its group isn't enumerated: each record joins each of its hot keys with each of its rarest items. Of s
items these are the s - ceil(s t) + 1 first in an order that is the same everywhere: two sets with
similarity t share one of them, the first in that order of all that they share. The more records there
are, the more keys are hot and the larger two hot keys' group is; a rare item's stays small. The order
is that of counts in a sample, which any other order could replace.

What is large even then is split again by another hash of the items, within the group: its pairs agree
in two of the new segments as well. There hot keys are joined two by two, of different segments, as the
rarest items may be what the group shares: a pair with a key that isn't hot is found by that one, and
any other has two hot keys in different segments. After LEVELS such levels groups that are still large
are cut into parts, and every two parts are a task of bounded size.

No task gets a hot key's entries: where a block of records has many of them, they go to their
records at once, or to the next level, and only a mark that the key is hot goes to the key's task.
Which keys are taken for hot decides the way of a pair, not whether it is found: any key may be.

Between the candidates and the exact check stands a test without false negatives: the bits by which
two sets' parity sketches differ are at most the number of items in which the sets differ.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import current_verses, read, staged, width
from .cooccurrence import _expand, _ragged_pairs, _within
from .distinctive import CURRENT_SQL

#: A group of more entries is hot in the first round; one of more in the second is split anew.
#: Entries of one key in a block of records beyond which it is taken for such without being counted.
HOT, LARGE, MANY = 96, 4096, 24
#: Records in the sample that items are ordered by, and items whose counts in it are told to tasks.
SAMPLE, LISTED = 50_000, 1 << 16
#: An item in more than one of OFTEN records of the sample has its groups spread over all buckets; those of a rarer one share a bucket.
OFTEN = 1000
#: How often groups are split anew before they are cut into parts.
LEVELS = 2
#: Buckets a partition: a task holds one at a time, in the compact form in which it is shuffled.
BUCKETS = 4
#: Entries of a batch that are written in one block a bucket; pairs tested at a time.
BLOCK = 1 << 20
#: The blocks that are shuffled: 32 bits of the key (the bucket has the others), and for each entry
#: twice the place of its record in the block's table of records, plus 1 if an item is deleted; and
#: the keys of the bucket that are known to be hot. Blocks by record have whole keys and no such marks;
#: those of rarest items have no keys, and 32 bits of each item for marks.
BLOCKS = "bucket int, keys binary, refs binary, ids binary, sketches binary, sizes binary, marks binary"
#: A pair, or a record and the group that it is to be split in, or a block.
FOUND = f"id_a bigint, id_b bigint, `group` bigint, {BLOCKS}"


def differ(s, l, t: float):
    """In how many items sets of s and l items with similarity t can differ."""
    import numpy as np

    return np.floor((s + l) * ((1 - t) / (1 + t)) + 1e-9).astype(np.int64)


@cache
def classes(t: float, most: int):
    """Arrays (first length of each class, number of segments of each class), up to length `most`.

    A class's segments serve the pairs whose smaller set is in it. Lengths grow by 1 / t a class, so
    that a set of s items has its partners' classes between that of t s and its own: two or so.
    """
    import numpy as np

    first = [1]
    while first[-1] <= most:
        first.append(max(first[-1] + 1, math.floor(first[-1] / t)))
    lows = np.array(first[:-1], np.int64)
    last = np.array(first[1:], np.int64) - 1
    return lows, differ(last, np.floor(last / t + 1e-9), t) // 2 + 2


def mix(x):
    """A bijective scrambling of 64-bit integers."""
    import numpy as np

    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signed(t: float, level: int):
    """Sizes, items and groups of records to entries (key, record, deleted) and the records' sketches."""
    import numpy as np

    def run(sizes, items, groups):
        h = mix(items ^ np.int64(level * 0x2545F4914F6CDD1D)) if level else mix(items)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        bit = np.left_shift(np.uint64(1), h & np.uint64(63))
        starts = np.cumsum(sizes) - sizes
        sketch = np.bitwise_xor.reduceat(bit, starts)
        lows, segments = classes(t, int(sizes.max()))
        own = np.searchsorted(lows, sizes, "right") - 1
        low = np.searchsorted(lows, np.maximum(1, np.ceil(sizes * t - 1e-9)), "right") - 1
        levels = own - low + 1
        # an occurrence: a record at a level
        orec = np.repeat(np.arange(len(sizes)), levels)
        olev = np.repeat(low, levels) + _within(levels)
        om = segments[olev]
        obase = np.cumsum(om) - om  # the place of an occurrence's segment 0
        # items of each occurrence
        n = sizes[orec]
        take = np.repeat(starts[orec], n) + _within(n)
        occ = np.repeat(np.arange(len(orec)), n)
        seg = ((h[take] >> np.uint64(8)) % om[occ].astype(np.uint64)).astype(np.int64)
        place = obase[occ] + seg
        value = mix(h[take] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        # a segment's signature is the sum of its items' values: a deletion subtracts one
        order = np.argsort(place, kind="stable")
        total = np.zeros(int(om.sum()), np.uint64)
        if len(order):
            at = place[order]
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            total[at[first]] = np.add.reduceat(value[order], first)
        which = np.repeat(olev, om).astype(np.uint64) << np.uint64(32) | _within(om).astype(np.uint64)
        salt = mix(which + np.uint64(1)) ^ groups.view(np.uint64)[np.repeat(orec, om)]
        key = np.concatenate((mix(total ^ salt), mix((total[place] - value) ^ salt[place])))
        record = np.concatenate((np.repeat(orec, om), orec[occ]))
        deleted = np.zeros(len(key), bool)
        deleted[len(total) :] = True
        return key, record, deleted, sketch

    return run


def _write(key, ref, ids, sketch, size, buckets: int, marks=None) -> pa.RecordBatch:
    """Entries in a block a bucket; only the records that a block names are in its table."""
    import numpy as np

    split = lambda k: ((k >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    # the bucket has the remainder of the upper half, the block the quotient's and lower half's bits mixed
    marks = np.zeros(0, np.uint64) if marks is None else marks
    return _blocks(split(key), _lower_half(key), ref, ids, sketch, size, buckets, split(marks), _lower_half(marks))


def _blocks(bucket, key, ref, ids, sketch, size, buckets: int, of_mark=None, marks=None) -> pa.RecordBatch:
    """A row a bucket that has entries or marks, made without a loop over buckets: there are more of them the larger the input."""
    import numpy as np

    code = bucket * len(ids) + (ref >> 1)
    order = np.argsort(code, kind="stable")
    code, bucket, ref = code[order], bucket[order], ref[order]
    new = np.append(True, code[1:] != code[:-1])[: len(code)]
    used = ref[new] >> 1
    in_table = np.bincount(bucket[new], minlength=buckets)
    place = np.cumsum(new) - 1 - (np.cumsum(in_table) - in_table)[bucket]
    entries = np.bincount(bucket, minlength=buckets)
    if marks is None:
        of_mark, marks = np.zeros(0, np.int64), np.zeros(0, np.uint32)
    marked = np.bincount(of_mark, minlength=buckets)
    columns = [
        (key[order], entries),
        ((place << 1 | ref & 1).astype(np.uint32), entries),
        (ids[used], in_table),
        (sketch[used], in_table),
        (size[used].astype(np.int32), in_table),
        (marks[np.argsort(of_mark, kind="stable")], marked),
    ]
    return _rows(np.flatnonzero(entries + marked), columns)


def _rows(names, columns) -> pa.RecordBatch:
    """Rows of the buckets of these names; columns: values in the order of buckets, and how many each bucket has."""
    import numpy as np

    made = [pa.array(names.astype(np.int32))]
    for values, counts in columns:
        ends = np.append(0, np.cumsum(counts[names]) * values.itemsize).astype(np.int32)
        made.append(pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]))
    return pa.record_batch(made, names=_BLOCK_NAMES)


def _lower_half(key):
    import numpy as np

    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _whole(low, bucket):
    """The key of a group in one number: the 32 bits that blocks have of it, and its bucket's."""
    import numpy as np

    return low.astype(np.uint64) << np.uint64(32) | np.uint64(bucket)


def _read(rows: list[dict]):
    """(key, record, deleted, ids, sketches, sizes, marks) of blocks of one bucket."""
    import numpy as np

    from_ = lambda name, kind: [np.frombuffer(r[name], kind) for r in rows]
    ids, refs = from_("ids", np.int64), from_("refs", np.uint32)
    base = np.cumsum([0, *(len(x) for x in ids)])
    ref = np.concatenate([r.astype(np.int64) + 2 * b for r, b in zip(refs, base)])
    return (
        np.concatenate(from_("keys", np.uint32)).astype(np.uint64),
        ref >> 1,
        (ref & 1).astype(bool),
        np.concatenate(ids),
        np.concatenate(from_("sketches", np.uint64)),
        np.concatenate(from_("sizes", np.int32)).astype(np.int64),
        np.unique(np.concatenate(from_("marks", np.uint32))).astype(np.uint64),
    )


_BLOCK_NAMES = ["bucket", "keys", "refs", "ids", "sketches", "sizes", "marks"]
_FOUND_NAMES = ["id_a", "id_b", "group", *_BLOCK_NAMES]


def _found_blocks(blocks: pa.RecordBatch) -> pa.RecordBatch:
    return pa.record_batch([pa.nulls(len(blocks), pa.int64())] * 3 + blocks.columns, names=_FOUND_NAMES)


def _no_blocks(a, b, group) -> pa.RecordBatch:
    none = [pa.nulls(len(a), pa.int32()), *(pa.nulls(len(a), pa.binary()) for _ in _BLOCK_NAMES[1:])]
    return pa.record_batch([pa.array(a), b, group, *none], names=_FOUND_NAMES)


def _pairs_batch(a, b) -> pa.RecordBatch:
    return _no_blocks(a, pa.array(b), pa.nulls(len(a), pa.int64()))


def _members(ids, group) -> pa.RecordBatch:
    """Records that are to be split anew within their groups."""
    import numpy as np

    both = np.unique(np.stack((ids, group.view(np.int64)), 1), axis=0)
    return _no_blocks(both[:, 0], pa.nulls(len(both), pa.int64()), pa.array(both[:, 1]))


def _many(key, most: int):
    """The keys that stand more than `most` times among these, ascending; and whether each entry has one."""
    import numpy as np

    names, place, counts = np.unique(key, return_inverse=True, return_counts=True)
    return names[counts > most], (counts > most)[place]


def _first(t: float, level: int, buckets: int, hot: bool, many: int, common=None):
    """(id, group, items) rows to blocks of the first round: of hot entries by record, or of the others by key.

    With common, what _common gives, records' rarest items come out beside the hot entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        sign = _signed(t, level)
        for batch in batches:
            ids, groups = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            sizes = np.diff(batch.column(2).offsets.to_numpy()).astype(np.int64)
            items = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            for lo, hi in _chunks(sizes):
                upto = int(sizes[:lo].sum())
                part = sizes[lo:hi]
                key, record, deleted, sketch = sign(part, items[upto : upto + int(part.sum())], groups[lo:hi])
                marks, is_hot = _many(key, many)
                keep = is_hot if hot else ~is_hot
                key, record, deleted = key[keep], record[keep], deleted[keep]
                if hot:
                    whole = _whole(_lower_half(key), 0) | (key >> np.uint64(32)) % np.uint64(buckets)
                    yield _hot_blocks(whole, record, deleted, ids[lo:hi], sketch, part, buckets)
                    if common:
                        yield _rarest(t, ids[lo:hi], part, items[upto : upto + int(part.sum())], sketch, common, buckets)
                else:
                    yield _write(key, record << 1 | deleted, ids[lo:hi], sketch, part, buckets, marks)

    return run


def _common(records: DataFrame):
    """(items, counts, often): the items that stand more than once in a sample of the records, ascending, the most
    frequent LISTED at most; often has the 32 bits of those in more than one of OFTEN records, ascending."""
    import numpy as np

    total = records.count()
    step = total // SAMPLE + 1
    sample = records.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select(F.explode("items").alias("item"))
    counted = sample.groupBy("item").count().where("count > 1").orderBy(F.desc("count"), "item").limit(LISTED).toArrow()
    items, counts = (counted[c].to_numpy() for c in ("item", "count"))
    order = np.argsort(items)
    often = np.sort(_lower_half(mix(items[counts * OFTEN > total // step])))
    return items[order], counts[order].astype(np.int32), often


def _prefix(sizes, t: float):
    """How many of a set's rarest items there are of which it shares one with any similar set."""
    import numpy as np

    return sizes - np.ceil(sizes * t - 1e-9).astype(np.int64) + 1


def _rarest(t: float, ids, sizes, items, sketch, common, buckets: int) -> pa.RecordBatch:
    """The rarest items of records, in blocks by record."""
    import numpy as np

    listed, counts, _ = common
    bucket = (mix(ids) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    row = np.empty(len(ids), np.int64)
    row[order] = np.arange(len(ids))
    count = np.zeros(len(items), np.int32)
    if len(listed):
        at = np.minimum(np.searchsorted(listed, items), len(listed) - 1)
        count = np.where(listed[at] == items, counts[at], 0)
    h = mix(items)
    by = np.lexsort((h, count, np.repeat(row, sizes)))
    first, per = _prefix(sizes[order], t), np.bincount(bucket, minlength=buckets)
    rarest = _lower_half(h[by][_within(sizes[order]) < np.repeat(first, sizes[order])])
    none = np.zeros(buckets, np.int64)
    marks = np.bincount(bucket[order], weights=first, minlength=buckets).astype(np.int64)
    nothing = np.zeros(0, np.uint32)
    return _rows(
        np.flatnonzero(per),
        [(nothing, none), (nothing, none), (ids[order], per), (sketch[order], per), (sizes[order].astype(np.int32), per), (rarest, marks)],
    )


def _chunks(sizes):
    """Ranges of rows of about BLOCK / 8 items each."""
    import numpy as np

    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + BLOCK // 8, "right")))
        yield lo, hi
        lo = hi


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each bucket, of batches sorted by bucket."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _matched(t: float, buckets: int, hot: int | None = None, large: int | None = None, cut: bool = False):
    """Blocks sorted by bucket to pairs, and to the entries of groups larger than `hot` or `large`, or marked so.

    The hot ones come out in blocks by record. Large groups' records come out with the group that they
    are to be split in; if they are to be cut, they are cut into parts, and every two parts get a key
    of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for rows in _by_bucket(batches):
            key, record, deleted, ids, sketch, size, marks = _read(rows)
            bucket = rows[0]["bucket"]
            if not len(key):
                continue
            # whole entries come first in each group: those with an item deleted needn't meet each other
            order = np.argsort(key << np.uint64(1) | deleted, kind="stable")
            k = key[order]
            starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            lengths = np.diff(np.append(starts, len(k)))
            many = lengths > 1
            if hot or large:
                wide = (lengths > (hot or large)) | np.isin(k[starts], marks)
                many &= ~wide
                mine = order[np.repeat(starts[wide], lengths[wide]) + _within(lengths[wide])]
                if not len(mine):
                    pass
                elif hot:
                    yield _found_blocks(_hot_blocks(_whole(key[mine], bucket), record[mine], deleted[mine], ids, sketch, size, buckets))
                elif not cut:
                    yield _members(ids[record[mine]], mix(_whole(key[mine], bucket)))
                else:
                    for g in np.flatnonzero(wide):
                        group = order[starts[g] : starts[g] + lengths[g]]
                        for part in _part_pairs(group, ids[record[group]], _whole(key[group[:1]], bucket)[0], large):
                            entries = record[part[1]] << 1 | deleted[part[1]]
                            yield _found_blocks(_write(part[0], entries, ids, sketch, size, buckets))
            left = np.repeat(starts[many], lengths[many]) + _within(lengths[many])
            after = np.repeat(starts[many] + lengths[many], lengths[many]) - left - 1
            left, after = (x[~deleted[order[left]]] for x in (left, after))
            for i, j in _expand(left, left + 1, after, BLOCK):
                a, b = record[order[i]], record[order[j]]
                apart = np.bitwise_count(sketch[a] ^ sketch[b]).astype(np.int64)
                small, large_ = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
                keep = (ids[a] != ids[b]) & (small >= large_ * t - 1e-9) & (apart <= differ(small, large_, t))
                x, y = ids[a[keep]], ids[b[keep]]
                if len(x):
                    both = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0)
                    yield _pairs_batch(both[:, 0], both[:, 1])

    return run


def _part_pairs(group, ids, key, large: int):
    """(keys, entries) for every two parts of a group that is cut into parts of about `large` / 2 entries by id."""
    import numpy as np

    n = max(2, -(-2 * len(group) // large))
    of = (mix(ids ^ np.int64(0x5DEECE66D)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=n))
    parts = [group[order[(ends[x - 1] if x else 0) : ends[x]]] for x in range(n)]
    for x in range(n):
        for y in range(x + 1, n):
            both = np.concatenate((parts[x], parts[y]))
            if len(both) > 1:
                yield np.repeat(mix(mix(np.array([key], np.uint64)) + np.uint64(x * n + y)), len(both)), both


def _hot_blocks(key, record, deleted, ids, sketch, size, buckets: int) -> pa.RecordBatch:
    """Hot entries in blocks by record: the whole key takes two columns of the table's form."""
    import numpy as np

    bucket = (mix(ids[record]) % np.uint64(buckets)).astype(np.int64)
    return _blocks(bucket, key, record << 1 | deleted, ids, sketch, size, buckets)


def _second(t: float, buckets: int, many: int, often=None):
    """Blocks of hot entries by record to blocks of the second round, whose keys are two hot keys, or one and a rare item.

    The latter with often, what _common gives.

    Keys that many records of a bucket have are marked and left out; their records come out instead,
    with the group that they are to be split in. A hot key carries no segment: keys of one segment of a
    record, whole and less one item, are joined too. That adds groups that aren't needed, and loses none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for rows in _by_bucket(batches):
            ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
            sketch = np.concatenate([np.frombuffer(r["sketches"], np.uint64) for r in rows])
            size = np.concatenate([np.frombuffer(r["sizes"], np.int32) for r in rows])
            base = np.cumsum([0, *(len(r["ids"]) // 8 for r in rows)])
            ref = np.concatenate([np.frombuffer(r["refs"], np.uint32).astype(np.int64) + 2 * b for r, b in zip(rows, base)])
            key = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
            ids, first, of = np.unique(ids, return_index=True, return_inverse=True)
            sketch, size = sketch[first], size[first]
            record, deleted = of[ref >> 1], (ref & 1).astype(bool)
            order = np.lexsort((key, record))
            record, key, deleted = record[order], key[order], deleted[order]
            starts = np.flatnonzero(np.concatenate(([True], record[1:] != record[:-1])))
            lengths = np.diff(np.append(starts, len(record)))
            two = _two_by_two(starts, lengths, key, deleted) if often is None else _with_rarest(t, rows, ids, size, record, key, deleted, often)
            for i, both, mark in two:
                marks, is_large = _many(both, many)
                if len(marks):
                    group = _whole(_lower_half(both[is_large]), 0) | (both[is_large] >> np.uint64(32)) % np.uint64(buckets)
                    yield _members(ids[record[i][is_large]], mix(group))
                keep = ~is_large
                yield _found_blocks(_write(both[keep], record[i][keep] << 1 | mark[keep], ids, sketch, size, buckets, marks))

    return run


def _two_by_two(starts, lengths, key, deleted):
    """(entry, key, deleted) for every two hot entries of a record.

    One is marked deleted only where both are: two such never need to meet.
    """
    for i, j in _ragged_pairs(starts, lengths, BLOCK):
        yield i, mix(mix(key[i]) + key[j]), deleted[i] & deleted[j]


def _with_rarest(t: float, rows: list[dict], ids, size, record, key, deleted, often):
    """(entry, key, deleted) for every hot entry and each of its record's rarest items.

    Unless an item is met often its keys' upper half, which has the bucket, is of the item alone: a record
    then is in as many blocks as it has rarest items, not hot keys times those.
    """
    import numpy as np

    told = [r for r in rows if r["marks"]]
    items = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r["marks"], np.uint32) for r in told)]).astype(np.uint64)
    of = np.searchsorted(ids, np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["ids"], np.int64) for r in told)]))
    counts = _prefix(size.astype(np.int64), t)
    begin = np.zeros(len(ids), np.int64)
    begin[of] = np.cumsum(counts[of]) - counts[of]
    for i, x in _expand(np.arange(len(record)), begin[record], counts[record], BLOCK):
        both = mix(mix(key[i]) + items[x])
        at = np.minimum(np.searchsorted(often, items[x]), max(0, len(often) - 1))
        spread = often[at] == items[x] if len(often) else np.zeros(len(x), bool)
        alone = mix(items[x]) >> np.uint64(32) << np.uint64(32) | both & np.uint64(0xFFFFFFFF)
        yield i, np.where(spread, both, alone), deleted[i]


def candidates(records: DataFrame, t: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b: each pair of records (id, items) that can be similar, once.

    items are distinct 64-bit hashes, at least one a record; ids are distinct. Each round's outcome is
    staged: what several branches read is made once.
    """
    parts = width(records.sparkSession)
    buckets = parts * BUCKETS

    def by_bucket(blocks: DataFrame) -> DataFrame:
        # hashing the few bucket numbers would leave some partitions empty, others with several
        return blocks.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket")

    rows, pairs = records.select("id", F.lit(0).cast("bigint").alias("group"), "items"), []
    for level in range(LEVELS):
        last = level == LEVELS - 1
        common = None if level else _common(records)
        by_key = rows.mapInArrow(_first(t, level, buckets, False, MANY), BLOCKS)
        by_record = rows.mapInArrow(_first(t, level, buckets, True, MANY, common), BLOCKS)
        found = staged(by_bucket(by_key).mapInArrow(_matched(t, buckets, hot=HOT), FOUND))
        hot = by_bucket(by_record.unionAll(found.where("bucket is not null").select(*_BLOCK_NAMES)))
        # at the last level nothing is marked: groups are cut where they are whole
        many = BLOCK * BLOCK if last else LARGE // 2
        twice = hot.mapInArrow(_second(t, buckets, many, common and common[2]), FOUND)
        twice = twice if last else staged(twice)
        blocks = by_bucket(twice.where("bucket is not null").select(*_BLOCK_NAMES))
        again = staged(blocks.mapInArrow(_matched(t, buckets, large=LARGE, cut=last), FOUND))
        pairs += [x.where("id_b is not null") for x in (found, again)]
        if last:
            parted = by_bucket(again.where("bucket is not null").select(*_BLOCK_NAMES))
            pairs.append(parted.mapInArrow(_matched(t, buckets), FOUND))
            break
        members = staged(again.unionAll(twice).where("`group` is not null").select(F.col("id_a").alias("id"), "group").distinct())
        if members.isEmpty():
            break
        rows = members.join(records, "id").select("id", "group", "items")
    every = pairs[0].select("id_a", "id_b")
    for more in pairs[1:]:
        every = every.unionAll(more.select("id_a", "id_b"))
    return every.distinct()


def representatives(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, key, ...): (key, rep, copies), a row a key with its least id, and the rows of those ids.

    Only keys and ids are shuffled; where the rows lie partitioned by id, they stay there.
    """
    classes = keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return classes, keyed.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")


def _similar_sets(records: DataFrame, t: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of records (id, terms): rows (id, terms, key), classes and their sets, and the pairs of similar
    classes (key_a, key_b, shared, total)."""
    keyed = staged(
        records.where("size(terms) > 0")
        .select("id", F.sort_array(F.array_distinct("terms")).alias("terms"))
        .withColumn("key", F.md5(F.to_json("terms")))
    )
    classes, sets = representatives(keyed)
    classes, sets = staged(classes), staged(sets)
    hashed = sets.select("id", F.transform("terms", lambda x: F.xxhash64(x)).alias("items"))
    pairs = candidates(hashed, t)
    for s in "ab":
        side = sets.select(F.col("id").alias(f"id_{s}"), F.col("key").alias(f"key_{s}"), F.col("terms").alias(f"terms_{s}"))
        pairs = pairs.join(side, f"id_{s}")
    shared = F.size(F.array_intersect("terms_a", "terms_b"))
    total = F.size("terms_a") + F.size("terms_b")
    verified = pairs.select("key_a", "key_b", shared.alias("shared"), total.alias("total")).where(
        F.col("shared") >= (F.col("total") - F.col("shared")) * t
    )
    return keyed, classes, sets, verified


def similar_pairs(records: DataFrame, t: float = 0.75) -> DataFrame:
    """(id_a, id_b, shared, similarity), id_a < id_b, of records (id, terms) whose sets of terms have
    at least one term each and Jaccard similarity t or more.

    Null and empty terms' records are in no pair; a term's repetitions don't count; ids are distinct.
    Records with the same set are one class while pairs are searched, so copies cost nothing there;
    at the end each pair of classes is joined with its members, every link coming out.
    """
    keyed, classes, sets, verified = _similar_sets(records, t)
    copied = classes.where("copies > 1").select(F.col("rep").alias("id")).join(sets, "id")
    twins = copied.select(
        F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.size("terms").alias("shared"), (2 * F.size("terms")).alias("total")
    )
    members = keyed.select("key", "id")
    links = verified.unionByName(twins)
    for s in "ab":
        links = links.join(members.select(F.col("key").alias(f"key_{s}"), F.col("id").alias(f"id_{s}")), f"key_{s}")
    return links.where((F.col("key_a") != F.col("key_b")) | (F.col("id_a") < F.col("id_b"))).select(
        F.least("id_a", "id_b").alias("id_a"),
        F.greatest("id_a", "id_b").alias("id_b"),
        "shared",
        (F.col("shared") / (F.col("total") - F.col("shared"))).alias("similarity"),
    )


def similar_classes(records: DataFrame, t: float = 0.75) -> DataFrame:
    """(id, class, links): a row a record (id, terms) with terms, linear in copies.

    class is the least id of the records with the same set; links is the number of other records whose
    set is similar, those with the same set included.
    """
    keyed, classes, _, verified = _similar_sets(records, t)
    ends = verified.select("key_a", "key_b").unionAll(verified.select(F.col("key_b"), F.col("key_a")))
    others = (
        ends.join(classes.select(F.col("key").alias("key_b"), "copies"), "key_b")
        .groupBy(F.col("key_a").alias("key"))
        .agg(F.sum("copies").alias("others"))
    )
    counted = classes.join(others, "key", "left").select(
        "key", F.col("rep").alias("class"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    return keyed.select("id", "key").join(counted, "key").select("id", "class", "links")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    verses = current_verses(read(spark, sf_dir, "scoring_verses"))
    pairs = similar_pairs(verses.select(F.col("verse_id").alias("id"), "terms"))
    return pairs.select(F.col("id_a").alias("verse_a"), F.col("id_b").alias("verse_b"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each current verse with terms, the class of verses with its set, and how many verses are similar to it."""
    verses = current_verses(read(spark, sf_dir, "scoring_verses"))
    rows = similar_classes(verses.select(F.col("verse_id").alias("id"), "terms"))
    return rows.select(F.col("id").alias("verse_id"), F.col("class").alias("class_id"), "links")


P1_SQL = f"""
with {CURRENT_SQL}, s as (
  select verse_id, list_distinct(terms) as terms from cv where len(terms) > 0
), t as (
  select verse_id, len(terms) as n, unnest(terms) as term from s
), c as (
  select a.verse_id as verse_a, b.verse_id as verse_b, count(*) as shared, any_value(a.n + b.n) as total
  from t a join t b on a.term = b.term and a.verse_id < b.verse_id and a.n * 4 >= b.n * 3 and b.n * 4 >= a.n * 3
  group by a.verse_id, b.verse_id
)
select verse_a, verse_b from c where shared * 4 >= (total - shared) * 3
"""

P1_CLASSES_SQL = f"""
with {CURRENT_SQL}, k as (
  select verse_id, array_to_string(list_sort(list_distinct(terms)), chr(31)) as key from cv where len(terms) > 0
), p as ({P1_SQL}), e as (select verse_a as verse_id from p union all select verse_b from p
), l as (select verse_id, count(*) as links from e group by verse_id)
select verse_id, min(verse_id) over (partition by key) as class_id, coalesce(links, 0) as links from k left join l using (verse_id)
"""
