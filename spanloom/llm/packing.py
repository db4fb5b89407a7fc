"""Filling fixed-capacity containers: best fit, then swap-based local search, in shards and rounds."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, staged, width
from .tokenizer import token_counts

CAPACITY = 2048
#: Items that one task packs at a time. More items only mean more shards, and rounds of them.
SHARD = 20_000
#: A further round over underfull bins is made only if the last one saved more than this share of them.
GAIN = 0.001

PLACED = "id bigint, piece int, length int, shard bigint, bin int, start int, open boolean"


class _Bins:
    """Bins of items by index, with the space that each has left."""

    def __init__(self, sizes: list[int], capacity: int, items: list[list[int]] | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = items or []
        self.left: list[int] = [capacity - sum(sizes[i] for i in b) for b in self.items]

    def best_fit(self) -> None:
        """Items by descending size, each into the fullest bin that holds it.

        Open bins are kept by their space left, and a bit mask says which spaces there are.
        """
        by_left: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for i in sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i], i)):
            size = self.sizes[i]
            fits = mask >> size
            if fits:
                left = size + (fits & -fits).bit_length() - 1
                b = by_left[left].pop()
                if not by_left[left]:
                    mask &= ~(1 << left)
            else:
                b, left = len(self.items), self.capacity
                self.items.append([])
                self.left.append(left)
            self.items[b].append(i)
            self.left[b] = left = left - size
            by_left[left].append(b)
            mask |= 1 << left

    def improve(self) -> int:
        """Local search over the underfull bins until no step is left; how many steps were made.

        A step makes one bin fuller by d at another's cost: one or two items of the giver move, and
        none, one or two of the fuller bin's go back. It is made only if the sum of squared fills
        rises, that is, if the giver has more space than the taker will have. A bin that is filled
        leaves the search, one that is emptied is dropped. Bins are gone through from the fullest
        on, until a whole pass changes nothing; the sum rises and is bounded, so that ends.

        An index holds, for every total of one or two items of an underfull bin, the bins that have
        it, the emptiest first, and a bit mask says which totals there are: so a bin meets all its
        partners at once, whatever their number. Items count by size: a bin has at most about
        `capacity` pairs of different sizes, however many its items are.
        """
        self._index: dict[int, list[tuple[int, int, tuple[int, ...]]]] = {}  # total: heap of (-space, bin, sizes)
        self._mask = 0
        self._has: list[dict[int, list[int]]] = []  # a bin's items by size
        for items in self.items:
            by_size: dict[int, list[int]] = {}
            for i in items:
                by_size.setdefault(self.sizes[i], []).append(i)
            self._has.append(by_size)
        for b in range(len(self.items)):
            self._enter(b)
        steps = before = 0
        while True:
            for b in sorted((b for b in range(len(self.items)) if self.left[b] and self._has[b]), key=lambda b: (self.left[b], b)):
                while self.left[b] and self._has[b] and self._step(b):
                    steps += 1
            if steps == before:
                break
            before = steps
        self.items = [[i for same in by_size.values() for i in same] for by_size in self._has]
        kept = [b for b in range(len(self.items)) if self.items[b]]
        self.items, self.left = [self.items[b] for b in kept], [self.left[b] for b in kept]
        return steps

    def _totals(self, b: int) -> dict[int, tuple[int, ...]]:
        """What one or two items of a bin come to: by total, the sizes, one rather than two."""
        has = self._has[b]
        sizes = sorted(has)
        out: dict[int, tuple[int, ...]] = {n: (n,) for n in sizes}
        for k, n in enumerate(sizes):
            for m in sizes[k if len(has[n]) > 1 else k + 1 :]:
                out.setdefault(n + m, (n, m))
        return out

    def _enter(self, b: int) -> None:
        if self.left[b]:
            for total, sizes in self._totals(b).items():
                heappush(self._index.setdefault(total, []), (-self.left[b], b, sizes))
                self._mask |= 1 << total

    def _emptiest(self, total: int, other_than: int) -> tuple[int, tuple[int, ...]] | None:
        """The emptiest underfull bin that has items of this total, and their sizes."""
        heap, own, found = self._index[total], [], None
        while heap:
            left, b, sizes = heap[0]
            has = self._has[b]
            if self.left[b] != -left or any(n not in has for n in sizes) or (sizes[0] == sizes[-1] and len(has[sizes[0]]) < len(sizes)):
                heappop(heap)  # outdated
            elif b == other_than:
                own.append(heappop(heap))
            else:
                found = b, sizes
                break
        for entry in own:
            heappush(heap, entry)
        if not heap:
            self._mask &= ~(1 << total)
        return found

    def _step(self, taker: int) -> bool:
        """Makes the step that fills `taker` most, giving back as little as can be; False if there is none."""
        gap = self.left[taker]
        best, move = 0, None
        for total, back in {0: (), **self._totals(taker)}.items():
            # totals in the index that raise the fill by more than `best` and by no more than the gap
            wanted = (self._mask >> (total + best + 1)) & ((1 << (gap - best)) - 1)
            while wanted:
                d = best + wanted.bit_length()
                found = self._emptiest(total + d, taker)
                if found and self.left[found[0]] > gap - d:
                    best, move = d, (*found, back)
                    break
                wanted &= (1 << (d - best - 1)) - 1
            if best == gap:
                break
        if not move:
            return False
        giver, given, back = move
        for source, target, sizes in ((giver, taker, given), (taker, giver, back)):
            for n in sizes:
                same = self._has[source][n]
                self._has[target].setdefault(n, []).append(same.pop())
                if not same:
                    del self._has[source][n]
                self.left[source] += n
                self.left[target] -= n
        self._enter(giver)
        self._enter(taker)
        return True


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices of sizes, each between 1 and capacity: best fit decreasing, then local search."""
    bins = _Bins(sizes, capacity)
    bins.best_fit()
    bins.improve()
    return bins.items


def _packed(capacity: int):
    """Rows (part, id, piece, length, shard, bin) sorted by part to their places; a part is held at a time.

    Rows that have no bin yet are placed by best fit; those that have start from there, so that a
    further round never needs more bins. Bins with space left are marked open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            rows.sort(key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1]))
            real = [r for r in rows if r[2]]
            before: dict[tuple, list[int]] = {}
            for i, r in enumerate(real):
                before.setdefault(r[3:], []).append(i)
            sizes = [r[2] for r in real]
            if (None, None) in before:
                bins = _Bins(sizes, capacity)
                bins.best_fit()
            else:
                bins = _Bins(sizes, capacity, [before[b] for b in sorted(before)])
            bins.improve()
            places, at = [], 0
            for b, (items, left) in enumerate(zip(bins.items, bins.left)):
                at = 0
                for i in items:
                    places.append((*real[i][:3], part, b, at, left > 0))
                    at += sizes[i]
            # items of no length lie at the end of the part's last bin
            b, opened = max(0, len(bins.items) - 1), bool(bins.left) and bins.left[-1] > 0
            places += [(*r[:3], part, b, at, opened) for r in rows if not r[2]]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            names = ["id", "piece", "length", "shard", "bin", "start", "open"]
            for k in range(0, len(places), 1 << 16):
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*places[k : k + (1 << 16)]), kinds)], names=names)

        part, rows = None, []
        for batch in batches:
            for p, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part and rows:
                    yield from done(part, rows)
                    rows = []
                part = p
                rows.append(tuple(row))
        if rows:
            yield from done(part, rows)

    return run


def _round(items: DataFrame, capacity: int) -> DataFrame:
    rows = items.select("part", "id", "piece", "length", "shard", "bin").repartition(width(items.sparkSession), "part")
    return staged(rows.sortWithinPartitions("part").mapInArrow(_packed(capacity), PLACED))


def containers(sizes: DataFrame, capacity: int = CAPACITY, gain: float = GAIN) -> DataFrame:
    """(id, piece, container, start, length) of sizes (id, n): every item in a container of `capacity`.

    An item of up to capacity is piece 0, whole. A longer one is cut into full containers of its
    own, pieces 0, 1 ... and a rest that is packed like an item. An item of no length, or null
    length, has a place of no length at the end of a container. Ids may be null or repeated: each
    row is an item. Container numbers are distinct but not consecutive.

    Items are spread over shards of about SHARD items by a hash, each packed by one task: best fit,
    then local search. The bins that stay underfull are put together anew, whole, into parts of
    about SHARD items, and the search goes on over each, so that shards' waste meets. That is
    repeated with other parts while there is more than one and a round saves more than `gain` of
    its bins. No round adds a bin. Sizes, not texts, are moved.
    """
    n = F.coalesce(F.greatest("n", F.lit(0)), F.lit(0)).cast("bigint")
    items = sizes.select("id", n.alias("n")).select("id", "n", F.expr(f"n div {capacity}").alias("full"), (F.col("n") % capacity).alias("rest"))
    own = items.where("full > 0").select("id", F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)).alias("piece"))
    rest = items.where("rest > 0 or full = 0").select("id", F.col("full").cast("int").alias("piece"), F.col("rest").cast("int").alias("length"))
    rest = staged(rest)
    parts = max(1, -(-rest.count() // SHARD))
    # the id's hash alone would gather an id that is repeated very often; its row's size and place spread that
    salt = F.xxhash64("id", "piece", "length", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    unplaced = rest.withColumns({"part": F.pmod(salt, F.lit(parts)), "shard": F.lit(None).cast("bigint"), "bin": F.lit(None).cast("int")})
    placed, closed, first = _round(unplaced, capacity), None, parts
    while parts > 1:
        kept = placed.where("not open")
        closed = kept if closed is None else closed.unionByName(kept)
        opened = placed.where("open")
        rows, bins = opened.agg(F.count(F.lit(1)), F.count(F.when((F.col("start") == 0) & (F.col("length") > 0), 1))).first()
        parts = -(-rows // SHARD)
        if not parts:
            break
        # parts are numbered on from round to round, so that a container's number stays its own
        part = F.lit(first) + F.pmod(F.xxhash64("shard", "bin"), F.lit(parts))
        first += parts
        placed = _round(opened.withColumn("part", part), capacity)
        after = placed.where("start = 0 and length > 0").count()
        if bins - after <= gain * bins:
            break
    if parts:
        closed = placed if closed is None else closed.unionByName(placed)
    places = closed.select("id", "piece", (F.col("shard") * (1 << 24) + F.col("bin")).alias("container"), "start", "length")
    # containers that one piece fills are numbered from below zero, by partition
    alone = own.select(
        "id", "piece", (-1 - F.monotonically_increasing_id()).alias("container"), F.lit(0).alias("start"), F.lit(capacity).alias("length")
    )
    return places.unionByName(alone)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document, or piece of a longer one, lies; a piece's start is its offset in the container."""
    counts = token_counts(read(spark, sf_dir, "documents"))
    return containers(staged(counts.select(F.col("doc_id").alias("id"), F.col("n_tokens").alias("n")))).select(
        F.col("id").alias("doc_id"), "piece", "container", F.col("start").alias("offset"), "length"
    )


def _fill(placed: DataFrame) -> DataFrame:
    bins = placed.groupBy("container").agg(F.sum("length").alias("fill"))
    return bins.agg(
        F.count(F.lit(1)).alias("containers"),
        F.ceil(F.sum("fill") / CAPACITY).alias("least"),
        F.sum("fill").alias("tokens"),
        F.round(F.sum("fill") / (F.count(F.lit(1)) * CAPACITY), 6).alias("used"),
    )


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: containers, the least number that could do, tokens, and the share of space used."""
    return _fill(p8_containers(spark, sf_dir))


def p8_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row that says whether the containers keep the rules, for a statement in SQL.

    documents: how many have all their pieces, from 0 on; split: documents up to the capacity in
    more than one piece; overfull: containers of more than the capacity; apart: places that don't
    begin where the one before them ends; well_filled: at most one container in a hundred, and one,
    more than the tokens need.
    """
    placed = staged(p8_containers(spark, sf_dir))
    whole = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.max("piece").alias("last"), F.sum("length").alias("n"))
    pieces = whole.agg(
        F.count(F.when(F.col("k") == F.col("last") + 1, 1)).alias("documents"),
        F.count(F.when((F.col("n") <= CAPACITY) & (F.col("k") > 1), 1)).alias("split"),
    )
    behind = Window.partitionBy("container").orderBy("offset", "length", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("length").over(behind), F.lit(0))
    bins = placed.withColumn("before", before).groupBy("container").agg(
        F.sum("length").alias("fill"), F.count(F.when(F.col("before") != F.col("offset"), 1)).alias("apart")
    )
    rules = bins.agg(
        F.count(F.when(F.col("fill") > CAPACITY, 1)).alias("overfull"),
        F.coalesce(F.sum("apart"), F.lit(0)).alias("apart"),
        (F.count(F.lit(1)) <= F.ceil(F.sum("fill") / CAPACITY) * 1.01 + 1).alias("well_filled"),
    )
    return pieces.crossJoin(F.broadcast(rules))  # a row and a row


P8_SOUND_SQL = """
select count(*) as documents, 0 as split, 0 as overfull, 0 as apart, true as well_filled from documents
"""
