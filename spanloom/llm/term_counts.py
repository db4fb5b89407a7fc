"""Frequency of every distinct term: burst tries per worker, merged subtree by subtree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import current_verses, read, staged, width
from .distinctive import CURRENT_SQL

#: A trie's container bursts into containers of the next character beyond so many terms.
CONTAINER = 1024
#: Distinct terms that a task's tries hold; beyond, their leaves leave and new tries are begun.
HELD = 1 << 19
#: Subtrees a partition: routing prefixes are lengthened until no subtree holds more than this share.
SUBTREES = 8

LEAVES = "version int, prefix string, terms array<string>, tf array<bigint>, df array<bigint>"


class BurstTrie:
    """Counters by term: inner nodes by character, containers of suffixes at the leaves.

    A container that outgrows `capacity` bursts: its place is taken by a node with a container for
    each first character of its suffixes, so frequent prefixes are split deeply and rare ones not.
    """

    def __init__(self, capacity: int = CONTAINER):
        self.capacity = capacity
        self.root: dict = {}  # a container: its keys are suffixes, its values [tf, df]
        self.inner: set[int] = set()  # ids of the dicts that are inner nodes
        self.terms = 0

    def add(self, term: str, tf: int, df: int) -> None:
        node, parent, depth = self.root, None, 0
        while id(node) in self.inner:
            parent, edge = node, term[depth : depth + 1]
            node = parent.get(edge)
            if node is None:
                node = parent[edge] = {}
            depth += 1
            if not edge:  # the term ends at an inner node: a container for the empty suffix alone
                break
        suffix = term[depth:]
        entry = node.get(suffix)
        if entry:
            entry[0] += tf
            entry[1] += df
            return
        node[suffix] = [tf, df]
        self.terms += 1
        if len(node) > self.capacity:
            self._burst(node)

    def _burst(self, node: dict) -> None:
        full = [node]
        while full:
            node = full.pop()
            parts: dict = {}
            for suffix, entry in node.items():
                parts.setdefault(suffix[:1], {})[suffix[1:]] = entry
            node.clear()
            node.update(parts)
            self.inner.add(id(node))
            full.extend(part for part in parts.values() if len(part) > self.capacity)

    def leaves(self) -> Iterator[tuple[str, dict]]:
        """(prefix, container) of each container."""
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if id(node) in self.inner:
                stack.extend((prefix + edge, child) for edge, child in node.items())
            elif node:
                yield prefix, node


def _leaf_batch(version: int | None, trie: BurstTrie) -> Iterator[pa.RecordBatch]:
    for prefix, leaf in trie.leaves():
        yield pa.record_batch(
            [
                pa.array([version], pa.int32()),
                pa.array([prefix], pa.string()),
                pa.array([list(leaf)], pa.list_(pa.string())),
                pa.array([[e[0] for e in leaf.values()]], pa.list_(pa.int64())),
                pa.array([[e[1] for e in leaf.values()]], pa.list_(pa.int64())),
            ],
            names=["version", "prefix", "terms", "tf", "df"],
        )


def _count(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Rows (version, terms) to the leaves of one trie a version; the terms of a batch are counted
    by code first, so that the trie is walked once a distinct term of the batch. A full trie's leaves
    leave; a term can come in several, which merge later."""
    import numpy as np

    tries: dict[int | None, BurstTrie] = {}
    for batch in batches:
        versions, lists = batch.column(0), batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().dictionary_encode()
        if not len(flat):
            continue
        names = flat.dictionary.to_pylist()
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        group = versions.dictionary_encode(null_encoding="encode")
        of_row = group.indices.to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        pairs = np.unique(rows * len(names) + codes)
        for k, version in enumerate(group.dictionary.to_pylist()):
            tf = np.bincount(codes[of_row[rows] == k], minlength=len(names))
            once = pairs[of_row[pairs // len(names)] == k]
            df = np.bincount(once % len(names), minlength=len(names))
            trie = tries.setdefault(version, BurstTrie())
            there = np.flatnonzero(df)
            for c, t, d in zip(there.tolist(), tf[there].tolist(), df[there].tolist()):
                trie.add(names[c], t, d)
        if sum(trie.terms for trie in tries.values()) > held:
            for version, trie in tries.items():
                yield from _leaf_batch(version, trie)
            tries = {}
    for version, trie in tries.items():
        yield from _leaf_batch(version, trie)


def _router(split: set[str]):
    """A term's route: its shortest prefix that isn't to be split, marked when it is the whole term."""

    def route(term: str) -> str:
        for k in range(len(term) + 1):
            if term[:k] not in split:
                return term[:k]
        return term

    return route


def _cut(split: set[str]):
    """A mapInArrow function that cuts leaves along the routes and writes whole terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route = _router(split)
        for batch in batches:
            for row in batch.to_pylist():
                prefix, parts = row["prefix"], {}
                whole = route(prefix) if prefix not in split else None
                for term, tf, df in zip(row["terms"], row["tf"], row["df"]):
                    term = prefix + term
                    part = parts.setdefault(route(term) if whole is None else whole, ([], [], []))
                    part[0].append(term)
                    part[1].append(tf)
                    part[2].append(df)
                if parts:
                    yield pa.record_batch(
                        [
                            pa.array([row["version"]] * len(parts), pa.int32()),
                            pa.array(list(parts), pa.string()),
                            pa.array([p[0] for p in parts.values()], pa.list_(pa.string())),
                            pa.array([p[1] for p in parts.values()], pa.list_(pa.int64())),
                            pa.array([p[2] for p in parts.values()], pa.list_(pa.int64())),
                        ],
                        names=["version", "prefix", "terms", "tf", "df"],
                    )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by version and route to one row a term: a subtree is held at a time."""

    def done(key, trie):
        for prefix, leaf in trie.leaves():
            yield pa.record_batch(
                [
                    pa.array([key[0]] * len(leaf), pa.int32()),
                    pa.array([prefix + s for s in leaf], pa.string()),
                    pa.array([e[0] for e in leaf.values()], pa.int64()),
                    pa.array([e[1] for e in leaf.values()], pa.int64()),
                ],
                names=["version", "term", "tf", "df"],
            )

    key, trie = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["version"], row["prefix"]) != key:
                if trie is not None:
                    yield from done(key, trie)
                key, trie = (row["version"], row["prefix"]), BurstTrie()
            for term, tf, df in zip(row["terms"], row["tf"], row["df"]):
                trie.add(term, tf, df)
    if trie is not None:
        yield from done(key, trie)


def splits(leaves: DataFrame, parts: int) -> set[str]:
    """The prefixes under which more than 1 / parts of all the leaves' entries lie.

    At each depth there are fewer than `parts` of them, so the set is small whatever the data.
    """
    sizes = leaves.groupBy("prefix").agg(F.sum(F.size("terms")).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    under = sizes.select(
        "n", F.explode(F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda k: F.col("prefix").substr(F.lit(1), k))).alias("p")
    )
    heavy = under.groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") > max(CONTAINER, total // max(1, parts)))
    return {r.p for r in heavy.select("p").toLocalIterator()}


def term_counts(records: DataFrame) -> DataFrame:
    """(version, term, tf, df) over records (version, terms): every distinct term of each version.

    tf counts occurrences, df records. Records with null or empty terms count nothing; a null
    version is a version; the empty string is a term.

    Each task counts its rows in burst tries. Their leaves, a small part of the input, are staged;
    prefixes that hold too large a share of them are split further, and leaves are cut along these
    adaptive prefixes and shuffled to where the matching subtrees merge. A term of any frequency is
    one entry a task before the shuffle, so there is no hot key.
    """
    spark = records.sparkSession
    leaves = staged(records.where("terms is not null").select("version", "terms").mapInArrow(_count, LEAVES))
    parts = width(spark)
    split = splits(leaves, parts * SUBTREES)
    return (
        leaves.mapInArrow(_cut(split), LEAVES)
        .repartition(parts, "version", "prefix")
        .sortWithinPartitions("version", "prefix")
        .mapInArrow(_merge, "version int, term string, tf bigint, df bigint")
    )


def marked_counts(verses: DataFrame) -> DataFrame:
    """(corpus_version_id, normalized, total_frequency, document_frequency, rare, common) of current verses.

    rare: df is at most the df at place ceil(V / 5) of the version's V ascending df; common: df is
    beyond a fifth of its N verses. In a tiny version a term can be both. The place is found in the
    histogram of df, which has few distinct values.
    """
    version = F.col("corpus_version_id")
    verses = staged(verses.select("corpus_version_id", "terms"))  # read twice
    n = verses.groupBy(version.alias("version_n")).agg(F.count(F.lit(1)).alias("n"))
    counts = staged(term_counts(verses.select(version.alias("version"), "terms")))
    histogram = counts.groupBy("version", "df").agg(F.count(F.lit(1)).alias("k"))
    by_df = Window.partitionBy("version").orderBy("df").rowsBetween(Window.unboundedPreceding, 0)
    threshold = (
        histogram.withColumns({"upto": F.sum("k").over(by_df), "v": F.sum("k").over(Window.partitionBy("version"))})
        .where(F.col("upto") * 5 >= F.col("v"))
        .groupBy(F.col("version").alias("version_t"))
        .agg(F.min("df").alias("threshold"))
    )
    # a row a corpus version
    scalars = n.join(threshold, F.col("version_n").eqNullSafe(F.col("version_t")))
    return counts.join(F.broadcast(scalars), F.col("version").eqNullSafe(F.col("version_n"))).select(
        F.col("version").alias("corpus_version_id"),
        F.col("term").alias("normalized"),
        F.col("tf").alias("total_frequency"),
        F.col("df").alias("document_frequency"),
        (F.col("df") <= F.col("threshold")).alias("rare"),
        (F.col("df") * 5 > F.col("n")).alias("common"),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms marked; one that is both rare and common comes out under either mark."""
    counts = marked_counts(current_verses(read(spark, sf_dir, "scoring_verses")))
    marks = F.array_compact(F.array(F.when(F.col("rare"), "rare"), F.when(F.col("common"), "common")))
    return counts.select("corpus_version_id", "normalized", F.explode(marks).alias("mark"))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_counts(current_verses(read(spark, sf_dir, "scoring_verses")))


_COUNTS_SQL = f"""
with {CURRENT_SQL}, t as (
  select verse_id, version, unnest(terms) as term from cv
), c as (
  select version, term, count(*) as tf, count(distinct verse_id) as df from t group by version, term
), n as (
  select version, count(*) as n from cv group by version
), r as (
  select version, list_sort(list(df))[cast((count(*) + 4) // 5 as int)] as threshold from c group by version
)
"""

P3_COUNTS_SQL = f"""{_COUNTS_SQL}
select version as corpus_version_id, term as normalized, tf as total_frequency, df as document_frequency,
  df <= threshold as rare, 5 * df > n as common
from c join n using (version) join r using (version)
"""

P3_SQL = f"""{_COUNTS_SQL}
select version as corpus_version_id, term as normalized, mark from (
  select version, term, 'rare' as mark from c join r using (version) where df <= threshold
  union all
  select version, term, 'common' from c join n using (version) where 5 * df > n)
"""
