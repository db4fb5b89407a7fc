"""Top N items within every group, by secondary sort over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, width


def _stream_first(group: str, n: int):
    """A mapInArrow function over rows sorted by group: it passes on the first n rows of each group.

    Only the last group's key and its count outlive a batch; nothing is buffered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        last, seen = None, 0
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            keys = batch.column(batch.schema.get_field_index(group))
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            lengths = np.diff(np.append(starts, size))
            rank = np.arange(size) - np.repeat(starts, lengths)
            first = (keys[0].is_valid, keys[0].as_py())
            if first == last:
                rank[: lengths[0]] += seen
            seen = int(lengths[-1]) + (seen if len(starts) == 1 and first == last else 0)
            last = (keys[size - 1].is_valid, keys[size - 1].as_py())
            yield batch.filter(pa.array(rank < n))

    return run


def top_n(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of every group under `order`, which must be total to make the result unique.

    Rows lie anywhere at first: each partition is sorted by group and order and streams out at most
    n rows of each group, so a group of any size leaves at most n rows a partition. Only those are
    hash-partitioned by group, sorted and streamed once more. A null group is a group. Ties that
    `order` leaves open are settled arbitrarily. n < 1 gives no rows; columns pass through as they are.
    """
    if n < 1:
        return df.limit(0)
    first = _stream_first(group, n)
    local = df.sortWithinPartitions(F.col(group), *order).mapInArrow(first, df.schema)
    return (
        local.repartition(width(df.sparkSession), group)
        .sortWithinPartitions(F.col(group), *order)
        .mapInArrow(first, df.schema)
    )


def latest_scores(results: DataFrame) -> DataFrame:
    """One row a (query_reference, target_reference): the score of the greatest scored_at.

    A null scored_at is older than any other; rows that tie in it count by the greatest score, NaN
    above all and null below all. Pairs whose score is then null or NaN are left out.
    """
    return (
        results.groupBy("query_reference", "target_reference")
        .agg(F.max(F.struct("scored_at", "score")).alias("last"))
        .select("query_reference", "target_reference", F.col("last.score").alias("score"))
        .where(F.col("score").isNotNull() & ~F.isnan("score"))
    )


def placed(df: DataFrame, label: str, books: DataFrame) -> DataFrame:
    """df with book_order_, chapter_ and verse_ of a label `Book chapter:verse`.

    books is the fixed table of at most a few hundred books and is broadcast. What can't be read is
    null, which sorts after everything else.
    """
    place = F.substring_index(label, " ", -1)
    book = F.expr(f"left({label}, greatest(0, length({label}) - length(substring_index({label}, ' ', -1)) - 1))")
    names = F.broadcast(books.groupBy(F.col("name").alias("book_")).agg(F.min("book_order").alias("book_order_")))
    return (
        df.withColumns(
            {
                "book_": book,
                "chapter_": F.substring_index(place, ":", 1).try_cast("int"),
                "verse_": F.substring_index(place, ":", -1).try_cast("int"),
            }
        )
        .join(names, "book_", "left")
        .drop("book_")
    )


def best_targets(results: DataFrame, books: DataFrame, n: int = 5) -> DataFrame:
    """(query_reference, target_reference, score): the n best targets of each query.

    By score descending, then book order, chapter and verse as numbers, then the label itself.
    """
    rows = placed(latest_scores(results), "target_reference", books)
    order = [
        F.col("score").desc(),
        F.col("book_order_").asc_nulls_last(),
        F.col("chapter_").asc_nulls_last(),
        F.col("verse_").asc_nulls_last(),
        F.col("target_reference").asc(),
    ]
    return top_n(rows, "query_reference", order, n).select("query_reference", "target_reference", "score")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = best_targets(read(spark, sf_dir, "related_results"), read(spark, sf_dir, "books"))
    return best.select("query_reference", "target_reference")


P4_SQL = """
with last as (
  select distinct query_reference, target_reference, score from (
    select query_reference, target_reference, score,
      rank() over (partition by query_reference, target_reference order by scored_at desc) as r
    from related_results) where r = 1
), placed as (
  select l.*, b.book_order,
    cast(regexp_extract(target_reference, '([0-9]+):([0-9]+)$', 1) as int) as chapter,
    cast(regexp_extract(target_reference, '([0-9]+):([0-9]+)$', 2) as int) as verse
  from last l left join books b on b.name = regexp_replace(target_reference, ' [0-9]+:[0-9]+$', '')
  where score is not null and not isnan(score)
)
select query_reference, target_reference from (
  select *, row_number() over (partition by query_reference
    order by score desc, book_order nulls last, chapter nulls last, verse nulls last, target_reference) as rn
  from placed) where rn <= 5
"""
