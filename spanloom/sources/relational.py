"""Verses from relational tables, and the constraints that those tables should keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.errors import NotFound


def read_database(spark: SparkSession, url: str, version: str, **options: str) -> DataFrame:
    """Verses of a corpus version from a database with tables verses, books and corpus_versions.

    The joins and the filter are the database's; verses are read in ranges of their id, in parallel,
    if partitionColumn, lowerBound, upperBound and numPartitions are given.
    """
    query = "(select v.id, b.name as book, b.book_order, v.chapter, v.verse, v.display_text, c.name as version from verses v join books b on b.id = v.book_id join corpus_versions c on c.id = v.corpus_version_id) as t"
    rows = spark.read.format("jdbc").options(url=url, dbtable=query, **options).load().where(F.col("version") == version)
    return rows.select("book", "book_order", "chapter", "verse", "display_text")


def join_tables(verses: DataFrame, books: DataFrame, versions: DataFrame, version: str) -> DataFrame:
    """The same from tables: verses (corpus_version_id, book_order, chapter, verse, display_text), books and versions (corpus_version_id, corpus_version)."""
    chosen = versions.where(F.col("corpus_version") == version).select("corpus_version_id").distinct()
    if not chosen.limit(1).count():
        raise NotFound(f"no corpus version {version}")
    names = books.select("book_order", F.col("name").alias("book"))
    return verses.join(F.broadcast(chosen), "corpus_version_id").join(F.broadcast(names), "book_order").select("book", "book_order", "chapter", "verse", "display_text")  # fixed tables


def violations(verses: DataFrame, books: DataFrame, statistics: DataFrame) -> DataFrame:
    """(rule, violations): how often each constraint is broken; a row a rule, 0 where it is kept."""
    by_place = verses.groupBy("corpus_version_id", "book_order", "chapter", "verse").agg(F.count(F.lit(1)).alias("n"))
    unknown = verses.join(F.broadcast(books.select("book_order")), "book_order", "left_anti")  # a fixed table
    terms = statistics.groupBy("corpus_version_id", "normalized").agg(F.count(F.lit(1)).alias("n"))
    checks = {
        "verses: repeated place": by_place.where("n > 1"),
        "verses: no text": verses.where("coalesce(display_text, '') = ''"),
        "verses: unknown book": unknown.where("book_order is not null"),
        "token_statistics: repeated term": terms.where("n > 1"),
        "token_statistics: total below document frequency": statistics.where("total_frequency < document_frequency"),
        "token_statistics: negative idf": statistics.where("idf < 0"),
        "books: order or testament": books.where("book_order not between 1 and 66 or testament not in ('OT', 'NT')"),
    }
    out = None
    for rule, broken in checks.items():
        row = broken.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out
