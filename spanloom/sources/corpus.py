"""A corpus: verses in canonical order, their tokens, and what is counted over them."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric, refs, text
from ..plans.config import TESTAMENT_CUT
from ..plans.errors import NotFound
from ..plans.storage import own_dir

REFERENCE = ["book_order", "chapter", "verse"]


def current_rows(deliveries: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key by the column `at` (null is oldest), whole; equal rows come out once."""
    rest = [c for c in deliveries.columns if c not in (key, at)]
    newest = F.max(F.struct(at, *rest)).alias("row")
    return deliveries.where(F.col(key).isNotNull()).groupBy(key).agg(newest).select(key, *(F.col(f"row.{c}").alias(c) for c in (at, *rest)))


def canonical_ids(verses: DataFrame) -> DataFrame:
    """verses with id, the place in canonical order from 0, and chapter_ordinal.

    Verses are numbered within their chapter; a chapter's first number comes from the table of
    chapters, which is small, so that no task sorts the whole corpus.
    """
    chapters = verses.groupBy("book_order", "chapter").agg(F.count(F.lit(1)).alias("size"))
    order = Window.orderBy("book_order", "chapter")
    first = chapters.select(
        F.col("book_order").alias("b_"),
        F.col("chapter").alias("c_"),
        (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("first_"),
        (F.row_number().over(order) - 1).alias("chapter_ordinal"),
    )
    within = F.row_number().over(Window.partitionBy("book_order", "chapter").orderBy("verse"))
    return (
        verses.withColumn("within_", within)
        .join(first, (F.col("book_order") == F.col("b_")) & (F.col("chapter") == F.col("c_")))
        .withColumn("id", (F.col("first_") + F.col("within_") - 1).cast("bigint"))
        .drop("b_", "c_", "first_", "within_")
    )


class Corpus:
    """Lazily built tables of one corpus version. They can be written once and read again."""

    def __init__(self, verses: DataFrame, version: str = "", pattern: str = text.TOKEN):
        """verses: book, book_order, chapter, verse, display_text; a key of the first four is unique."""
        self.spark: SparkSession = verses.sparkSession
        self.version, self.pattern, self.is_written, self.path = version, pattern, False, None
        columns = ["book", *REFERENCE, "display_text"]
        self.verses = canonical_ids(verses.select(*columns)).withColumn("label", refs.label(F.col("book"), F.col("chapter"), F.col("verse")))

    @classmethod
    def of_deliveries(cls, scoring_verses: DataFrame, version_id: int, **kw) -> Corpus:
        rows = current_rows(
            scoring_verses.select("verse_id", "loaded_at", "corpus_version_id", "display_text", "reference"), "verse_id", "loaded_at"
        ).where(F.col("corpus_version_id") == version_id)
        return cls(rows.select("reference.*", "display_text"), str(version_id), **kw)

    @classmethod
    def of_lines(cls, rows: DataFrame, **kw) -> Corpus:
        return cls(rows, **kw)

    @cached_property
    def tokens(self) -> DataFrame:
        """A row a token: the verse's key, position, offsets, and the three layers of its form.

        Written sorted by form, so that a search for a word reads the few row groups that can hold it.
        """
        rows = self._token_rows()
        return self._kept("tokens", rows.repartitionByRange("folded").sortWithinPartitions("folded", "id") if self.path else rows)

    def _token_rows(self) -> DataFrame:
        rows = text.token_rows(self.verses.select("id", "book", *REFERENCE, "display_text"), "display_text", self.pattern)
        return rows.withColumn("normalized", text.normalized(F.col("folded")))

    @cached_property
    def statistics(self) -> DataFrame:
        """(normalized, document_frequency, total_frequency, idf) of every normalized form.

        Counted a verse at a time first, so that frequent forms are pre-aggregated before the shuffle.
        """
        per_verse = self.verses.select(F.explode(text.surfaces(F.col("display_text"), self.pattern)).alias("s"), "id").groupBy(
            "id", text.normalized(text.fold(F.col("s"))).alias("normalized")
        ).agg(F.count(F.lit(1)).alias("n"))
        counted = per_verse.groupBy("normalized").agg(
            F.count(F.lit(1)).alias("document_frequency"), F.sum("n").alias("total_frequency")
        )
        size = self.verses.agg(F.count(F.lit(1)).alias("size"))
        rows = counted.crossJoin(F.broadcast(size)).select(  # one row
            "normalized",
            "document_frequency",
            "total_frequency",
            numeric.idf(F.col("size"), F.col("document_frequency")).alias("idf"),
        )
        return self._kept("statistics", rows)

    @cached_property
    def scalars(self) -> DataFrame:
        """One row: corpus_size, vocabulary_size, rare_threshold (the df at place ceil(V / 5))."""
        stats = self.statistics.agg(
            F.count(F.lit(1)).alias("vocabulary_size"),
            F.coalesce(F.expr("percentile_disc(0.2) within group (order by document_frequency)"), F.lit(0)).cast("bigint").alias("rare_threshold"),
        )
        return self.verses.agg(F.count(F.lit(1)).alias("corpus_size")).crossJoin(stats)

    @cached_property
    def size_and_threshold(self) -> tuple[int, int]:
        row = self.scalars.first()
        return row.corpus_size, row.rare_threshold

    @cached_property
    def features(self) -> DataFrame:
        """A row a verse with arrays over its tokens: surfaces, folded, normalized, df and sentence starts.

        What pair scoring needs. Built once a corpus: tokens meet their statistics in a join, which
        the engine may broadcast or shuffle (and split where terms are very frequent), and are
        gathered by verse.
        """
        return self._kept("features", self._features(F.lit(True)))

    def _features(self, where: Column) -> DataFrame:
        """features of the verses that a condition on book_order, chapter and verse picks."""
        tokens = self.tokens if "tokens" in self.__dict__ else self._token_rows()  # what isn't written needn't be for this
        rows = (
            tokens.where(where)
            .join(self.statistics.select("normalized", "document_frequency"), "normalized")
            .groupBy("id")
            .agg(
                F.array_sort(
                    F.collect_list(F.struct("position", "char_start", "char_end", "surface", "folded", "normalized", "document_frequency"))
                ).alias("t")
            )
        )
        gap = lambda x, i: F.col("display_text").substr(
            F.get("t", i - 1).char_end + 1, F.greatest(F.lit(0), x.char_start - F.get("t", i - 1).char_end)
        )
        empty = lambda kind: F.array().cast(f"array<{kind}>")
        return self.verses.where(where).join(rows, "id", "left").select(
            "id",
            "label",
            "book",
            *REFERENCE,
            "display_text",
            *(F.coalesce(F.col(f"t.{c}"), empty("string")).alias(c) for c in ("surface", "folded", "normalized")),
            F.coalesce(F.col("t.document_frequency"), empty("bigint")).alias("df"),
            F.coalesce(
                F.transform("t", lambda x, i: (i == 0) | F.coalesce(gap(x, i).rlike(text.SENTENCE_END), F.lit(False))), empty("boolean")
            ).alias("starts"),
        )

    def write(self, path: str) -> None:
        """The tables that queries read; those of tokens, statistics and features are built from what is already written."""
        half = self._begun(path)
        half.tokens, half.statistics, half.features

    def _begun(self, path: str) -> Corpus:
        """The same corpus over written verses; each other table is written there when it is first asked for."""
        self.verses.write.parquet(f"{path}/verses")
        half = Corpus._of(self.spark.read.parquet(f"{path}/verses"), self.version, self.pattern)
        half.path = path
        return half

    def _kept(self, name: str, rows: DataFrame) -> DataFrame:
        if not self.path:
            return rows
        rows.write.parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    @classmethod
    def _of(cls, verses: DataFrame, version: str, pattern: str) -> Corpus:
        self = cls.__new__(cls)
        self.spark, self.verses, self.version, self.pattern, self.is_written, self.path = verses.sparkSession, verses, version, pattern, False, None
        return self

    @classmethod
    def read(cls, spark: SparkSession, path: str, version: str = "", pattern: str = text.TOKEN) -> Corpus:
        """A corpus whose tables were written: nothing is tokenised or counted again."""
        self = cls._of(spark.read.parquet(f"{path}/verses"), version, pattern)
        for name in ("tokens", "statistics", "features"):
            self.__dict__[name] = spark.read.parquet(f"{path}/{name}")
        self.is_written = True
        return self

    def prepared(self) -> Corpus:
        """The same corpus over tables in the shared folder, each built once, when it is first asked for:
        what no query needs takes neither time nor disk."""
        half = self._begun(f"{own_dir(self.spark)}/corpus-{uuid.uuid4().hex}")
        half.is_written = True
        return half

    def verse(self, reference: refs.Reference):
        """The feature row of one verse."""
        here = (F.col("book_order") == reference.book_order) & (F.col("chapter") == reference.chapter) & (F.col("verse") == reference.verse)
        row = (self.features.where(here) if self.is_written else self._features(here)).first()
        if row is None:
            raise NotFound(f"not in the corpus: {reference}")
        return row


def in_testament(which: str | None, cut: int = TESTAMENT_CUT):
    """A predicate on book_order; all for None."""
    if which is None:
        return F.lit(True)
    return F.col("book_order") <= cut if which == "OT" else F.col("book_order") > cut
