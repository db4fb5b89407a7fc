"""Counts over a corpus beyond its term statistics: bounds, survival, segments, repeated texts, postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.corpus import Corpus


def postings(corpus: Corpus, layer: str = "folded") -> DataFrame:
    """(key, id, positions) of one of the layers surface, folded and normalized."""
    return corpus.tokens.groupBy(F.col(layer).alias("key"), "id").agg(F.array_sort(F.collect_list("position")).alias("positions"))


def corpus_bounds(corpus: Corpus) -> DataFrame:
    """(measure, least, median, p95, most): words of a verse, letters of a word, frequency of a word, and
    repetition of a word in a verse. Quantiles are of the nearest rank."""
    vocabulary = corpus.tokens.groupBy("folded").agg(F.count(F.lit(1)).alias("n"))
    words = corpus.verses.select(F.size(text.surfaces(F.col("display_text"), corpus.pattern)).cast("bigint").alias("x")).where("x > 0")
    again = corpus.tokens.groupBy("id", "folded").agg(F.count(F.lit(1)).alias("x"))
    parts = {
        "verse_words": words,
        "word_letters": vocabulary.select(text.letters(F.col("folded")).cast("bigint").alias("x")),
        "corpus_frequency": vocabulary.select(F.col("n").alias("x")),
        "repetition": again.select("x"),
    }
    rank = lambda q: F.expr(f"percentile_disc({q}) within group (order by x)").cast("bigint")
    out = None
    for name, part in parts.items():
        row = part.agg(F.min("x").alias("least"), rank(0.5).alias("median"), rank(0.95).alias("p95"), F.max("x").alias("most"))
        row = row.select(F.lit(name).alias("measure"), "least", "median", "p95", "most")
        out = row if out is None else out.unionByName(row)
    return out


def repeated_texts(corpus: Corpus) -> DataFrame:
    """(display_text, multiplicity) of texts that stand in several verses."""
    return (
        corpus.verses.where("display_text is not null")
        .groupBy("display_text")
        .agg(F.count(F.lit(1)).alias("multiplicity"))
        .where("multiplicity > 1")
    )


def survival(counts: DataFrame, column: str) -> DataFrame:
    """(n, survivors): how many rows have at least n in a column of positive whole numbers, for each n to the greatest.

    The histogram is small; it is summed from its end.
    """
    histogram = counts.groupBy(F.col(column).cast("bigint").alias("n")).agg(F.count(F.lit(1)).alias("k")).where("n > 0")
    every = histogram.agg(F.max("n").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(1).cast("bigint"), "m")).alias("n"))
    later = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return every.join(F.broadcast(histogram), "n", "left").select("n", F.sum(F.coalesce("k", F.lit(0))).over(later).alias("survivors"))


def length_survival(corpus: Corpus) -> DataFrame:
    """How many words of the vocabulary have n letters or more."""
    return survival(corpus.tokens.select("folded").distinct().select(text.letters(F.col("folded")).alias("letters")), "letters")


def repetition_survival(corpus: Corpus) -> DataFrame:
    """How many pairs of word and verse have the word n times or more."""
    return survival(corpus.tokens.groupBy("id", "folded").agg(F.count(F.lit(1)).alias("times")), "times")


def character_frequency(corpus: Corpus) -> DataFrame:
    """(character, words): in how many words of the vocabulary a character stands."""
    words = corpus.tokens.select("folded").distinct()
    return words.select(F.explode(F.array_distinct(F.split("folded", ""))).alias("character")).where("character <> ''").groupBy("character").agg(
        F.count(F.lit(1)).alias("words")
    )


def segment_frequency(corpus: Corpus) -> DataFrame:
    """(position, fragment, words): in how many words of the vocabulary a fragment stands as the whole,
    initial, terminal or an internal part, and anywhere (`any`)."""
    words = corpus.tokens.select("folded").distinct().withColumn("n", F.length("folded"))
    fragments = (
        words.select("folded", "n", F.explode(F.sequence(F.lit(1), "n")).alias("a"))
        .select("folded", "n", "a", F.explode(F.sequence("a", "n")).alias("b"))
        .select(
            "folded",
            F.expr("substring(folded, a, b - a + 1)").alias("fragment"),
            F.when((F.col("a") == 1) & (F.col("b") == F.col("n")), "whole")
            .when(F.col("a") == 1, "initial")
            .when(F.col("b") == F.col("n"), "terminal")
            .otherwise("internal")
            .alias("at"),
        )
    )
    return (
        fragments.select("folded", "fragment", F.explode(F.array(F.col("at"), F.lit("any"))).alias("position"))
        .distinct()
        .groupBy("position", "fragment")
        .agg(F.count(F.lit(1)).alias("words"))
    )


def chapter_sizes(corpus: Corpus) -> DataFrame:
    """(book, chapter, verses, chapters): verses of each chapter, and the greatest chapter of its book."""
    sizes = corpus.verses.groupBy("book", "book_order", "chapter").agg(F.count(F.lit(1)).alias("verses"))
    return sizes.select("book", "chapter", "verses", F.max("chapter").over(Window.partitionBy("book_order")).alias("chapters"))
