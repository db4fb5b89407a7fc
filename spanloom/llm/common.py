"""What the operators of this package share: current verses, staging, shuffle width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import staged

__all__ = ["current_verses", "normal", "read", "staged", "width"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normal(term: Column) -> Column:
    """The key of a term: lower case, straight apostrophe, no blanks at its ends."""
    return F.trim(F.translate(F.lower(term), "’", "'"))


def current_verses(verses: DataFrame) -> DataFrame:
    """(verse_id, corpus_version_id, terms) of the newest delivery of each verse.

    The newest is the greatest loaded_at; a null one is older than any other, and rows that tie
    are taken in the order of version and terms, so that the result is the same in every run. Null
    terms are left out; where both token columns are null the terms are empty. Rows without a
    verse_id are no verses. The maximum combines on the map side, so a verse delivered millions of
    times is no hot key.
    """
    entries = F.coalesce(F.col("normalized_tokens"), F.col("tokens.folded"), F.array().cast("array<string>"))
    row = F.struct(
        F.col("loaded_at").alias("at"),
        F.col("corpus_version_id").alias("version"),
        F.transform(F.filter(entries, lambda x: x.isNotNull()), normal).alias("terms"),
    )
    return (
        verses.where("verse_id is not null")
        .groupBy("verse_id")
        .agg(F.max(row).alias("row"))
        .select("verse_id", F.col("row.version").alias("corpus_version_id"), F.col("row.terms").alias("terms"))
    )


def width(spark: SparkSession) -> int:
    """How many partitions a shuffle has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
