"""Term statistics kept over a stream of texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..plans.storage import own_dir


def term_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """(normalized, document_frequency, total_frequency) of a stream or table of texts, each row a text.

    The terms of a text are sorted, so that a text counts for a term where its run begins: one
    aggregation is enough, and a stream holds one state row a term. Null texts count nothing.
    """
    words = F.sort_array(F.transform(text.surfaces(F.col(column)), lambda s: text.normalized(text.fold(s))))
    rows = texts.select(words.alias("words")).select("words", F.posexplode("words").alias("at", "normalized"))
    begins = (F.col("at") == 0) | (F.get("words", F.col("at") - 1) != F.col("normalized"))
    return rows.select("normalized", begins.alias("begins")).groupBy("normalized").agg(
        F.count_if("begins").alias("document_frequency"), F.count(F.lit(1)).alias("total_frequency")
    )


def refresh(spark: SparkSession, source: str, schema, where: str | None = None) -> DataFrame:
    """Runs the stream over what has arrived in a folder of parquet files, and gives the table that it keeps.

    A micro-batch writes the terms that it changes, under its number, so that one that is run again
    writes the same place; the table is the last row of each term. The stream's progress is kept in the
    shared folder too, so that a run that is lost goes on where it was.
    """
    home = where or f"{own_dir(spark)}/terms-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(source)
    query = (
        term_counts(stream)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{home}/progress")
        .trigger(availableNow=True)
        .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{home}/changes/batch={batch}"))
        .start()
    )
    query.awaitTermination()
    return current(spark, home)


def current(spark: SparkSession, home: str) -> DataFrame:
    """The table that a stream keeps in a folder: of each term, what the last batch that met it wrote."""
    last = F.max(F.struct("batch", "document_frequency", "total_frequency")).alias("last")
    rows = spark.read.parquet(f"{home}/changes").groupBy("normalized").agg(last)
    return rows.select("normalized", "last.document_frequency", "last.total_frequency")
