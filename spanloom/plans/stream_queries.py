"""Queries that run as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming import term_stream
from .registry import TOKEN_SQL, table


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "documents").select("doc_id", "text").schema
    return term_stream.refresh(spark, f"{sf_dir}/document[s].parquet", schema)  # a file or a folder


STREAMS = {
    "streaming_term_counts": (
        _terms,
        f"""with t as (
  select doc_id, replace(lower(replace(unnest(regexp_extract_all(text, '{TOKEN_SQL}')), 'İ', 'i̇')), '’', '''') as normalized from documents)
select normalized, count(distinct doc_id) as document_frequency, count(*) as total_frequency from t group by normalized""",
    ),
}
