"""How distinctive a term is of its record: residuals against the margins of the collection, and tf-idf.

The residuals of correspondence analysis come from row and column margins by plain column
arithmetic. They order terms otherwise than tf-idf does, so the ranking that p2_found asks for is
taken from the score computed beside them over the same margins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import current_verses, read

#: A term in more than one of so many records is hot: there are at most HOT_SHARE times as many hot
#: terms as a record has terms on average, so that their table is small whatever the collection's size.
HOT_SHARE = 500


def term_margins(records: DataFrame) -> DataFrame:
    """(version, term, df, total): in how many records a term stands, and how often."""
    return (
        records.groupBy("version", "term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    )


def record_terms(verses: DataFrame) -> DataFrame:
    """(verse_id, version, row_total, term, tf): a row a term of a current verse.

    tf is how often the term stands in the verse. Current verses lie partitioned by verse_id, so the
    count needs no shuffle.
    """
    return (
        verses.select(
            "verse_id",
            F.col("corpus_version_id").alias("version"),
            F.size("terms").alias("row_total"),
            F.explode("terms").alias("term"),
        )
        .groupBy("verse_id", "version", "row_total", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def scored_terms(verses: DataFrame) -> DataFrame:
    """(verse_id, version, term, tf, df, n, idf, score, expected, residual) of each term of a verse.

    residual is the adjusted standardised residual of tf in the table of records by terms of its
    version: (tf - e) / sqrt(e (1 - r/T) (1 - c/T)), e = r c / T, with the record's total r, the
    term's total c and the version's total T. It is null where the variance is nil (a version with
    one term only). score is (1 + ln tf) (ln((N + 1) / (df + 1)) + 1), rounded to 6 places. Verses
    without terms give no rows but count in N. A null version is a version.

    Hot terms meet their margins in a broadcast join (their number is bounded, see HOT_SHARE), so
    only the others are shuffled by term and no term's rows gather in one task.
    """
    size = verses.groupBy(F.col("corpus_version_id").alias("version_")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("all_total")
    )
    terms = record_terms(verses)
    margins = term_margins(terms).join(F.broadcast(size), F.col("version").eqNullSafe(F.col("version_"))).drop("version_")
    margins = margins.withColumnsRenamed({"version": "version_", "term": "term_"})
    hot = margins.where(F.col("df") * HOT_SHARE > F.col("n"))
    same = F.col("version").eqNullSafe(F.col("version_")) & (F.col("term") == F.col("term_"))
    either = terms.join(F.broadcast(hot), same, "left")
    met = either.where("df is not null").drop("version_", "term_")
    cold = margins.where(F.col("df") * HOT_SHARE <= F.col("n"))
    others = either.where("df is null").select(terms.columns).join(cold, same).drop("version_", "term_")
    return _scores(met.unionByName(others))


def _scores(rows: DataFrame) -> DataFrame:
    total = F.col("all_total")
    expected = F.col("row_total") * F.col("total") / total
    variance = expected * (1 - F.col("row_total") / total) * (1 - F.col("total") / total)
    idf = F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1
    return rows.withColumns({"idf": idf, "expected": expected}).withColumns(
        {
            "score": F.round((1 + F.ln("tf")) * idf, 6),
            "residual": F.when(variance > 0, (F.col("tf") - expected) / F.sqrt(variance)),
        }
    )


def first_terms(scored: DataFrame, by: Column, n: int) -> DataFrame:
    """The n first terms of each verse by `by` descending, then the term ascending."""
    order = Window.partitionBy("verse_id").orderBy(by.desc(), F.col("term").asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_terms(current_verses(read(spark, sf_dir, "scoring_verses")))
    return first_terms(scored, F.col("score"), 3).select("verse_id", F.col("term").alias("normalized"))


def p2_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of every current verse with its statistics, counted anew, and its residual."""
    rows = scored_terms(current_verses(read(spark, sf_dir, "scoring_verses")))
    return rows.select(
        "verse_id",
        F.col("term").alias("normalized"),
        "tf",
        F.col("df").alias("document_frequency"),
        F.round("idf", 6).alias("idf"),
        "score",
        F.round("residual", 4).alias("residual"),
    )


def _both_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(verse_id, term, by_score, by_residual) of terms with their places in both rankings of their verse."""
    scored = scored_terms(current_verses(read(spark, sf_dir, "scoring_verses")))
    of_verse = Window.partitionBy("verse_id")
    place = lambda by: F.row_number().over(of_verse.orderBy(by.desc_nulls_last(), F.col("term").asc()))
    return scored.select(
        "verse_id", "term", F.round("residual", 4).alias("residual"), place(F.col("score")).alias("by_score"), place(F.round("residual", 4)).alias("by_residual")
    )


def p2_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three terms of each current verse with the greatest residuals."""
    rows = _both_rankings(spark, sf_dir).where("by_residual <= 3")
    return rows.select("verse_id", F.col("term").alias("normalized"), F.col("by_residual").alias("rank"))


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: in how many places the first three terms by residual are the first three by score, of all such places."""
    rows = _both_rankings(spark, sf_dir)
    return rows.agg(
        F.count_if(F.col("by_score") <= 3).alias("places"), F.count_if((F.col("by_score") <= 3) & (F.col("by_residual") <= 3)).alias("agreeing")
    )


CURRENT_SQL = """
cv as (
  select verse_id, corpus_version_id as version, list_transform(
      coalesce(normalized_tokens, list_transform(tokens, lambda x: x.folded), []),
      lambda x: trim(replace(lower(x), '’', ''''), ' ')) as terms
  from (select *, row_number() over (partition by verse_id order by loaded_at desc) as rn from scoring_verses)
  where rn = 1)
"""

_SCORED_SQL = f"""
with {CURRENT_SQL}, n as (
  select version, count(*) as n, sum(len(terms)) as all_total from cv group by version
), t as (
  select verse_id, version, term, count(*) as tf
  from (select verse_id, version, unnest(terms) as term from cv) group by verse_id, version, term
), d as (
  select version, term, count(*) as df, sum(tf) as total from t group by version, term
), s as (
  select t.*, df, n, all_total, total, len(cv.terms) as row_total, ln((n + 1) / (df + 1)) + 1 as idf,
    round((1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1), 6) as score
  from t join d using (version, term) join n using (version) join cv using (verse_id))
"""

P2_SQL = f"""{_SCORED_SQL}
select verse_id, term as normalized from (
  select *, row_number() over (partition by verse_id order by score desc, term) as rn from s) where rn <= 3
"""

P2_RESIDUALS_SQL = f"""{_SCORED_SQL}
select verse_id, term as normalized, tf, df as document_frequency, round(idf, 6) as idf, score,
  round((tf - e) / sqrt(e * (1 - row_total / all_total) * (1 - total / all_total)), 4) as residual
from (select *, cast(row_total as double) * total / all_total as e from s)
"""

_PLACES_SQL = f"""
select verse_id, normalized, row_number() over (partition by verse_id order by score desc, normalized) as by_score,
  row_number() over (partition by verse_id order by residual desc nulls last, normalized) as by_residual
from ({P2_RESIDUALS_SQL})
"""

P2_RANKING_SQL = f"select verse_id, normalized, by_residual as rank from ({_PLACES_SQL}) where by_residual <= 3"

P2_AGREEMENT_SQL = f"""
select count(*) filter (by_score <= 3) as places, count(*) filter (by_score <= 3 and by_residual <= 3) as agreeing from ({_PLACES_SQL})
"""
