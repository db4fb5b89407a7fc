"""Searches for related verses over whole tables: every current verse whose verse_id is divisible by
EVERY is a source, against all verses of its corpus version, in every version.

The queries of the same name without "every_" take one verse, as their SQL has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import many, search, second, statistics
from ..sources import ingest
from ..sources.corpus import REFERENCE, Corpus
from . import pair_sql, registry, second_queries, source_queries, study
from .registry import VERSION, Query, corpus, current_rows, sql, table
from .second_queries import LETTERS, sql2

EVERY = 50
#: The versions that the SQL is written out for; queries take the versions that they find.
VERSIONS = (1, 2, 3)


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "scoring_verses").select("verse_id", "loaded_at", "corpus_version_id", "reference")
    return current_rows(rows, "verse_id", "loaded_at").where("corpus_version_id is not null")


def versions(spark: SparkSession, sf_dir: str) -> list[int]:
    """The corpus versions of the current verses: a short list."""
    return sorted(r[0] for r in current(spark, sf_dir).select("corpus_version_id").distinct().collect())


def of_versions(f: Callable[[SparkSession, str, Corpus, int], DataFrame], pattern: str = text.TOKEN) -> Query:
    """The union of f(spark, sf_dir, corpus, version) over all versions, with corpus_version_id."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = None
        for version in versions(spark, sf_dir):
            rows = f(spark, sf_dir, corpus(spark, sf_dir, version, pattern), version)
            rows = rows.select(F.lit(version).cast("int").alias("corpus_version_id"), "*")
            out = rows if out is None else out.unionByName(rows)
        return out

    return run


def sources(spark: SparkSession, sf_dir: str, c: Corpus, version: int) -> DataFrame:
    """(source_id) of the verses that are searched for."""
    picked = current(spark, sf_dir).where((F.col("corpus_version_id") == version) & (F.col("verse_id") % EVERY == 0)).select("reference.*")
    return c.verses.join(picked.select(*REFERENCE), REFERENCE).select(F.col("id").alias("source_id"))


def every(f: Callable[[Corpus, DataFrame], DataFrame], *columns: str, pattern: str = text.TOKEN, flat: bool = False) -> Query:
    """columns of f(corpus, sources), with the labels of both verses."""

    def run(spark: SparkSession, sf_dir: str, c: Corpus, version: int) -> DataFrame:
        named = f(c, sources(spark, sf_dir, c, version)).withColumnRenamed("source_label", "reference")
        return study.flat(named, "reference") if flat else named.select("reference", "label", *columns)

    return of_versions(run, pattern)


def sql_of_versions(one: str) -> str:
    """A SQL of one version, written out for all."""
    mark = f"corpus_version_id = {VERSION}"
    assert mark in one
    return "\nunion all ".join(f"select cast({k} as int) as corpus_version_id, * from ({one.replace(mark, f'corpus_version_id = {k}')})" for k in VERSIONS)


SOURCES_SQL = f", p as (select * from v where verse_id % {EVERY} = 0)"


def _overlap_sql(layer: str, where: str = "true", rare: bool = False) -> str:
    common = "sum(case when w.document_frequency <= (select rare_threshold from scalars) then w.idf else 0 end) as rare"
    return sql(
        f"""{SOURCES_SQL}, w as (
  select distinct id, label, book_order, {layer} as key, idf, document_frequency from tok join stats using (normalized)
), q as (select id, sum(idf) as total from w group by id
), m as (
  select s.id as source_id, s.label as reference, w.id, w.label, sum(w.idf) as common, count(*) as shared, {common}
  from w join w s on s.key = w.key join p on p.id = s.id where w.id <> s.id and {where} group by all)
select reference, label, shared, round(common / (a.total + b.total - common), 6) as jaccard{", round(least(1, rare / 12), 6) as rare" if rare else ""}
from m join q a on a.id = m.id join q b on b.id = m.source_id"""
    )


def _overlap(level: str) -> Query:
    return every(lambda c, s: many.weighted_overlap(c, s, level), "shared", "jaccard")


WHOLE: dict[str, tuple[Query, str | None]] = {
    "every_related_candidates": (
        every(many.candidates),
        sql(f"{SOURCES_SQL} select distinct s.label as reference, t.label from tok t join tok s on s.folded = t.folded join p on p.id = s.id where t.id <> p.id"),
    ),
    "every_related_jaccard": (_overlap("exact_spelling"), _overlap_sql("folded")),
    "every_match_level_letter_exact": (_overlap("letter_exact"), _overlap_sql("surface")),
    "every_match_level_normalized": (_overlap("normalized"), _overlap_sql("normalized")),
    "every_related_rare": (every(many.components, "shared", "jaccard", "rare"), _overlap_sql("folded", rare=True)),
    "every_related_filtered": (every(lambda c, s: many.components(c, s, "OT"), "shared", "jaccard", "rare"), _overlap_sql("folded", "w.book_order <= 39", rare=True)),
    "every_related_full": (every(many.related, flat=True), pair_sql.EVERY_FULL),
    "every_related_many": (every(lambda c, s: many.related(c, s, 5), "rank", "score"), pair_sql.EVERY_MANY),
    "every_phrase_runs": (
        every(many.phrase_runs, "source_start", "target_start", "length"),
        sql(
            f"""{SOURCES_SQL}, m as (
  select s.label as reference, t.label, s.position as i, t.position as j from tok s join p on p.id = s.id join tok t on t.folded = s.folded and t.id <> p.id
), g as (select *, i - row_number() over (partition by reference, label, j - i order by i) as island from m)
select reference, label, min(i) as source_start, min(j) as target_start, count(*) as length from g group by reference, label, j - i, island having count(*) >= 3"""
        ),
    ),
    "every_candidate_mates": (every(many.candidate_mates, "rank", "score", "evidence_types"), pair_sql.EVERY_MATES),
    "every_lexical_witnesses": (every(many.lexical_witnesses, "witness", "score", "complete"), pair_sql.EVERY_WITNESSES),
    "every_weighted_dice": (
        every(many.weighted_dice, "dice", pattern=text.JOINED_TOKEN),
        sql2(
            f"""{SOURCES_SQL}, l as (select max({LETTERS}) as longest from vocab
), w as (
  select id, label, folded, count(*) * round(greatest(0, least(1, ln(1 + {LETTERS}) / ln(1 + any_value(longest)))), 6) as q from tok, l group by id, label, folded
), t as (select id, sum(q) as total from w group by id
), m as (
  select s.id as source_id, s.label as reference, w.id, w.label, sum(least(w.q, s.q)) as common
  from w join w s on s.folded = w.folded join p on p.id = s.id where w.id <> s.id group by all)
select reference, label, round(2 * common / (a.total + b.total), 6) as dice from m join t a on a.id = m.id join t b on b.id = m.source_id"""
        ),
    ),
    "every_proximity_axes": (
        every(many.proximity, "axes.*", "proximity", pattern=text.JOINED_TOKEN),
        sql2(
            r""", n as (
  select v.id, count(surface) as words, coalesce(sum(length(regexp_replace(surface, '[^\p{L}]', '', 'g'))), 0) as letters
  from v left join tok on tok.id = v.id group by v.id
), a as (
  select v.*, dense_rank() over (order by book_order, chapter) - 1 as c,
    sum(words) over w - words as ws, greatest(sum(words) over w - words, sum(words) over w - 1) as we,
    sum(letters) over w - letters as ls, greatest(sum(letters) over w - letters, sum(letters) over w - 1) as le
  from v join n on n.id = v.id window w as (order by v.id rows unbounded preceding)
), t as (
  select sum(words) as tw, sum(letters) as tl, count(*) as tv, (select count(distinct (book_order, chapter)) from v) as tc, (select max(book_order) from v) as tb from n
), p as (select * from a where verse_id % 50 = 0
), x as (
  select p.label as reference, a.label,
    greatest(0, 1 - ln(1 + greatest(0, a.ws - p.we - 1, p.ws - a.we - 1)) / ln(1 + greatest(1, tw - 1))) as word,
    greatest(0, 1 - abs(a.book_order - p.book_order) / greatest(1, tb - 1)) as book,
    greatest(0, 1 - ln(1 + greatest(0, a.ls - p.le - 1, p.ls - a.le - 1)) / ln(1 + greatest(1, tl - 1))) as letter,
    greatest(0, 1 - abs(a.id - p.id) / greatest(1, tv - 1)) as verse,
    greatest(0, 1 - abs(a.c - p.c) / greatest(1, tc - 1)) as chapter,
    case when (a.book_order <= 39) = (p.book_order <= 39) then 1.0 else 0.0 end as testament
  from a, p, t where a.id <> p.id)
select reference, label, round(word, 6) as word, round(book, 6) as book, round(letter, 6) as letter, round(verse, 6) as verse, round(chapter, 6) as chapter,
  cast(testament as double) as testament,
  round((1243 * word + 196 * book + 71 * letter + 33 * verse + 29 * chapter + 14 * testament) / 1586, 6) as proximity from x"""
        ),
    ),
}
WHOLE = {name: (q, s and sql_of_versions(s)) for name, (q, s) in WHOLE.items()}


def _tables() -> dict[str, tuple[Query, str | None]]:
    """Queries over all verses of every version, each version a corpus: NAME_of_versions for a query NAME of one."""

    def of(f: Callable[[Corpus], DataFrame], pattern: str = text.TOKEN) -> Query:
        return of_versions(lambda spark, sf_dir, c, version: f(c), pattern)

    def rows(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
        columns = ["verse_id", "loaded_at", "corpus_version_id", "reference", "source_book_code", "display_text", "italics", "paratext"]
        current = current_rows(table(spark, sf_dir, "scoring_verses").select(*columns), "verse_id", "loaded_at")
        return current.where(F.col("corpus_version_id") == version).select("reference.*", *columns[4:])

    found = {
        "tokenize": of(registry._tokens),
        "token_statistics": of(registry._rounded_statistics),
        "corpus_scalars": of(lambda c: c.scalars),
        "postings": of(statistics.postings),
        "exact_word": of(lambda c: search.exact_word(c, registry.WORD).select("label", "positions", "surfaces", "total", "total_occurrences")),
        "exact_word_case_sensitive": of(lambda c: search.exact_word(c, registry.CASED, case_sensitive=True).select("label", "positions")),
        "exact_phrase": of(lambda c: search.exact_phrase(c, registry.PHRASE).select("label", "start_positions", "total_occurrences")),
        "exact_phrase_case_sensitive": of(lambda c: search.exact_phrase(c, "And the", case_sensitive=True).select("label", "start_positions")),
        "exact_phrase_spelled": of(lambda c: search.exact_phrase_spelled(c, "river, and").select("label", F.size("start_positions").alias("times"))),
        "term_distribution": of(lambda c: search.term_distribution(c, registry.WORD)),
        "term_first_last": of(lambda c: search.term_summary(c, registry.WORD)),
        "corpus_bounds": of(statistics.corpus_bounds),
        "repeated_texts": of(statistics.repeated_texts),
        "length_survival": of(statistics.length_survival),
        "repetition_survival": of(statistics.repetition_survival),
        "character_frequency": of(statistics.character_frequency),
        "segment_frequency": of(statistics.segment_frequency),
        "chapter_sizes": of(statistics.chapter_sizes),
        "word_values": of(second_queries._word_values, text.JOINED_TOKEN),
        "text_identity": of(second.text_identities, text.JOINED_TOKEN),
        "import_counts": of_versions(lambda spark, sf_dir, c, v: ingest.counts(rows(spark, sf_dir, v).select("book_order", "chapter", "italics", "paratext"))),
        "canonical_json": of_versions(lambda spark, sf_dir, c, v: ingest.canonical_json(rows(spark, sf_dir, v)).select("value")),
    }
    single = registry.BASIC | study.STUDY | second_queries.SECOND | {"canonical_json": (None, source_queries.CANONICAL_SQL)}
    return {f"{name}_of_versions": (q, (s := single[name][1]) and sql_of_versions(s)) for name, q in found.items()}


WHOLE |= _tables()
