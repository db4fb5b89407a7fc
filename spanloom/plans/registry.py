"""The queries of the library by name, with the SQL that states each result.

Every query runs over whole tables: the corpus is all current verses of one corpus version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import refs, text
from ..operators import search, statistics
from ..sources.corpus import Corpus, current_rows  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
VERSION = 1
WORD, CASED, PHRASE = "river", "And", "unto the"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_prepared: dict[tuple, Corpus] = {}


def corpus(spark: SparkSession, sf_dir: str, version: int = VERSION, pattern: str = text.TOKEN) -> Corpus:
    """The corpus of a version, prepared once a session and folder: queries then read its tables."""
    key = (spark.sparkContext.applicationId, sf_dir, version, pattern)
    if key not in _prepared:
        _prepared[key] = Corpus.of_deliveries(table(spark, sf_dir, "scoring_verses"), version, pattern=pattern).prepared()
    return _prepared[key]


def preparations() -> dict[str, Callable[[SparkSession, str], object]]:
    """What queries find prepared in a session, by name: each makes and keeps it."""
    from ..operators.second import Second
    from .second_queries import joined

    def second(spark: SparkSession, sf_dir: str) -> None:
        tables = Second.of(joined(spark, sf_dir))
        tables.vocabulary, tables.axes, tables.features

    def first(spark: SparkSession, sf_dir: str) -> None:
        tables = corpus(spark, sf_dir)
        tables.tokens, tables.statistics, tables.features

    return {"prepare_corpus": first, "prepare_second": second}


def probe(spark: SparkSession, sf_dir: str, nth: int = 0) -> refs.ReferenceRange:
    """The place of the current verse with the nth smallest verse_id: a reference that every table has."""
    rows = table(spark, sf_dir, "scoring_verses").where(F.col("corpus_version_id") == VERSION).select("verse_id", "reference")
    found = None
    for _ in range(nth + 1):  # a minimum each, instead of a sort
        later = rows.where(F.col("verse_id") > found.verse_id) if found else rows
        found = later.agg(F.min(F.struct("verse_id", "reference")).alias("place")).first().place
    row = found.reference
    return refs.Books.of(table(spark, sf_dir, "books")).parse(f"{row.book} {row.chapter}:{row.verse}")


def on_corpus(f: Callable[[Corpus], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(corpus(spark, sf_dir))


TOKEN_SQL = r"[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*"
CORPUS_SQL = f"""
v as (
  select row_number() over (order by reference.book_order, reference.chapter, reference.verse) - 1 as id, verse_id,
    reference.book as book, reference.book_order as book_order, reference.chapter as chapter, reference.verse as verse,
    reference.book || ' ' || reference.chapter || ':' || reference.verse as label, display_text
  from (select *, row_number() over (partition by verse_id order by loaded_at desc) as rn from scoring_verses)
  where rn = 1 and corpus_version_id = {VERSION}
), tok as (
  select id, book, book_order, chapter, verse, label, surface, position, lower(surface) as folded,
    replace(lower(surface), '’', '''') as normalized
  from (
    select *, unnest(s) as surface, generate_subscripts(s, 1) - 1 as position
    from (select *, regexp_extract_all(display_text, '{TOKEN_SQL}') as s from v))
), stats as (
  select normalized, count(distinct id) as document_frequency, count(*) as total_frequency,
    ln(((select count(*) from v) + 1) / (count(distinct id) + 1)) + 1 as idf
  from tok group by normalized
), scalars as (
  select (select count(*) from v) as corpus_size, count(*) as vocabulary_size,
    quantile_disc(document_frequency, 0.2) as rare_threshold from stats
), vocab as (
  select folded, count(*) as n, count(distinct id) as verses from tok group by folded
)
"""


def sql(body: str) -> str:
    return f"with {CORPUS_SQL} {body}"


def _tokens(c: Corpus) -> DataFrame:
    return c.tokens.select("id", "position", "char_start", "char_end", "surface", "folded", "normalized")


def _rounded_statistics(c: Corpus) -> DataFrame:
    return c.statistics.withColumn("idf", F.round("idf", 9))


def _book_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses joined with the table of books and the corpus versions' names."""
    verses = table(spark, sf_dir, "scoring_verses").select("verse_id", "corpus_version_id", F.col("reference.book_order").alias("book_order")).distinct()
    versions = table(spark, sf_dir, "corpus_statistics").select("corpus_version_id", "corpus_version").distinct()
    books = table(spark, sf_dir, "books").select("book_order", "osis", "testament")
    joined = verses.join(F.broadcast(books), "book_order").join(F.broadcast(versions), "corpus_version_id")  # fixed tables
    return joined.groupBy("corpus_version", "osis", "testament").agg(F.countDistinct("verse_id").alias("verses"))


BASIC: dict[str, tuple[Query, str | None]] = {
    "tokenize": (
        on_corpus(_tokens),
        sql(
            """, pieces as (
  select id, display_text, position, surface, folded, normalized,
    sum(length(surface)) over w - length(surface) as before
  from tok join v using (id) window w as (partition by id order by position rows unbounded preceding)
), cut as (
  -- the text between the tokens: what is left when every token is cut out
  select id, unnest(g) as gap, generate_subscripts(g, 1) - 1 as position
  from (select id, regexp_split_to_array(display_text, '%s') as g from v where display_text is not null)
), gaps as (
  select id, position, sum(length(gap)) over (partition by id order by position rows unbounded preceding) as gapped from cut
)
select id, position, cast(before + gapped as int) as char_start, cast(before + gapped + length(surface) as int) as char_end,
  surface, folded, normalized
from pieces join gaps using (id, position)"""
            % TOKEN_SQL
        ),
    ),
    "token_statistics": (
        on_corpus(_rounded_statistics),
        sql("select normalized, document_frequency, total_frequency, round(idf, 9) as idf from stats"),
    ),
    "corpus_scalars": (on_corpus(lambda c: c.scalars), sql("select * from scalars")),
    "postings": (
        on_corpus(lambda c: statistics.postings(c)),
        sql("select folded as key, id, list_sort(list(position)) as positions from tok group by folded, id"),
    ),
    "exact_word": (
        on_corpus(lambda c: search.exact_word(c, WORD).select("label", "positions", "surfaces", "total", "total_occurrences")),
        sql(
            f""", m as (
  select label, list(position order by position) as positions, list(surface order by position) as surfaces
  from tok where folded = '{WORD}' group by label)
select *, (select count(*) from m) as total, (select sum(len(positions)) from m) as total_occurrences from m"""
        ),
    ),
    "exact_word_case_sensitive": (
        on_corpus(lambda c: search.exact_word(c, CASED, case_sensitive=True).select("label", "positions")),
        sql(f"select label, list(position order by position) as positions from tok where surface = '{CASED}' group by label"),
    ),
    "exact_word_limited": (
        on_corpus(lambda c: search.exact_word(c, WORD, limit=20).select("label", "total")),
        sql(
            f"""select label, count(*) over () as total from (select distinct label, book_order, chapter, verse from tok where folded = '{WORD}')
order by book_order, chapter, verse limit 20"""
        ),
    ),
    "exact_phrase": (
        on_corpus(lambda c: search.exact_phrase(c, PHRASE).select("label", "start_positions", "total_occurrences")),
        sql(
            """, m as (select a.label, list(a.position order by a.position) as start_positions
  from tok a join tok b on a.id = b.id and b.position = a.position + 1 where a.folded = 'unto' and b.folded = 'the' group by a.label)
select *, (select sum(len(start_positions)) from m) as total_occurrences from m"""
        ),
    ),
    "exact_phrase_case_sensitive": (
        on_corpus(lambda c: search.exact_phrase(c, "And the", case_sensitive=True).select("label", "start_positions")),
        sql(
            """select a.label, list(a.position order by a.position) as start_positions
from tok a join tok b on a.id = b.id and b.position = a.position + 1 where a.surface = 'And' and b.surface = 'the' group by a.label"""
        ),
    ),
    "exact_phrase_spelled": (
        on_corpus(lambda c: search.exact_phrase_spelled(c, "river, and").select("label", F.size("start_positions").alias("times"))),
        sql(
            r"""select label, len(regexp_extract_all(lower(display_text), '(^|[^\p{L}\p{N}''’])river, and([^\p{L}\p{N}''’]|$)')) as times
from v where regexp_matches(lower(display_text), '(^|[^\p{L}\p{N}''’])river, and([^\p{L}\p{N}''’]|$)')"""
        ),
    ),
    "term_distribution": (
        on_corpus(lambda c: search.term_distribution(c, WORD)),
        sql(f"select book, book_order, count(distinct id) as verses, count(*) as occurrences from tok where folded = '{WORD}' group by book, book_order"),
    ),
    "term_first_last": (
        on_corpus(lambda c: search.term_summary(c, WORD)),
        sql(f"select count(distinct id) as verse_frequency, count(*) as total_frequency, arg_min(label, id) as first_mention, arg_max(label, id) as last_mention from tok where folded = '{WORD}'"),
    ),
    "passage_context": (
        lambda spark, sf_dir: search.passage(corpus(spark, sf_dir), probe(spark, sf_dir), 3),
        sql(
            """, p as (select id, book_order from v order by verse_id limit 1)
select v.id, label, display_text, v.id = p.id as requested from v, p where abs(v.id - p.id) <= 3 and v.book_order = p.book_order"""
        ),
    ),
    "passage_across_books": (
        lambda spark, sf_dir: search.passage(corpus(spark, sf_dir), probe(spark, sf_dir), 20, same_book=False),
        sql(
            """, p as (select id from v order by verse_id limit 1)
select v.id, label, display_text, v.id = p.id as requested from v, p where abs(v.id - p.id) <= 20"""
        ),
    ),
    "books_and_versions": (
        _book_counts,
        """select c.corpus_version, osis, testament, count(distinct verse_id) as verses
from scoring_verses s join books b on b.book_order = s.reference.book_order
join (select distinct corpus_version_id, corpus_version from corpus_statistics) c using (corpus_version_id) group by all""",
    ),
    "corpus_bounds": (
        on_corpus(statistics.corpus_bounds),
        sql(
            r""", x as (
  select 'verse_words' as measure, count(*) as x from tok group by id
  union all select 'word_letters', length(regexp_replace(folded, '[^\p{L}]', '', 'g')) from vocab
  union all select 'corpus_frequency', n from vocab
  union all select 'repetition', count(*) from tok group by id, folded)
select measure, min(x) as least, quantile_disc(x, 0.5) as median, quantile_disc(x, 0.95) as p95, max(x) as most from x group by measure"""
        ),
    ),
    "repeated_texts": (
        on_corpus(statistics.repeated_texts),
        sql("select display_text, count(*) as multiplicity from v where display_text is not null group by display_text having count(*) > 1"),
    ),
    "length_survival": (
        on_corpus(statistics.length_survival),
        sql(
            r""", l as (select length(regexp_replace(folded, '[^\p{L}]', '', 'g')) as x from vocab)
select n, (select count(*) from l where x >= n) as survivors from range(1, (select max(x) + 1 from l)) t(n)"""
        ),
    ),
    "repetition_survival": (
        on_corpus(statistics.repetition_survival),
        sql(
            """, l as (select count(*) as x from tok group by id, folded)
select n, (select count(*) from l where x >= n) as survivors from range(1, (select max(x) + 1 from l)) t(n)"""
        ),
    ),
    "character_frequency": (
        on_corpus(statistics.character_frequency),
        sql("select character, count(distinct folded) as words from (select folded, unnest(string_split(folded, '')) as character from vocab) group by character"),
    ),
    "segment_frequency": (
        on_corpus(statistics.segment_frequency),
        sql(
            """, f as (
  select folded, substr(folded, a, b - a + 1) as fragment,
    case when a = 1 and b = length(folded) then 'whole' when a = 1 then 'initial' when b = length(folded) then 'terminal' else 'internal' end as position
  from (select folded, a, unnest(range(a, length(folded) + 1)) as b from (select folded, unnest(range(1, length(folded) + 1)) as a from vocab)))
select position, fragment, count(distinct folded) as words from (select * from f union all select folded, fragment, 'any' from f) group by position, fragment"""
        ),
    ),
    "chapter_sizes": (
        on_corpus(statistics.chapter_sizes),
        sql("select book, chapter, verses, max(chapter) over (partition by book) as chapters from (select book, chapter, count(*) as verses from v group by book, chapter)"),
    ),
}


def every() -> dict[str, tuple[Query, str | None]]:
    from . import form_queries, measure_sql, second_queries, source_queries, stream_queries, study, whole_queries

    family = {"word_family": (second_queries.SECOND["word_family"][0], form_queries.WORD_FAMILY)}
    measures = {"second_measures": (second_queries.second_measures, measure_sql.MEASURES)}
    lines = {"canonical_json": (study.STUDY["canonical_json"][0], source_queries.CANONICAL_SQL)}
    return BASIC | study.STUDY | lines | second_queries.SECOND | family | measures | form_queries.FORMS | source_queries.SOURCES | stream_queries.STREAMS | whole_queries.WHOLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return every()["related_full"][0](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in every().items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for name, (_, s) in every().items() if s}
