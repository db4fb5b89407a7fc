"""Queries over sources and sinks: lines with their places, issues, markup, canonical lines and digests, dictionaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ingest, wordnet
from . import registry
from .config import ScoringConfig
from .pair_sql import ENDS_SQL
from .registry import TOKEN_SQL, VERSION, current_rows, on_corpus, sql, table
from .storage import own_dir, write_text

COLUMNS = ["verse_id", "loaded_at", "corpus_version_id", "reference", "source_book_code", "display_text", "italics", "paratext"]


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_rows(table(spark, sf_dir, "scoring_verses").select(*COLUMNS), "verse_id", "loaded_at")
    return rows.where(F.col("corpus_version_id") == VERSION)


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current verses written as a source of text files, in the order of their ids, and read as lines."""
    place = F.concat(F.col("reference.chapter").cast("string"), F.lit(":"), F.col("reference.verse").cast("string"))
    rows = _current(spark, sf_dir).select("verse_id", F.concat_ws(" ", "source_book_code", place, "display_text").alias("record"))
    path = f"{own_dir(spark)}/lines-{uuid.uuid4().hex}"
    rows.repartitionByRange("verse_id").sortWithinPartitions("verse_id").select("record").write.option("lineSep", "\r\n").text(path)
    return ingest.read_lines(spark, path, "UTF-8")


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = ingest.parse_records(_source(spark, sf_dir), table(spark, sf_dir, "books"))
    return ingest.issues(records.where(F.col("display_text") != ""))


def _markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side texts and the first added words put back as marks, and read from them again."""
    rows = _current(spark, sf_dir).where("display_text is not null")
    text, span = F.translate("display_text", "[]<>", ""), F.get("italics", F.lit(0))
    marked = F.concat(text.substr(F.lit(1), span.start), F.lit("["), text.substr(span.start + 1, span.end - span.start), F.lit("]"), text.substr(span.end + 1, F.length(text)))
    sides = F.array_join(F.transform(F.coalesce("paratext", F.array().cast("array<struct<type:string,raw:string,text:string>>")), lambda x: F.concat(F.lit("<<"), F.translate(x.raw, "<>", ""), F.lit(">>"))), "")
    body = F.concat(F.coalesce(marked, text), sides)
    parsed = rows.select("verse_id", ingest.side_texts(body).alias("sides"), ingest.added_words(F.regexp_replace(body, ingest.SIDE_TEXT, "")).alias("cut"))
    return parsed.select(
        "verse_id",
        F.transform("sides", lambda x: x.type).alias("types"),
        F.transform("sides", lambda x: x.text).alias("texts"),
        F.col("cut.display").alias("display"),
        F.transform("cut.spans", lambda x: x.start).alias("starts"),
        F.transform("cut.spans", lambda x: x.end).alias("ends"),
        F.col("cut.unbalanced").alias("unbalanced"),
    )


def _verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _current(spark, sf_dir).select("reference.*", "source_book_code", "display_text", "italics", "paratext")


def _roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses written as canonical lines and read again, their number checked."""
    verses = _verses(spark, sf_dir)
    path = f"{own_dir(spark)}/canonical-{uuid.uuid4().hex}"
    ingest.write_canonical(verses, path)
    read = ingest.read_canonical(spark, path, verses.count())
    spans = F.transform("italics", lambda x: F.concat_ws(" ", x.start, x.end, x.source))
    sides = F.transform("paratext", lambda x: F.concat_ws(" ", x.type, x.text))
    return read.select("book_order", "chapter", "verse", "book", "source_book_code", "display_text", spans.alias("spans"), sides.alias("sides"))


def _starts(c) -> DataFrame:
    at = F.filter(F.transform("starts", lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    return c.features.where(F.size("surface") > 0).select("label", at.alias("positions"))


def _digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of the scoring parameters over the corpus: a digest of their stable JSON."""
    n, threshold = registry.corpus(spark, sf_dir).size_and_threshold
    rows = [(level, ScoringConfig(level).sha256(threshold)) for level in ("letter_exact", "exact_spelling", "normalized")]
    return spark.createDataFrame(rows, "match_level string, sha256 string")


# A small dictionary in the form of its files: an index line names the places of a word's senses.
DICTIONARY = {
    "index.noun": "river n 1 1 @ 1 0 00000100\nlamp n 2 1 @ 2 0 00000200 00000300\nburning_lamp n 1 1 @ 1 0 00000300\nbroken n 2 1 @ 2 0 00000200\n",
    "data.noun": "00000100 17 n 02 river 0 stream_of_water 0 001 @ 00000001 n 0000 | a large stream; \"the river runs\"\n"
    "00000200 06 n 01 lamp 0 000 | an artificial light\n00000300 06 n 03 lamp 0 lantern 0 burning_lamp 0 000 | a light that is carried; \"a lamp\"; \"more\"\n00000400 06 x 01 odd 0 000 | no such letter\n",
    "index.verb": "lamp v 1 0 1 0 00000500\n",
    "data.verb": "00000500 30 v 01 lamp 0 000 | to strike\n",
    "index.adj": "",
    "data.adj": "",
    "index.adv": "",
    "data.adv": "",
}


def _senses(spark: SparkSession, _: str) -> DataFrame:
    root = f"{own_dir(spark)}/dictionary-{uuid.uuid4().hex}"
    for name, content in DICTIONARY.items():
        write_text(spark, f"{root}/{name}", "  1 a header line\n" + content)
    return wordnet.senses(wordnet.read_index(spark, root), wordnet.read_data(spark, root))


SENSES_SQL = """
select * from (values
  ('river', 0, 'wn30:n:00000100', 'noun', 'a large stream', ['river', 'stream of water']),
  ('lamp', 0, 'wn30:n:00000200', 'noun', 'an artificial light', ['lamp']),
  ('lamp', 1, 'wn30:n:00000300', 'noun', 'a light that is carried', ['lamp', 'lantern', 'burning lamp']),
  ('burning lamp', 0, 'wn30:n:00000300', 'noun', 'a light that is carried', ['lamp', 'lantern', 'burning lamp']),
  ('lamp', 10000, 'wn30:v:00000500', 'verb', 'to strike', ['lamp'])) as t(headword, ordinal, sense_id, part_of_speech, definition, synonyms)
"""

_CURRENT_SQL = f"""c as (
  select * from (select *, row_number() over (partition by verse_id order by loaded_at desc) as rn from scoring_verses)
  where rn = 1 and corpus_version_id = {VERSION})"""
_LINES_SQL = f"""{_CURRENT_SQL}, r as (
  select verse_id, concat_ws(' ', source_book_code, reference.chapter || ':' || reference.verse, display_text) as record from c
), s as (
  select row_number() over (order by verse_id) as line, record, octet_length(encode(record)) as n from r
), l as (
  select line, record, sum(n + 2) over (order by line) - n - 2 as byte_start, sum(n + 2) over (order by line) - 2 as byte_end from s)"""
_VALUE_SQL = """'{"reference":{"book":' || to_json(reference.book) || ',"bookOrder":' || reference.book_order || ',"chapter":' || reference.chapter || ',"verse":' || reference.verse || '}'
  || coalesce(',"sourceBookCode":' || to_json(source_book_code), '') || coalesce(',"displayText":' || to_json(display_text), '')
  || coalesce(',"italics":[' || array_to_string(list_transform(italics, lambda x: '{"start":' || x.start || ',"end":' || x."end" || ',"source":' || to_json(x.source) || '}'), ',') || ']', '')
  || coalesce(',"paratext":[' || array_to_string(list_transform(paratext, lambda x: '{"type":' || to_json(x.type) || ',"raw":' || to_json(x.raw) || ',"text":' || to_json(x.text) || '}'), ',') || ']', '') || '}'"""

CANONICAL_SQL = f"with {_CURRENT_SQL} select {_VALUE_SQL} as value from c"

SOURCES = {
    "import_provenance": (
        _source,
        f"with {_LINES_SQL} select cast(line as int) as line, record, cast(byte_start as bigint) as byte_start, cast(byte_end as bigint) as byte_end from l",
    ),
    "import_issues": (
        _issues,
        rf"""with {_LINES_SQL}, m as (
  select line, regexp_extract(record, '^([1-3]?[A-Za-z]+) (\d+):(\d+) (.+)$', 1) as code, try_cast(regexp_extract(record, '^([1-3]?[A-Za-z]+) (\d+):(\d+) (.+)$', 2) as int) as chapter,
    try_cast(regexp_extract(record, '^([1-3]?[A-Za-z]+) (\d+):(\d+) (.+)$', 3) as int) as verse, trim(regexp_replace(regexp_extract(record, '^([1-3]?[A-Za-z]+) (\d+):(\d+) (.+)$', 4), '<<(.+?)>>', '', 'g')) as bare
  from l
), p as (
  select m.*, b.name as book, b.book_order from m left join books b on b.osis = m.code where replace(replace(bare, '[', ''), ']', '') <> ''
), k as (
  select *, book || ' ' || chapter || ':' || verse as reference, lag(book_order) over w as pb, lag(chapter) over w as pc, lag(verse) over w as pv,
    row_number() over (partition by book_order, chapter, verse order by line) as again
  from p where book is not null window w as (order by line)
)
select 'unknown_book_code' as code, line, null as reference from p where book is null
union all select 'duplicate_reference', line, reference from k where again > 1
union all select 'unbalanced_paratext', line, reference from k where contains(bare, '<<') or contains(bare, '>>')
union all select 'unbalanced_italics', line, reference from k where length(replace(bare, '[', '')) <> length(replace(bare, ']', ''))
union all select 'nonconsecutive_reference', line, reference from k where pb is not null and not (
  (book_order = pb and chapter = pc and verse = pv + 1) or (book_order = pb and chapter = pc + 1 and verse = 1) or (book_order = pb + 1 and chapter = 1 and verse = 1))""",
    ),
    "import_markup": (
        _markup,
        f"""with {_CURRENT_SQL}
select verse_id, coalesce(list_transform(paratext, lambda x: case when contains(lower(translate(x.raw, '[]<>', '')), 'the end') then 'terminal'
    when contains(lower(translate(x.raw, '[]<>', '')), 'written') or contains(lower(translate(x.raw, '[]<>', '')), 'epistle') then 'subscription' else 'heading' end), []) as types,
  coalesce(list_transform(paratext, lambda x: translate(x.raw, '[]<>', '')), []) as texts, translate(display_text, '[]<>', '') as display,
  case when len(italics) > 0 then [italics[1].start] else [] end as starts, case when len(italics) > 0 then [italics[1]."end"] else [] end as ends, false as unbalanced
from c where display_text is not null""",
    ),
    "canonical_roundtrip": (
        _roundtrip,
        f"""with {_CURRENT_SQL}
select reference.book_order as book_order, reference.chapter as chapter, reference.verse as verse, reference.book as book, source_book_code, display_text,
  list_transform(italics, lambda x: x.start || ' ' || x."end" || ' ' || x.source) as spans, list_transform(paratext, lambda x: x.type || ' ' || x.text) as sides from c""",
    ),
    "chapter_digests": (
        lambda spark, sf_dir: ingest.chapter_digests(_verses(spark, sf_dir)),
        f"""with {_CURRENT_SQL}, l as (select reference.book_order as book_order, reference.chapter as chapter, reference.verse as verse, {_VALUE_SQL} as value from c)
select book_order, chapter, sha256(string_agg(value || chr(10), '' order by verse)) as sha256 from l group by book_order, chapter""",
    ),
    "sentence_starts": (
        on_corpus(_starts),
        sql(
            f""", gap as (
  select id, unnest(g) as gap, generate_subscripts(g, 1) - 1 as position
  from (select id, regexp_split_to_array(display_text, '{TOKEN_SQL}') as g from v where display_text is not null)
)
select label, list(position order by position) as positions from tok join gap using (id, position) where position = 0 or regexp_matches(gap, '{ENDS_SQL}') group by label"""
        ),
    ),
    "scoring_digest": (
        _digest,
        sql(
            """select match_level, sha256('{"algorithmVersion":"1.1.0","capitalizationPositionMultipliers":{"different":0,"differentOnlySentenceStart":0.25,"identical":1,"identicalSentenceStart":0.5},"matchLevel":"'
  || match_level || '","normalizationVersion":"1.0.1","phraseCap":25,"phraseLevelMultipliers":{"caseExact":1,"caseFolded":0.8,"normalized":0.5},"rareCap":12,"rareThreshold":'
  || rare_threshold || ',"rareThresholdPercentile":20,"roundingDecimalPlaces":6,"tieBreakOrder":["score_desc","phrase_desc","rare_desc","jaccard_desc","cross_reference_desc","canonical_order_asc"],"tokenizerVersion":"1.0.0","weights":{"capitalization":0.1,"crossReference":0.05,"jaccard":0.4,"order":0.1,"phrase":0.2,"rare":0.15}}') as sha256
from scalars, (select unnest(['letter_exact', 'exact_spelling', 'normalized']) as match_level)"""
        ),
    ),
    "dictionary_senses": (_senses, SENSES_SQL),
}
