"""Queries over rankings, workflows, topics, cross-references and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import refs
from ..operators import cross_references, related, topics, workflows
from ..sources import ingest, relational
from . import pair_sql, registry
from .config import ScoringConfig
from .registry import WORD, corpus, on_corpus, probe, sql, table

PROBE_SQL = ", p as (select * from v order by verse_id limit 1), p2 as (select * from v order by verse_id limit 1 offset 1)"


def at_probe(f):
    """f(corpus, reference) at the first probe."""
    return lambda spark, sf_dir: f(corpus(spark, sf_dir), probe(spark, sf_dir).start)


def _two(spark: SparkSession, sf_dir: str) -> tuple:
    return corpus(spark, sf_dir), [probe(spark, sf_dir, k).start for k in (0, 1)]


def _components(testament: str | None = None, level: str = "exact_spelling"):
    """Weighted overlap and rarity of every candidate as the pair scorer gives them."""

    def run(c, reference) -> DataFrame:
        n, threshold = c.size_and_threshold
        targets = c.features.where(related.in_testament(testament))
        scored = related.score_against(targets, [c.verse(reference)], ScoringConfig(level), n, threshold)
        return scored.join(c.verses.select("id", "label"), "id").select(
            "label", F.col("components.jaccard").alias("jaccard"), F.col("components.rare").alias("rare"), F.size("matched_normalized").alias("shared")
        )

    return run


def _overlap_sql(layer: str, where: str = "true", rare: bool = False) -> str:
    return sql(
        f"""{PROBE_SQL}, w as (
  select distinct id, label, book_order, {layer} as key, idf, document_frequency from tok join stats using (normalized)
), s as (
  select w.* from w, p where w.id = p.id
), m as (
  select w.label, w.id, sum(w.idf) as total, sum(case when s.key is not null then w.idf else 0 end) as common, count(s.key) as shared,
    sum(case when s.key is not null and w.document_frequency <= (select rare_threshold from scalars) then w.idf else 0 end) as rare
  from w left join s on s.key = w.key where {where.replace("book_order", "w.book_order")} group by w.label, w.id
)
select m.label, shared, round(common / (total + (select sum(idf) from s) - common), 6) as jaccard{", round(least(1, rare / 12), 6) as rare" if rare else ""}
from m, p where shared > 0 and m.id <> p.id"""
    )


def flat(found: DataFrame, *first: str) -> DataFrame:
    """A ranking with its evidence in plain columns: phrases as `i j n level`, rare words as `word df`."""
    return found.select(
        *first,
        "rank",
        "label",
        "score",
        *(F.col(f"components.{c}") for c in ("jaccard", "phrase", "rare", "ordering", "capitalization")),
        "matched_normalized",
        F.transform("phrases", lambda x: F.concat_ws(" ", x.source_start, x.target_start, F.size(x.tokens), x.level)).alias("phrases"),
        F.transform("rare_tokens", lambda x: F.concat_ws(" ", x.token, x.document_frequency)).alias("rare_tokens"),
        "reasons",
    )


def _in_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r.name for r in table(spark, sf_dir, "books").where("book_order in (1, 2, 3)").select("name").collect()]
    return flat(related.related(corpus(spark, sf_dir), probe(spark, sf_dir).start, 20, books=names))


def _compare(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c, places = _two(spark, sf_dir)
        return related.compare(c, places)[name]

    return run


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compare("pairs")(spark, sf_dir).select("left", "right", "score", F.col("components.jaccard").alias("jaccard"))


def synonyms(spark: SparkSession) -> DataFrame:
    """Senses as a dictionary gives them."""
    rows = [("s1", "noun", "moving water", ["river", "stream", "brook water"]), ("s2", "noun", "a light", ["lamp", "lantern", "LAMP", "torch_light", "candle"])]
    return spark.createDataFrame(rows, topics.SENSES)


def _topic(step):
    return lambda spark, sf_dir: step(corpus(spark, sf_dir), synonyms(spark))


def _ranked(c, senses: DataFrame, limit: int = 100) -> DataFrame:
    return topics.rank_candidates(c, topics.bridge_candidates(c, senses), limit)


def _graph(name: str):
    return at_probe(lambda c, r: workflows.evidence_graph(c, r)[name])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deliveries as a source's lines: code, place and text."""
    rows = table(spark, sf_dir, "scoring_verses").select(
        F.col("verse_id").alias("line"),
        F.concat(F.col("source_book_code"), F.lit(" "), F.col("reference.chapter").cast("string"), F.lit(":"), F.col("reference.verse").cast("string"), F.lit(" "), F.col("display_text")).alias("record"),
        F.lit(0).alias("byte_start"),
        F.lit(0).alias("byte_end"),
    ).distinct()
    return ingest.parse_records(rows.where("record is not null"), table(spark, sf_dir, "books"))


def _import_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("line", "source_book_code", "book", "chapter", "verse", "display_text", "problem")


def _import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "scoring_verses").select("verse_id", "loaded_at", "corpus_version_id", "reference", "italics", "paratext")
    current = registry.current_rows(rows, "verse_id", "loaded_at").where(F.col("corpus_version_id") == registry.VERSION)
    return ingest.counts(current.select("reference.book_order", "reference.chapter", "italics", "paratext"))


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["verse_id", "loaded_at", "corpus_version_id", "reference", "source_book_code", "display_text", "italics", "paratext"]
    current = registry.current_rows(table(spark, sf_dir, "scoring_verses").select(*columns), "verse_id", "loaded_at")
    rows = current.where(F.col("corpus_version_id") == registry.VERSION).select("reference.*", "source_book_code", "display_text", "italics", "paratext")
    return ingest.canonical_json(rows).select("value")


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "scoring_verses").select("verse_id", "loaded_at", "corpus_version_id", "reference", "display_text")
    current = registry.current_rows(rows, "verse_id", "loaded_at")
    verses = current.select("corpus_version_id", "reference.book_order", "reference.chapter", "reference.verse", "display_text")
    return relational.violations(verses, table(spark, sf_dir, "books"), table(spark, sf_dir, "token_statistics"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "related_results").select(F.col("query_reference").alias("source"), F.col("target_reference").alias("target"))
    records = pairs.where("source <> target").withColumn("note", F.lit(" from a ranking "))
    approved = {"enabled": True, "sourceUrl": "file:results", "license": "given", "ownerApproved": True, "approvalStatus": "approved", "checksum": "0" * 64}
    return cross_references.prepare(approved, records, table(spark, sf_dir, "books"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "related_results").select(F.col("query_reference").alias("reference")).distinct()
    parsed = refs.parse_references(labels, "reference", table(spark, sf_dir, "books"))
    return parsed.select("reference", "parsed.book_order", "parsed.chapter", "parsed.verse", refs.range_label(*(F.col(f"parsed.{x}") for x in ("book", "chapter", "verse", "end_chapter", "end_verse"))).alias("label"))


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every current place written as a range, by each of its book's aliases, some of them wrong."""
    rows = table(spark, sf_dir, "scoring_verses").select("reference.*").distinct()
    books = table(spark, sf_dir, "books").select("book_order", F.explode(F.array_distinct(F.concat(F.array("name", "osis"), "aliases"))).alias("alias"))
    c, v = F.col("chapter"), F.col("verse")
    to = lambda *parts: F.concat(F.lit("  "), F.upper("alias"), F.lit("  "), c, F.lit(":"), v, *(F.lit(x) if isinstance(x, str) else x for x in parts))
    forms = F.array(to(), to("-", v + 2), to(" – ", c + 1, ":", v), to("-", v - 1), to("-0"), to("x"), F.concat(F.lit("no such book "), c, F.lit(":"), v))
    texts = rows.join(F.broadcast(books), "book_order").select(F.explode(forms).alias("reference")).distinct()  # a fixed table
    parsed = refs.parse_references(texts, "reference", table(spark, sf_dir, "books"))
    places = ("book", "chapter", "verse", "end_chapter", "end_verse")
    return parsed.select("reference", *(F.col(f"parsed.{x}") for x in places), refs.range_label(*(F.col(f"parsed.{x}") for x in places)).alias("label"))


STUDY = {
    "related_candidates": (
        at_probe(lambda c, r: related.candidates(c, r).select("label")),
        sql(f"{PROBE_SQL} select distinct t.label from tok t join tok s on s.folded = t.folded join p on p.id = s.id where t.id <> p.id"),
    ),
    "related_jaccard": (at_probe(related.weighted_overlap), _overlap_sql("folded")),
    "match_level_letter_exact": (at_probe(lambda c, r: related.weighted_overlap(c, r, "letter_exact")), _overlap_sql("surface")),
    "match_level_normalized": (at_probe(lambda c, r: related.weighted_overlap(c, r, "normalized")), _overlap_sql("normalized")),
    "related_rare": (at_probe(_components()), _overlap_sql("folded", rare=True)),
    "related_filtered": (at_probe(_components("OT")), _overlap_sql("folded", "book_order <= 39", rare=True)),
    "related_full": (at_probe(lambda c, r: flat(related.related(c, r))), pair_sql.RELATED_FULL),
    "related_books": (_in_books, pair_sql.RELATED_BOOKS),
    "related_many": (lambda spark, sf_dir: related.related_many(*_two(spark, sf_dir)).select("reference", "rank", "label", "score"), pair_sql.RELATED_MANY),
    "phrase_runs": (
        at_probe(related.phrase_runs),
        sql(
            f"""{PROBE_SQL}, m as (
  select t.label, s.position as i, t.position as j from tok s join p on p.id = s.id join tok t on t.folded = s.folded and t.id <> p.id
), g as (select *, i - row_number() over (partition by label, j - i order by i) as island from m)
select label, min(i) as source_start, min(j) as target_start, count(*) as length from g group by label, j - i, island having count(*) >= 3"""
        ),
    ),
    "compare_common": (
        _compare("common_normalized"),
        sql(f"{PROBE_SQL} select normalized as token from tok, p, p2 where tok.id in (p.id, p2.id) group by normalized having count(distinct tok.id) = 2"),
    ),
    "compare_unique": (
        _compare("unique"),
        sql(f"{PROBE_SQL} select min(tok.label) as label, normalized as token from tok, p, p2 where tok.id in (p.id, p2.id) group by normalized having count(distinct tok.id) = 1"),
    ),
    "compare_pairs": (_pairs, pair_sql.COMPARE_PAIRS),
    "gather_mentions": (
        on_corpus(lambda c: workflows.gather_mentions(c, WORD).select("label", "positions", "total_verses", "truncated")),
        sql(
            f"""select label, positions, total_verses, total_verses > 100 as truncated from (
  select id, label, list(position order by position) as positions, count(*) over () as total_verses from tok where folded = '{WORD}' group by id, label)
order by id limit 100"""
        ),
    ),
    "first_mention_chain": (
        on_corpus(lambda c: workflows.first_mention_chain(c, WORD)),
        sql(
            f"""select source, target, step from (
  select label as target, lag(label) over (order by id) as source, row_number() over (order by id) - 1 as step
  from (select distinct id, label from tok where folded = '{WORD}' order by id limit 100)) where source is not null"""
        ),
    ),
    "divide_term": (
        on_corpus(lambda c: workflows.divide_term(c, WORD).select("book", "verse_count", "occurrence_count", F.transform("examples", lambda x: x.label).alias("examples"), F.transform("examples", lambda x: x.context).alias("contexts"), "total_verses", "total_occurrences")),
        sql(
            f""", m as (
  select id, label, book, list(position order by position) as places, count(*) over () as total_verses from tok where folded = '{WORD}' group by id, label, book
), f as (select * from m order by id limit 500), r as (
  select *, row_number() over (partition by book order by id) as r from f
), c as (
  select r.id, string_agg(t.surface, ' ' order by t.position) as context from r join tok t on t.id = r.id
  where t.position between places[1] - 3 and places[1] + 3 group by r.id)
select book, count(*) as verse_count, sum(len(places)) as occurrence_count, list(label order by r.id) filter (r <= 3) as examples,
  list(context order by r.id) filter (r <= 3) as contexts, any_value(total_verses) as total_verses, (select sum(len(places)) from m) as total_occurrences
from r join c using (id) group by book"""
        ),
    ),
    "candidate_mates": (at_probe(lambda c, r: workflows.candidate_mates(c, r).select("rank", "label", "score", "evidence_types")), pair_sql.CANDIDATE_MATES),
    "lexical_witnesses": (at_probe(lambda c, r: workflows.lexical_witnesses(c, r).select("witness", "label", "score", "complete")), pair_sql.LEXICAL_WITNESSES),
    "graph_nodes": (_graph("nodes"), pair_sql.GRAPH_NODES),
    "graph_edges": (_graph("table"), pair_sql.GRAPH_EDGES),
    "topic_candidates": (
        _topic(topics.bridge_candidates),
        sql("select normalized as term, document_frequency as verse_frequency, total_frequency from stats where normalized in ('river', 'stream', 'lamp', 'lantern', 'candle')"),
    ),
    "topic_ranked": (
        _topic(lambda c, s: _ranked(c, s).select("term", "label", "occurrence_count", "total", "truncated")),
        sql(
            """, h as (select normalized as term, id, label, count(*) as occurrence_count from tok
  where normalized in ('river', 'stream', 'lamp', 'lantern', 'candle') group by all
), r as (select *, row_number() over (partition by term order by id) as r, count(*) over (partition by term) as total from h)
select term, label, occurrence_count, total, total > 100 as truncated from r where r <= 100"""
        ),
    ),
    "topic_combined": (
        _topic(lambda c, s: topics.combine_rankings(_ranked(c, s, 500)).drop("id")),
        sql(
            """, h as (select normalized as term, id, label, count(*) as occurrence_count from tok
  where normalized in ('river', 'stream', 'lamp', 'lantern', 'candle') group by all
), r as (select *, row_number() over (partition by term order by id) as r from h)
select label, min(term) as winning_term, list(term order by term) as matched_terms, arg_min(occurrence_count, term) as occurrence_count
from r where r <= 500 group by label"""
        ),
    ),
    "cross_reference_canonical": (
        _links,
        r"""with r as (
  select distinct query_reference as s, target_reference as t from related_results where query_reference <> target_reference
), k as (
  select r.*, (a.book_order, cast(regexp_extract(s, '(\d+):(\d+)$', 1) as int), cast(regexp_extract(s, '(\d+):(\d+)$', 2) as int)) as ks,
    (b.book_order, cast(regexp_extract(t, '(\d+):(\d+)$', 1) as int), cast(regexp_extract(t, '(\d+):(\d+)$', 2) as int)) as kt
  from r join books a on a.name = regexp_replace(s, ' \d+:\d+$', '') join books b on b.name = regexp_replace(t, ' \d+:\d+$', ''))
select distinct case when ks > kt then t else s end as source, case when ks > kt then s else t end as target, 'from a ranking' as note from k""",
    ),
    "parse_references": (
        _parsed,
        r"""select query_reference as reference, b.book_order, cast(regexp_extract(query_reference, '(\d+):(\d+)$', 1) as int) as chapter,
  cast(regexp_extract(query_reference, '(\d+):(\d+)$', 2) as int) as verse, query_reference as label
from (select distinct query_reference from related_results) left join books b on b.name = regexp_replace(query_reference, ' \d+:\d+$', '')""",
    ),
    "parse_ranges": (
        _ranges,
        r"""with a as (
  select book_order, name, unnest(list_distinct(list_concat([name, osis], aliases))) as alias from books
), k as (
  select lower(regexp_replace(trim(alias), '\s+', ' ', 'g')) as key, arg_max(name, book_order) as book from a group by key
), p as (
  select distinct alias, reference.chapter as c, reference.verse as v from scoring_verses join a on a.book_order = reference.book_order
), f as (
  select distinct unnest([
    {'t': t, 'key': key, 'c': c, 'v': v, 'ec': c, 'ev': v}, {'t': t || '-' || (v + 2), 'key': key, 'c': c, 'v': v, 'ec': c, 'ev': v + 2},
    {'t': t || ' – ' || (c + 1) || ':' || v, 'key': key, 'c': c, 'v': v, 'ec': c + 1, 'ev': v}, {'t': t || '-' || (v - 1), 'key': null, 'c': c, 'v': v, 'ec': c, 'ev': v},
    {'t': t || '-0', 'key': null, 'c': c, 'v': v, 'ec': c, 'ev': v}, {'t': t || 'x', 'key': null, 'c': c, 'v': v, 'ec': c, 'ev': v},
    {'t': 'no such book ' || c || ':' || v, 'key': null, 'c': c, 'v': v, 'ec': c, 'ev': v}]) as x
  from (select *, '  ' || upper(alias) || '  ' || c || ':' || v as t, lower(regexp_replace(trim(alias), '\s+', ' ', 'g')) as key from p)
), u as (
  select distinct x.t as reference, book, x.c as c, x.v as v, x.ec as ec, x.ev as ev from f left join k on k.key = x.key
)
select distinct reference, book, case when book is not null then c end as chapter, case when book is not null then v end as verse,
  case when book is not null then ec end as end_chapter, case when book is not null then ev end as end_verse,
  book || ' ' || c || ':' || v || case when c = ec and v = ev then '' when c = ec then '-' || ev else '-' || ec || ':' || ev end as label from u"""
    ),
    "related_reasons": (
        at_probe(lambda c, r: flat(related.having(related.related(c, r), 0.2, ["shared_exact_phrase"]))),
        pair_sql.RELATED_REASONS,
    ),
    "import_records": (
        _import_records,
        r"""select distinct verse_id as line, case when ok then source_book_code else '' end as source_book_code, b.name as book,
  case when ok then chapter end as chapter, case when ok then verse end as verse,
  case when ok then replace(replace(trim(regexp_replace(display_text, '<<(.+?)>>', '', 'g')), '[', ''), ']', '') else '' end as display_text,
  case when not ok then 'malformed_record' when b.name is null then 'unknown_book_code' end as problem
from (select *, reference.chapter as chapter, reference.verse as verse,
    regexp_matches(source_book_code || ' 1:1 ' || display_text, '^([1-3]?[A-Za-z]+) (\d+):(\d+) (.+)$') as ok from scoring_verses) s
left join books b on b.osis = s.source_book_code and ok where source_book_code is not null and display_text is not null""",
    ),
    "data_quality": (
        _quality,
        f"""with c as (
  select verse_id, corpus_version_id, reference.book_order as b, reference.chapter as c, reference.verse as v, display_text from (
    select *, row_number() over (partition by verse_id order by loaded_at desc) as rn from scoring_verses) where rn = 1
), s as (
  select corpus_version_id as version, normalized, count(*) as n,
    count_if(total_frequency < document_frequency) as f, count_if(idf < 0) as i from token_statistics group by all)
select 'verses: repeated place' as rule, count(*) as violations from (select 1 from c group by corpus_version_id, b, c, v having count(*) > 1)
union all select 'verses: no text', count(*) from c where coalesce(display_text, '') = ''
union all select 'verses: unknown book', count(*) from c where b not in (select book_order from books)
union all select 'token_statistics: repeated term', count(*) from s where n > 1
union all select 'token_statistics: total below document frequency', coalesce(sum(f), 0) from s
union all select 'token_statistics: negative idf', coalesce(sum(i), 0) from s
union all select 'books: order or testament', count(*) from books where book_order not between 1 and 66 or testament not in ('OT', 'NT')""",
    ),
    "import_counts": (
        _import_counts,
        f"""select count(distinct reference.book_order) as books, count(distinct (reference.book_order, reference.chapter)) as chapters,
  count(*) as verses, coalesce(sum(len(italics)), 0) as italic_spans, coalesce(sum(len(paratext)), 0) as paratext_items
from (select *, row_number() over (partition by verse_id order by loaded_at desc) as rn from scoring_verses) where rn = 1 and corpus_version_id = {registry.VERSION}""",
    ),
    "canonical_json": (_canonical, None),  # its SQL is in source_queries
}
