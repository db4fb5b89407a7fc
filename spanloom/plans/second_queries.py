"""Queries of the second algorithm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import second
from ..sources.corpus import Corpus
from . import study
from .registry import TOKEN_SQL, WORD, corpus, probe, sql
from .study import PROBE_SQL


def joined(spark: SparkSession, sf_dir: str) -> Corpus:
    return corpus(spark, sf_dir, pattern=text.JOINED_TOKEN)


def on(f):
    return lambda spark, sf_dir: f(joined(spark, sf_dir))


def at(f):
    """f(tables, reference) at the probe."""
    return lambda spark, sf_dir: f(second.Second.of(joined(spark, sf_dir)), probe(spark, sf_dir).start)


def sql2(body: str) -> str:
    """Over tokens that hyphens and dashes join."""
    return sql(body).replace(TOKEN_SQL, r"[\p{L}\p{N}]+(?:[''’\-‐‑‒–—][\p{L}\p{N}]+)*")


LETTERS = r"length(regexp_replace(folded, '[^\p{L}]', '', 'g'))"
CLAMPED = "greatest(0, least(1, {}))"


def _word_values(c: Corpus) -> DataFrame:
    s = second.Second.of(c)
    limits = s.vocabulary.agg(F.max("frequency").alias("most"), F.min("frequency").alias("least"), F.max("letters").alias("longest"))
    rows = s.vocabulary.crossJoin(F.broadcast(limits))  # one row
    rarity = second.corpus_rarity(F.col("most"), F.col("frequency"), F.col("least"))
    length = second.word_length_value(F.col("folded"), F.col("longest"))
    return rows.select("folded", rarity.alias("rarity"), length.alias("length_value"), second.exact_word_evidence(F.col("folded"), rarity).alias("evidence"), second.repetition_value(F.col("frequency")).alias("repetition"))


def _proximity(s: second.Second, reference) -> DataFrame:
    source = s.verse(reference)
    return s.proximity(s.features.where(F.col("id") != source.id), source).select("label", "axes.*", "proximity")


def _family(s: second.Second, _) -> DataFrame:
    return s.word_family(WORD)


def _measured(s: second.Second, reference) -> DataFrame:
    """What a verse and every other that shares a word with it tell by themselves."""
    source = s.verse(reference)
    rows = s.features.where((F.col("id") != source.id) & F.arrays_overlap("folded", F.lit(sorted(set(source.folded)))))
    names = ("ordered_coverage", "relative_position", "pair_direction", "gap_agreement", "continuity")
    return s.measure(rows, source).select(
        "label", "jaccard", "phrase", "phrase_variant", *(F.element_at("order_measurements", n).alias(n) for n in names), "ordering", "capitalization",
        "phrase_count", "variant_count", "identity_score",
    )


second_measures = at(_measured)


def _related(s: second.Second, reference) -> DataFrame:
    return s.related(reference).select(
        "rank", "label", "score", "textual", "proximity", "jaccard", "phrase", "phrase_variant", "rarity", "ordering", "capitalization", "morphology_score", "letter_score", "reasons"
    )


SECOND = {
    "word_values": (
        on(_word_values),
        sql2(
            f""", l as (select max(n) as most, min(n) as least, max({LETTERS}) as longest from vocab
), r as (
  select folded, n, round(greatest(0, least(1, (1 + ln((most + 1) / (n + 1))) / (1 + ln((most + 1) / (least + 1))))), 6) as rarity,
    round(greatest(0, least(1, ln(1 + {LETTERS}) / ln(1 + greatest(1, longest)))), 6) as length_value,
    round(greatest(0, least(1, ln(1 + {LETTERS}) / ln(19))), 6) as fixed
  from vocab, l)
select folded, rarity, length_value, round(fixed * (0.3 + 0.7 * rarity), 6) as evidence,
  round(greatest(0, least(1, ln(1 + n) / ln(19))), 6) as repetition from r"""
        ),
    ),
    "weighted_dice": (
        lambda spark, sf_dir: second.weighted_dice(joined(spark, sf_dir), probe(spark, sf_dir).start),
        sql2(
            f"""{PROBE_SQL}, l as (select max({LETTERS}) as longest from vocab
), w as (
  select id, label, folded, count(*) * round(greatest(0, least(1, ln(1 + {LETTERS}) / ln(1 + any_value(longest)))), 6) as q from tok, l group by id, label, folded
), s as (select w.* from w, p where w.id = p.id
), m as (
  select w.id, w.label, sum(w.q) as total, sum(coalesce(least(w.q, s.q), 0)) as common, count(s.q) as shared
  from w left join s on s.folded = w.folded group by w.id, w.label)
select m.label, round(2 * common / (total + (select sum(q) from s)), 6) as dice from m, p where shared > 0 and m.id <> p.id"""
        ),
    ),
    "proximity_axes": (
        at(_proximity),
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
), p as (select * from a order by verse_id limit 1
), x as (
  select a.label,
    greatest(0, 1 - ln(1 + greatest(0, a.ws - p.we - 1, p.ws - a.we - 1)) / ln(1 + greatest(1, tw - 1))) as word,
    greatest(0, 1 - abs(a.book_order - p.book_order) / greatest(1, tb - 1)) as book,
    greatest(0, 1 - ln(1 + greatest(0, a.ls - p.le - 1, p.ls - a.le - 1)) / ln(1 + greatest(1, tl - 1))) as letter,
    greatest(0, 1 - abs(a.id - p.id) / greatest(1, tv - 1)) as verse,
    greatest(0, 1 - abs(a.c - p.c) / greatest(1, tc - 1)) as chapter,
    case when (a.book_order <= 39) = (p.book_order <= 39) then 1.0 else 0.0 end as testament
  from a, p, t where a.id <> p.id)
select label, round(word, 6) as word, round(book, 6) as book, round(letter, 6) as letter, round(verse, 6) as verse, round(chapter, 6) as chapter,
  cast(testament as double) as testament,
  round((1243 * word + 196 * book + 71 * letter + 33 * verse + 29 * chapter + 14 * testament) / 1586, 6) as proximity from x"""
        ),
    ),
    "text_identity": (
        on(second.text_identities),
        sql2(
            """, k as (select id, string_agg(folded, chr(31) order by position) as key from tok group by id
), f as (select key, min(id) as first from k group by key having count(*) > 1)
select a.label as label_a, b.label as label_b,
  case when a.display_text = b.display_text then 'exact_display_text' else 'measured_complete_token_sequence' end as level
from f join k using (key) join v b on b.id = k.id join v a on a.id = f.first where k.id <> f.first"""
        ),
    ),
    "text_identity_classes": (
        on(second.text_identity_classes),
        sql2(
            """, k as (select id, string_agg(folded, chr(31) order by position) as key from tok group by id
), x as (
  select label, first_value(label) over (partition by key order by id) as token_class,
    first_value(label) over (partition by key, display_text order by id) as text_class, count(*) over (partition by key) as verses
  from k join v using (id))
select * from x where verses > 1"""
        ),
    ),
    "word_family": (at(_family), None),
    "related_second": (at(_related), None),
    "second_compare": (
        lambda spark, sf_dir: second.Second.of(joined(spark, sf_dir))
        .compare([probe(spark, sf_dir, k).start for k in (0, 1, 2)])
        .select("left", "right", "score", "textual", "proximity"),
        None,
    ),
    "second_graph": (at(lambda s, r: s.graph(r)["edges"]), None),
    "second_topic": (lambda spark, sf_dir: second.Second.of(joined(spark, sf_dir)).topic_branches(study.synonyms(spark)), None),
    "candidate_tiers": (at(lambda s, r: s.tier_totals(r)), None),
}
