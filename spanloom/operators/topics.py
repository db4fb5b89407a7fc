"""Vocabulary bridges: from a topic that the corpus doesn't hold, over a dictionary's senses, to words that it does."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import refs, text
from ..plans.config import MOST, within
from ..plans.errors import InvalidRequest, Unavailable, Unprocessable
from ..sources.corpus import REFERENCE, Corpus
from . import search

SENSES = "sense_id string, part_of_speech string, definition string, synonyms array<string>"


class Dictionary(Protocol):
    available: bool

    def lookup(self, headword: str) -> DataFrame | None:
        """A SENSES frame with a column ordinal, in published order; None without an entry."""


@dataclass
class Resolution:
    """status: exact, requires_sense_selection, requires_candidate_selection, no_candidates or resolved."""

    status: str
    topic: str
    frames: dict[str, DataFrame] = field(default_factory=dict)


def bridge_candidates(corpus: Corpus, senses: DataFrame) -> DataFrame:
    """(term, verse_frequency, total_frequency): synonyms of one token that the corpus holds, once each."""
    words = senses.select(F.explode("synonyms").alias("synonym")).withColumn(
        "tokens", text.surfaces(F.replace("synonym", F.lit("_"), F.lit(" ")), corpus.pattern)
    )
    single = words.where(F.size("tokens") == 1).select(text.normalized(text.fold(F.get("tokens", F.lit(0)))).alias("term")).distinct()
    stats = corpus.statistics.select(F.col("normalized").alias("term"), F.col("document_frequency").alias("verse_frequency"), "total_frequency")
    return single.join(stats, "term")


def rank_candidates(corpus: Corpus, terms: DataFrame, limit: int = 100) -> DataFrame:
    """(term, label, occurrence_count, score, total, truncated): for each term the first `limit` verses that
    hold it in the normalized layer, in canonical order."""
    from pyspark.sql import Window

    within("limit", limit, 1, MOST)
    hits = corpus.tokens.join(terms.select(F.col("term").alias("normalized")), "normalized").groupBy(
        F.col("normalized").alias("term"), "id", "book", *REFERENCE
    ).agg(F.count(F.lit(1)).alias("occurrence_count"))
    of_term = Window.partitionBy("term")
    ranked = hits.withColumns({"place": F.row_number().over(of_term.orderBy("id")), "total": F.count(F.lit(1)).over(of_term)})
    return ranked.where(F.col("place") <= limit).select(
        "term", "id", refs.label(F.col("book"), F.col("chapter"), F.col("verse")).alias("label"), "occurrence_count", F.lit(1.0).alias("score"),
        "total", (F.col("total") > limit).alias("truncated"),
    )


def combine_rankings(ranked: DataFrame) -> DataFrame:
    """(label, winning_term, matched_terms, occurrence_count): a verse once, won by its first term in the alphabet.

    Works on the lists as they were limited.
    """
    key = F.struct(F.collate("term", "UNICODE").alias("k"), F.col("term").alias("term"))
    return ranked.groupBy("id", "label").agg(
        F.min_by("term", key).alias("winning_term"),
        F.transform(F.array_sort(F.collect_list(key)), lambda x: x.term).alias("matched_terms"),
        F.min_by("occurrence_count", key).alias("occurrence_count"),
    )


def resolve_topic(
    corpus: Corpus, topic: str, dictionary: Dictionary, sense_id: str | None = None, terms: list[str] | None = None, limit: int = 100
) -> Resolution:
    """One step of the dialogue; the caller carries its state. Exact matches end it before the dictionary is asked."""
    topic = (topic or "").strip()
    words = search.query_tokens(corpus, topic)
    if not topic or len(topic) > 100 or not words:
        raise InvalidRequest("a topic has 1 to 100 characters and a word")
    exact = (search.exact_word if len(words) == 1 else search.exact_phrase)(corpus, topic, limit=MOST)
    if exact.limit(1).count():
        return Resolution("exact", topic, {"exact": exact})
    if not dictionary.available:
        raise Unavailable("no dictionary, and nothing kept for this topic")
    senses = dictionary.lookup(topic)
    if senses is None:
        raise Unprocessable(f"no entry for {topic}")
    if sense_id is None:
        return Resolution("requires_sense_selection", topic, {"senses": senses})
    sense = senses.where(F.col("sense_id") == sense_id)
    if not sense.limit(1).count():
        raise Unprocessable("the sense isn't one of this entry")
    offered = bridge_candidates(corpus, sense)
    names = {r.term for r in offered.select("term").toLocalIterator()}  # an entry's synonyms
    if not names:
        return Resolution("no_candidates", topic, {"sense": sense})
    if not terms:
        return Resolution("requires_candidate_selection", topic, {"sense": sense, "candidates": offered})
    asked = {t.strip().lower() for t in terms}
    if not asked <= names:
        raise Unprocessable("every term comes from the chosen sense and stands in the corpus")
    ranked = rank_candidates(corpus, offered.where(F.col("term").isin(sorted(asked))), limit)
    return Resolution("resolved", topic, {"sense": sense, "candidates": offered, "ranked": ranked, "combined": combine_rankings(ranked)})
