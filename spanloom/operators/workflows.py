"""Study workflows over exact matches and rankings: evidence graph, mentions, mates, divisions, witnesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import refs, text
from ..plans.config import MOST, within
from ..plans.storage import staged
from ..sources.corpus import REFERENCE, Corpus
from . import search
from .related import related


def evidence_types() -> Column:
    """What a ranking row rests on, as an array of names."""
    kinds = {
        "exact_word": F.size("matched_surfaces") > 0,
        "normalized_word": F.size("matched_normalized") > 0,
        "exact_phrase": F.size("phrases") > 0,
        "rare_word": F.size("rare_tokens") > 0,
        "word_order": F.col("components.ordering") > 0,
        "configured_cross_reference": F.col("components.cross_reference") > 0,
    }
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in kinds.items())))


def gather_mentions(corpus: Corpus, term: str, limit: int = 100) -> DataFrame:
    """Verses with a word in canonical order; total_verses and truncated tell whether there are more."""
    within("limit", limit, 1, MOST)
    found = search.exact_word(corpus, term, limit=limit)
    return found.select(
        "id", "label", "display_text", "positions", "surfaces", F.array(F.lit("exact_word")).alias("evidence_types"),
        F.col("total").alias("total_verses"), "total_occurrences", (F.col("total") > limit).alias("truncated"),
    )


def first_mention_chain(corpus: Corpus, term: str, limit: int = 100) -> DataFrame:
    """(source, target, step): each mention with the next one; step 1 starts from the first mention."""
    mentions = gather_mentions(corpus, term, limit).select("id", "label")  # at most 500 rows
    order = Window.orderBy("id")
    links = mentions.select(F.lag("label").over(order).alias("source"), F.col("label").alias("target"), (F.row_number().over(order) - 1).alias("step"))
    return links.where("source is not null")


def candidate_mates(corpus: Corpus, reference: refs.Reference, limit: int = 20) -> DataFrame:
    within("limit", limit, 1, 100)
    rows = related(corpus, reference, limit).withColumn("evidence_types", evidence_types())
    return rows.join(corpus.verses.select("id", "display_text"), "id")


def divide_term(corpus: Corpus, term: str, examples: int = 3, verses: int | None = MOST) -> DataFrame:
    """(book, book_order, verse_count, occurrence_count, examples, total_verses, total_occurrences, truncated).

    Groups are of the first `verses` verses with the word (None: of all), totals of all. An example has
    its label, its positions, and the three tokens on either side of the first.
    """
    within("examples", examples, 1, 10)
    found = search.exact_word(corpus, term, limit=verses)
    rank = F.row_number().over(Window.partitionBy("book").orderBy("id"))
    at = F.get("positions", F.lit(0))
    surfaces = text.surfaces(F.col("display_text"), corpus.pattern)
    context = F.array_join(F.slice(surfaces, F.greatest(F.lit(0), at - 3) + 1, at + 4 - F.greatest(F.lit(0), at - 3)), " ")
    rows = found.withColumns({"rank": rank, "context": context})
    shown = F.when(F.col("rank") <= examples, F.struct("id", "label", "positions", "context"))
    return rows.groupBy("book", "book_order").agg(
        F.count(F.lit(1)).alias("verse_count"),
        F.sum(F.size("positions")).alias("occurrence_count"),
        F.transform(F.array_sort(F.collect_list(shown)), lambda x: x.dropFields("id")).alias("examples"),
        F.first("total").alias("total_verses"),
        F.first("total_occurrences").alias("total_occurrences"),
        (F.first("total") > verses if verses else F.lit(False)).alias("truncated"),
    )


def lexical_witnesses(corpus: Corpus, reference: refs.Reference, count: int = 3, candidate_limit: int = 100) -> DataFrame:
    """The best verse of each other book, the first `count` in ranking order; complete says whether there are so many."""
    within("count", count, 2, 3)
    within("candidate_limit", candidate_limit, count, MOST)
    rows = related(corpus, reference, candidate_limit).where(F.col("book_order") != reference.book_order)
    best = rows.withColumn("first", F.row_number().over(Window.partitionBy("book_order").orderBy("rank"))).where("first = 1")
    chosen = best.orderBy("rank").limit(count)  # 2 or 3 rows
    place = F.row_number().over(Window.orderBy("rank"))
    return chosen.withColumns({"witness": place, "complete": F.count(F.lit(1)).over(Window.partitionBy()) == count})


def graph_terms(corpus: Corpus, results: DataFrame) -> DataFrame:
    """(term, idf, place): the words that results share with the source, by idf, then alphabetically."""
    terms = results.select(F.explode("matched_normalized").alias("normalized")).distinct()
    rated = terms.join(corpus.statistics.select("normalized", "idf"), "normalized", "left")  # a result's words are few
    order = Window.orderBy(F.coalesce("idf", F.lit(0.0)).desc(), F.collate("normalized", "UNICODE"))
    return rated.select(F.col("normalized").alias("term"), "idf", F.row_number().over(order).alias("place"))


def evidence_graph(corpus: Corpus, reference: refs.Reference, results: int = 12, terms: int = 12, nodes: int = 40) -> dict[str, DataFrame]:
    """nodes (id, kind, label, display_text, role, canonical_order) and edges (id, source, target,
    evidence_types, explanation_id, score, term_of) around a verse, of bounded size, and explanations.

    Results take nodes first, then terms by idf as room is left. The source has an edge to each term,
    a result to each term that it matches. truncated (one row) says whether anything was left out.
    """
    within("nodes", nodes, 2, 100)
    within("results", results, 1, 50)
    within("terms", terms, 0, 25)
    source = corpus.verse(reference)
    name = source.label
    allowed = min(results, nodes - 1)
    # one more than is shown tells whether there are more
    ranked = staged(related(corpus, reference, allowed + 1).withColumn("evidence_types", evidence_types()))
    top = ranked.where(F.col("rank") <= allowed)
    room = F.least(F.lit(terms), F.lit(nodes - 1) - F.col("n_results"))
    every_term = graph_terms(corpus, top)
    chosen = every_term.crossJoin(top.agg(F.count(F.lit(1)).alias("n_results"))).where(F.col("place") <= room)  # one row
    verse_id = lambda c: F.concat(F.lit("verse:"), c)
    term_id = lambda c: F.concat(F.lit("term:"), c)
    texts = corpus.verses.select("id", "display_text")
    node_rows = (
        corpus.verses.where(F.col("id") == source.id)
        .select(verse_id(F.col("label")).alias("node"), F.lit("verse").alias("kind"), "label", "display_text", F.lit("source").alias("role"), F.col("id").alias("canonical_order"))
        .unionByName(
            top.join(texts, "id").select(
                verse_id(F.col("label")).alias("node"), F.lit("verse").alias("kind"), "label", "display_text", F.lit("result").alias("role"), F.col("id").alias("canonical_order")
            )
        )
        .unionByName(
            chosen.select(
                term_id(F.col("term")).alias("node"), F.lit("term").alias("kind"), F.col("term").alias("label"), F.lit(None).cast("string").alias("display_text"),
                F.lit("evidence_term").alias("role"), F.lit(None).cast("bigint").alias("canonical_order"),
            )
        )
    )
    score_id = F.concat(F.lit(f"score:{name}->"), F.col("label"))
    score_edges = top.select(
        F.concat(F.lit(f"edge:{name}->"), F.col("label")).alias("edge"), F.lit(f"verse:{name}").alias("source"), verse_id(F.col("label")).alias("target"),
        F.lit(name).alias("source_label"), F.col("label").alias("target_label"), "evidence_types", score_id.alias("explanation_id"), "score",
    )
    own = list(dict.fromkeys(source.normalized))
    exact = F.col("term").isin(own) if own else F.lit(False)
    of_source = chosen.select("term", F.lit(name).alias("label"), exact.alias("exact"))
    hits = top.select("label", "matched_surfaces", F.explode("matched_normalized").alias("term")).join(chosen.select("term"), "term")
    of_results = hits.select("term", "label", F.exists("matched_surfaces", lambda s: F.lower(s) == F.col("term")).alias("exact"))
    occurrence = F.concat(F.lit("term:"), F.col("label"), F.lit("->"), F.col("term"))
    term_edges = of_source.unionByName(of_results).select(
        F.concat(F.lit("edge:"), occurrence).alias("edge"), verse_id(F.col("label")).alias("source"), term_id(F.col("term")).alias("target"),
        F.col("label").alias("source_label"), F.col("term").alias("target_label"),
        F.array(F.when(F.col("exact"), "exact_word").otherwise("normalized_word")).alias("evidence_types"),
        occurrence.alias("explanation_id"), F.lit(None).cast("double").alias("score"),
    )
    edges = score_edges.unionByName(term_edges)
    rows = edges.select("*", F.array_join(F.transform("evidence_types", lambda t: F.replace(t, F.lit("_"), F.lit(" "))), ", ").alias("summary"))
    left_out = ranked.agg((F.count(F.lit(1)) > allowed).alias("more_results")).crossJoin(
        every_term.agg(F.count(F.lit(1)).alias("n_terms")).crossJoin(chosen.agg(F.count(F.lit(1)).alias("n_chosen")))
    )
    truncated = left_out.select((F.col("more_results") | (F.col("n_terms") > F.col("n_chosen"))).alias("truncated"))
    return {"nodes": node_rows, "edges": edges, "table": rows, "explanations": top, "truncated": truncated}
