"""Related verses: candidates that share a token, scored with their evidence, ranked."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heapreplace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import numeric, pairs, refs
from ..plans.config import ScoringConfig
from ..plans.config import limit as checked_limit
from ..plans.errors import InvalidRequest
from ..sources.corpus import REFERENCE, Corpus, in_testament

LAYER = {"letter_exact": "surface", "exact_spelling": "folded", "normalized": "normalized"}
EXPLANATION = """
source_id bigint, id bigint, score double,
components struct<jaccard: double, phrase: double, rare: double, ordering: double, capitalization: double, cross_reference: double>,
matched_tokens array<struct<token: string, source_position: int, target_position: int, source_surface: string, target_surface: string, level: string>>,
matched_surfaces array<string>, matched_normalized array<string>,
phrases array<struct<tokens: array<string>, source_start: int, target_start: int, level: string, multiplier: double>>,
capitalization array<struct<token: string, source_position: int, target_position: int, multiplier: double, weight: double, reason: string>>,
rare_tokens array<struct<token: string, document_frequency: bigint, idf: double>>,
reasons array<string>
"""
FIELDS = ["surface", "folded", "normalized", "df", "starts"]

#: What tells two results of one score apart, in this order; then the canonical place, which is the order of ids.
TIES = ("phrase", "rare", "jaccard", "cross_reference")


def ranking() -> list[Column]:
    """A ranking's order."""
    return [F.col("score").desc(), *(F.col(f"components.{c}").desc() for c in TIES), F.col("id").asc()]


def rank_key(found: dict, id_: int) -> tuple:
    """The same order for a scored pair in Python: the greater, the earlier."""
    return (found["score"], *(found["components"][c] for c in TIES), -id_)


def score_against(
    features: DataFrame, sources: list, config: ScoringConfig, n: int, rare_threshold: int, cross: set | None = None, keep: int | None = None
) -> DataFrame:
    """An EXPLANATION row for each source and each row of features that shares a key with it.

    sources: a few feature rows. Candidates are found and scored in one scan of the features: a
    filter on overlapping keys, then Arrow batches. There is no shuffle. With `keep`, of each batch and
    source only so many come out, the first in ranking order: the others can't be among the first of all.
    """
    layer = LAYER[config.match_level]
    own = [{"id": s.id, **{f: list(s[f]) for f in FIELDS}} for s in sources]
    keys = sorted({k for s in own for k in s[layer]})
    schema = to_arrow_schema(features.sparkSession.createDataFrame([], EXPLANATION).schema)
    wanted = [set(s[layer]) for s in own]
    linked = cross or set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_source: list[list] = [[] for _ in own]
            for target in batch.to_pylist():
                there = target[layer]
                for source, mine, best in zip(own, wanted, of_source):
                    if target["id"] != source["id"] and not mine.isdisjoint(there):
                        found = pairs.score_pair(source, target, config, n, rare_threshold, (source["id"], target["id"]) in linked)
                        row = (rank_key(found, target["id"]), {"source_id": source["id"], "id": target["id"], **found})
                        if not keep or len(best) < keep:
                            heappush(best, row)
                        elif row[0] > best[0][0]:
                            heapreplace(best, row)
            yield pa.RecordBatch.from_pylist([row for best in of_source for _, row in best], schema)

    overlapping = features.where(F.arrays_overlap(layer, F.lit(keys))) if keys else features.limit(0)
    return overlapping.select("id", *FIELDS).mapInArrow(run, EXPLANATION)


def related(
    corpus: Corpus,
    reference: refs.Reference,
    limit: int | None = 50,
    books: list[str] | None = None,
    testament: str | None = None,
    config: ScoringConfig | None = None,
) -> DataFrame:
    """The verses related to one, ranked, with their evidence and rank from 1.

    Filters come before scoring. A range stands for its first verse. Needs a shared token, so that a
    verse without tokens has no relations.
    """
    if testament not in (None, "OT", "NT"):
        raise InvalidRequest("testament is OT or NT")
    config = config or ScoringConfig()
    source = corpus.verse(reference)
    n, threshold = corpus.size_and_threshold
    targets = corpus.features.where(in_testament(testament))
    if books:
        targets = targets.where(F.col("book").isin(list(books)))
    most = checked_limit(limit, 50)
    scored = score_against(targets, [source], config, n, threshold, keep=most)
    return ranked(corpus, scored, most, few=True)


def ranked(corpus: Corpus, scored: DataFrame, limit: int, few: bool = False) -> DataFrame:
    """Of each source, the first `limit` rows in ranking order, with label and rank.

    Only they are joined with their verses; few: they are of a few sources, so that they can be broadcast.
    """
    order = Window.partitionBy("source_id").orderBy(*ranking())
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return (F.broadcast(top) if few else top).join(corpus.verses.select("id", "label", "book", *REFERENCE), "id")


def having(found: DataFrame, minimum_score: float = 0.0, reasons: list[str] | None = None) -> DataFrame:
    """Of a ranking, the rows with a score and, if reasons are named, one of them; ranks stay what they are."""
    kept = found.where(F.col("score") >= minimum_score)
    return kept.where(F.arrays_overlap("reasons", F.lit(list(reasons)))) if reasons else kept


def related_many(corpus: Corpus, references: list[refs.Reference], limit: int = 5, config: ScoringConfig | None = None) -> DataFrame:
    """Rankings of several verses in one scan; what a golden list of rankings is made of."""
    n, threshold = corpus.size_and_threshold
    sources = [corpus.verse(r) for r in references]
    names = {s.id: s.label for s in sources}
    scored = score_against(corpus.features, sources, config or ScoringConfig(), n, threshold, keep=limit)
    label = F.create_map(*(F.lit(x) for item in names.items() for x in item))
    return ranked(corpus, scored, limit, few=True).withColumn("reference", F.element_at(label, F.col("source_id")))


def candidates(corpus: Corpus, reference: refs.Reference, level: str = "exact_spelling") -> DataFrame:
    """(id, label): verses other than the source with a token of it, by an equi-join on the tokens."""
    layer = LAYER[level]
    source = corpus.verses.where(
        (F.col("book_order") == reference.book_order) & (F.col("chapter") == reference.chapter) & (F.col("verse") == reference.verse)
    ).select(F.col("id").alias("source_id"))
    own = corpus.tokens.join(F.broadcast(source), F.col("id") == F.col("source_id")).select("source_id", F.col(layer).alias("key")).distinct()
    hits = corpus.tokens.withColumn("key", F.col(layer)).join(F.broadcast(own), "key")  # one verse's words
    return hits.where(F.col("id") != F.col("source_id")).select("id").distinct().join(corpus.verses.select("id", "label"), "id")


def weighted_overlap(corpus: Corpus, reference: refs.Reference, level: str = "exact_spelling") -> DataFrame:
    """(label, shared, jaccard): weighted Jaccard of every candidate, by joins and sums alone.

    Weights are idf of the normalized form; sums are taken in the order of the words.
    """
    layer = LAYER[level]
    words = corpus.tokens.groupBy("id", F.col(layer).alias("key")).agg(F.max_by("normalized", "position").alias("normalized"))
    weighted = words.join(corpus.statistics.select("normalized", "idf"), "normalized").select("id", "key", "idf")
    source = corpus.verses.where(
        (F.col("book_order") == reference.book_order) & (F.col("chapter") == reference.chapter) & (F.col("verse") == reference.verse)
    ).select(F.col("id").alias("source_id"))
    own = weighted.join(F.broadcast(source), F.col("id") == F.col("source_id")).select("source_id", F.col("key").alias("own_key"), F.col("idf").alias("own_idf"))
    total = own.groupBy("source_id").agg(numeric.sum_by(F.col("own_key"), F.col("own_idf")).alias("own_total"))
    both = weighted.join(F.broadcast(own.drop("source_id")), F.col("key") == F.col("own_key"), "left")
    sums = both.groupBy("id").agg(
        numeric.sum_by(F.col("key"), F.col("idf")).alias("total"),
        numeric.sum_by(F.col("key"), F.when(F.col("own_key").isNotNull(), F.col("idf")).otherwise(0.0)).alias("common"),
        F.count("own_key").alias("shared"),
    )
    return (
        sums.where("shared > 0")
        .crossJoin(F.broadcast(total))  # one row
        .where(F.col("id") != F.col("source_id"))
        .join(corpus.verses.select("id", "label"), "id")
        .select("label", "shared", numeric.round6(F.col("common") / (F.col("total") + F.col("own_total") - F.col("common"))).alias("jaccard"))
    )


def phrase_runs(corpus: Corpus, reference: refs.Reference, least: int = 3) -> DataFrame:
    """(label, source_start, target_start, length): maximal common runs of a verse with every other.

    Pairs of equal tokens are joined on the token; on each diagonal, islands of consecutive places
    are runs.
    """
    source = corpus.verses.where(
        (F.col("book_order") == reference.book_order) & (F.col("chapter") == reference.chapter) & (F.col("verse") == reference.verse)
    ).select(F.col("id").alias("source_id"))
    own = corpus.tokens.join(F.broadcast(source), F.col("id") == F.col("source_id")).select("source_id", "folded", F.col("position").alias("i"))
    met = corpus.tokens.select("id", "folded", F.col("position").alias("j")).join(F.broadcast(own), "folded").where(F.col("id") != F.col("source_id"))
    diagonal = Window.partitionBy("id", "shift").orderBy("i")
    islands = met.withColumn("shift", F.col("j") - F.col("i")).withColumn("island", F.col("i") - F.row_number().over(diagonal))
    runs = islands.groupBy("id", "shift", "island").agg(
        F.min("i").alias("source_start"), F.min("j").alias("target_start"), F.count(F.lit(1)).alias("length")
    )
    return runs.where(F.col("length") >= least).join(corpus.verses.select("id", "label"), "id").select("label", "source_start", "target_start", "length")


def compare(corpus: Corpus, references: list[refs.Reference], config: ScoringConfig | None = None) -> dict[str, DataFrame]:
    """Two to ten verses side by side: what all share, what each alone has, and every pair's evidence.

    common_surface and common_normalized (token); unique (label, token); pairs (left, right, and the
    explanation), scored at the default level.
    """
    if not 2 <= len(references) <= 10:
        raise InvalidRequest("a comparison takes 2 to 10 references")
    rows = [corpus.verse(r) for r in references]
    ids = [r.id for r in rows]
    tokens = corpus.tokens.where(F.col("id").isin(ids))
    n_of = F.count_distinct("id")

    def common(layer: str) -> DataFrame:
        return tokens.groupBy(F.col(layer).alias("token")).agg(n_of.alias("n")).where(F.col("n") == len(set(ids))).select("token")

    alone = tokens.groupBy("normalized").agg(n_of.alias("n"), F.min("id").alias("id")).where("n = 1")
    labels = corpus.verses.where(F.col("id").isin(ids)).select("id", "label")
    n, threshold = corpus.size_and_threshold
    cfg = config or ScoringConfig()
    spark = corpus.spark
    schema = spark.createDataFrame([], EXPLANATION).schema
    own = [{"id": r.id, **{f: list(r[f]) for f in FIELDS}} for r in rows]
    found = [
        {"source_id": a["id"], "id": b["id"], **pairs.score_pair(a, b, cfg, n, threshold)} for k, a in enumerate(own) for b in own[k + 1 :]
    ]  # at most 45 pairs
    left = labels.withColumnsRenamed({"id": "source_id", "label": "left"})
    right = labels.withColumnRenamed("label", "right")
    return {
        "common_surface": common("surface"),
        "common_normalized": common("normalized"),
        "unique": alone.join(labels, "id").select("label", F.col("normalized").alias("token")),
        "pairs": spark.createDataFrame(found, schema).join(left, "source_id").join(right, "id"),
    }
