"""The second algorithm: relations beyond shared words, and a score of text and neighbourhood.

What the pair scorer needs of the whole corpus comes as columns: the frequency of each token, the
places of a verse on the axes of words, letters and chapters. Frequencies of the fragments and
phrases that the pairs turn out to rest on are joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import forms, numeric, pairs, refs, text
from ..plans.config import TESTAMENT_CUT
from ..plans.config import limit as checked_limit
from ..plans.errors import InvalidRequest
from ..plans.storage import staged
from ..sources.corpus import REFERENCE, Corpus, in_testament
from . import statistics

QUOTA, RELATIONS, SOURCES = 5000, 240, 8


def corpus_rarity(most: Column, frequency: Column, least: Column | float = 1) -> Column:
    low = F.lit(least) if not isinstance(least, Column) else least
    top, here = F.greatest(low, most), F.greatest(low, frequency)
    return numeric.round6(numeric.clamp((1 + F.ln((top + 1) / (here + 1))) / (1 + F.ln((top + 1) / (low + 1)))))


def word_length_value(word: Column, most: Column | int = 18) -> Column:
    top = F.greatest(F.lit(1), F.lit(most) if isinstance(most, int) else most)
    return numeric.round6(numeric.clamp(F.log1p(text.letters(word)) / F.log1p(top)))


def exact_word_evidence(word: Column, rarity: Column, most: int = 18) -> Column:
    return numeric.round6(word_length_value(word, most) * (0.30 + 0.70 * numeric.clamp(rarity)))


def repetition_value(count: Column, most: int = 18) -> Column:
    return numeric.round6(numeric.clamp(F.log1p(F.greatest(F.lit(0), count)) / F.log1p(F.lit(max(1, most)))))


def interval_gap(a: Column, a_end: Column, b: Column, b_end: Column) -> Column:
    return F.when(a_end < b, b - a_end - 1).when(b_end < a, a - b_end - 1).otherwise(0)


def log_closeness(distance: Column, most: Column) -> Column:
    return numeric.clamp(1 - F.log1p(F.greatest(F.lit(0), distance)) / F.log1p(F.greatest(F.lit(1), most)))


def linear_closeness(distance: Column, most: Column) -> Column:
    return numeric.clamp(1 - F.greatest(F.lit(0), distance) / F.greatest(F.lit(1), most))


def weighted(values: dict[str, Column], counts: dict[str, int]) -> Column:
    total = F.lit(0.0)
    for name, n in counts.items():
        total = total + n * numeric.clamp(F.coalesce(values[name], F.lit(0.0)))
    return numeric.round6(numeric.clamp(total / sum(counts.values())))


class Second:
    """Tables of a corpus for this algorithm; its tokens should be of text.JOINED_TOKEN."""

    def __init__(self, corpus: Corpus):
        self.corpus = corpus
        self.width = int(corpus.spark.conf.get("spark.sql.shuffle.partitions"))

    @classmethod
    def of(cls, corpus: Corpus) -> Second:
        """One for each prepared corpus, so that its tables are built once too."""
        if "second" not in corpus.__dict__:
            corpus.__dict__["second"] = cls(corpus)
        return corpus.__dict__["second"]

    def _kept(self, df: DataFrame) -> DataFrame:
        return staged(df) if self.corpus.is_written else df

    @cached_property
    def segments(self) -> DataFrame:
        return self._kept(statistics.segment_frequency(self.corpus))

    @cached_property
    def vocabulary(self) -> DataFrame:
        """(folded, frequency, verses, letters)."""
        counted = self.corpus.tokens.groupBy("folded").agg(F.count(F.lit(1)).alias("frequency"), F.count_distinct("id").alias("verses"))
        return self._kept(counted.withColumn("letters", text.letters(F.col("folded"))))

    @cached_property
    def axes(self) -> DataFrame:
        """(id, word_start, word_end, letter_start, letter_end): running counts, summed a chapter first."""
        size = self.corpus.verses.select(
            "id", "book_order", "chapter",
            F.size(s := text.surfaces(F.col("display_text"), self.corpus.pattern)).alias("words"),
            F.aggregate(s, F.lit(0), lambda acc, x: acc + text.letters(x)).alias("letters"),
        )
        chapters = size.groupBy("book_order", "chapter").agg(F.sum("words").alias("cw"), F.sum("letters").alias("cl"))
        before = Window.orderBy("book_order", "chapter").rowsBetween(Window.unboundedPreceding, -1)
        first = chapters.select("book_order", "chapter", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("cw", "cl")))
        within = Window.partitionBy("book_order", "chapter").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
        at = size.withColumns({"w": F.sum("words").over(within), "l": F.sum("letters").over(within)}).join(first, ["book_order", "chapter"])
        ends = lambda start, end: F.greatest(start, end - 1)
        w, l_ = F.col("cw") + F.col("w") - F.col("words"), F.col("cl") + F.col("l") - F.col("letters")
        return at.select(
            "id", w.alias("word_start"), ends(w, F.col("cw") + F.col("w")).alias("word_end"), l_.alias("letter_start"), ends(l_, F.col("cl") + F.col("l")).alias("letter_end")
        )

    @cached_property
    def bounds(self):
        """One row of scalars: what the scorer measures against."""
        words = self.corpus.verses.agg(
            F.max(F.size(s := text.surfaces(F.col("display_text"), self.corpus.pattern))).alias("verse_words"),
            F.sum(F.size(s)).alias("tokens"),
            F.sum(F.aggregate(s, F.lit(0), lambda acc, x: acc + text.letters(x))).alias("letters"),
            F.count(F.lit(1)).alias("verses"),
            F.count_distinct("book_order", "chapter").alias("chapters"),
            F.max("book_order").alias("books"),
        )
        vocab = self.vocabulary.agg(
            F.count(F.lit(1)).alias("vocabulary"), F.max("letters").alias("word_letters"), F.max("frequency").alias("most"), F.min("frequency").alias("least")
        )
        return words.crossJoin(vocab).first()  # one row each

    @cached_property
    def survival(self) -> tuple[dict, dict]:
        """How many words have n letters or more, and how many pairs of word and verse n repetitions or more."""
        return tuple({r.n: r.survivors for r in f(self.corpus).collect()} for f in (statistics.length_survival, statistics.repetition_survival))  # a row a length

    @cached_property
    def features(self) -> DataFrame:
        rows = (
            self.corpus.tokens.join(self.vocabulary.select("folded", "frequency"), "folded")
            .groupBy("id")
            .agg(F.array_sort(F.collect_list(F.struct("position", "char_start", "char_end", "surface", "folded", "frequency"))).alias("t"))
        )
        empty = lambda kind: F.array().cast(f"array<{kind}>")
        pick = lambda c, kind: F.coalesce(F.col(f"t.{c}"), empty(kind)).alias(c)
        return self._kept(
            self.corpus.verses.join(rows, "id", "left")
            .join(self.axes, "id")
            .select(
                "id", "label", "book", *REFERENCE, "chapter_ordinal", F.coalesce("display_text", F.lit("")).alias("display_text"),
                "word_start", "word_end", "letter_start", "letter_end", pick("surface", "string"), pick("folded", "string"),
                pick("frequency", "bigint"), pick("char_start", "int"), pick("char_end", "int"),
            )
        )

    def verse(self, reference: refs.Reference):
        self.corpus.verse(reference)  # says so if there is none
        return self.features.where(
            (F.col("book_order") == reference.book_order) & (F.col("chapter") == reference.chapter) & (F.col("verse") == reference.verse)
        ).first()

    # -- proximity ---------------------------------------------------------------------------

    def proximity(self, rows: DataFrame, source) -> DataFrame:
        """rows (with the columns of features) with axes (a struct of six) and proximity."""
        b = self.bounds
        most = lambda n: F.lit(max(1, n - 1))
        gap = lambda s, e: interval_gap(F.lit(source[s]), F.lit(source[e]), F.col(s), F.col(e))
        apart = lambda c: F.abs(F.col(c) - F.lit(source[c]))
        values = {
            "word": log_closeness(gap("word_start", "word_end"), most(b.tokens)),
            "book": linear_closeness(apart("book_order"), most(b.books)),
            "letter": log_closeness(gap("letter_start", "letter_end"), most(b.letters)),
            "verse": linear_closeness(apart("id"), most(b.verses)),
            "chapter": linear_closeness(apart("chapter_ordinal"), most(b.chapters)),
            "testament": ((F.col("book_order") <= TESTAMENT_CUT) == F.lit(source.book_order <= TESTAMENT_CUT)).cast("double"),
        }
        return rows.withColumns(
            {"axes": F.struct(*(numeric.round6(v).alias(k) for k, v in values.items())), "proximity": weighted(values, forms.PROXIMITY)}
        )

    # -- relations between words ---------------------------------------------------------------

    def word_relations(self, words: list[str], limit: int = RELATIONS) -> DataFrame:
        """(source_term, term, score, kind, tier): the words of the vocabulary most like one of a few words.

        The (at most 8) longest words are held against every distinct word of the corpus, in one scan
        of the vocabulary: never against its verses.
        """
        most = self.bounds.word_letters
        sources = sorted(set(words), key=lambda w: (-forms.word_length_value(w, most), w))[:SOURCES]
        schema = "source_term string, term string, score double, kind string, fragment string, tier string, verses bigint"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for term, verses in zip(*(c.to_pylist() for c in batch.columns)):
                    best = None
                    for source in sources:
                        if term == source:
                            best = (source, term, 1.0, "exact_word", source, "exact", verses)
                            break
                        m, kind, fragment, _ = forms.morphology(source, term)
                        x, y = sorted((source, term))
                        score_l, kind_l, fragment_l = forms.letter_pattern(x, y, most)
                        score = forms.recursive_mean([m, score_l])
                        if score > 0 and (best is None or best[2] < score):
                            best = (source, term, pairs.round6(score), *((kind, fragment, "morphology") if m else (kind_l, fragment_l, "letters")), verses)
                    if best:
                        out.append(best)
                columns = zip(*out) if out else [[]] * 7
                kinds = [pa.string(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["source_term", "term", "score", "kind", "fragment", "tier", "verses"])

        spread = self.vocabulary.select("folded", "verses").repartition(self.width)
        found = spread.mapInArrow(run, schema)
        return found.orderBy(F.col("score").desc(), F.collate("term", "UNICODE")).limit(limit)

    def word_family(self, term: str, shown: int = 60, discovered: int = 300) -> DataFrame:
        """(rank, term, score, kind, tier, verses, examples): words like one, with their first three verses."""
        top = self.word_relations([term.lower()], discovered).withColumn(
            "rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.collate("term", "UNICODE")))
        ).where(F.col("rank") <= shown)  # at most 300 rows
        hits = self.corpus.tokens.select("folded", "id", "book", *REFERENCE).distinct().join(F.broadcast(top.select(F.col("term").alias("folded"))), "folded")
        place = F.row_number().over(Window.partitionBy("folded").orderBy("id"))
        first = hits.withColumn("n", place).where("n <= 3").groupBy(F.col("folded").alias("term")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("id", refs.label(F.col("book"), F.col("chapter"), F.col("verse")).alias("label")))), lambda x: x.label).alias("examples")
        )
        return top.join(first, "term").select("rank", "term", "score", "kind", "tier", "verses", "examples")

    # -- candidates and scores ----------------------------------------------------------------

    def candidates(self, source, books: list[str] | None = None, testament: str | None = None) -> DataFrame:
        """(id, identity, exact, morphology, letters, bound): verses in any of the four tiers.

        identity: the same displayed text or the same tokens; exact: a shared word; the other two:
        a word related to one of the source's. bound estimates the score for the order of evaluation.
        """
        b = self.bounds
        relations = self.word_relations(source.folded)
        tiers = F.broadcast(relations.select(F.col("term").alias("folded"), "tier").where("tier <> 'exact'"))  # at most 240
        rows = self.features.where((F.col("id") != source.id) & in_testament(testament))
        if books:
            rows = rows.where(F.col("book").isin(list(books)))
        words = rows.select("id", F.explode(F.array_distinct("folded")).alias("folded")).join(tiers, "folded").groupBy("id").agg(
            F.max(F.col("tier") == "morphology").alias("m"), F.max(F.col("tier") == "letters").alias("l")
        )
        own = list(dict.fromkeys(source.folded))
        tw = lambda x: word_length_value(x, F.lit(b.word_letters))
        distinct = F.array_distinct("folded")
        shared = F.array_intersect(distinct, F.lit(own) if own else F.array().cast("array<string>"))
        frequency = F.map_from_entries(F.array_distinct(F.arrays_zip("folded", "frequency")))
        rarity = F.transform(shared, lambda t: F.pow(corpus_rarity(F.lit(b.most), F.element_at(frequency, t), float(b.least)), 2))
        own_weight = sum(forms.word_length_value(w, b.word_letters) for w in own)
        total = F.lit(own_weight) + numeric.ordered_sum(F.transform(distinct, tw))
        coverage = 2 * numeric.ordered_sum(F.transform(shared, tw)) / F.when(total > 0, total).otherwise(1.0)
        bound = F.when(F.size(shared) > 0, numeric.round6(0.35 * coverage + 0.25 * numeric.ordered_sum(rarity) / F.size(shared))).otherwise(0.0)
        same = (F.col("display_text") == source.display_text) | (F.col("folded") == (F.lit(list(source.folded)) if own else F.array().cast("array<string>")))
        tiered = rows.join(words, "id", "left").select(
            "*", same.alias("identity"), (F.size(shared) > 0).alias("exact"), F.coalesce("m", F.lit(False)).alias("morphology"),
            F.coalesce("l", F.lit(False)).alias("letters_tier"), bound.alias("bound"),
        )
        return tiered.where("identity or exact or morphology or letters_tier")

    def related(
        self, reference: refs.Reference, limit: int | None = 50, books: list[str] | None = None, testament: str | None = None,
        level: str = "exact_spelling", minimum_score: float = 0.0, quota: int = QUOTA,
    ) -> DataFrame:
        """The verses related to one by this algorithm, ranked, with components and rank.

        Of the candidates, identities first and then by their bound, the first `quota` are scored.
        """
        source = self.verse(reference)
        found = self.candidates(source, books, testament)
        chosen = staged(found.orderBy(F.col("identity").desc(), F.col("bound").desc(), "id").limit(quota)).repartition(self.width)
        scored = self.finish(self.measure(chosen, source, level), source, level).where(F.col("score") >= minimum_score)
        order = Window.orderBy(F.col("identity_score").desc(), F.col("score").desc(), F.col("textual").desc(), F.col("proximity").desc(), *REFERENCE)
        n = checked_limit(limit, 50)
        top = scored.orderBy(F.col("identity_score").desc(), F.col("score").desc(), F.col("textual").desc(), F.col("proximity").desc(), *REFERENCE).limit(n)
        return top.withColumn("rank", F.row_number().over(order))  # at most 500 rows

    def compare(self, references: list[refs.Reference], level: str = "exact_spelling") -> DataFrame:
        """(left, right, score, ...): every two of 2 to 10 verses, scored as by `related`."""
        if not 2 <= len(references) <= 10:
            raise InvalidRequest("a comparison takes 2 to 10 references")
        rows = [self.verse(r) for r in references]
        out = None
        for k, source in enumerate(rows[:-1]):
            later = [r.id for r in rows[k + 1 :]]
            pairs_of = self.finish(self.measure(self.features.where(F.col("id").isin(later)), source, level), source, level)
            pairs_of = pairs_of.withColumns({"left": F.lit(source.label), "right": F.col("label")})
            out = pairs_of if out is None else out.unionByName(pairs_of)
        return out

    def graph(self, reference: refs.Reference, results: int = 10, terms: int = 8, nodes: int = 30) -> dict[str, DataFrame]:
        """nodes (node, kind, place) and edges (source, target, kind, score): a verse, its best results and the
        first shared words of each, in the order in which they are met; what is beyond `nodes` is left out."""
        top = staged(self.related(reference, results).select("rank", "label", "score", F.slice("shared", 1, terms).alias("shared")))
        name = str(reference)
        words = top.select("rank", "label", F.posexplode("shared").alias("k", "term"))
        met = (
            self.corpus.spark.createDataFrame([(name, "verse", 0, -1)], "node string, kind string, rank int, k int")
            .unionByName(top.select(F.col("label").alias("node"), F.lit("verse").alias("kind"), "rank", F.lit(-1).alias("k")))
            .unionByName(words.select(F.concat(F.lit("term:"), "term").alias("node"), F.lit("term").alias("kind"), "rank", "k"))
        )
        first = met.groupBy("node", "kind").agg(F.min(F.struct("rank", "k")).alias("at"))
        placed = first.select("node", "kind", F.row_number().over(Window.orderBy("at")).alias("place")).where(F.col("place") <= nodes)  # at most 91 rows
        edge = lambda source, target, kind, score: F.struct(source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), score.alias("score"))
        term = F.concat(F.lit("term:"), "term")
        edges = top.select(F.inline(F.array(edge(F.lit(name), F.col("label"), "lexical_similarity", F.col("score"))))).unionByName(
            words.select(F.inline(F.array(edge(F.lit(name), term, "contains_term", F.lit(1.0)), edge(term, F.col("label"), "contains_term", F.lit(1.0)))))
        )
        for side in ("source", "target"):
            edges = edges.join(placed.select(F.col("node").alias(side)), side, "left_semi")
        return {"nodes": placed, "edges": edges.distinct()}

    def topic_branches(self, senses: DataFrame, selected: str | None = None, shown: int = 12) -> DataFrame:
        """(sense_id, term, score, confidence, bridge_strength, rank): for each sense of a dictionary's entry, the
        words of the corpus most like its synonyms. Without a selection each sense is a branch of equal confidence."""
        rows = senses.collect()  # one entry
        kept = [r for r in rows if selected in (None, r.sense_id)]
        confidence = 1.0 if selected else pairs.round6(1 / max(2, len(rows)))
        out = None
        for r in kept:
            words = sorted({w.lower() for s in r.synonyms for w in forms.parts(s.replace("_", " ")) if " " not in s.replace("_", " ")})
            if words:
                found = self.word_relations(words, shown)
                order = Window.orderBy(F.col("score").desc(), F.collate("term", "UNICODE"))
                branch = found.select(
                    F.lit(r.sense_id).alias("sense_id"), "term", "score", F.lit(confidence).alias("confidence"), numeric.round6(F.col("score") * confidence).alias("bridge_strength"),
                    F.row_number().over(order).alias("rank"),
                )
                out = branch if out is None else out.unionByName(branch)
        return out if out is not None else self.corpus.spark.createDataFrame([], "sense_id string, term string, score double, confidence double, bridge_strength double, rank int")

    def tier_totals(self, reference: refs.Reference, quota: int = QUOTA) -> DataFrame:
        """(tier, total, evaluated, pruned) of a verse's candidates."""
        rows = self.candidates(self.verse(reference))
        names = {"complete_verse_identity": "identity", "shared_vocabulary": "exact", "morphology": "morphology", "letter_patterns": "letters_tier"}
        counted = rows.agg(*(F.count_if(F.col(c)).alias(t) for t, c in names.items()))
        cut = lambda t: F.col(t) if t == "complete_verse_identity" else F.least(F.col(t), F.lit(quota))
        lines = [F.struct(F.lit(t).alias("tier"), F.col(t).alias("total"), cut(t).alias("evaluated"), (F.col(t) - cut(t)).alias("pruned")) for t in names]
        return counted.select(F.inline(F.array(*lines)))

    MEASURED = """
    id bigint, jaccard double, phrase double, phrase_variant double, ordering double, capitalization double,
    rarities array<double>, phrase_texts array<string>, phrase_count int, variant_count int, shared array<string>, identity_score double,
    order_measurements map<string, double>, near_phrases int
    """

    def measure(self, rows: DataFrame, source, level: str = "exact_spelling") -> DataFrame:
        """MEASURED rows joined with the features they measure: all that a pair tells by itself."""
        b, (length_left, repetition_left) = self.bounds, self.survival
        layer = "surface" if level == "letter_exact" else "folded"
        own = source.asDict(recursive=True)
        own = {k: own[k] for k in ("display_text", "surface", "folded", "frequency", "char_start", "char_end")}
        schema = to_arrow_schema(rows.sparkSession.createDataFrame([], self.MEASURED).schema)
        most, words = b.word_letters, max(1, b.verse_words - 1)
        top, low, vocabulary = b.most, b.least, b.vocabulary

        def one(target: dict) -> dict:
            a, c = own[layer], target[layer]
            tw = lambda t: forms.word_length_value(t, most)
            frequency = {**dict(zip(target["folded"], target["frequency"])), **dict(zip(own["folded"], own["frequency"]))}
            count_a, count_c = forms.Counter(a), forms.Counter(c)
            shared = [w for w in count_a if w in count_c]
            matched = sum((min(tw(w) * count_a[w], tw(w) * count_c[w]) for w in shared), 0.0)
            whole = sum((tw(w) * n for w, n in count_a.items()), 0.0) + sum((tw(w) * n for w, n in count_c.items()), 0.0)
            exact, variant = forms.phrases(own, target, a, c, level == "letter_exact")
            text_of = lambda r: forms.display_slice(own, r[1], r[0])
            weight_of = lambda r: pairs.round6(pairs.clamp(forms.log_share(len(forms.letters(text_of(r))), most)))
            left = left_variant = 1.0
            for r in exact:
                left *= 1 - weight_of(r)
            for r in variant:
                left_variant *= 1 - weight_of(r) * r[3]
            ordering, measured, aligned = forms.order_evidence(a, c, tw, words)
            case = [(pairs.round6(tw(own["folded"][i])), forms.case_evidence(own["surface"][i], target["surface"][j])) for i, j, _ in aligned]
            case_weight = sum((w for w, _ in case), 0.0)
            rarities = [forms.corpus_rarity(top, frequency.get(w.lower(), low), low) for w in shared]
            rarities += [forms.corpus_rarity(vocabulary, length_left.get(len(forms.letters(w)), 1), 1) for w in shared]
            once = repetition_left.get(1, 1)
            rarities += [forms.corpus_rarity(once, repetition_left.get(min(count_a[w], count_c[w]), 1), 1) for w in shared]
            identity = 0.0
            if own["folded"] == target["folded"]:
                identity = forms.sequence_measurements(own["display_text"], target["display_text"], own["surface"], target["surface"])
            near = forms.near_phrases(a, c, words)
            r6, cl = pairs.round6, pairs.clamp
            return {
                "id": target["id"], "jaccard": r6(cl(2 * matched / (whole or 1))), "phrase": r6(cl(1 - left)), "phrase_variant": r6(cl(1 - left_variant)),
                "ordering": ordering, "capitalization": r6(cl(sum((w * m for w, m in case), 0.0) / case_weight)) if case_weight else 0.0,
                "rarities": rarities,
                "phrase_texts": [text_of(r).lower() for r in exact + variant], "phrase_count": len(exact), "variant_count": len(variant),
                "shared": shared, "identity_score": identity, "order_measurements": list(measured.items()), "near_phrases": sum(x["gap"] > 0 for x in near),
            }

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_pylist([one(t) for t in batch.to_pylist()], schema)

        needed = rows.select("id", "display_text", "surface", "folded", "frequency", "char_start", "char_end")
        measured = needed.mapInArrow(run, self.MEASURED).join(self.best_words(rows, list(dict.fromkeys(own[layer])), layer), "id", "left")
        blank = {"morphology_score": 0.0, "letter_score": 0.0, "morphology_fragment": "", "morphology_position": "", "letter_kind": "", "letter_fragment": ""}
        measured = measured.fillna(blank)
        keep = ["id", "label", "book", *REFERENCE, "chapter_ordinal", "word_start", "word_end", "letter_start", "letter_end"]
        return measured.join(rows.select(*keep), "id")

    def best_words(self, rows: DataFrame, words: list[str], layer: str) -> DataFrame:
        """(id, morphology_*, letter_*): the best relation of a row's words with other words of the source.

        Each distinct word of the corpus is held against the source's words once; verses then take
        the best of their words: by score, then the earliest of the source's words, then their own.
        """
        most = self.bounds.word_letters
        schema = "word string, m struct<score: double, x: int, fragment: string, position: string>, l struct<score: double, x: int, kind: string, fragment: string>"
        arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for word in batch.column(0).to_pylist():
                    m, lp = (0.0, 0, "", ""), (0.0, 0, "", "")
                    for x, own in enumerate(words):
                        if own != word:
                            score, _, fragment, position = forms.morphology(own, word)
                            if score > m[0]:
                                m = (score, x, fragment, position)
                            score, kind, fragment = forms.letter_pattern(*sorted((own, word)), most)
                            if score > lp[0]:
                                lp = (score, x, kind, fragment)
                    out.append({"word": word, "m": dict(zip(("score", "x", "fragment", "position"), m)), "l": dict(zip(("score", "x", "kind", "fragment"), lp))})
                yield pa.RecordBatch.from_pylist(out, arrow)

        exploded = rows.select("id", F.posexplode(layer).alias("at", "word"))
        # the comparison outweighs its input by far: tasks must not be merged for the input's size
        related_words = exploded.select("word").distinct().repartition(self.width).mapInArrow(run, schema)
        first = lambda c: F.min(F.struct((-F.col(f"{c}.score")).alias("s"), F.col(f"{c}.x").alias("x"), "at", F.col(c).alias("best"))).alias(c)
        best = exploded.join(related_words, "word").groupBy("id").agg(first("m"), first("l"))
        return best.select(
            "id", F.col("m.best.score").alias("morphology_score"), F.col("m.best.fragment").alias("morphology_fragment"), F.col("m.best.position").alias("morphology_position"),
            F.col("l.best.score").alias("letter_score"), F.col("l.best.kind").alias("letter_kind"), F.col("l.best.fragment").alias("letter_fragment"),
        )

    def near_phrases(self, reference: refs.Reference) -> DataFrame:
        """(label, source_start, target_start, length, gap, value): spans of a verse whose words stand in another
        verse in order, with how much lies between them there; in one scan of the verses that share a word."""
        source = self.verse(reference)
        words, most = list(source.folded), max(1, self.bounds.verse_words - 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for label, there in zip(*(c.to_pylist() for c in batch.columns)):
                    out += [(label, x["start"], x["target_start"], x["length"], x["gap"], x["value"]) for x in forms.near_phrases(words, there, most)]
                kinds = [pa.string(), *[pa.int32()] * 4, pa.float64()]
                columns = zip(*out) if out else [[]] * 6
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["label", "source_start", "target_start", "length", "gap", "value"])

        hit = F.arrays_overlap("folded", F.lit(sorted(set(words)))) if words else F.lit(False)
        rows = self.features.where(hit & (F.col("id") != source.id)).select("label", "folded")
        return rows.mapInArrow(run, "label string, source_start int, target_start int, length int, gap int, value double")

    def phrase_frequency(self, source) -> DataFrame:
        """(phrase, times): how often each displayed phrase of a verse stands in the corpus, in one scan."""
        own = {k: source[k] for k in ("display_text", "folded", "char_start", "char_end")}
        words = list(own["folded"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen: forms.Counter = forms.Counter()
                for target in batch.to_pylist():
                    there = set()
                    for n, i, j in pairs.common_runs(words, target["folded"]):
                        for m in range(2, n + 1):
                            mine = forms.display_slice(own, i, m).lower()
                            if mine != forms.display_slice(target, j, m).lower():
                                break
                            there.add((mine, j))
                    seen.update(p for p, _ in there)
                yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["phrase", "times"])

        hit = F.arrays_overlap("folded", F.lit(sorted(set(words)))) if words else F.lit(False)
        rows = self.features.where(hit).select("display_text", "folded", "char_start", "char_end")
        return rows.mapInArrow(run, "phrase string, times bigint").groupBy("phrase").agg(F.sum("times").alias("times"))

    def finish(self, measured: DataFrame, source, level: str = "exact_spelling") -> DataFrame:
        """Measured pairs with the frequencies of what they rest on, the groups, and the score."""
        b = self.bounds
        size = F.lit(b.vocabulary)
        segments = self.segments
        wanted = measured.select(F.explode(F.array("morphology_fragment", "letter_fragment")).alias("fragment")).distinct()
        known = segments.join(wanted, "fragment", "left_semi").groupBy("fragment").agg(F.map_from_entries(F.collect_list(F.struct("position", "words"))).alias("at"))
        characters = statistics.character_frequency(self.corpus).agg(F.map_from_entries(F.collect_list(F.struct("character", "words"))).alias("chars"))  # an alphabet
        phrases = self.phrase_frequency(source).agg(F.map_from_entries(F.collect_list(F.struct("phrase", "times"))).alias("phrases"))  # one verse's
        side = lambda s: known.select(F.col("fragment").alias(f"{s}_fragment"), F.col("at").alias(f"{s}_at"))
        rows = (
            measured.join(side("morphology"), "morphology_fragment", "left")
            .join(side("letter"), "letter_fragment", "left")
            .crossJoin(F.broadcast(characters))
            .crossJoin(F.broadcast(phrases))
        )
        at = lambda s, p: F.try_element_at(F.col(f"{s}_at"), p)
        segment = corpus_rarity(size, F.coalesce(at("morphology", F.col("morphology_position")), at("morphology", F.lit("any")), F.lit(1)))
        rarest = F.array_min(F.transform(F.array_distinct(F.filter(F.split("letter_fragment", ""), lambda c: c != "")), lambda c: F.coalesce(F.try_element_at("chars", c), size)))
        # a word is its own prefix and suffix: whole words count among the initial and terminal ones
        edge = lambda p: F.nullif(F.coalesce(at("letter", F.lit(p)), F.lit(0)) + F.coalesce(at("letter", F.lit("whole")), F.lit(0)), F.lit(0))
        kind = F.col("letter_kind")
        count = F.coalesce(
            F.when(kind == "raw_prefix", edge("initial")).when(kind == "raw_suffix", edge("terminal")).when(kind == "raw_substring", at("letter", F.lit("any"))).otherwise(rarest),
            size,
        )
        pattern = numeric.round6(F.ln((size + 1) / (F.greatest(F.lit(1), count) + 1)) / F.ln(size + 1))
        of_phrases = F.transform("phrase_texts", lambda p: corpus_rarity(F.lit(b.tokens), F.coalesce(F.try_element_at("phrases", p), F.lit(1))))
        rare = F.concat(
            "rarities", of_phrases,
            F.array(F.when(F.col("morphology_score") > 0, segment).otherwise(0.0), F.when(F.col("letter_score") > 0, pattern).otherwise(0.0)),
        )
        rows = rows.withColumn("rarity", numeric.round6(numeric.clamp(numeric.recursive_mean(rare))))
        c = F.col
        groups = {
            "word": numeric.clamp(numeric.recursive_mean(F.array("jaccard", "morphology_score", "phrase", "phrase_variant"))),
            "rarity": numeric.clamp(c("rarity")),
            "letter": numeric.clamp(numeric.recursive_mean(F.array("letter_score", "capitalization"))),
            "order": numeric.clamp(c("ordering")),
            "line": numeric.clamp(c("phrase")),
        }
        rows = rows.withColumns({"groups": F.struct(*(numeric.round6(v).alias(k) for k, v in groups.items())), "textual": weighted(groups, forms.TEXTUAL)})
        near = self.proximity(rows, source)
        final = F.least(F.lit(forms.MOST_SCORE), weighted({"textual": c("textual"), "neighbour": c("proximity")}, forms.FINAL))
        reasons = {
            "complete_verse_identity": c("identity_score") > 0, "shared_nonzero_token": F.size("shared") > 0, "shared_exact_phrase": c("phrase_count") > 0,
            "punctuation_variant_phrase": c("variant_count") > 0, "morphological_relationship": c("morphology_score") > 0, "letter_pattern": c("letter_score") > 0,
        }
        return near.withColumns(
            {
                "score": F.when(c("identity_score") > 0, c("identity_score")).otherwise(final),
                "reasons": F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in reasons.items()))),
            }
        )


def text_identities(corpus: Corpus) -> DataFrame:
    """(label_a, label_b, level): verses of the same tokens; level says whether the displayed text is the same too.

    Verses meet by the digest of their tokens. A first verse stands for its group, so that a text
    repeated very often gives a row a verse, not a row a pair.
    """
    tokens = text.surfaces(F.col("display_text"), corpus.pattern)
    rows = corpus.verses.select("id", "label", "display_text", F.lower(F.array_join(tokens, "\x1f")).alias("key")).where("key <> ''")
    first = rows.groupBy("key").agg(F.min(F.struct("id", "label", "display_text")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(first, "key").where(F.col("id") != F.col("first.id")).select(
        F.col("first.label").alias("label_a"),
        F.col("label").alias("label_b"),
        F.when(F.col("display_text") == F.col("first.display_text"), "exact_display_text").otherwise("measured_complete_token_sequence").alias("level"),
    )


def text_identity_classes(corpus: Corpus) -> DataFrame:
    """(label, token_class, text_class, verses): of every verse whose tokens another verse has, its classes.

    token_class is the first verse with the same tokens, text_class the first of these with the same
    displayed text, so that any two verses of a class can be told apart; verses is the token class's size.
    """
    tokens = text.surfaces(F.col("display_text"), corpus.pattern)
    rows = corpus.verses.select("id", "label", "display_text", F.lower(F.array_join(tokens, "\x1f")).alias("key")).where("key <> ''")
    first = F.min_by("label", "id")
    by_tokens = rows.groupBy("key").agg(first.alias("token_class"), F.count(F.lit(1)).alias("verses")).where("verses > 1")
    by_text = rows.groupBy("key", "display_text").agg(first.alias("text_class"))
    return rows.join(by_tokens, "key").join(by_text, ["key", "display_text"]).select("label", "token_class", "text_class", "verses")


def weighted_dice(corpus: Corpus, reference: refs.Reference) -> DataFrame:
    """(label, dice): twice the common weight by the sum of weights, words weighted by length and counted
    as often as they stand."""
    most = corpus.tokens.agg(F.max(text.letters(F.col("folded"))).alias("most"))
    counted = corpus.tokens.groupBy("id", "folded").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(most))  # one row
    rows = counted.select("id", "folded", "n", word_length_value(F.col("folded"), F.col("most")).alias("w"))
    source = corpus.verses.where(
        (F.col("book_order") == reference.book_order) & (F.col("chapter") == reference.chapter) & (F.col("verse") == reference.verse)
    ).select(F.col("id").alias("source_id"))
    own = rows.join(F.broadcast(source), F.col("id") == F.col("source_id")).select("source_id", "folded", F.col("n").alias("own_n"), F.col("w").alias("own_w"))
    total = own.groupBy("source_id").agg(numeric.sum_by(F.col("folded"), F.col("own_n") * F.col("own_w")).alias("own_total"))
    sums = rows.join(F.broadcast(own.drop("source_id")), "folded", "left").groupBy("id").agg(
        numeric.sum_by(F.col("folded"), F.col("n") * F.col("w")).alias("total"),
        numeric.sum_by(F.col("folded"), F.coalesce(F.least(F.col("n") * F.col("w"), F.col("own_n") * F.col("own_w")), F.lit(0.0))).alias("common"),
        F.count("own_n").alias("shared"),
    )
    joined = sums.where("shared > 0").crossJoin(F.broadcast(total)).where(F.col("id") != F.col("source_id"))  # one row
    return joined.join(corpus.verses.select("id", "label"), "id").select("label", numeric.round6(2 * F.col("common") / (F.col("total") + F.col("own_total"))).alias("dice"))


def identity_measures(corpus: Corpus) -> DataFrame:
    """(label, first, score): for each verse with the tokens of an earlier one, how far both texts agree place
    by place, in tokens, letters, marks and characters."""
    features = Second.of(corpus).features.where(F.size("folded") > 0)
    keyed = features.select("id", "label", "display_text", "surface", F.md5(F.array_join("folded", "\x1f")).alias("key"))
    first = keyed.groupBy("key").agg(F.min(F.struct("id", "label", "display_text", "surface")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keyed.join(first, "key").where(F.col("id") != F.col("first.id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            scores = [forms.sequence_measurements(r["first"]["display_text"], r["display_text"], r["first"]["surface"], r["surface"]) for r in rows]
            labels = [[r["label"] for r in rows], [r["first"]["label"] for r in rows]]
            yield pa.record_batch([*(pa.array(x, pa.string()) for x in labels), pa.array(scores, pa.float64())], names=["label", "first", "score"])

    return met.select("label", "display_text", "surface", "first").mapInArrow(run, "label string, first string, score double")
