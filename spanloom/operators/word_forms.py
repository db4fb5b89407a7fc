"""What words of a vocabulary come from, what they are made of, and how rare what verses share is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import forms, numeric, refs
from ..sources.corpus import Corpus
from .second import Second, corpus_rarity, word_length_value

# Endings that are taken off, and beginnings and endings that are told.
STRIPPED = ["ingly", "edly", "ing", "eth", "est", "ed", "es", "s"]
BEGINNINGS = "a be con de dis en ex fore in mis non over pre re self sub trans un under".split()
ENDS = "able al ance dom ed en er est eth ful hood ing ion ish ism ist ity less ly ment ness ous ship ward wise y".split()


def _without(word: Column, ending: str) -> Column:
    """The word without an ending, if it has it and two letters more."""
    n = len(ending)
    return F.when(F.endswith(word, F.lit(ending)) & (F.length(word) > n + 1), word.substr(F.lit(1), F.length(word) - n))


def lemmas(word: Column) -> Column:
    """array<string>: a word in lower case and what it may come from, without the ending that it has.

    -ies and -ied may come from -y; before -ing and -ed an e may be lost, or the last letter doubled.
    Each is a rule of its own; rules that don't apply give null, and what is shorter than two letters goes.
    """
    word = F.lower(word)
    stems = {ending: _without(word, ending) for ending in STRIPPED}
    from_y = [F.when((F.length(word) > 4) & F.endswith(word, F.lit(x)), F.concat(word.substr(F.lit(1), F.length(word) - 3), F.lit("y"))) for x in ("ies", "ied")]
    lost_e = [F.concat(stems[x], F.lit("e")) for x in ("ing", "ed")]
    doubled = [
        F.when((F.length(stems[x]) > 2) & (stems[x].substr(-1, 1) == stems[x].substr(-2, 1)), stems[x].substr(F.lit(1), F.length(stems[x]) - 1))
        for x in ("ing", "ed")
    ]
    found = F.array_compact(F.array(*from_y, *stems.values(), *lost_e, *doubled))
    return F.array_distinct(F.concat(F.array(word), F.filter(found, lambda x: F.length(x) >= 2)))


def affixes(word: Column) -> tuple[Column, Column]:
    """Arrays of the beginnings and of the ends that a word has, with two letters more beside them."""
    long = lambda x: F.length(word) > len(x) + 1
    return (
        F.array_compact(F.array(*(F.when(F.startswith(word, F.lit(x)) & long(x), F.lit(x)) for x in BEGINNINGS))),
        F.array_compact(F.array(*(F.when(F.endswith(word, F.lit(x)) & long(x), F.lit(x)) for x in ENDS))),
    )


def word_forms(corpus: Corpus) -> DataFrame:
    """(word, lemmas, prefixes, suffixes) of every distinct word."""
    words = Second.of(corpus).vocabulary.select(F.col("folded").alias("word"))
    prefixes, suffixes = affixes(F.col("word"))
    return words.select("word", F.array_sort(lemmas(F.col("word"))).alias("lemmas"), prefixes.alias("prefixes"), suffixes.alias("suffixes"))


def compounds(corpus: Corpus) -> DataFrame:
    """(word, left_part, right_part, root): every way in which a word is one of the vocabulary followed by
    another, or by a form of it. Splits meet the vocabulary in joins, left parts first."""
    words = Second.of(corpus).vocabulary.select(F.col("folded").alias("word"))
    cut = words.where(F.length("word") > 1).select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    split = cut.select("word", F.col("word").substr(F.lit(1), F.col("at")).alias("left_part"), F.col("word").substr(F.col("at") + 1, F.length("word")).alias("right_part"))
    begun = split.join(words.select(F.col("word").alias("left_part")), "left_part", "left_semi")
    rooted = begun.withColumn("root", F.explode(lemmas(F.col("right_part"))))
    return rooted.join(words.select(F.col("word").alias("root")), "root", "left_semi").select("word", "left_part", "right_part", "root")


def shared_rarity(corpus: Corpus, reference: refs.Reference, cap: float = 2, idf_cap: float = 3) -> DataFrame:
    """(label, shared, concentration, continuous): how rare the words are that a verse shares with each other one.

    concentration: squares of rarity times length; continuous: squares of idf by the greatest one of the
    corpus; each summed over the distinct shared words, by its cap.
    """
    tables = Second.of(corpus)
    b = tables.bounds
    source = corpus.verse(reference)
    rarity = corpus_rarity(F.lit(b.most), F.col("frequency"), F.lit(b.least))
    idf = numeric.idf(F.lit(b.verses), F.col("verses"))
    most = tables.vocabulary.agg(F.max(idf)).first()[0]
    own = tables.vocabulary.where(F.col("folded").isin(sorted(set(source.folded)))).select(
        "folded",
        (F.pow(rarity, 2) * word_length_value(F.col("folded"), F.lit(18))).alias("rare"),
        F.pow(idf / F.lit(most), 2).alias("weighty"),
    )
    met = corpus.tokens.select("id", "folded").distinct().join(F.broadcast(own), "folded").where(F.col("id") != source.id)  # one verse's words
    sums = met.groupBy("id").agg(
        F.count(F.lit(1)).alias("shared"), *(numeric.sum_by(F.col("folded"), F.col(c)).alias(c) for c in ("rare", "weighty"))
    )
    return sums.join(corpus.verses.select("id", "label"), "id").select(
        "label", "shared", numeric.round6(numeric.clamp(F.col("rare") / cap)).alias("concentration"), numeric.round6(numeric.clamp(F.col("weighty") / idf_cap)).alias("continuous")
    )


def fragment_rarity(corpus: Corpus) -> DataFrame:
    """(position, fragment, rarity): how rare a segment is among the distinct words, on a logarithmic scale."""
    tables = Second.of(corpus)
    size = tables.bounds.vocabulary
    rarity = F.ln(F.lit(size + 1) / (F.greatest(F.lit(1), "words") + 1)) / F.ln(F.lit(size + 1))
    return tables.segments.select("position", "fragment", numeric.round6(rarity).alias("rarity"))


def word_measures(corpus: Corpus, word: str) -> DataFrame:
    """(term, prefix, suffix, substring, in_order, in_any_order, edits, morphology, kind, letters, letter_kind):
    how much every distinct word shares with one, and the scores made of that; one scan of the vocabulary."""
    most = Second.of(corpus).bounds.word_letters

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for term in batch.column(0).to_pylist():
                m, kind, *_ = forms.morphology(word, term)
                x, y = sorted((word, term))
                score, letter_kind, _ = forms.letter_pattern(x, y, most)
                shared = (f(word, term) for f in (forms.common_prefix, forms.common_suffix, forms.longest_substring, forms.ordered_letters, forms.unordered_letters))
                out.append((term, *map(len, shared), forms.levenshtein(word, term), m, kind, score, letter_kind))
            kinds = [pa.string(), *[pa.int32()] * 6, pa.float64(), pa.string(), pa.float64(), pa.string()]
            columns = zip(*out) if out else [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in MEASURES.split(", ")])

    return Second.of(corpus).vocabulary.select("folded").mapInArrow(run, MEASURES)


MEASURES = "term string, prefix int, suffix int, substring int, in_order int, in_any_order int, edits int, morphology double, kind string, letters double, letter_kind string"
