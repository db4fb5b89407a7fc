"""Exact search: words, phrases, distributions, passages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import refs, text
from ..plans.config import limit as checked_limit
from ..plans.config import within
from ..plans.errors import InvalidRequest, NotFound
from ..sources.corpus import REFERENCE, Corpus

KEY = ["id", "book", *REFERENCE]


def query_tokens(corpus: Corpus, query: str) -> list[str]:
    import regex

    return regex.findall(corpus.pattern, query)


def _key(case_sensitive: bool) -> str:
    return "surface" if case_sensitive else "folded"


def _form(token: str, case_sensitive: bool) -> str:
    import unicodedata

    return token if case_sensitive else unicodedata.normalize("NFC", token).lower()


def word_matches(corpus: Corpus, query: str, case_sensitive: bool = False, layer: str | None = None) -> DataFrame:
    """(id, book, ..., positions, surfaces): the verses that hold a word, with where.

    The filter on the word reaches the token table's scan; only the matching tokens are grouped.
    """
    words = query_tokens(corpus, query)
    if len(words) != 1:
        raise InvalidRequest("a word search takes one word")
    hits = corpus.tokens.where(F.col(layer or _key(case_sensitive)) == _form(words[0], case_sensitive))
    at = F.array_sort(F.collect_list(F.struct("position", "surface")))
    return hits.groupBy(*KEY).agg(at.alias("at")).select(*KEY, F.col("at.position").alias("positions"), F.col("at.surface").alias("surfaces"))


def exact_word(corpus: Corpus, query: str, case_sensitive: bool = False, limit: int | None = None) -> DataFrame:
    """Verses in canonical order with their text; total and total_occurrences are counted before the limit."""
    matches = word_matches(corpus, query, case_sensitive)
    return _listed(corpus, matches, F.size("positions"), limit)


def _listed(corpus: Corpus, matches: DataFrame, occurrences, limit: int | None) -> DataFrame:
    totals = matches.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(occurrences), F.lit(0)).alias("total_occurrences"))
    ordered = matches.orderBy(*REFERENCE)
    n = checked_limit(limit, None)
    first = ordered.limit(n) if n else matches
    listed = first.join(corpus.verses.select("id", "label", "display_text"), "id").crossJoin(F.broadcast(totals))  # one row
    return listed.orderBy(*REFERENCE)


def phrase_matches(corpus: Corpus, query: str, case_sensitive: bool = False) -> DataFrame:
    """(id, book, ..., start_positions): where a phrase's tokens follow each other; starts may overlap.

    A relational division: a start is where every token of the phrase lies at its distance.
    """
    words = [_form(w, case_sensitive) for w in query_tokens(corpus, query)]
    if len(words) < 2:
        raise InvalidRequest("a phrase search takes two words or more")
    needle = F.map_from_arrays(F.lit(sorted(set(words))), F.array(*(F.lit([k for k, w in enumerate(words) if w == x]) for x in sorted(set(words)))))
    key = F.col(_key(case_sensitive))
    hits = corpus.tokens.where(key.isin(sorted(set(words))))
    starts = (
        hits.select(*KEY, "position", F.explode(F.element_at(needle, key)).alias("offset"))
        .groupBy(*KEY, (F.col("position") - F.col("offset")).alias("start"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == len(words))
    )
    return starts.groupBy(*KEY).agg(F.array_sort(F.collect_list("start")).alias("start_positions"))


def exact_phrase(corpus: Corpus, query: str, case_sensitive: bool = False, limit: int | None = None) -> DataFrame:
    return _listed(corpus, phrase_matches(corpus, query, case_sensitive), F.size("start_positions"), limit)


def exact_phrase_spelled(corpus: Corpus, query: str) -> DataFrame:
    """Phrases whose marks and blanks between the words are those of the query too, case apart.

    One scan of the verses: those whose text holds the query are cut into tokens, and nothing is joined.
    """
    query = query.strip()
    words = [_form(w, False) for w in query_tokens(corpus, query)]
    size = len(words)
    if size < 2:
        raise InvalidRequest("a phrase search takes two words or more")
    verses = corpus.verses.select("id", "label", "display_text").where("display_text is not null")
    if query.isascii():  # other letters may be lowered by what stands beside them, so that a part and the whole differ
        verses = verses.where(F.contains(F.lower("display_text"), F.lit(query.lower())))
    pattern = corpus.pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).finditer
        for batch in batches:
            rows, starts, first, length = [], [], [], []
            for k, t in enumerate(batch.column(2).to_pylist()):
                found = list(find(t))
                forms = [_form(m[0], False) for m in found]
                for at in range(len(forms) - size + 1):
                    if forms[at : at + size] == words:
                        rows.append(k)
                        starts.append(at)
                        first.append(found[at].start() + 1)
                        length.append(found[at + size - 1].end() - found[at].start())
            columns = [*batch.take(pa.array(rows, pa.int64())).columns, *(pa.array(x, pa.int32()) for x in (starts, first, length))]
            yield pa.record_batch(columns, names=["id", "label", "display_text", "start", "first", "length"])

    spans = verses.mapInArrow(run, "id bigint, label string, display_text string, start int, first int, length int")
    same = F.lower(F.col("display_text").substr(F.col("first"), F.col("length"))) == query.lower()
    return spans.where(same).groupBy("id", "label").agg(F.array_sort(F.collect_list("start")).alias("start_positions"))


def term_distribution(corpus: Corpus, query: str, case_sensitive: bool = False) -> DataFrame:
    """(book, book_order, verses, occurrences): how many verses of each book hold a word; never cut."""
    matches = word_matches(corpus, query, case_sensitive)
    return matches.groupBy("book", "book_order").agg(F.count(F.lit(1)).alias("verses"), F.sum(F.size("positions")).alias("occurrences"))


def term_summary(corpus: Corpus, query: str, case_sensitive: bool = False) -> DataFrame:
    """One row: verse_frequency, total_frequency, first_mention, last_mention (null without a match)."""
    place = F.struct(*REFERENCE)
    name = refs.label(F.col("book"), F.col("chapter"), F.col("verse"))
    return word_matches(corpus, query, case_sensitive).agg(
        F.count(F.lit(1)).alias("verse_frequency"),
        F.coalesce(F.sum(F.size("positions")), F.lit(0)).alias("total_frequency"),
        F.min_by(name, place).alias("first_mention"),
        F.max_by(name, place).alias("last_mention"),
    )


def passage(corpus: Corpus, span: refs.ReferenceRange, context: int = 2, same_book: bool = True) -> DataFrame:
    """(id, label, display_text, requested): a range of verses and `context` around it.

    Context doesn't leave the range's book unless same_book is false (the second algorithm's way).
    """
    within("context", context, 0, 20)
    place = lambda r: (F.col("book_order") == r.book_order) & (F.col("chapter") == r.chapter) & (F.col("verse") == r.verse)
    ends = corpus.verses.where(place(span.start) | place(span.end)).agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n")).first()
    if ends.n != (1 if span.start == span.end else 2):
        raise NotFound(f"not in the corpus: {span}")
    around = corpus.verses.where(F.col("id").between(ends.a - context, ends.b + context))
    if same_book:
        around = around.where(F.col("book_order").isin(span.start.book_order, span.end.book_order))
    return around.select("id", "label", "display_text", F.col("id").between(ends.a, ends.b).alias("requested"))
