import os

import pytest
from pyspark.sql import functions as F

from spanloom.functions import refs
from spanloom.operators import search, statistics
from spanloom.plans.errors import InvalidRequest, NotFound
from spanloom.sources.corpus import Corpus

VERSES = [
    ("Genesis", 1, 1, 1, "In the beginning God created the heaven and the earth."),
    ("Genesis", 1, 1, 2, "And the earth was without form, and void; and darkness was upon the face of the deep."),
    ("John", 43, 1, 1, "In the beginning was the Word, and the Word was with God, and the Word was God."),
    ("John", 43, 1, 2, "The same was in the beginning with God."),
]
SCHEMA = "book string, book_order int, chapter int, verse int, display_text string"


def make(spark, rows=VERSES):
    return Corpus(spark.createDataFrame(rows, SCHEMA))


@pytest.fixture(scope="module")
def corpus(spark):
    return make(spark).prepared()


def place(book, order, chapter, verse):
    r = refs.Reference(order, chapter, verse, book)
    return refs.ReferenceRange(r, r)


def test_statistics(corpus):
    by = {r.normalized: r for r in corpus.statistics.collect()}
    assert (by["word"].document_frequency, by["word"].total_frequency, by["beginning"].document_frequency) == (1, 3, 3)
    row = corpus.scalars.first()
    assert (row.corpus_size, row.vocabulary_size) == (4, len(by))


def test_words(corpus):
    assert search.exact_word(corpus, "word").count() == 1
    assert search.exact_word(corpus, "word", case_sensitive=True).count() == 0
    assert search.exact_word(corpus, "Word", case_sensitive=True).first().positions == [5, 8, 14]
    first = search.exact_word(corpus, "beginning", limit=1).first()
    assert (first.label, first.total, first.total_occurrences) == ("Genesis 1:1", 3, 3)
    for bad in ("two words", "", "..."):
        with pytest.raises(InvalidRequest):
            search.exact_word(corpus, bad)
    with pytest.raises(InvalidRequest):
        search.exact_word(corpus, "word", limit=0)


def test_phrases(corpus):
    rows = search.exact_phrase(corpus, "in the beginning").collect()
    assert [r.start_positions for r in rows] == [[0], [0], [3]]
    assert search.exact_phrase(corpus, "beginning created").count() == 0
    assert search.exact_phrase_spelled(corpus, "form and void").count() == 0
    assert search.exact_phrase_spelled(corpus, "Form, and void").count() == 1
    with pytest.raises(InvalidRequest):
        search.exact_phrase(corpus, "one")


def test_overlapping_starts(spark):
    one = make(spark, [("A", 1, 1, 1, "ha ha ha ha")])
    assert search.exact_phrase(one, "ha ha").first().start_positions == [0, 1, 2]


def test_distribution(corpus, spark):
    assert {r.book: r.verses for r in search.term_distribution(corpus, "beginning").collect()} == {"Genesis": 1, "John": 2}
    s = search.term_summary(corpus, "beginning").first()
    assert (s.first_mention, s.last_mention) == ("Genesis 1:1", "John 1:2")
    assert search.term_summary(corpus, "absent").first().verse_frequency == 0
    many = make(spark, [("Psalms", 19, i, 1, "Repeated token") for i in range(1, 502)])
    assert search.term_distribution(many, "repeated").first().verses == 501


def test_passage(corpus):
    rows = search.passage(corpus, place("Genesis", 1, 1, 1), 1).orderBy("id").collect()
    assert [(r.label, r.requested) for r in rows] == [("Genesis 1:1", True), ("Genesis 1:2", False)]
    assert search.passage(corpus, place("Genesis", 1, 1, 2), 1, same_book=False).count() == 3
    with pytest.raises(NotFound):
        search.passage(corpus, place("Genesis", 1, 9, 9))
    with pytest.raises(InvalidRequest):
        search.passage(corpus, place("Genesis", 1, 1, 1), 21)


def test_empty_and_null_texts(spark):
    c = make(spark, [("A", 1, 1, 1, None), ("A", 1, 1, 2, ""), ("A", 1, 1, 3, "one")])
    assert (c.scalars.first().corpus_size, c.statistics.count()) == (3, 1)
    empty = make(spark, [])
    assert (empty.scalars.first().corpus_size, empty.scalars.first().rare_threshold, search.exact_word(empty, "x").count()) == (0, 0, 0)


def test_canonical_order_and_prepared(spark, corpus):
    shuffled = make(spark, VERSES[::-1])
    assert [r.label for r in shuffled.verses.orderBy("id").collect()] == [r.label for r in corpus.verses.orderBy("id").collect()]
    assert [r.id for r in shuffled.verses.orderBy("id").collect()] == [0, 1, 2, 3]
    assert {r.chapter_ordinal for r in corpus.verses.collect()} == {0, 1}


def test_survival_and_bounds(corpus):
    left = {r.n: r.survivors for r in statistics.repetition_survival(corpus).collect()}
    times = [r.n for r in corpus.tokens.groupBy("id", "folded").agg(F.count("*").alias("n")).collect()]
    assert left == {n: sum(t >= n for t in times) for n in range(1, max(times) + 1)}
    bounds = {r.measure: r for r in statistics.corpus_bounds(corpus).collect()}
    assert bounds["verse_words"].least == 8 and bounds["corpus_frequency"].most == max(r.n for r in corpus.tokens.groupBy("folded").agg(F.count("*").alias("n")).collect())


def test_spelled_phrases_are_found_by_a_scan(spark, corpus):
    rows = [("Genesis", 1, 1, k + 1, t) for k, t in enumerate(["A river, and a RIVER, AND the sea.", "River; and", "rivers, and", "The river, and.", None, "Καὶ ὁ ΛΌΓΟΣ, καὶ"])]
    c = make(spark, rows)
    found = search.exact_phrase_spelled(c, "river, and")
    assert sorted((r.id, r.start_positions) for r in found.collect()) == [(0, [1, 4]), (3, [1])]
    assert [r.id for r in search.exact_phrase_spelled(c, "λόγος, καὶ").collect()] == [5]
    # neither tokens nor verses meet in a join, one of whose sides the driver might have to hold
    assert "Join" not in search.exact_phrase_spelled(corpus, "form, and void")._jdf.queryExecution().optimizedPlan().toString()


def test_tables_are_written_when_they_are_asked_for(spark):
    c = make(spark).prepared()
    folder = c.path.removeprefix("file://")
    assert search.exact_phrase_spelled(c, "form, and void").count() == 1
    assert sorted(os.listdir(folder)) == ["verses"]
    assert c.features.count() == 4
    assert sorted(os.listdir(folder)) == ["features", "statistics", "verses"]
    assert search.exact_word(c, "word").count() == 1 and c.tokens is c.tokens
    assert sorted(os.listdir(folder)) == ["features", "statistics", "tokens", "verses"]
    make(spark).write(f"{c.path}-whole")
    assert sorted(os.listdir(f"{folder}-whole")) == ["features", "statistics", "tokens", "verses"]
