import json

import pytest
import regex
from pyspark.sql import functions as F

from spanloom.functions import forms, refs
from spanloom.functions.text import JOINED_TOKEN
from spanloom.operators import cross_references, related, second, topics, workflows
from spanloom.plans.config import ScoringConfig
from spanloom.plans import api
from spanloom.plans.errors import InvalidRequest, NotFound, Unavailable, Unprocessable, VersionConflict
from spanloom.sources.corpus import Corpus

from .test_search import SCHEMA

VERSES = [
    ("Genesis", 1, 1, 1, "In the beginning God created the heaven and the earth."),
    ("Genesis", 1, 1, 2, "And the earth was without form, and void."),
    ("Psalms", 19, 90, 2, "Before the mountains were brought forth, or ever thou hadst formed the earth and the world."),
    ("John", 43, 1, 1, "In the beginning was the Word, and the Word was with God, and the Word was God."),
    ("John", 43, 3, 16, "For God so loved the world, that he gave his only begotten Son."),
    ("Romans", 45, 1, 20, "For the invisible things of him from the creation of the world are clearly seen."),
    ("1 John", 62, 4, 9, "God sent his only begotten Son into the world, that we might live through him."),
]
BOOKS = [(1, "Gen", "Genesis", []), (19, "Ps", "Psalms", []), (43, "John", "John", []), (45, "Rom", "Romans", []), (62, "1John", "1 John", [])]


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark.createDataFrame(VERSES, SCHEMA)).prepared()


def at(text):
    return refs.Books(BOOKS).parse(text).start


def test_related(corpus):
    rows = related.related(corpus, at("John 3:16")).orderBy("rank").collect()
    assert rows[0].label == "1 John 4:9" and "John 3:16" not in {r.label for r in rows}
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
    assert {r.label for r in related.related(corpus, at("John 3:16"), testament="OT").collect()} <= {"Genesis 1:1", "Genesis 1:2", "Psalms 90:2"}
    assert {r.label for r in related.related(corpus, at("John 3:16"), books=["Romans"]).collect()} == {"Romans 1:20"}
    assert related.related(corpus, at("John 3:16"), limit=2).count() == 2
    with pytest.raises(NotFound):
        related.related(corpus, at("John 9:9"))
    with pytest.raises(InvalidRequest):
        related.related(corpus, at("John 3:16"), testament="X")
    many = related.related_many(corpus, [at("John 3:16"), at("Genesis 1:1")], 2)
    assert {r.reference for r in many.collect()} == {"John 3:16", "Genesis 1:1"} and many.count() == 4


def test_levels_agree_with_joins(corpus):
    for level in ("letter_exact", "exact_spelling", "normalized"):
        joined = {r.label: r.jaccard for r in related.weighted_overlap(corpus, at("Genesis 1:1"), level).collect()}
        scored = related.related(corpus, at("Genesis 1:1"), config=ScoringConfig(level)).select("label", F.col("components.jaccard").alias("j"))
        assert {r.label: r.j for r in scored.collect()} == pytest.approx(joined, abs=2e-6)


def test_compare(corpus):
    found = related.compare(corpus, [at("John 3:16"), at("1 John 4:9")])
    assert "begotten" in {r.token for r in found["common_normalized"].collect()}
    assert ("John 3:16", "loved") in {(r.label, r.token) for r in found["unique"].collect()}
    [pair] = found["pairs"].collect()
    assert pair.score > 0
    with pytest.raises(InvalidRequest):
        related.compare(corpus, [at("John 3:16")])


def test_workflows(corpus):
    assert [r.label for r in workflows.gather_mentions(corpus, "beginning").collect()] == ["Genesis 1:1", "John 1:1"]
    assert workflows.first_mention_chain(corpus, "beginning").count() == 1
    assert workflows.candidate_mates(corpus, at("John 3:16")).orderBy("rank").first().label == "1 John 4:9"
    rows = workflows.divide_term(corpus, "world").orderBy("book_order").collect()
    assert [r.book for r in rows] == ["Psalms", "John", "Romans", "1 John"] and rows[0].total_occurrences == 4
    assert rows[1].examples[0].context == "so loved the world that he gave"
    w = workflows.lexical_witnesses(corpus, at("John 3:16"), 2).collect()
    assert len({r.book for r in w}) == 2 and all(r.complete for r in w)
    graph = workflows.evidence_graph(corpus, at("John 3:16"))
    assert graph["table"].count() == graph["edges"].count() and graph["nodes"].count() <= 40
    names = {r.node for r in graph["nodes"].collect()}
    assert all(e.source in names and e.target in names for e in graph["edges"].collect())
    small = workflows.evidence_graph(corpus, at("John 3:16"), nodes=4)
    assert small["nodes"].count() <= 4 and small["truncated"].first().truncated
    for call in (lambda: workflows.evidence_graph(corpus, at("John 3:16"), nodes=101), lambda: workflows.lexical_witnesses(corpus, at("John 3:16"), 4)):
        with pytest.raises(InvalidRequest):
            call()


class Words:
    def __init__(self, spark, available=True):
        self.spark, self.available, self.asked = spark, available, 0

    def lookup(self, headword):
        self.asked += 1
        rows = [("s1", "noun", "agreement", ["earth", "concord", "two words"]), ("s2", "noun", "music", ["melody"])]
        return self.spark.createDataFrame(rows, topics.SENSES) if headword == "harmony" else None


def test_topics(corpus, spark):
    words = Words(spark)
    assert topics.resolve_topic(corpus, "world", words).status == "exact" and words.asked == 0
    assert topics.resolve_topic(corpus, "harmony", words).status == "requires_sense_selection"
    offered = topics.resolve_topic(corpus, "harmony", words, "s1")
    assert (offered.status, [r.term for r in offered.frames["candidates"].collect()]) == ("requires_candidate_selection", ["earth"])
    done = topics.resolve_topic(corpus, "harmony", words, "s1", ["Earth"])
    assert done.status == "resolved" and {r.label for r in done.frames["combined"].collect()} == {"Genesis 1:1", "Genesis 1:2", "Psalms 90:2"}
    assert topics.resolve_topic(corpus, "harmony", words, "s2").status == "no_candidates"
    for error, args in ((Unprocessable, ("harmony", words, "s9")), (Unprocessable, ("harmony", words, "s1", ["love"])), (Unprocessable, ("nothing", words)), (Unavailable, ("harmony", Words(spark, False))), (InvalidRequest, ("", words))):
        with pytest.raises(error):
            topics.resolve_topic(corpus, *args)


def test_cross_references(spark):
    books = spark.createDataFrame(BOOKS, "book_order int, osis string, name string, aliases array<string>")
    manifest = {"enabled": True, "sourceUrl": "https://x", "license": "l", "checksum": "a" * 64, "ownerApproved": True, "approvalStatus": "approved"}
    make = lambda *rows: spark.createDataFrame(list(rows), "source string, target string, note string")
    rows = make(("Romans 5:8", "John 3:16", "n"), ("John 3:16", "Romans 5:8", " n "), ("John 3:16", "Romans 5:8", None))
    got = {(r.source, r.target, r.note) for r in cross_references.prepare(manifest, rows, books).collect()}
    assert got == {("John 3:16", "Romans 5:8", "n"), ("John 3:16", "Romans 5:8", None)}
    assert cross_references.prepare({"enabled": False}, rows, books).count() == 0
    with pytest.raises(InvalidRequest):
        cross_references.prepare({"enabled": True}, rows, books)
    for bad in (("John 3:16", "John 3:16", None), ("John 3:16", "Nowhere 1:1", None)):
        with pytest.raises(Exception, match="no cross-reference"):
            cross_references.prepare(manifest, make(bad), books).collect()


def test_second_algorithm(corpus, spark):
    s = second.Second(corpus)
    rows = s.related(at("John 3:16")).orderBy("rank").collect()
    assert "1 John 4:9" in {r.label for r in rows} and all(0 < r.score < 0.985 for r in rows)
    texts = {f"{v[0]} {v[2]}:{v[3]}": dict.fromkeys(w.lower() for w in regex.findall(JOINED_TOKEN, v[4])) for v in VERSES}
    source, most = texts["John 3:16"], s.bounds.word_letters
    for r in rows:
        # the parts again, from the words of the two verses
        others = [(x, y) for x in source for y in texts[r.label] if x != y]
        assert r.morphology_score == max(forms.morphology(x, y)[0] for x, y in others)
        assert r.letter_score == max(forms.letter_pattern(*sorted((x, y)), most)[0] for x, y in others)
        parts = {"jaccard": r.jaccard, "morphology": r.morphology_score, "phrase": r.phrase, "phrase_variant": r.phrase_variant, "rarity": r.rarity, "letter_pattern": r.letter_score, "capitalization": r.capitalization, "ordering": r.ordering}
        assert r.textual == pytest.approx(forms.textual_score(parts)[0], abs=2e-6)
        assert r.score == pytest.approx(forms.weighted_by_counts({"textual": r.textual, "neighbour": r.proximity}, forms.FINAL), abs=2e-6)
        assert r.proximity == pytest.approx(forms.weighted_by_counts(r.axes.asDict(), forms.PROXIMITY), abs=2e-6)
    twice = Corpus(spark.createDataFrame([*VERSES, ("Romans", 45, 9, 9, VERSES[4][4])], SCHEMA)).prepared()
    top = second.Second(twice).related(at("John 3:16")).orderBy("rank").first()
    assert (top.label, top.score) == ("Romans 9:9", 1.0) and "complete_verse_identity" in top.reasons
    assert [(r.label_a, r.label_b) for r in second.text_identities(twice).collect()] == [("John 3:16", "Romans 9:9")]
    family = s.word_family("form").orderBy("rank").collect()
    assert family[0].term == "form" and "formed" in {r.term for r in family}


def test_second_comparison_and_graph(corpus, spark):
    s = second.Second.of(corpus)
    pairs = {(r.left, r.right): r.score for r in s.compare([at("John 3:16"), at("1 John 4:9"), at("Genesis 1:1")]).collect()}
    ranked = {r.label: r.score for r in s.related(at("John 3:16")).collect()}
    assert len(pairs) == 3 and pairs["John 3:16", "1 John 4:9"] == ranked["1 John 4:9"]
    graph = s.graph(at("John 3:16"), nodes=6)
    nodes = {r.node for r in graph["nodes"].collect()}
    assert len(nodes) == 6 and all(e.source in nodes and e.target in nodes for e in graph["edges"].collect())
    senses = Words(spark).lookup("harmony")
    rows = s.topic_branches(senses).collect()
    assert {r.sense_id for r in rows} == {"s1", "s2"} and all(r.confidence == 0.5 for r in rows)
    assert s.topic_branches(senses, "s1").orderBy("rank").first().term == "earth"


def test_requests(corpus):
    books = refs.Books(BOOKS)
    got = api.answer(corpus, books, "related", {"reference": "John 3:16", "limit": 1, "match_level": "normalized"})
    assert got.frames["results"].first().label == "1 John 4:9" and len(got.meta["configurationSha256"]) == 64
    assert api.answer(corpus, books, "exact", {"query": "the world"}).frames["matches"].count() == 4
    assert api.answer(corpus, books, "passage", {"reference": "Genesis 1:1", "context": 1}).frames["verses"].count() == 2
    assert api.answer(corpus, books, "graph", {"reference": "John 3:16", "nodes": 5}).frames["nodes"].count() <= 5
    record = json.loads(api.export(corpus, books, "distribution", {"query": "world"}).first().value)
    assert record["recordVersion"] == "1.0.0" and len(record["response"]) == 4
    for bad in (("none", {}), ("exact", {}), ("exact", {"query": 1}), ("exact", {"query": "x", "more": 1}), ("related", {"reference": "John 3:16", "limit": True})):
        with pytest.raises(InvalidRequest):
            api.answer(corpus, books, *bad)
    with pytest.raises(VersionConflict):
        api.answer(corpus, books, "related", {"reference": "John 3:16", "algorithm": "9"})
