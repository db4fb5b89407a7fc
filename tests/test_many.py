"""Searches for many sources: each source gets what its own search gives it, and every source is searched for."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.functions import forms
from spanloom.functions.text import JOINED_TOKEN
from spanloom.operators import many, related, second, workflows
from spanloom.plans import registry, whole_queries
from spanloom.sources.corpus import Corpus

from .test_search import SCHEMA
from .test_study import VERSES, at

PLACES = ["Genesis 1:1", "John 3:16", "1 John 4:9"]


@pytest.fixture(scope="module")
def corpora(spark):
    return [Corpus(spark.createDataFrame(VERSES, SCHEMA), pattern=p).prepared() for p in (registry.text.TOKEN, JOINED_TOKEN)]


def by_source(c, found, *columns):
    names = c.verses.select("id", "label")
    rows = found.drop("label").join(names, "id").join(names.withColumnsRenamed({"id": "source_id", "label": "reference"}), "source_id")
    rows = rows.select("reference", "label", *columns).collect()
    return {p: sorted(tuple(r[1:]) for r in rows if r.reference == p) for p in PLACES}


def test_each_source_gets_its_own_search(corpora, monkeypatch):
    c, j = corpora
    monkeypatch.setattr(many, "BLOCK", 2)
    monkeypatch.setattr(many, "ROWS", 3)
    of = lambda x: x.verses.where(F.col("label").isin(PLACES)).select(F.col("id").alias("source_id"))
    s = second.Second.of(j)
    cases = [
        (c, many.candidates(c, of(c)), (), lambda r: related.candidates(c, r)),
        (c, many.phrase_runs(c, of(c), 2), ("source_start", "target_start", "length"), lambda r: related.phrase_runs(c, r, 2)),
        (c, many.related(c, of(c), 3), ("rank", "score"), lambda r: related.related(c, r, 3)),
        (c, many.candidate_mates(c, of(c), 2), ("rank", "evidence_types"), lambda r: workflows.candidate_mates(c, r, 2)),
        (c, many.lexical_witnesses(c, of(c), 2), ("witness", "score", "complete"), lambda r: workflows.lexical_witnesses(c, r, 2)),
        (j, many.proximity(j, of(j)), ("proximity",), lambda r: s.proximity(s.features.where(F.col("id") != s.verse(r).id), s.verse(r))),
    ]
    for level in related.LAYER:
        cases.append((c, many.weighted_overlap(c, of(c), level), ("shared", "jaccard"), lambda r, level=level: related.weighted_overlap(c, r, level)))
    for corpus, found, columns, one in cases:
        got = by_source(corpus, found, *columns)
        assert got == {p: sorted(tuple(r) for r in one(at(p)).select("label", *columns).collect()) for p in PLACES}, columns
        assert all(got.values())
    scored = by_source(c, many.components(c, of(c)), "shared", "jaccard")
    assert scored == by_source(c, many.weighted_overlap(c, of(c)), "shared", "jaccard")
    # the single search of weighted_dice counts words that aren't shared, as its SQL does: pairs are counted here instead
    words = {r.label: Counter(r.folded) for r in s.features.collect()}
    weight = lambda w: forms.word_length_value(w, s.bounds.word_letters)
    whole = lambda a: sum(weight(w) * n for w, n in words[a].items())
    for source, found in by_source(j, many.weighted_dice(j, of(j)), "dice").items():
        dice = {t: 2 * sum(weight(w) * n for w, n in (words[source] & words[t]).items()) / (whole(source) + whole(t)) for t in words if t != source}
        assert dict(found) == pytest.approx({t: x for t, x in dice.items() if x}, abs=2e-6) and max(dice.values()) <= 1


def test_every_source_is_searched_for(spark):
    sf = "/root/testdata/sf0.001"
    rows = whole_queries.current(spark, sf).where("verse_id % 50 = 0").select("corpus_version_id", "reference").collect()
    wanted = {(r.corpus_version_id, f"{r.reference.book} {r.reference.chapter}:{r.reference.verse}") for r in rows}
    assert len(wanted) > 1
    found = registry.queries()["every_related_many"](spark, sf).collect()
    assert {(r.corpus_version_id, r.reference) for r in found} == wanted
    assert whole_queries.WHOLE.keys() <= registry.queries().keys()


def test_every_version_comes_out(spark):
    sf = "/root/testdata/sf0.001"
    wanted = {r.corpus_version_id: r["count"] for r in whole_queries.current(spark, sf).groupBy("corpus_version_id").count().collect()}
    assert len(wanted) > 1
    found = registry.queries()["corpus_scalars_of_versions"](spark, sf).collect()
    assert {r.corpus_version_id: r.corpus_size for r in found} == wanted
    found = registry.queries()["canonical_json_of_versions"](spark, sf).groupBy("corpus_version_id").count().collect()
    assert {r.corpus_version_id: r["count"] for r in found} == wanted


def test_texts_that_equal_one_another_but_not_the_first(spark):
    texts = ["And he went.", "and he WENT", "and he WENT", "And he went.", "He came."]
    c = Corpus(spark.createDataFrame([("Genesis", 1, 1, k + 1, t) for k, t in enumerate(texts)], SCHEMA), pattern=JOINED_TOKEN)
    got = {r.label[8:]: (r.token_class[8:], r.text_class[8:], r.verses) for r in second.text_identity_classes(c).collect()}
    assert got == {"1:1": ("1:1", "1:1", 4), "1:2": ("1:1", "1:2", 4), "1:3": ("1:1", "1:2", 4), "1:4": ("1:1", "1:1", 4)}
