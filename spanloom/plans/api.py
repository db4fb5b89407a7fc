"""Requests as plain mappings: checked strictly, answered with metadata and frames."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from ..functions import refs
from ..operators import related, search, workflows
from ..sources import ingest
from ..sources.corpus import Corpus
from .config import ALGORITHM, ScoringConfig
from .errors import InvalidRequest, VersionConflict


@dataclass
class Answer:
    meta: dict
    frames: dict[str, DataFrame]


#: What each request takes: names, the types that they allow, and whether they must be there.
FIELDS: dict[str, dict[str, tuple[type, bool]]] = {
    "exact": {"query": (str, True), "case_sensitive": (bool, False), "limit": (int, False)},
    "distribution": {"query": (str, True), "case_sensitive": (bool, False)},
    "passage": {"reference": (str, True), "context": (int, False)},
    "related": {"reference": (str, True), "limit": (int, False), "books": (list, False), "testament": (str, False), "match_level": (str, False), "algorithm": (str, False)},
    "compare": {"references": (list, True)},
    "graph": {"reference": (str, True), "results": (int, False), "terms": (int, False), "nodes": (int, False)},
    "gather_mentions": {"term": (str, True), "limit": (int, False)},
    "first_mention_chain": {"term": (str, True), "limit": (int, False)},
    "candidate_mates": {"reference": (str, True), "limit": (int, False)},
    "divide_term": {"term": (str, True), "examples": (int, False)},
    "lexical_witnesses": {"reference": (str, True), "count": (int, False), "candidate_limit": (int, False)},
}


def checked(kind: str, request: Mapping) -> dict:
    """The request, if it is one: no field too many, none missing, all of their types."""
    if kind not in FIELDS:
        raise InvalidRequest(f"no such request: {kind}")
    fields = FIELDS[kind]
    if extra := set(request) - set(fields):
        raise InvalidRequest(f"unknown fields: {', '.join(sorted(extra))}")
    for name, (type_, needed) in fields.items():
        value = request.get(name)
        if value is None:
            if needed:
                raise InvalidRequest(f"{name} is missing")
        elif not isinstance(value, type_) or (type_ is int and isinstance(value, bool)):
            raise InvalidRequest(f"{name} is a {type_.__name__}")
    return {k: v for k, v in request.items() if v is not None}


def answer(corpus: Corpus, books: refs.Books, kind: str, request: Mapping) -> Answer:
    q = checked(kind, request)
    place = lambda: books.parse(q.pop("reference")).start
    level = q.get("match_level", "exact_spelling")
    config = ScoringConfig(level)
    if q.get("algorithm", ALGORITHM) != ALGORITHM:
        raise VersionConflict(f"this engine runs {ALGORITHM}")
    trace = [f"{kind}:{json.dumps(q, sort_keys=True, ensure_ascii=False)}"]
    one: dict[str, Callable[[], dict[str, DataFrame]]] = {
        "exact": lambda: {"matches": (search.exact_word if len(search.query_tokens(corpus, q["query"])) == 1 else search.exact_phrase)(corpus, **q)},
        "distribution": lambda: {"books": search.term_distribution(corpus, **q), "summary": search.term_summary(corpus, **q)},
        "passage": lambda: {"verses": search.passage(corpus, books.parse(q.pop("reference")), **q)},
        "related": lambda: {"results": related.related(corpus, place(), q.get("limit", 50), q.get("books"), q.get("testament"), config)},
        "compare": lambda: related.compare(corpus, [books.parse(r).start for r in q["references"]]),
        "graph": lambda: workflows.evidence_graph(corpus, place(), **q),
        "gather_mentions": lambda: {"mentions": workflows.gather_mentions(corpus, **q)},
        "first_mention_chain": lambda: {"links": workflows.first_mention_chain(corpus, **q)},
        "candidate_mates": lambda: {"results": workflows.candidate_mates(corpus, place(), **q)},
        "divide_term": lambda: {"groups": workflows.divide_term(corpus, **q)},
        "lexical_witnesses": lambda: {"witnesses": workflows.lexical_witnesses(corpus, place(), **q)},
    }
    frames = one[kind]()
    meta = {
        "corpusVersion": corpus.version,
        "algorithmVersion": ALGORITHM,
        "configurationSha256": config.sha256(corpus.size_and_threshold[1]),
        "queryTrace": trace,
        "generatedAt": datetime.now(UTC).isoformat(),
    }
    return Answer(meta, frames)


def export(corpus: Corpus, books: refs.Books, kind: str, request: Mapping) -> DataFrame:
    """A research record: the query run again, with its rows, as one line of JSON."""
    first = next(iter(answer(corpus, books, kind, request).frames.values()))
    return ingest.research_record({"kind": kind, **request}, first)
