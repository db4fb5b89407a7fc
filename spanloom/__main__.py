"""Command line: import a source, index a corpus, and ask it."""

from __future__ import annotations

import argparse
import json
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import refs, text
from .operators import related, search
from .plans import storage
from .plans.config import LEVELS, ScoringConfig
from .plans.errors import EngineError
from .sources import ingest
from .sources.corpus import Corpus


#: Rows that are printed of a result without a limit of its own, and issues of an import; what is left out is told.
SHOWN = 10_000


def show(df: DataFrame) -> None:
    rows = df.toJSON().take(SHOWN + 1)
    for row in rows[:SHOWN]:
        print(row)
    if len(rows) > SHOWN:
        print(f"more than {SHOWN} rows; --limit chooses how many", file=sys.stderr)


def import_source(spark: SparkSession, a: argparse.Namespace, books: DataFrame) -> int:
    """Lines to out/verses, out/manifest.json and out/import-report.json; nothing but issues if there are any."""
    source, sums = a.source, (None, None)
    if a.member:
        source = f"{storage.own_dir(spark)}/member-{uuid.uuid4().hex}"
        sums = storage.extract_member(spark, a.source, a.member, source)
    records = storage.staged(ingest.parse_records(ingest.read_lines(spark, source), books))
    found = ingest.issues(records).orderBy("line").limit(SHOWN).collect()
    for issue in found:
        print(json.dumps(issue.asDict()), file=sys.stderr)
    if found:
        return 2
    verses = records.where("problem is null")
    ingest.write_canonical(verses, f"{a.out}/verses")
    counts = ingest.counts(verses).first().asDict()
    report = {"counts": counts, "sourceSha256": sums[0], "memberSha256": sums[1], "canonicalSha256": ingest.canonical_sha256(verses)}
    manifest = {
        "schemaVersion": "1.0.0", "corpusVersion": a.corpus_version, "edition": a.edition, "sourceUrl": a.source_url, "sourceMember": a.member,
        "encoding": "windows-1252", "lineEndings": "CRLF", "canonicalFormat": "jsonl-utf8-lf-v1", "license": {"statement": a.license},
        "bookOrder": [r.name for r in books.select("book_order", "name").distinct().orderBy("book_order").collect()],  # a fixed table
        "counts": {k: counts[k] for k in ("books", "chapters", "verses")}, **{k: v for k, v in report.items() if k != "counts"},
    }
    report |= {"schemaVersion": "1.0.0", "issues": [], "manifestErrors": ingest.manifest_errors(manifest)}
    for name, content in (("manifest", manifest), ("import-report", report)):
        storage.write_text(spark, f"{a.out}/{name}.json", json.dumps(content, indent=2, ensure_ascii=False) + "\n")
    print(json.dumps(counts | {"canonical_sha256": report["canonicalSha256"]}))
    return 0


def arguments(argv: list[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="spanloom", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, about: str, *positional: str) -> argparse.ArgumentParser:
        p = verbs.add_parser(name, help=about)
        for x in positional:
            p.add_argument(x)
        return p

    verb("reference", "what a reference means", "books", "text")
    verb("tokenize", "the tokens of a text", "text")
    p = verb("import", "lines of a source to canonical JSON, issues and counts", "source", "books", "out")
    p.add_argument("--member", help="the source's name in a zip archive")
    for name in ("corpus-version", "edition", "source-url", "license"):
        p.add_argument(f"--{name}", help="for the manifest")
    verb("index", "the tables of a corpus from canonical JSON lines", "canonical", "out")
    verb("stats", "sizes of an indexed corpus", "corpus")
    for name in ("exact", "phrase", "term"):
        p = verb(name, {"exact": "verses with a word", "phrase": "verses with a phrase", "term": "a word by book"}[name], "corpus", "text")
        p.add_argument("--case-sensitive", action="store_true")
        p.add_argument("--limit", type=int)
    p = verb("related", "verses related to one", "corpus", "books", "text")
    p.add_argument("--limit", type=int, default=50)
    p.add_argument("--book", action="append")
    p.add_argument("--testament", choices=("OT", "NT"))
    p.add_argument("--level", choices=LEVELS, default="exact_spelling")
    return top.parse_args(argv)


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    books = lambda: spark.read.parquet(a.books)
    if a.verb == "reference":
        print(refs.Books.of(books()).parse(a.text))
    elif a.verb == "tokenize":
        show(spark.createDataFrame([(a.text,)], "t string").select(F.inline(text.tokenize(F.col("t")))))
    elif a.verb == "import":
        return import_source(spark, a, books())
    elif a.verb == "index":
        Corpus(ingest.read_canonical(spark, f"{a.canonical}/verses")).write(a.out)
    else:
        corpus = Corpus.read(spark, a.corpus)
        if a.verb == "stats":
            show(corpus.scalars)
        elif a.verb == "exact":
            show(search.exact_word(corpus, a.text, a.case_sensitive, a.limit))
        elif a.verb == "phrase":
            show(search.exact_phrase(corpus, a.text, a.case_sensitive, a.limit))
        elif a.verb == "term":
            show(search.term_distribution(corpus, a.text, a.case_sensitive).orderBy("book_order"))
        else:
            place = refs.Books.of(books()).parse(a.text).start
            show(related.related(corpus, place, a.limit, a.book, a.testament, ScoringConfig(a.level)).orderBy("rank"))
    return 0


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("spanloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        return run(spark, a)
    except EngineError as wrong:
        print(f"{wrong.status}: {wrong}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
