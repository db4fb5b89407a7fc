"""Import of line-oriented sources: `<book code> <chapter>:<verse> <text>`, with [added words] and <<side texts>>.

Nothing is dropped in silence: every line that isn't a verse, and every rule that a verse breaks, is
an issue.
"""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from ..functions import refs
from ..plans.errors import InvalidRequest

# Fixed values.
RECORD = r"^([1-3]?[A-Za-z]+) (\d+):(\d+) (.+)$"
SIDE_TEXT = r"<<(.+?)>>"
#: Lines that one task checks in sequence.
BLOCK = 100_000
#: Windows-1252 where it differs from Latin-1: the characters of the bytes 0x80 to 0x9F.
C1 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
CANONICAL = "reference struct<book: string, bookOrder: int, chapter: int, verse: int>, sourceBookCode string, displayText string, italics array<struct<start: int, end: int, source: string>>, paratext array<struct<type: string, raw: string, text: string>>"


def decode_windows_1252(data: Column) -> Column:
    return F.translate(F.decode(data, "ISO-8859-1"), "".join(chr(x) for x in range(0x80, 0xA0)), C1)


def read_archive(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(path, archive_sha256, member_sha256, text) of the member of each zip archive that a path names."""

    def extract(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                with zipfile.ZipFile(io.BytesIO(row["content"])) as archive:
                    data = archive.read(member)
                out.append((row["path"], hashlib.sha256(row["content"]).hexdigest(), hashlib.sha256(data).hexdigest(), data))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.binary()))], names=["path", "archive_sha256", "member_sha256", "data"])

    schema = StructType([*(StructField(n, StringType()) for n in ("path", "archive_sha256", "member_sha256")), StructField("data", BinaryType())])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(extract, schema).select("path", "archive_sha256", "member_sha256", decode_windows_1252(F.col("data")).alias("text"))


def read_lines(spark: SparkSession, path: str, encoding: str = "windows-1252") -> DataFrame:
    """(line, record, byte_start, byte_end): the lines of a text file, or of a folder's files in the order of
    their names, numbered from 1, with their places in the whole.

    Files are read in splits. A split's first number and place are the sums of those before it, a row a
    split; within a split lines are numbered as they lie.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    rows = read.select(
        F.col("value").cast("binary").alias("data"),
        F.struct("_metadata.file_path", "_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("k"),
    ).withColumn("size", F.length("data") + 1)
    splits = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    first = splits.select("split", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "bytes")))
    within = Window.partitionBy("split").orderBy("k")
    placed = rows.withColumns({"nth": F.row_number().over(within), "upto": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))})
    text = decode_windows_1252(F.col("data")) if encoding == "windows-1252" else F.decode("data", encoding)
    cut = placed.join(F.broadcast(first), "split").select(  # a row a split
        (F.col("n_before") + F.col("nth")).cast("int").alias("line"),
        F.regexp_replace(text, "\r$", "").alias("record"),
        (F.col("bytes_before") + F.col("upto") - F.col("size")).alias("byte_start"),
        (F.col("size") - 1 - F.endswith(text, F.lit("\r")).cast("int")).alias("n"),
    )
    return cut.select("line", "record", "byte_start", (F.col("byte_start") + F.col("n")).alias("byte_end"))


def side_texts(marked: Column) -> Column:
    """array<struct<type, raw, text>> of the <<side texts>>."""
    found = F.regexp_extract_all(marked, F.lit(SIDE_TEXT), F.lit(1))

    def kind(raw: Column) -> Column:
        low = F.lower(F.translate(raw, "[]", ""))
        return (
            F.when(F.contains(low, F.lit("the end")), "terminal")
            .when(F.contains(low, F.lit("written")) | F.contains(low, F.lit("epistle")), "subscription")
            .otherwise("heading")
        )

    return F.transform(found, lambda raw: F.struct(kind(raw).alias("type"), raw.alias("raw"), F.translate(raw, "[]", "").alias("text")))


def added_words(text: Column) -> Column:
    """struct<display, spans array<struct<start, end, source>>, unbalanced>: [added words] and where they stand.

    A fold over the characters; a bracket within another, or without its other half, is unbalanced.
    """
    start = F.struct(
        F.lit(0).alias("at"), F.lit(-1).alias("open"), F.lit(False).alias("bad"), F.array().cast("array<struct<start:int,end:int,source:string>>").alias("spans")
    )

    def step(acc: Column, c: Column) -> Column:
        opens, closes = c == "[", c == "]"
        closing = closes & (acc.open >= 0)
        span = F.array(F.struct(acc.open.alias("start"), acc.at.alias("end"), F.lit("square_brackets").alias("source")))
        return F.struct(
            (acc.at + F.when(opens | closes, 0).otherwise(1)).alias("at"),
            F.when(opens & (acc.open < 0), acc.at).when(closing, F.lit(-1)).otherwise(acc.open).alias("open"),
            (acc.bad | (opens & (acc.open >= 0)) | (closes & (acc.open < 0))).alias("bad"),
            F.when(closing, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"),
        )

    display = F.translate(text, "[]", "")
    return F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""),
        start,
        step,
        lambda acc: F.struct(display.alias("display"), acc.spans.alias("spans"), (acc.bad | (acc.open >= 0)).alias("unbalanced")),
    )


def parse_records(lines: DataFrame, books: DataFrame, code: str = "osis") -> DataFrame:
    """lines with what each says: book, book_order, chapter, verse, display_text, italics, paratext, and problem.

    problem is malformed_record or unknown_book_code, null for verses; empty lines are left out.
    """
    part = lambda k: F.regexp_extract("record", RECORD, k)
    names = F.broadcast(books.select(F.col(code).alias("code"), F.col("name").alias("book"), "book_order"))  # a fixed table
    rows = lines.where("record <> ''").withColumns({"code": part(1), "marked": part(4)}).join(names, "code", "left")
    bare = F.trim(F.regexp_replace("marked", SIDE_TEXT, ""))
    parsed = rows.withColumns({"bare": bare, "cut": added_words(bare)})
    return parsed.select(
        "line", "record", "byte_start", "byte_end", F.col("code").alias("source_book_code"), "book", "book_order",
        part(2).try_cast("int").alias("chapter"), part(3).try_cast("int").alias("verse"), F.col("cut.display").alias("display_text"),
        F.col("cut.spans").alias("italics"), side_texts(F.col("marked")).alias("paratext"),
        F.when(F.col("code") == "", "malformed_record").when(F.col("book").isNull(), "unknown_book_code").alias("problem"),
        (F.contains("bare", F.lit("<<")) | F.contains("bare", F.lit(">>"))).alias("bad_paratext"), F.col("cut.unbalanced").alias("bad_italics"),
    )


def issues(records: DataFrame, expected_books: int | None = None, expected_verses: int | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """(code, line, reference): what is wrong with parsed records. The expectations are optional."""
    label = refs.label(F.col("book"), F.col("chapter"), F.col("verse"))
    verses = records.where("problem is null").withColumn("reference", label)
    of_line = lambda df, code: df.select(F.lit(code).alias("code"), "line", "reference")
    out = records.where("problem is not null").select(F.col("problem").alias("code"), "line", F.lit(None).cast("string").alias("reference"))
    again = F.row_number().over(Window.partitionBy("book_order", "chapter", "verse").orderBy("line")) > 1
    out = out.unionByName(of_line(verses.withColumn("again", again).where("again"), "duplicate_reference"))
    out = out.unionByName(of_line(verses.where("bad_paratext"), "unbalanced_paratext"))
    out = out.unionByName(of_line(verses.where("bad_italics"), "unbalanced_italics"))
    # the place before a line's: within its block, or the last one of an earlier block
    block = F.floor(F.col("line") / BLOCK)
    place = F.struct(*(F.col(c).alias(c) for c in ("book_order", "chapter", "verse")))
    blocks = verses.groupBy(block.alias("block")).agg(F.max_by(place, "line").alias("last"))
    earlier = blocks.select("block", F.lag("last").over(Window.orderBy("block")).alias("earlier"))  # a row a block
    chained = (
        verses.withColumn("block", block)
        .withColumn("before", F.lag(place).over(Window.partitionBy("block").orderBy("line")))
        .join(F.broadcast(earlier), "block")
        .withColumn("before", F.coalesce("before", "earlier"))
    )
    b, c, v = (F.col(f"before.{x}") for x in ("book_order", "chapter", "verse"))
    follows = (
        ((F.col("book_order") == b) & (F.col("chapter") == c) & (F.col("verse") == v + 1))
        | ((F.col("book_order") == b) & (F.col("chapter") == c + 1) & (F.col("verse") == 1))
        | ((F.col("book_order") == b + 1) & (F.col("chapter") == 1) & (F.col("verse") == 1))
    )
    out = out.unionByName(of_line(chained.where(F.col("before").isNotNull() & ~follows), "nonconsecutive_reference"))
    whole = verses.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("book_order").alias("books"), F.count_if(F.col("display_text") == "").alias("empty"),
        F.min_by("reference", "line").alias("first"), F.max_by("reference", "line").alias("last"),
    )
    tests = [("empty_verse", F.col("empty") > 0)]
    if expected_verses is not None:
        tests.append(("unexpected_verse_count", F.col("n") != expected_verses))
    if expected_books is not None:
        tests.append(("unexpected_book_count", F.col("books") != expected_books))
    for code, wanted, column in (("unexpected_first_reference", first, "first"), ("unexpected_last_reference", last, "last")):
        if wanted is not None:
            tests.append((code, F.col(column) != wanted))
    failed = whole.select(F.explode(F.array_compact(F.array(*(F.when(test, F.lit(code)) for code, test in tests)))).alias("code"))
    return out.unionByName(failed.select("code", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("reference")))


def checksum_issues(archives: DataFrame, archive_sha256: str, member_sha256: str) -> DataFrame:
    """(code): which of the two pinned digests a source misses."""
    tests = {"source_checksum_mismatch": F.col("archive_sha256") != archive_sha256, "member_checksum_mismatch": F.col("member_sha256") != member_sha256}
    return archives.select(F.explode(F.array_compact(F.array(*(F.when(t, F.lit(c)) for c, t in tests.items())))).alias("code"))


def counts(verses: DataFrame) -> DataFrame:
    """One row: books, chapters, verses, italic_spans, paratext_items of rows with italics and paratext."""
    return verses.agg(
        F.count_distinct("book_order").alias("books"),
        F.count_distinct("book_order", "chapter").alias("chapters"),
        F.count(F.lit(1)).alias("verses"),
        F.coalesce(F.sum(F.size(F.coalesce("italics", F.array()))), F.lit(0)).alias("italic_spans"),
        F.coalesce(F.sum(F.size(F.coalesce("paratext", F.array()))), F.lit(0)).alias("paratext_items"),
    )


def canonical_json(verses: DataFrame) -> DataFrame:
    """(book_order, chapter, verse, value): a line of JSON a verse, keys in fixed order."""
    reference = F.struct("book", F.col("book_order").alias("bookOrder"), "chapter", "verse")
    line = F.to_json(F.struct(reference.alias("reference"), F.col("source_book_code").alias("sourceBookCode"), F.col("display_text").alias("displayText"), "italics", "paratext"))
    return verses.select("book_order", "chapter", "verse", line.alias("value"))


def write_canonical(verses: DataFrame, path: str) -> None:
    """Text files whose names and lines are in canonical order."""
    canonical_json(verses).repartitionByRange("book_order", "chapter").sortWithinPartitions("book_order", "chapter", "verse").select("value").write.text(path)


def canonical_sha256(verses: DataFrame) -> str:
    """The digest of the canonical lines, read in order through the driver: for a corpus of a book's size.

    For larger ones there is corpus_sha256.
    """
    import hashlib

    digest = hashlib.sha256()
    for row in canonical_json(verses).orderBy("book_order", "chapter", "verse").select("value").toLocalIterator():
        digest.update(row.value.encode() + b"\n")
    return digest.hexdigest()


def chapter_digests(verses: DataFrame) -> DataFrame:
    """(book_order, chapter, sha256): the digest of each chapter's canonical lines in order."""
    lines = canonical_json(verses).groupBy("book_order", "chapter").agg(F.array_sort(F.collect_list(F.struct("verse", "value"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: F.concat(x.value, F.lit("\n"))), "")
    return lines.select("book_order", "chapter", F.sha2(text, 256).alias("sha256"))


def corpus_sha256(verses: DataFrame) -> str:
    """The digest of the chapters' digests in order: a row a chapter comes to the driver."""
    import hashlib

    digest = hashlib.sha256()
    for row in chapter_digests(verses).orderBy("book_order", "chapter").toLocalIterator():
        digest.update(row.sha256.encode())
    return digest.hexdigest()


def read_canonical(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Verses of canonical JSON lines; an error if there aren't as many as the manifest says."""
    rows = spark.read.schema(CANONICAL).json(path).select(
        "reference.book", F.col("reference.bookOrder").alias("book_order"), "reference.chapter", "reference.verse",
        F.col("sourceBookCode").alias("source_book_code"), F.col("displayText").alias("display_text"), "italics", "paratext",
    )
    if expected is not None and (n := rows.count()) != expected:
        raise InvalidRequest(f"{n} verses, not {expected}")
    return rows


def manifest_errors(m: dict) -> list[str]:
    """What is wrong with a corpus manifest."""
    import re
    from urllib.parse import urlparse

    text = lambda k: isinstance(m.get(k), str) and m[k].strip()
    url = urlparse(m.get("sourceUrl") or "")
    n = m.get("counts") or {}
    rules = {
        "schemaVersion": m.get("schemaVersion") == "1.0.0",
        **{k: bool(text(k)) for k in ("corpusVersion", "edition", "sourceMember")},
        "sourceUrl": bool(url.scheme and (url.netloc or url.path)),
        **{k: bool(re.fullmatch("[a-f0-9]{64}", m.get(k) or "")) for k in ("sourceSha256", "memberSha256", "canonicalSha256")},
        "encoding": m.get("encoding") == "windows-1252",
        "lineEndings": m.get("lineEndings") == "CRLF",
        "canonicalFormat": m.get("canonicalFormat") == "jsonl-utf8-lf-v1",
        "bookOrder": len(m.get("bookOrder") or []) == 66,
        "counts.books": n.get("books") == len(m.get("bookOrder") or []),
        "counts": min(n.get("chapters", 0), n.get("verses", 0)) >= 1,
        "license": bool(((m.get("license") or {}).get("statement") or "").strip()),
    }
    return [k for k, ok in rules.items() if not ok]


def research_record(query: dict, response: DataFrame) -> DataFrame:
    """(value): one line of JSON with the query, when it was asked, and the rows that it gives now."""
    rows = response.agg(F.collect_list(F.struct(*response.columns)).alias("response"))  # a bounded report
    return rows.select(
        F.to_json(F.struct(F.lit("1.0.0").alias("recordVersion"), F.current_timestamp().alias("exportedAt"), F.lit(json.dumps(query, sort_keys=True)).alias("query"), "response")).alias("value")
    )
