"""References to places of a text: `Book chapter:verse`, ranges, aliases, canonical order."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.errors import InvalidRequest

REFERENCE = r"^(.+?)\s+(\d+):(\d+)(?:\s*[-–]\s*(?:(\d+):)?(\d+))?$"


@dataclass(frozen=True, order=True)
class Reference:
    book_order: int
    chapter: int
    verse: int
    book: str

    def __str__(self) -> str:
        return f"{self.book} {self.chapter}:{self.verse}"


@dataclass(frozen=True)
class ReferenceRange:
    start: Reference
    end: Reference

    def __str__(self) -> str:
        if self.start == self.end:
            return str(self.start)
        if self.start.chapter == self.end.chapter:
            return f"{self.start}-{self.end.verse}"
        return f"{self.start}-{self.end.chapter}:{self.end.verse}"


def alias_key(text: str) -> str:
    return re.sub(r"\s+", " ", text.strip()).lower()


class Books:
    """The fixed list of books, on the driver: for query arguments. Later entries win where aliases clash."""

    def __init__(self, rows: list[tuple[int, str, str, list[str]]]):
        """rows: (book_order, osis, name, aliases)."""
        self.by_alias: dict[str, tuple[int, str]] = {}
        for order, osis, name, aliases in sorted(rows):
            for alias in (name, osis, *(aliases or [])):
                self.by_alias[alias_key(alias)] = (order, name)

    @classmethod
    def of(cls, books: DataFrame) -> Books:
        rows = books.select("book_order", "osis", "name", "aliases").collect()  # tens of rows
        return cls([(r.book_order, r.osis, r.name, list(r.aliases or [])) for r in rows])

    def parse(self, text: str) -> ReferenceRange:
        m = re.match(REFERENCE, text.strip())
        if not m:
            raise InvalidRequest(f"no reference: {text!r}")
        book = self.by_alias.get(alias_key(m[1]))
        if book is None:
            raise InvalidRequest(f"unknown book: {m[1]!r}")
        c, v = int(m[2]), int(m[3])
        end_c, end_v = int(m[4] or c), int(m[5] or v)
        if min(c, v, end_c, end_v) < 1:
            raise InvalidRequest("chapters and verses are counted from 1")
        if (end_c, end_v) < (c, v):
            raise InvalidRequest("the range ends before it starts")
        return ReferenceRange(Reference(book[0], c, v, book[1]), Reference(book[0], end_c, end_v, book[1]))


def aliases(books: DataFrame) -> DataFrame:
    """(alias, book_order, name): every name, code and alias by its key; of clashing ones the latest book."""
    every = books.select(
        "book_order",
        "name",
        F.explode(F.concat(F.array("name", "osis"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"),
    )
    key = F.lower(F.regexp_replace(F.trim("alias"), r"\s+", " "))
    return every.groupBy(key.alias("alias")).agg(F.max(F.struct("book_order", "name")).alias("b")).select("alias", "b.book_order", "b.name")


def parse_references(df: DataFrame, column: str, books: DataFrame) -> DataFrame:
    """df with a struct `parsed` of what a column of references says, null where it says nothing valid.

    The table of aliases is small and fixed, and is broadcast.
    """
    pattern = REFERENCE.replace("\\", "\\\\")
    part = lambda k: F.expr(f"regexp_extract(trim(`{column}`), '{pattern}', {k})")
    number = lambda k, other: F.when(part(k) == "", other).otherwise(part(k)).try_cast("int")
    chapter, verse = part(2).try_cast("int"), part(3).try_cast("int")
    read = df.withColumns(
        {
            "alias": F.lower(F.regexp_replace(F.trim(part(1)), r"\s+", " ")),
            "chapter_": chapter,
            "verse_": verse,
            "end_chapter_": number(4, part(2)),
            "end_verse_": number(5, part(3)),
        }
    )
    joined = read.join(F.broadcast(aliases(books)), "alias", "left")
    ends = F.struct(F.col("end_chapter_"), F.col("end_verse_")) >= F.struct(F.col("chapter_"), F.col("verse_"))
    valid = F.col("book_order").isNotNull() & (F.least("chapter_", "verse_", "end_chapter_", "end_verse_") >= 1) & ends
    parsed = F.struct(
        F.col("name").alias("book"),
        F.col("book_order").alias("book_order"),
        F.col("chapter_").alias("chapter"),
        F.col("verse_").alias("verse"),
        F.col("end_chapter_").alias("end_chapter"),
        F.col("end_verse_").alias("end_verse"),
    )
    return joined.select(*df.columns, F.when(valid, parsed).alias("parsed"))


def label(book: Column, chapter: Column, verse: Column) -> Column:
    return F.concat(book, F.lit(" "), chapter.cast("string"), F.lit(":"), verse.cast("string"))


def range_label(book: Column, chapter: Column, verse: Column, end_chapter: Column, end_verse: Column) -> Column:
    start = label(book, chapter, verse)
    return (
        F.when((chapter == end_chapter) & (verse == end_verse), start)
        .when(chapter == end_chapter, F.concat(start, F.lit("-"), end_verse.cast("string")))
        .otherwise(F.concat(start, F.lit("-"), end_chapter.cast("string"), F.lit(":"), end_verse.cast("string")))
    )
