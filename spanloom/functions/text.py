"""Text layers as Column expressions: tokens with offsets, folding, normal forms, sentence starts."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# What a token is. Apostrophes join within a word; all other marks part words.
TOKEN = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
#: The second algorithm's token: hyphens and dashes join as well.
JOINED_TOKEN = r"[\p{L}\p{N}]+(?:['’\-‐‑‒–—][\p{L}\p{N}]+)*"
#: Text between two tokens that ends a sentence.
SENTENCE_END = r"""[.!?][\s\])}"'’]*$"""

#: Letters that a canonical composition changes although no combining mark is in a token: Kelvin, Angstrom, Ohm.
_SINGLETONS = ("KÅΩ", "KÅΩ")


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition, which Spark has no function for: meant for texts once, at ingest."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def fold(surface: Column) -> Column:
    """Lower case in composed form. A token holds no combining marks, so that only singletons need composing."""
    return F.lower(F.translate(surface, *_SINGLETONS))


def normalized(folded: Column) -> Column:
    return F.translate(folded, "’", "'")


def normalization_rules(folded: Column) -> Column:
    """The rules that `normalized` applied."""
    return F.when(F.contains(folded, F.lit("’")), F.array(F.lit("typographic-apostrophe-equivalence"))).otherwise(
        F.array().cast("array<string>")
    )


def surfaces(text: Column, pattern: str = TOKEN) -> Column:
    """array<string>: the tokens of a text, [] for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.array().cast("array<string>"))


def tokenize(text: Column, pattern: str = TOKEN) -> Column:
    """array<struct<position, char_start, char_end, surface, folded>> of a text, in order.

    The text is cut at its tokens; offsets are running lengths of the pieces, counted in characters.
    """
    mark = "\x01"
    pieces = F.split(F.regexp_replace(F.translate(text, mark, " "), f"({pattern})", f"{mark}$1{mark}"), mark)
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<position:int,char_start:int,char_end:int,surface:string>>").alias("out"))
    # pieces at odd places are tokens; a token's number is half its place
    numbered = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    cut = F.aggregate(
        numbered,
        step,
        lambda acc, x: F.struct(
            (acc.at + F.length(x.p)).alias("at"),
            F.when(
                x.i % 2 == 1,
                F.concat(
                    acc.out,
                    F.array(
                        F.struct(
                            (x.i / 2).cast("int").alias("position"),
                            acc.at.alias("char_start"),
                            (acc.at + F.length(x.p)).alias("char_end"),
                            x.p.alias("surface"),
                        )
                    ),
                ),
            )
            .otherwise(acc.out)
            .alias("out"),
        ),
        lambda acc: acc.out,
    )
    return F.transform(
        F.coalesce(cut, F.array().cast("array<struct<position:int,char_start:int,char_end:int,surface:string>>")),
        lambda t: F.struct(t.position, t.char_start, t.char_end, t.surface, fold(t.surface).alias("folded")),
    )


def letters(word: Column) -> Column:
    """How many letters a word has."""
    return F.length(F.regexp_replace(word, r"[^\p{L}]", ""))


def is_sentence_start(position: Column, between: Column) -> Column:
    """between: the text from the token before to this one."""
    return (position == 0) | F.coalesce(between.rlike(SENTENCE_END), F.lit(False))


def token_rows(df: DataFrame, column: str, pattern: str = TOKEN) -> DataFrame:
    """A row a token of df's column: df's other columns, position, char_start, char_end, surface, folded.

    Linear in the text, in Arrow batches; folding composes fully. Null texts have no tokens.
    """
    keys = [c for c in df.columns if c != column]

    def run(batches):
        import regex

        find = regex.compile(pattern).finditer
        for batch in batches:
            rows, positions, starts, ends, surface = [], [], [], [], []
            for k, t in enumerate(batch.column(batch.schema.get_field_index(column)).to_pylist()):
                if t:
                    for n, m in enumerate(find(t)):
                        rows.append(k)
                        positions.append(n)
                        starts.append(m.start())
                        ends.append(m.end())
                        surface.append(m[0])
            kept = batch.select(keys).take(pa.array(rows, pa.int64()))
            words = pa.array(surface, pa.string()).dictionary_encode()
            forms = [w.lower() if w.isascii() else unicodedata.normalize("NFC", w).lower() for w in words.dictionary.to_pylist()]
            folded = pa.array(forms, pa.string()).take(words.indices)
            columns = [pa.array(x, pa.int32()) for x in (positions, starts, ends)] + [words.cast(pa.string()), folded]
            yield pa.record_batch([*kept.columns, *columns], names=[*keys, "position", "char_start", "char_end", "surface", "folded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != column)
    return df.select(*keys, column).mapInArrow(run, f"{schema}, position int, char_start int, char_end int, surface string, folded string")
