"""Imported pairs of references in one orientation, each once."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import refs
from ..plans.errors import InvalidRequest


def prepare(manifest: dict, records: DataFrame, books: DataFrame) -> DataFrame:
    """(source, target, note) of records (source, target, note): the earlier place first, repetitions once.

    A set that isn't enabled gives no rows. An enabled one needs its source, licence, checksum and
    approval. Ranges stand for their first verse. References that can't be read, and pairs of a
    place with itself, are errors.
    """
    if not manifest.get("enabled"):
        return records.select("source", "target", "note").limit(0)
    given = all(manifest.get(k) for k in ("sourceUrl", "license", "ownerApproved")) and manifest.get("approvalStatus") == "approved"
    if not given or not re.fullmatch(r"[0-9a-fA-F]{64}", manifest.get("checksum") or ""):
        raise InvalidRequest("an enabled set needs its source, licence, checksum and approval")
    both = refs.parse_references(records.select("source", "target", "note"), "source", books).withColumnRenamed("parsed", "a")
    both = refs.parse_references(both, "target", books).withColumnRenamed("parsed", "b")
    key = lambda c: F.struct(f"{c}.book_order", f"{c}.chapter", f"{c}.verse")
    name = lambda c: refs.label(F.col(f"{c}.book"), F.col(f"{c}.chapter"), F.col(f"{c}.verse"))
    checked = both.withColumn(
        "wrong",
        F.when(F.col("a").isNull() | F.col("b").isNull(), F.concat_ws(" -> ", "source", "target")).when(key("a") == key("b"), F.concat_ws(" -> ", "source", "target")),
    )
    sound = checked.where(F.col("wrong").isNull() | F.raise_error(F.concat(F.lit("no cross-reference: "), F.col("wrong"))).isNotNull())
    turned = key("a") > key("b")
    note = F.nullif(F.trim(F.coalesce("note", F.lit(""))), F.lit(""))
    return sound.select(
        F.when(turned, name("b")).otherwise(name("a")).alias("source"), F.when(turned, name("a")).otherwise(name("b")).alias("target"), note.alias("note")
    ).distinct()
