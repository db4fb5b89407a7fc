"""Dictionary files: an index of headwords to places, and data lines at those places."""

from __future__ import annotations

import tarfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import stable_sha256
from ..plans.errors import InvalidRequest

# Parts of speech in the order of lookup, and the names of their letters.
PARTS = ["noun", "verb", "adj", "adv"]
NAMES = {"n": "noun", "v": "verb", "a": "adjective", "s": "adjective satellite", "r": "adverb"}


def parse_index(line: Column) -> Column:
    """struct<lemma, type, offsets array<bigint>>; null for what is no index line."""
    f = F.split(F.trim(line), r"\s+")
    synsets, pointers = F.get(f, F.lit(2)).try_cast("int"), F.get(f, F.lit(3)).try_cast("int")
    offsets = F.transform(F.slice(f, F.coalesce(pointers, F.lit(0)) + 7, F.coalesce(synsets, F.lit(0))), lambda x: x.try_cast("bigint"))
    sound = (F.size(f) >= 7) & (F.size(offsets) == synsets) & ~F.exists(offsets, lambda x: x.isNull())
    return F.when(sound, F.struct(F.get(f, F.lit(0)).alias("lemma"), F.get(f, F.lit(1)).alias("type"), offsets.alias("offsets")))


def parse_data(line: Column) -> Column:
    """struct<offset, type, words array<string>, definition>; null for what is no data line."""
    at = F.instr(line, "|")
    f = F.split(F.trim(F.substring_index(line, "|", 1)), r"\s+")
    n = F.conv(F.get(f, F.lit(3)), 16, 10).try_cast("int")
    words = F.transform(F.filter(F.slice(f, 5, F.coalesce(n, F.lit(0)) * 2), lambda x, i: i % 2 == 0), lambda w: F.translate(w, "_", " "))
    gloss = F.trim(F.get(F.split(line.substr(at + 1, F.length(line)), r';\s*"'), F.lit(0)))
    kind = F.get(f, F.lit(2))
    sound = (at > 0) & kind.isin(list(NAMES)) & n.isNotNull()
    return F.when(sound, F.struct(F.get(f, F.lit(0)).cast("bigint").alias("offset"), kind.alias("type"), words.alias("words"), gloss.alias("definition")))


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """(headword, part, offset, ordinal): the senses of each headword in published order."""
    out = None
    for k, part in enumerate(PARTS):
        lines = spark.read.text(f"{root}/index.{part}").where(~F.startswith("value", F.lit("  ")) & (F.col("value") != ""))
        parsed = lines.select(parse_index(F.col("value")).alias("p")).where("p is not null")
        rows = parsed.select(F.col("p.lemma").alias("headword"), F.lit(part).alias("part"), F.posexplode("p.offsets").alias("k", "offset")).select(
            "headword", "part", "offset", (F.lit(k * 10_000) + F.col("k")).alias("ordinal")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def read_data(spark: SparkSession, root: str) -> DataFrame:
    """(part, offset, type, words, definition)."""
    out = None
    for part in PARTS:
        lines = spark.read.text(f"{root}/data.{part}").where(~F.startswith("value", F.lit("  ")) & (F.col("value") != ""))
        rows = lines.select(F.lit(part).alias("part"), parse_data(F.col("value")).alias("p")).where("p is not null").select("part", "p.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def senses(index: DataFrame, data: DataFrame) -> DataFrame:
    """(headword, ordinal, sense_id, part_of_speech, definition, synonyms), by an equi-join on place."""
    name = F.create_map(*(F.lit(x) for item in NAMES.items() for x in item))
    return index.join(data, ["part", "offset"]).select(
        F.translate("headword", "_", " ").alias("headword"),
        "ordinal",
        F.concat(F.lit("wn30:"), F.col("type"), F.lit(":"), F.lpad(F.col("offset").cast("string"), 8, "0")).alias("sense_id"),
        F.element_at(name, F.col("type")).alias("part_of_speech"),
        "definition",
        F.col("words").alias("synonyms"),
    )


class WordNet:
    """A dictionary over a table of senses; entries looked up are kept once in a folder, if one is given."""

    def __init__(self, spark: SparkSession, table: DataFrame | None, cache: str | None = None):
        self.spark, self.table, self.cache = spark, table, cache
        self.available = table is not None or cache is not None

    def lookup(self, headword: str) -> DataFrame | None:
        word = headword.strip().lower()
        path = f"{self.cache}/{stable_sha256(word)}" if self.cache else None
        if path:
            try:
                return self.spark.read.parquet(path)
            except Exception as missing:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(missing):
                    raise
        if self.table is None:
            return None
        rows = self.table.where(F.col("headword") == word)
        if not rows.limit(1).count():
            return None
        if path:
            rows.write.mode("ignore").parquet(path)
        return rows.orderBy("ordinal")


def keep_selection(spark: SparkSession, cache: str, topic: str, sense_id: str, terms: list[str]) -> str:
    """Writes down, once, which terms were chosen for a topic and sense; gives the record's key."""
    chosen = sorted(set(terms))
    key = stable_sha256({"topic": topic, "sense": sense_id, "selectedCandidates": chosen})
    row = spark.createDataFrame([(topic, sense_id, chosen)], "topic string, sense_id string, terms array<string>")
    row.coalesce(1).write.mode("ignore").parquet(f"{cache}/selections/{key}")
    return key


def unpack(archive: str, into: str, sha256: str | None = None) -> dict[str, str]:
    """The dictionary's files of a tar.gz in a folder; gives their digests."""
    import hashlib
    import os

    with open(archive, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    if sha256 and digest != sha256:
        raise InvalidRequest("the archive's digest differs")
    wanted = {f"{kind}.{part}" for kind in ("index", "data") for part in PARTS} | {"LICENSE"}
    os.makedirs(into, exist_ok=True)
    out = {}
    with tarfile.open(archive) as tar:
        for item in tar:
            name = os.path.basename(item.name)
            if item.isfile() and name in wanted:
                data = tar.extractfile(item).read()
                with open(os.path.join(into, name), "wb") as f:
                    f.write(data)
                out[name] = hashlib.sha256(data).hexdigest()
    if missing := wanted - {"LICENSE"} - out.keys():
        raise InvalidRequest(f"not in the archive: {', '.join(sorted(missing))}")
    return out
