import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from spanloom.plans.errors import InvalidRequest
from spanloom.sources import ingest, wordnet
from spanloom.streaming import term_stream

BOOKS = [(1, "Ge", "Genesis"), (2, "Ex", "Exodus"), (19, "Ps", "Psalms"), (45, "Ro", "Romans"), (66, "Re", "Revelation")]
PS1 = "Ps 3:1 <<A Psalm of David.>> LORD, how are they increased that trouble me! many [are] they that rise up against me."
PS2 = "Ps 3:2 Many [there be] which say of my soul, [There is] no help for him in God. Selah."


@pytest.fixture
def parse(tmp_path):
    def run(spark, *lines, eol="\r\n"):
        books = spark.createDataFrame(BOOKS, "book_order int, osis string, name string")
        path = tmp_path / f"lines-{len(list(tmp_path.iterdir()))}.txt"
        path.write_bytes(eol.join(lines).encode("cp1252"))
        return ingest.parse_records(ingest.read_lines(spark, str(path)), books)

    return run


def test_lines_in_splits(spark, tmp_path):
    """Numbers and places go on from split to split and from file to file."""
    lines = [f"{k} " + "é" * (k % 37) for k in range(3000)]
    (tmp_path / "src").mkdir()
    for n, part in enumerate((lines[:1200], lines[1200:])):
        (tmp_path / "src" / f"part-{n}").write_bytes(("\r\n".join(part) + "\r\n").encode("cp1252"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        read = ingest.read_lines(spark, str(tmp_path / "src"))
        assert spark.read.text(str(tmp_path / "src")).rdd.getNumPartitions() > 3
        rows = read.orderBy("line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = "".join(x + "\r\n" for x in lines).encode("cp1252")
    assert [r.record for r in rows] == lines and [r.line for r in rows] == list(range(1, 3001))
    assert all(whole[r.byte_start : r.byte_end].decode("cp1252") == r.record for r in rows)


def test_records(spark, parse):
    rows = parse(spark, PS1, "", PS2, "Re 22:21 The grace. Amen. <<THE END.>>", "Ro 16:27 Amen. <<[Written to the Romans.]>>").orderBy("line").collect()
    assert [(p.type, p.text) for p in rows[0].paratext] == [("heading", "A Psalm of David.")]
    assert [rows[0].display_text[s.start : s.end] for s in rows[0].italics] == ["are"]
    assert [rows[1].display_text[s.start : s.end] for s in rows[1].italics] == ["there be", "There is"]
    assert rows[1].line == 3 and rows[1].byte_start == len(PS1) + 4 and rows[1].byte_end - rows[1].byte_start == len(PS2)
    assert rows[2].paratext[0].type == "terminal" and "END" not in rows[2].display_text
    assert (rows[3].paratext[0].type, rows[3].paratext[0].text) == ("subscription", "Written to the Romans.")
    n = ingest.counts(parse(spark, PS1, PS2)).first()
    assert (n.books, n.chapters, n.verses, n.italic_spans, n.paratext_items) == (1, 1, 2, 3, 1)


def test_issues(spark, parse):
    rows = parse(spark, "Ge 1:1 In the [beginning God created", "Ge 1:3 And", "Ge 1:3 Again <<x", "nonsense", "Zz 1:1 x", "Ex 1:1 ok", eol="\n")
    codes = sorted(r.code for r in ingest.issues(rows, 2, 9, "Genesis 1:1", "Revelation 22:21").collect())
    assert codes == sorted(["unbalanced_italics", "nonconsecutive_reference", "nonconsecutive_reference", "duplicate_reference", "unbalanced_paratext", "malformed_record", "unknown_book_code", "unexpected_verse_count", "unexpected_last_reference"])
    assert ingest.issues(parse(spark, PS1, PS2)).count() == 0


def test_archive_and_canonical(spark, tmp_path, parse):
    data = bytes([0x41, 0x92, 0x97, 0x42])
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("t.txt", data)
    row = ingest.read_archive(spark, str(tmp_path / "a.zip"), "t.txt").first()
    assert row.text == "A’—B" and len(row.archive_sha256) == 64
    assert ingest.checksum_issues(ingest.read_archive(spark, str(tmp_path / "a.zip"), "t.txt"), "0", row.member_sha256).first().code == "source_checksum_mismatch"
    from spanloom.plans import storage

    assert storage.extract_member(spark, str(tmp_path / "a.zip"), "t.txt", str(tmp_path / "t.txt")) == (row.archive_sha256, row.member_sha256)
    assert (tmp_path / "t.txt").read_bytes() == data
    verses = parse(spark, PS2, PS1).where("problem is null")
    assert ingest.corpus_sha256(verses) == ingest.corpus_sha256(verses.orderBy(F.rand(1)))
    out = str(tmp_path / "out")
    ingest.write_canonical(verses, out)
    again = ingest.read_canonical(spark, out, 2)
    assert {r.display_text for r in again.collect()} == {r.display_text for r in verses.collect()}
    assert ingest.canonical_sha256(verses) == ingest.canonical_sha256(verses.orderBy(F.rand(1)))
    with pytest.raises(InvalidRequest):
        ingest.read_canonical(spark, out, 3)


def test_manifest():
    good = {
        "schemaVersion": "1.0.0", "corpusVersion": "v", "edition": "e", "sourceUrl": "https://x/y", "sourceMember": "m", "sourceSha256": "a" * 64, "memberSha256": "b" * 64,
        "canonicalSha256": "c" * 64, "encoding": "windows-1252", "lineEndings": "CRLF", "canonicalFormat": "jsonl-utf8-lf-v1", "bookOrder": list(range(66)),
        "counts": {"books": 66, "chapters": 1, "verses": 1}, "license": {"statement": "s"},
    }
    assert ingest.manifest_errors(good) == []
    assert set(ingest.manifest_errors(good | {"sourceUrl": "x", "memberSha256": "B" * 64, "license": {}})) == {"sourceUrl", "memberSha256", "license"}
    assert len(ingest.manifest_errors({})) == 15


def test_dictionary(spark, tmp_path):
    lines = {
        "index.noun": "  licence\nharmony n 2 1 @ 2 0 04713118 07027180\nbroken\n", "data.noun": "04713118 07 n 02 harmony 1 harmoniousness 0 000 | compatibility in opinion and action; \"an example\"\n07027180 10 n 02 harmony 0 musical_harmony 0 000 | structure of music\n",
        **{f"{k}.{p}": "" for k in ("index", "data") for p in ("verb", "adj", "adv")},
    }
    with tarfile.open(tmp_path / "d.tgz", "w:gz") as tar:
        for name, body in lines.items():
            info = tarfile.TarInfo(f"dict/{name}")
            info.size = len(body.encode())
            tar.addfile(info, io.BytesIO(body.encode()))
    root = str(tmp_path / "dict")
    assert len(wordnet.unpack(str(tmp_path / "d.tgz"), root)) == 8
    table = wordnet.senses(wordnet.read_index(spark, root), wordnet.read_data(spark, root))
    d = wordnet.WordNet(spark, table, str(tmp_path / "cache"))
    rows = d.lookup(" Harmony ").collect()
    assert [(r.sense_id, r.synonyms) for r in rows] == [("wn30:n:04713118", ["harmony", "harmoniousness"]), ("wn30:n:07027180", ["harmony", "musical harmony"])]
    assert rows[0].definition == "compatibility in opinion and action" and rows[0].part_of_speech == "noun"
    assert d.lookup("nothing") is None
    assert wordnet.WordNet(spark, None, str(tmp_path / "cache")).lookup("harmony").count() == 2
    bad = spark.createDataFrame([("00000000 no gloss divider",), ("broken",)], "l string")
    assert all(r.a is None and r.b is None for r in bad.select(wordnet.parse_data(F.col("l")).alias("a"), wordnet.parse_index(F.col("l")).alias("b")).collect())


def test_stream_goes_on(spark, tmp_path):
    source, home = str(tmp_path / "in"), str(tmp_path / "state")
    first = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id bigint, text string")
    first.write.parquet(source)
    got = term_stream.refresh(spark, source, first.schema, home)
    assert {(r.normalized, r.document_frequency, r.total_frequency) for r in got.collect()} == {("a", 1, 2), ("b", 1, 1)}
    spark.createDataFrame([(3, "b c")], first.schema).write.mode("append").parquet(source)
    got = term_stream.refresh(spark, source, first.schema, home)
    assert {(r.normalized, r.document_frequency, r.total_frequency) for r in got.collect()} == {("a", 1, 2), ("b", 2, 2), ("c", 1, 1)}
