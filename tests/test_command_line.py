import json

import pytest

from spanloom import __main__ as cli

LINES = ["Ge 1:1 In the beginning God created the heaven and the earth.", "Ge 1:2 And the earth was [without] form.", "Ge 1:3 Let there be light."]


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    rows = [(1, "Ge", "Genesis", ["gen"])]
    spark.createDataFrame(rows, "book_order int, osis string, name string, aliases array<string>").write.parquet(str(root / "books"))
    (root / "source.txt").write_bytes("\r\n".join(LINES).encode("cp1252"))
    (root / "bad.txt").write_text("Ge 1:1 x\nnonsense\n")
    return root


def call(spark, home, *argv):
    return cli.run(spark, cli.arguments([str(x) for x in argv]))


def test_verbs(spark, home, capsys):
    books, out, corpus = home / "books", home / "canonical", home / "corpus"
    assert call(spark, home, "import", home / "source.txt", books, out) == 0
    assert json.loads(capsys.readouterr().out)["verses"] == 3
    report, manifest = (json.loads((out / f"{x}.json").read_text()) for x in ("import-report", "manifest"))
    assert report["issues"] == [] and report["counts"]["italic_spans"] == 1 and "sourceUrl" in report["manifestErrors"]
    assert manifest["counts"] == {"books": 1, "chapters": 1, "verses": 3} and manifest["canonicalSha256"] == report["canonicalSha256"]
    assert call(spark, home, "import", home / "bad.txt", books, home / "no") == 2 and not (home / "no").exists()
    assert call(spark, home, "index", out, corpus) == 0
    capsys.readouterr()
    for argv, check in (
        (("stats", corpus), lambda rows: rows[0]["corpus_size"] == 3),
        (("exact", corpus, "earth"), lambda rows: [r["label"] for r in rows] == ["Genesis 1:1", "Genesis 1:2"]),
        (("phrase", corpus, "the earth", "--limit", 1), lambda rows: len(rows) == 1 and rows[0]["total"] == 2),
        (("term", corpus, "earth"), lambda rows: rows[0]["verses"] == 2),
        (("related", corpus, books, "gen 1:1"), lambda rows: rows[0]["label"] == "Genesis 1:2"),
        (("tokenize", "A b"), lambda rows: [r["surface"] for r in rows] == ["A", "b"]),
    ):
        assert call(spark, home, *argv) == 0
        assert check([json.loads(x) for x in capsys.readouterr().out.splitlines()])
    assert call(spark, home, "reference", books, "Gen 1:2-3") == 0
    assert capsys.readouterr().out.strip() == "Genesis 1:2-3"
