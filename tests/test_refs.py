import pytest

from spanloom.functions import refs
from spanloom.plans.errors import InvalidRequest

ROWS = [(1, "Gen", "Genesis", ["gn"]), (23, "Isa", "Isaiah", []), (43, "John", "John", ["jn"]), (46, "1Cor", "1 Corinthians", ["1 cor"])]


@pytest.mark.parametrize(
    "given, label, order",
    [("John 3:16", "John 3:16", 43), ("1 Cor 13:13-14:1", "1 Corinthians 13:13-14:1", 46), ("Isa 34:15-17", "Isaiah 34:15-17", 23), ("  jn   3:16 ", "John 3:16", 43)],
)
def test_parse(given, label, order):
    span = refs.Books(ROWS).parse(given)
    assert (str(span), span.start.book_order) == (label, order)


@pytest.mark.parametrize("bad", ["Unknown 1:1", "John 0:1", "John 3:16-15", "John", "John 3", "John 3:16-2:1"])
def test_errors(bad):
    with pytest.raises(InvalidRequest):
        refs.Books(ROWS).parse(bad)


def test_columns(spark):
    books = spark.createDataFrame(ROWS, "book_order int, osis string, name string, aliases array<string>")
    given = ["John 3:16", "1 cor 13:13-14:1", "Isa 34:15–17", "Unknown 1:1", "John 0:1", "John 3:16-15", None, ""]
    df = spark.createDataFrame([(g,) for g in given], "r string")
    rows = {r.r: r.parsed for r in refs.parse_references(df, "r", books).collect()}
    assert rows["John 3:16"].book_order == 43 and rows["1 cor 13:13-14:1"].end_chapter == 14 and rows["Isa 34:15–17"].end_verse == 17
    assert all(rows[bad] is None for bad in given[3:])
    assert refs.Reference(2, 1, 1, "Exodus") < refs.Reference(43, 1, 1, "John")
