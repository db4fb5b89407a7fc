import pytest

from spanloom.llm import queries


def test_names():
    q, o = queries.queries(), queries.oracle_sql()
    assert set(o) <= set(q)
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 9)} | {"p7_ids"} <= set(q)


@pytest.mark.parametrize("name", ["p3_found", "p4_found", "p9_found"])
def test_columns(spark, name):
    columns = {"p3_found": ["corpus_version_id", "normalized", "mark"], "p4_found": ["query_reference", "target_reference"], "p9_found": ["doc_id"]}
    assert queries.queries()[name](spark, "/root/testdata/sf0.001").columns == columns[name]
