import pytest

from kindred.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(name, same_rows):
    same_rows(Q.queries()[name], Q.oracle_sql()[name])


def test_registered():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in Q.queries()}
    assert set(Q.queries()) | {"pipeline"} <= set(entry.queries())
