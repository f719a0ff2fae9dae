import pytest

from catalox.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE_SQL[name])


def test_registered():
    import __spark_entry__ as e

    assert {f"op{i}" for i in range(1, 11)} <= {k.split("_")[0] for k in e.queries()}
    assert "pipeline" in e.queries()
