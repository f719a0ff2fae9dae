import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from catalox.session import session

    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return [_plain(x) for x in v] if isinstance(v, list | tuple) else str(v)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Asserts that a query and its SQL give the same columns and rows, in any order."""

    def check(query, sql):
        df = query(spark, SF)
        columns = sorted(df.columns)
        got = sorted(str(_plain(r)) for r in df.select(columns).collect())
        result = duck.execute(sql)
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        want = sorted(str(_plain([r[names.index(c)] for c in columns])) for r in result.fetchall())
        assert got == want

    return check
