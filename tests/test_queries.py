import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from catalox.plans.catalogue import ORACLE_SQL, QUERIES
from conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert rows and rows[0].__fields__ == ["asset_id", "file_name", "taken"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_rows_only_queries(spark):
    rows = QUERIES["row_packing"](spark, SF).collect()
    assert len({r.asset_id for r in rows}) == len(rows)
    root = QUERIES["merkle_tree_root"](spark, SF).first()
    assert len(root.root) == len(root.collection_root) == 64


def test_paged_scan_reads_once(spark, tmp_path):
    """The plan of a paged scan, and so what its tasks report to the driver, does not grow with the leaves; no orders give no rows."""
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    n = orders.count()
    times = -(-40_000 // n)
    many = orders.crossJoin(spark.range(times).withColumnRenamed("id", "copy")).withColumn("o_orderkey", F.col("o_orderkey") + F.col("copy") * 10_000_000).drop("copy")
    many.write.parquet(f"{tmp_path}/many/orders.parquet")
    found = QUERIES["paged_scan"](spark, f"{tmp_path}/many")
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = found.collect()
    assert [(r.position, r.token) for r in got] == [(i, i // 16_000) for i in range(n * times)]
    want = many.orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey").collect()
    assert [r.asset_id for r in got] == [r.o_orderkey for r in want]
    orders.limit(0).write.parquet(f"{tmp_path}/none/orders.parquet")
    assert QUERIES["paged_scan"](spark, f"{tmp_path}/none").collect() == []
