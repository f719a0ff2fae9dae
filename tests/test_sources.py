import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from catalox.sources import files, store
from catalox.streaming.ingest import change_stream, file_stream, import_stream


def test_store(spark, tmp_path):
    at = str(tmp_path / "c")
    df = spark.range(200).select("id", (F.col("id") * 2).alias("v"))
    store.write_version(df, at, 0, "id")
    assert store.latest(spark, at) == 0
    found = store.point_lookup(store.read_version(spark, at), "id", 17)
    assert [tuple(r)[:2] for r in found.collect()] == [(17, 34)]
    assert "PartitionFilters: [isnotnull(shard" in found._jdf.queryExecution().toString()
    changed = store.read_version(spark, at).filter("shard < 3").withColumn("v", F.lit(0).cast("long"))
    store.write_shards(changed, at, 1, "id")
    back = store.read_version(spark, at)
    assert back.count() == 200 and back.filter("shard < 3 and v <> 0").count() == 0
    with pytest.raises(ValueError, match="no complete version"):
        store.read_version(spark, str(tmp_path / "none"))


def test_files(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.png", b"deep")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("a.jpg", b"a")
        z.writestr("in.zip", inner.getvalue())
    (tmp_path / "d").mkdir()
    for name, data in (("d/x.JPG", b"x"), ("d/y.txt", b"y"), ("d/v.ts", b"v"), ("z.zip", outer.getvalue()), ("bad.zip", b"bad")):
        (tmp_path / name).write_bytes(data)
    found = files.scan_media(spark, str(tmp_path), content=True)
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["bad.zip", "x.JPG", "z.zip"]
    assert files.scan(spark, str(tmp_path), ignore=r"\.zip$").count() == 3
    entries = {r.path.split(tmp_path.name + "/")[1]: r.hash for r in files.expand_archives(found).collect()}
    assert set(entries) == {"bad.zip", "d/x.JPG", "z.zip/a.jpg", "z.zip/in.zip/deep.png"}
    assert entries["z.zip/in.zip/deep.png"] == hashlib.sha256(b"deep").hexdigest()


def test_import_stream(spark, tmp_path):
    source, table, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    put = lambda rows: spark.createDataFrame(rows, "path string, hash string").coalesce(1).write.mode("append").parquet(source)
    put([("a", "1"), ("b", "1"), ("c", "2")])
    schema = spark.read.parquet(source).schema
    import_stream(file_stream(spark, source, schema), table, mark).awaitTermination()
    put([("d", "2"), ("e", "3")])
    import_stream(file_stream(spark, source, schema), table, mark).awaitTermination()
    assert sorted((r.path, r.hash) for r in spark.read.parquet(table).collect()) == [("a", "1"), ("c", "2"), ("e", "3")]


def test_change_stream(spark, tmp_path):
    at, source, mark = (str(tmp_path / x) for x in ("store", "ops", "mark"))
    store.write_version(spark.createDataFrame([("r1", "n", ["a"])], "id string, name string, labels array<string>"), at, 0, "id")
    ops = spark.createDataFrame([("r1", 1, "push", "labels", "b"), ("r2", 2, "set", "name", "x")], "id string, seq int, kind string, field string, value string")
    ops.coalesce(1).write.parquet(source)
    change_stream(file_stream(spark, source, ops.schema), at, mark, "id", ["name"], "labels").awaitTermination()
    assert store.latest(spark, at) == 1
    assert sorted((r.id, r.name, str(r.labels)) for r in store.read_version(spark, at).collect()) == [("r1", "n", "['a', 'b']"), ("r2", "x", "None")]


def test_scratch_tables_go(spark):
    """Tables go with the scratch that they were written in; kept ones with the one around it."""
    import os

    from catalox.sources import scratch

    one = spark.range(3)
    local = lambda uri: "/" + uri.split(":", 1)[1].lstrip("/")
    with scratch.scratch(spark):
        with scratch.scratch(spark):
            gone, kept = scratch.materialize(one, "a"), scratch.materialize(one, "b", keep=True)
            files = [gone.inputFiles()[0], kept.inputFiles()[0]]
        assert kept.count() == 3 and [os.path.exists(local(f)) for f in files] == [False, True]
    assert not os.path.exists(local(files[1]))
    free = local(scratch.materialize(one, "c").inputFiles()[0])
    assert os.path.exists(free)
    scratch.drop_tables(spark)
    assert not os.path.exists(free)
