import pytest

from catalox.operators import search

ROWS = [
    ("1", "beach.jpg", "image/jpeg", "Noosa, Australia", ["holiday", "starred"], "2024-03-01"),
    ("2", "Beach House.PNG", "image/png", "Perth, Australia", [], "2023-01-05"),
    ("3", "city.mp4", "video/mp4", None, None, None),
    ("4", "dog.jpg", "image/jpeg", "Beachport", ["pets", "My Holiday"], "2022-12-31"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ROWS, "_id string, origFileName string, contentType string, location string, labels array<string>, photoDate string")


@pytest.mark.parametrize(("query", "want"), [
    ("", "1234"), ("   ", "1234"), ("beach", "124"), ("BEACH jpeg", "14"), ('"beach house"', "2"), (".location=australia", "12"), (".location=australia png", ""), (".location=australia noosa", "1"), (".location=beach dog", ""), (".labels=holiday dog", "4"), (".location=australia .labels=holiday jpg", "1"),
    (".a=b=c", "1234"), (".location=australia .a=b=c noosa", "1"), (".location=", "124"), (".label=holiday&starred", ""), (".LABELS=starred", "1"), ("photo", ""), (".=noosa", "1"),
    (".labels=-", "23"), (".labels=holiday", "14"), (".labels=holiday&starred", "1"), (".labels=starred|pets", "14"), (".labels=nothing", ""), (".date=2023", "2"),
    (".broken beach", "124"), (".nofield=x", ""), ('.labels="my holiday"', "4"), ("nothing", ""), ("australia beach", "12"),
])
def test_text(items, query, want):
    assert "".join(sorted(r._id for r in items.filter(search.text_filter(items, query)).collect())) == want


def test_numbers_never_match(spark):
    df = spark.createDataFrame([("a", 12)], "_id string, width int")
    assert df.filter(search.text_filter(df, ".width=12")).count() == 0


@pytest.mark.parametrize(("args", "want"), [
    ({}, "1234"), ({"query": "BEACH"}, "124"), ({"content_type": "IMAGE"}, "124"), ({"date_from": "2023-01-05"}, "12"), ({"date_to": "2023-01-05"}, "24"),
    ({"query": "beach", "content_type": "image/j", "date_from": "2024-01-01"}, "1"),
])
def test_asset_filter(items, args, want):
    from pyspark.sql import functions as F

    c = search.asset_filter(F.col("origFileName"), F.col("location"), F.col("contentType"), F.col("photoDate").cast("timestamp"), **args)
    assert "".join(sorted(r._id for r in items.filter(c).collect())) == want


def test_under_path(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("b/a",)], "p string")
    assert sorted(r.p for r in df.filter(search.under_path(F.col("p"), "a")).collect()) == ["a", "a/b"]
