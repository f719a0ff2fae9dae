import pytest
from pyspark.sql import functions as F

from catalox.functions import dates, ordering, places, records, text


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("size", "want"), [(0, "0 B"), (1, "1 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (1234567, "1.18 MB"), (1 << 30, "1 GB"), (5 << 40, "5 TB"), (5 << 50, "5120 TB")])
def test_file_size(spark, size, want):
    assert one(spark, text.file_size(F.col("s")), s=size) == want


@pytest.mark.parametrize(("query", "candidate", "want"), [("cat", "cat", False), ("Cat", "cat", False), ("cat", "cut", True), ("cat", "doggish", False), ("summary", "sumary", True), ("abc", "xyz", True), ("abc", "wxyz", False)])
def test_fuzzy(spark, query, candidate, want):
    assert one(spark, text.fuzzy_match(F.col("q"), F.col("c")), q=query, c=candidate) is want


@pytest.mark.parametrize(("value", "want"), [(32.30642, "32° 18.385' N"), (-122.614583, "122° 36.875' S"), (0.0, "0° 0.000' N"), (9.99999999, "10° 0.000' N")])
def test_degrees_minutes(spark, value, want):
    assert one(spark, places.degrees_minutes(F.col("v"), "N", "S"), v=value) == want


def test_coordinates(spark):
    assert one(spark, places.degrees(F.lit(10.0), F.lit(30.0), F.lit(36.0), F.lit("S"))) == pytest.approx(-10.51)
    assert one(spark, places.fraction(F.lit("385/10"))) == 38.5
    assert one(spark, places.fraction(F.lit("1/0"))) is None
    assert tuple(one(spark, places.video_coordinates(F.lit("+27.5916-151.0823/")))) == (27.5916, -151.0823)
    assert one(spark, places.video_coordinates(F.lit("nowhere"))) is None


def test_address(spark):
    row = ([{"types": ["route"], "address_components": [{"long_name": "X"}]}, {"types": ["street_address"], "address_components": [{"long_name": "1"}, {"long_name": "Oak"}, {"long_name": "1"}]}],)
    df = spark.createDataFrame([row], "r array<struct<types: array<string>, address_components: array<struct<long_name: string>>>>")
    assert df.select(places.address(F.col("r"))).first()[0] == "1, Oak"


def test_paths_and_labels(spark):
    assert one(spark, text.folder_labels(F.lit("/photos/2024/x.jpg"))) == ["photos", "2024"]
    assert one(spark, text.folder_labels(F.lit("x.jpg"))) == []
    assert one(spark, text.base_name(F.lit("a/b.jpg"))) == "b.jpg"
    assert one(spark, text.folder_of(F.lit("a/b.jpg"))) == "a"
    a = F.array(F.lit("x"), F.lit("y"))
    assert one(spark, text.pushed(a, F.lit("x"))) == ["x", "y"]
    assert one(spark, text.pushed(F.lit(None).cast("array<string>"), F.lit("x"))) == ["x"]
    assert one(spark, text.moved_to_end(a, F.lit("x"))) == ["y", "x"]
    assert one(spark, text.nested_get(F.lit('{"a": {"b": 3}}'), "a.b", "int")) == 3
    assert one(spark, text.nested_get(F.lit("{broken"), "a.b", "int")) is None


def test_orders(spark):
    names = ["img10", "img9", "img1a", "Img2", "b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(ordering.string_key(ordering.natural_key(F.col("n")))).collect()] == ["b", "img1a", "Img2", "img9", "img10"]
    long = spark.createDataFrame([("x" + "9" * 30,), ("x1" + "0" * 30,), ("x007",), ("x10",)], "n string")
    assert [r.n for r in long.orderBy(ordering.string_key(ordering.natural_key(F.col("n")))).collect()] == ["x007", "x10", "x" + "9" * 30, "x1" + "0" * 30]
    df = spark.createDataFrame([(2.0,), (float("nan"),), (None,), (-1.0,)], "v double")
    assert str([r.v for r in df.orderBy(*ordering.number_key(F.col("v"))).collect()]) == "[nan, -1.0, None, 2.0]"
    assert one(spark, ordering.place_key(F.lit("1 Oak, Noosa,  QLD, Australia"))) == ["Australia", "QLD", "Noosa"]


def test_dates(spark):
    assert str(one(spark, dates.exif_date(F.lit("2024:03:01 10:20:30"), F.lit(None).cast("string")))) == "2024-03-01 10:20:30"
    assert one(spark, dates.parsed(F.lit("no date"))) is None
    assert one(spark, dates.month_group(F.lit("2024-03-01").cast("timestamp"))) == ["2024", "March"]
    assert one(spark, dates.month_group(F.lit(None).cast("timestamp"))) == ["Undated"]


def test_records(spark):
    u = "0F8FAD5B-D9CB-469F-A165-70867728950E"
    assert one(spark, records.uuid_text(records.uuid_bytes(F.lit(u)))) == u.lower()
    assert one(spark, records.uuid_bytes(F.lit("x"))) is None
    assert [one(spark, records.classify_input(F.lit(x))) for x in (u, "a" * 64, "photos/x.jpg")] == ["asset_id", "hash", "path"]
    stamped = records.stamped(F.create_map(F.lit("a"), F.lit(5), F.lit("b"), F.lit(50)).cast("map<string,bigint>"), ["a", "b", "c"], F.lit(9).cast("bigint"))
    assert one(spark, stamped) == {"a": 9, "b": 50, "c": 9}
