"""Scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalox.functions import dates, media, ordering, records, text
from catalox.functions import places as geo
from catalox.operators import checks, search
from catalox.plans.registry import ASSETS, PLACES, query
from catalox.sources.tables import assets, load, places


@query("SELECT p_partkey, levenshtein(p_name, lower(p_type)) AS distance FROM part")
def levenshtein_pairs(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", F.lower("p_type")).alias("distance"))


@query("""SELECT p_partkey, p_name FROM part WHERE levenshtein('rod widget', p_name) BETWEEN 1 AND 3""")
def fuzzy_match(spark, sf_dir):
    return load(spark, sf_dir, "part").filter(text.fuzzy_match(F.lit("Rod Widget"), F.col("p_name"))).select("p_partkey", "p_name")


def _degrees_sql(c: str, positive: str, negative: str) -> str:
    t = f"round(abs({c}) * 60000)::BIGINT"
    return f"({t} // 60000) || '° ' || ({t} % 60000 // 1000) || '.' || lpad(({t} % 1000)::VARCHAR, 3, '0') || ''' ' || CASE WHEN {c} >= 0 THEN '{positive}' ELSE '{negative}' END"


@query(f"WITH {PLACES} SELECT item_id, {_degrees_sql('lat', 'N', 'S')} || ' ' || {_degrees_sql('lng', 'E', 'W')} AS shown FROM places")
def geo_format(spark, sf_dir):
    return places(spark, sf_dir).select("item_id", geo.coordinates(F.col("lat"), F.col("lng")).alias("shown"))


@query(f"""WITH {ASSETS} SELECT asset_id, CASE WHEN size < 1024 THEN size || ' B'
        ELSE regexp_replace(printf('%.2f', round(size / 1024.0::DOUBLE, 2)), '\\.?0+$', '') || ' KB' END AS shown FROM assets""")
def file_size_fmt(spark, sf_dir):
    return assets(spark, sf_dir).select("asset_id", text.file_size(F.col("size")).alias("shown"))


@query("SELECT p_partkey, p_brand || ',' || p_type AS labels FROM part")
def path_labels(spark, sf_dir):
    path = F.concat_ws("/", F.lit(""), "p_brand", "p_type", "p_name")
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(text.folder_labels(path), ",").alias("labels"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def nested_get(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", text.nested_get(F.col("props"), "k", "bigint").alias("k"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS taken FROM events")
def exif_dates(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("original"))
    taken = dates.exif_date(F.lit("no date"), F.col("original"), F.lit(None).cast("string"))
    return e.select("event_id", F.date_format(taken, "yyyy-MM-dd HH:mm:ss").alias("taken"))


@query("SELECT DISTINCT year(o_orderdate)::INT AS year, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start, year(o_orderdate) || '-01-01' AS year_start FROM orders")
def build_dates(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return o.select("year", day(dates.built_date(F.col("year"), F.col("month"))).alias("month_start"), day(dates.built_date(F.col("year"))).alias("year_start"))


@query("""SELECT event_id, lpad((32503680000000 - epoch_us(ts) // 1000)::VARCHAR, 20, '0') || '-' || lpad((user_id % 1000)::VARCHAR, 3, '0') AS key FROM events""")
def reverse_time_keys(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select("event_id", ordering.reverse_time_key(F.col("ts").cast("timestamp"), F.col("user_id") % 1000).alias("key"))


@query(f"WITH {PLACES} SELECT item_id, round(lat, 6) AS lat, lat BETWEEN -90 AND 90 AS ok FROM places WHERE lat IS NOT NULL")
def degrees_to_decimal(spark, sf_dir):
    p = places(spark, sf_dir).filter("lat is not null").withColumn("a", F.abs("lat"))
    d, m = F.floor("a"), F.floor((F.col("a") * 60) % 60)
    value = geo.degrees(d, m, F.col("a") * 3600 - d * 3600 - m * 60, F.when(F.col("lat") < 0, "S").otherwise("N"))
    return p.select("item_id", F.round(value, 6).alias("lat"), geo.in_range(value, F.lit(0.0)).alias("ok"))


@query("SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS plain FROM orders")
def uuid_forms(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("m"))
    there = records.uuid_bytes(F.upper(records.uuid_text(F.unhex("m"))))
    return o.select("o_orderkey", F.lower(F.hex(there)).alias("plain"))


_SHAPES = "shapes AS (SELECT p_partkey, p_size * 40 AS w, (p_partkey % 50 + 1) * 30 AS h, p_size % 9 AS o FROM part)"


@query(f"""WITH {_SHAPES}, t AS (SELECT p_partkey, CASE WHEN o IN (5, 6, 7, 8) THEN h ELSE w END AS w, CASE WHEN o IN (5, 6, 7, 8) THEN w ELSE h END AS h, o FROM shapes)
    SELECT p_partkey, CASE WHEN w > h THEN floor(w::DOUBLE / h * 200)::INT ELSE 200 END AS width, CASE WHEN w > h THEN 200 ELSE floor(h::DOUBLE / w * 200)::INT END AS height,
           CASE WHEN o IN (6, 7) THEN 90 WHEN o IN (3, 4) THEN 180 WHEN o IN (5, 8) THEN 270 WHEN o = 2 THEN 0 END AS rotate FROM t""")
def image_sizes(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40).alias("w"), ((F.col("p_partkey") % 50 + 1) * 30).alias("h"), (F.col("p_size") % 9).alias("o"))
    shown = p.withColumn("s", media.shown_size(F.col("w"), F.col("h"), F.col("o")))
    small = shown.withColumn("r", media.reduced_size(F.col("s.width"), F.col("s.height"), 200))
    return small.select("p_partkey", F.col("r.width").cast("int").alias("width"), F.col("r.height").cast("int").alias("height"), media.transformation(F.col("o"))["rotate"].alias("rotate"))


@query("SELECT p_partkey FROM part WHERE p_size <= 5 OR p_type = 'PROMO'")
def invalid_media(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.greatest(F.col("p_size") - 5, F.lit(0)).alias("size"), F.when(F.col("p_type") != "PROMO", 640).alias("width"), F.lit(480).alias("height"))
    return checks.invalid_media(p, "size", "width", "height").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_type IN ('SMALL', 'MEDIUM')")
def partial_replica(spark, sf_dir):
    folder = F.when(F.col("p_type") == "SMALL", "thumb/").when(F.col("p_type") == "MEDIUM", "").otherwise("asset/")
    return load(spark, sf_dir, "part").filter(search.in_partial_replica(F.concat(folder, "p_name"))).select("p_partkey")


@query("SELECT c_custkey, c_name FROM customer")
def encrypt_round_trip(spark, sf_dir):
    key = F.unhex(F.sha2(F.lit("a key for tests"), 256))
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return media.decrypted(media.encrypted(c, key, "c_name"), key, "c_name")


@query("SELECT event_id, CASE WHEN event_id % 4 > 0 THEN strftime(to_timestamp(1500000000 + event_id * 3600), '%Y-%m-%d %H:%M') END AS taken FROM events")
def sidecar_dates(spark, sf_dir):
    """Times in Unix seconds of sidecar files; some files tell none."""
    seconds = (F.lit(1_500_000_000) + F.col("event_id") * 3600).cast("string")
    json = F.when(F.col("event_id") % 4 == 0, F.lit('{"title": "x"}')).otherwise(F.format_string('{"photoTakenTime": {"timestamp": "%s"}}', seconds))
    return load(spark, sf_dir, "events").select("event_id", F.date_format(dates.sidecar_date(json), "yyyy-MM-dd HH:mm").alias("taken"))


@query("SELECT doc_id, base64(encode(substr(text, 1, 100))) AS coded, substr(text, 1, 100) AS plain FROM documents")
def base64_round_trip(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", text.base64_of(F.encode(F.substring("text", 1, 100), "UTF-8")).alias("coded"))
    return d.withColumn("plain", F.decode(F.unbase64("coded"), "UTF-8"))


@query("SELECT event_id, value * 2 AS inner_value, event_type AS kept, 'added' AS fresh FROM events")
def nested_set(spark, sf_dir):
    """Fields of nested records set by dotted path; the others stay."""
    e = load(spark, sf_dir, "events").select("event_id", F.struct(F.struct(F.col("value").alias("x"), F.col("event_type").alias("y")).alias("inner")).alias("r"))
    done = e.withColumn("r", F.col("r").withField("inner.x", F.col("r.inner.x") * 2).withField("inner.z", F.lit("added")))
    return done.select("event_id", F.col("r.inner.x").alias("inner_value"), F.col("r.inner.y").alias("kept"), F.col("r.inner.z").alias("fresh"))
