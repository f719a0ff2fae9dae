"""Listings, facets, duplicates and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalox.functions.dates import month_group
from catalox.functions.ordering import place_key
from catalox.operators import checks, facets, index, listing, search
from catalox.plans.registry import ASSETS, PLACES, SNAPSHOTS, query
from catalox.sources.files import hashed
from catalox.sources.tables import assets, load, places, snapshots


def _by_date(spark, sf_dir, *columns):
    a = assets(spark, sf_dir).select("asset_id", "photo_date", *columns)
    return index.numbered(a, [F.col("photo_date"), F.col("asset_id")])


_POSITIONS = f"WITH {ASSETS}, n AS (SELECT *, row_number() OVER (ORDER BY photo_date, asset_id) - 1 AS position FROM assets)"


@query(_POSITIONS + """, r AS (SELECT *, position - row_number() OVER (PARTITION BY content_type ORDER BY position) AS run FROM n)
    SELECT content_type, min(position) AS "from", max(position) AS "to", count(*) AS n FROM r GROUP BY content_type, run""")
def islands(spark, sf_dir):
    return listing.islands(_by_date(spark, sf_dir, "content_type"), ["content_type"])


@query(_POSITIONS + """, g AS (SELECT position, strftime(photo_date, '%B') || ' ' || strftime(photo_date, '%Y') AS heading FROM n)
    SELECT heading, min(position) AS "from", max(position) AS "to", count(*) AS n FROM g GROUP BY heading""")
def group_headings(spark, sf_dir):
    heading = F.array_join(F.reverse(month_group(F.col("photo_date"))), " ")
    return listing.islands(_by_date(spark, sf_dir).withColumn("heading", heading), ["heading"])


@query(_POSITIONS + " SELECT asset_id, lag(asset_id) OVER (ORDER BY position) AS previous, lead(asset_id) OVER (ORDER BY position) AS next FROM n")
def lag_lead(spark, sf_dir):
    return listing.neighbours(_by_date(spark, sf_dir), "asset_id", block=1000).select("asset_id", "previous", "next")


@query(_POSITIONS + """ SELECT asset_id, position FROM n
    WHERE position BETWEEN (SELECT min(position) FROM n WHERE asset_id IN (40, 900)) AND (SELECT max(position) FROM n WHERE asset_id IN (40, 900))""")
def select_range(spark, sf_dir):
    return listing.select_range(_by_date(spark, sf_dir), "asset_id", 900, 40).select("asset_id", "position")


@query("SELECT user_id, max(ts)::VARCHAR AS last_seen FROM events GROUP BY 1 ORDER BY max(ts) DESC, user_id LIMIT 10".replace("max(ts)::VARCHAR", "strftime(max(ts), '%Y-%m-%d %H:%M:%S')"))
def recent_unique(spark, sf_dir):
    return listing.recent_unique(load(spark, sf_dir, "events"), "user_id", "ts", 10).select("user_id", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


@query(f"""WITH {ASSETS}, r AS (SELECT content_type, asset_id, row_number() OVER (PARTITION BY content_type ORDER BY size DESC, asset_id) AS rank FROM assets)
    SELECT content_type, asset_id, rank FROM r WHERE rank <= 10""")
def top_n_per_group(spark, sf_dir):
    return listing.top_n_per_group(assets(spark, sf_dir), ["content_type"], [F.desc("size"), F.col("asset_id")], 10).select("content_type", "asset_id", "rank")


@query(f"""WITH RECURSIVE {ASSETS},
    t AS (SELECT asset_id, strftime(photo_date, '%B %Y') AS "group", 640 + size % 1280 AS w, 480 + size % 720 AS h, photo_date FROM assets),
    i AS (SELECT asset_id, "group", w::DOUBLE / h AS a, row_number() OVER (PARTITION BY "group" ORDER BY photo_date, asset_id) AS k FROM t),
    r AS (
        SELECT "group", k, asset_id, a, 0 AS row, 200 * a + 4 AS used FROM i WHERE k = 1
        UNION ALL
        SELECT i."group", i.k, i.asset_id, i.a, CASE WHEN r.used + 200 * i.a > 1200 THEN r.row + 1 ELSE r.row END,
               CASE WHEN r.used + 200 * i.a > 1200 THEN 200 * i.a + 4 ELSE r.used + 200 * i.a + 4 END
        FROM r JOIN i ON i."group" = r."group" AND i.k = r.k + 1),
    s AS (SELECT *, sum(a) OVER (PARTITION BY "group", row) AS wide, count(*) OVER (PARTITION BY "group", row) AS n, max(row) OVER (PARTITION BY "group") AS last FROM r),
    x AS (SELECT *, CASE WHEN row = last THEN 200.0::DOUBLE ELSE (1200 - 4 * (n - 1)) / wide END AS tall FROM s)
    SELECT asset_id, "group", row::INT AS row, round(tall, 6) AS row_height, round(tall * a, 6) AS thumb_width FROM x""")
def row_packing(spark, sf_dir):
    a = assets(spark, sf_dir).withColumn("heading", F.array_join(F.reverse(month_group(F.col("photo_date"))), " "))
    shaped = a.withColumns({"width": F.lit(640) + F.col("size") % 1280, "height": F.lit(480) + F.col("size") % 720})
    packed = listing.row_packing(shaped, "heading", [F.col("photo_date"), F.col("asset_id")], "asset_id")
    return packed.select("asset_id", "group", "row", F.round("row_height", 6).alias("row_height"), F.round("thumb_width", 6).alias("thumb_width"))


@query(f"WITH {ASSETS} SELECT year(photo_date)::INT AS year, count(*) AS n FROM assets GROUP BY 1")
def facet_years(spark, sf_dir):
    return facets.years(assets(spark, sf_dir), [F.col("photo_date"), F.col("photo_date") + F.expr("interval 0 days")])


@query(f"""WITH {PLACES}, p AS (SELECT item_id, string_split(location, ', ') AS l FROM places WHERE location IS NOT NULL)
    SELECT place, count(*) AS n FROM (SELECT item_id, unnest(list_distinct([l[-1], l[-2]])) AS place FROM p) GROUP BY place""")
def facet_places(spark, sf_dir):
    return facets.place_names(places(spark, sf_dir), F.col("location"))


@query(f"""WITH {PLACES} SELECT floor(lat / 11.25::DOUBLE)::BIGINT AS cell_y, floor(lng / 11.25::DOUBLE)::BIGINT AS cell_x, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng, count(*) AS n
    FROM places WHERE lat IS NOT NULL GROUP BY 1, 2""")
def geo_clusters(spark, sf_dir):
    c = facets.clusters(places(spark, sf_dir), "lat", "lng", 4)
    return c.withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


@query(f"WITH {PLACES} SELECT item_id FROM places WHERE lat BETWEEN -10 AND 45.5 AND lng BETWEEN -30 AND 60")
def geo_bounds(spark, sf_dir):
    return places(spark, sf_dir).filter(search.geo_box(F.col("lat"), F.col("lng"), -10, -30, 45.5, 60)).select("item_id")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def topk_values(spark, sf_dir):
    return facets.top_values(load(spark, sf_dir, "documents"), "source", 5)


@query(f"WITH {ASSETS} SELECT content_type, max(size) AS size, arg_max(asset_id, size * 100000000 - asset_id) AS asset_id FROM assets GROUP BY content_type")
def argmax(spark, sf_dir):
    best = F.max(F.struct("size", (-F.col("asset_id")).alias("m"))).alias("b")
    return assets(spark, sf_dir).groupBy("content_type").agg(best).select("content_type", "b.size", (-F.col("b.m")).alias("asset_id"))


@query(f"WITH {SNAPSHOTS} SELECT coalesce(l.key, o.key) AS key, CASE WHEN o.key IS NULL THEN 'removed' WHEN l.key IS NULL THEN 'new' WHEN l.hash <> o.hash THEN 'modified' ELSE 'unmodified' END AS status FROM local_ l FULL JOIN origin o ON l.key = o.key")
def verify_status(spark, sf_dir):
    local, origin = (d.select("key", F.col("price").alias("size"), "hash") for d in snapshots(spark, sf_dir))
    return checks.verify(local, origin, "key", full=True)


@query(f"""WITH {SNAPSHOTS}, s AS (SELECT CASE WHEN o.key IS NULL THEN 'removed' WHEN l.key IS NULL THEN 'new' ELSE 'unmodified' END AS status FROM local_ l FULL JOIN origin o ON l.key = o.key)
    SELECT status, count(*) AS n FROM s GROUP BY status""")
def verify_summary(spark, sf_dir):
    # Without a full check a hash counts only where the size differs, and prices are the same.
    local, origin = (d.select("key", F.col("price").alias("size"), "hash") for d in snapshots(spark, sf_dir))
    return checks.status_counts(checks.verify(local, origin, "key"))


@query(f"WITH {SNAPSHOTS} SELECT o.key, CASE WHEN l.key IS NULL THEN 'insert' WHEN l.hash <> o.hash THEN 'fix' ELSE 'keep' END AS action FROM origin o LEFT JOIN local_ l ON l.key = o.key")
def repair_records(spark, sf_dir):
    local, origin = snapshots(spark, sf_dir)
    return checks.repair(origin.select("key", "hash"), local, "key").select("key", "action")


@query(f"WITH {SNAPSHOTS} SELECT key FROM origin WHERE key NOT IN (SELECT key FROM local_)")
def anti_join(spark, sf_dir):
    local, origin = snapshots(spark, sf_dir)
    return checks.orphans(origin, local, "key").select("key")


@query(f"WITH {SNAPSHOTS} SELECT key FROM origin WHERE hash IN (SELECT hash FROM local_)")
def semi_join(spark, sf_dir):
    local, origin = snapshots(spark, sf_dir)
    return origin.join(local.select("hash"), "hash", "left_semi").select("key")


@query(f"WITH {SNAPSHOTS} SELECT DISTINCT key FROM local_ INTERSECT SELECT key FROM origin")
def intersect_keys(spark, sf_dir):
    local, origin = snapshots(spark, sf_dir)
    return local.select("key").intersect(origin.select("key"))


@query("""SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'known' ELSE coalesce(text, '') END) AS hash FROM documents""")
def hash_cache_join(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    when = F.lit("2024-01-01").cast("timestamp")
    files = d.select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("length"), when.alias("modified"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    known = d.join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    cache = known.select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("length"), when.alias("modified"), F.sha2(F.lit("known"), 256).alias("hash"))
    return hashed(files, cache).select("path", "hash")


@query(f"WITH {ASSETS} SELECT count(*) AS records, sum(size)::BIGINT AS total_size, count(DISTINCT hash) AS contents, floor(sum(size) / count(*))::BIGINT AS average_size FROM assets")
def db_summary(spark, sf_dir):
    return facets.summary(assets(spark, sf_dir), "size", "hash")


@query(f"""WITH {ASSETS} SELECT count(*) FILTER (content_type = 'image/jpeg') AS added, count(*) FILTER (content_type = 'image/png') AS skipped,
    count(*) FILTER (content_type = 'video/mp4') AS failed, count(*) AS processed, sum(size) FILTER (content_type = 'image/jpeg')::BIGINT AS total_size,
    floor(sum(size) FILTER (content_type = 'image/jpeg') / count(*) FILTER (content_type = 'image/jpeg'))::BIGINT AS average_size FROM assets""")
def check_summary(spark, sf_dir):
    status = F.when(F.col("content_type") == "image/jpeg", "success").when(F.col("content_type") == "image/png", "skipped").otherwise("failure")
    return checks.import_summary(assets(spark, sf_dir).withColumn("status", status), "status", "size")


@query(f"WITH {ASSETS} SELECT hash, count(*) AS n, min(asset_id) AS first_key FROM assets GROUP BY hash HAVING count(*) > 1")
def find_collisions(spark, sf_dir):
    return facets.collisions(assets(spark, sf_dir), "hash", "asset_id")


_COPIES = "c AS (SELECT *, count(*) OVER (PARTITION BY sha256(coalesce(text, ''))) AS records FROM documents)"


@query(f"WITH {_COPIES} SELECT sha256(coalesce(text, '')) AS hash, n_chars, count(*) AS n FROM c WHERE records > 1 GROUP BY 1, 2")
def find_duplicates(spark, sf_dir):
    return facets.duplicates(_hashed_documents(spark, sf_dir), "hash", "n_chars")


def _hashed_documents(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


@query(f"""WITH {ASSETS}, g AS (SELECT hash, count(*) AS n, count(DISTINCT size) AS sizes FROM assets GROUP BY hash HAVING count(*) > 1)
    SELECT count(*) FILTER (sizes = 1) AS true_duplicates, count(*) FILTER (sizes > 1) AS collisions FROM g""")
def duplicate_verdict(spark, sf_dir):
    return facets.duplicate_verdict(assets(spark, sf_dir), "hash", "size")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS r FROM documents) WHERE r > 1")
def dedup_keep_first(spark, sf_dir):
    return facets.later_copies(_hashed_documents(spark, sf_dir), "hash", "doc_id").select("doc_id")


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark, sf_dir):
    return checks.status_counts(load(spark, sf_dir, "events").select(F.col("event_type").alias("status")))


@query(_POSITIONS + """, m AS (SELECT strftime(photo_date, '%Y') AS year, strftime(photo_date, '%B') AS month, min(position) AS first_at FROM n GROUP BY 1, 2)
    SELECT year, string_agg(month, ',' ORDER BY first_at) AS entries FROM m GROUP BY year""")
def nav_tree(spark, sf_dir):
    g = _by_date(spark, sf_dir).select("position", month_group(F.col("photo_date")).alias("g")).select("position", F.col("g")[0].alias("year"), F.col("g")[1].alias("month"))
    return facets.navigation(g, "year", "month", "position").select("year", F.array_join("entries", ",").alias("entries"))


@query(f"""WITH {PLACES} SELECT CASE WHEN location IS NULL THEN 'Location unknown' ELSE location END AS heading, count(*) AS n FROM places GROUP BY 1""")
def place_headings(spark, sf_dir):
    group = F.coalesce(place_key(F.col("location")), F.array(F.lit("Location unknown")))
    return places(spark, sf_dir).select(F.array_join(F.reverse(group), ", ").alias("heading")).groupBy("heading").agg(F.count("*").alias("n"))
