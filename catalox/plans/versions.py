"""Digests, differences, merging and edits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalox.functions.records import record_hash as hash_of
from catalox.functions.records import shard_of
from catalox.functions.text import pulled, pushed
from catalox.operators import differences, digests, edits, merging
from catalox.plans.registry import ASSETS, ORACLE_SQL, SNAPSHOTS, query
from catalox.sources import store
from catalox.sources.assets import copy_assets, move_assets, write_assets
from catalox.sources.scratch import tables_dir
from catalox.sources.store import read_version, write_version
from catalox.sources.tables import as_assets, assets, load, snapshots
from catalox.streaming.ingest import change_stream, import_stream, view_stream

FIELDS = ["status", "priority", "price"]


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query(f"""WITH {SNAPSHOTS} SELECT key, sha256('{{"key":' || key || ',"price":' || price || ',"priority":"' || priority || '","status":"' || status || '"}}') AS hash FROM origin""")
def record_hash(spark, sf_dir):
    return snapshots(spark, sf_dir)[1].select("key", hash_of("status", "key", "priority", "price").alias("hash"))


@query(f"""WITH RECURSIVE {SNAPSHOTS},
    leaves AS (SELECT ('0x' || substr(md5(key::VARCHAR), 1, 8))::BIGINT % 100 AS shard, key, hash FROM local_),
    lv AS (
        SELECT shard, 0 AS h, row_number() OVER (PARTITION BY shard ORDER BY key) - 1 AS i, hash AS d FROM leaves
        UNION ALL
        SELECT shard, h + 1, i // 2, sha256(unhex(d) || unhex(nd))
        FROM (SELECT shard, h, i, d, lead(d) OVER (PARTITION BY shard ORDER BY i) AS nd FROM lv) WHERE i % 2 = 0 AND nd IS NOT NULL),
    peaks AS (SELECT shard, h, d FROM (SELECT *, max(i) OVER (PARTITION BY shard, h) AS last FROM lv) WHERE i = last AND i % 2 = 0)
    SELECT shard, (SELECT count(*) FROM leaves l WHERE l.shard = p.shard) AS n,
           list_reduce(list(d ORDER BY h DESC), lambda a, b: sha256(unhex(a) || unhex(b))) AS root
    FROM peaks p GROUP BY shard""")
def merkle_root(spark, sf_dir):
    local = snapshots(spark, sf_dir)[0].withColumn("shard", shard_of(F.col("key")))
    return digests.shard_roots(local, "shard", "key", "hash")


def _tree_sql(leaves: str, name: str) -> str:
    """CTEs that fold ``leaves`` (i, d), numbered from 0, to ``name`` (root): pairs join level by level and what stays alone joins from the left at the end."""
    return f"""{name}_lv AS (
        SELECT 0 AS h, i, d FROM {leaves}
        UNION ALL
        SELECT h + 1, i // 2, sha256(unhex(d) || unhex(nd)) FROM (SELECT h, i, d, lead(d) OVER (ORDER BY i) AS nd FROM {name}_lv) WHERE i % 2 = 0 AND nd IS NOT NULL),
    {name}_peaks AS (SELECT h, d FROM (SELECT *, max(i) OVER (PARTITION BY h) AS last FROM {name}_lv) WHERE i = last AND i % 2 = 0),
    {name} AS (SELECT list_reduce(list(d ORDER BY h DESC), lambda a, b: sha256(unhex(a) || unhex(b))) AS root FROM {name}_peaks)"""


@query(f"""WITH RECURSIVE {SNAPSHOTS},
    all_leaves AS (SELECT row_number() OVER (ORDER BY key) - 1 AS i, hash AS d FROM local_),
    {_tree_sql("all_leaves", "whole")},
    shard_leaves AS (SELECT row_number() OVER (ORDER BY shard) - 1 AS i, root AS d FROM ({ORACLE_SQL["merkle_root"].replace(SNAPSHOTS + ",", "")})),
    {_tree_sql("shard_leaves", "sharded")}
    SELECT whole.root, sharded.root AS collection_root FROM whole, sharded""")
def merkle_tree_root(spark, sf_dir):
    """One digest over all records in order of key, and the digest of the collection's shards."""
    local = snapshots(spark, sf_dir)[0].withColumn("shard", shard_of(F.col("key")))
    whole = digests.merkle_root(local, [F.col("key")], "hash")
    sharded = digests.collection_root(digests.shard_roots(local, "shard", "key", "hash"))
    return spark.createDataFrame([(whole, sharded)], "root string, collection_root string")


@query(f"""WITH RECURSIVE {SNAPSHOTS},
    kept_leaves AS (SELECT row_number() OVER (ORDER BY name) - 1 AS i, hash AS d FROM (SELECT priority || '/' || key AS name, hash FROM local_ WHERE priority NOT IN ('1-URGENT', '5-LOW'))),
    {_tree_sql("kept_leaves", "kept")}
    SELECT (SELECT count(*) FROM kept_leaves) AS n, kept.root FROM kept""")
def rebuild_without(spark, sf_dir):
    """The tree over all names but those below two folders."""
    named = snapshots(spark, sf_dir)[0].select(F.concat_ws("/", "priority", F.col("key").cast("string")).alias("name"), "hash")
    kept = differences.without(named, "name", ["1-URGENT", "5-LOW"])
    return spark.createDataFrame([(kept.count(), digests.merkle_root(kept, [F.col("name")], "hash"))], "n long, root string")


def _page_files(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    return p.select(F.concat(F.lit("asset/"), (F.col("page_id") % 7).cast("string"), F.lit("/"), F.col("page_id").cast("string")).alias("name"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))


_FILES_SQL = "SELECT 'asset/' || (page_id % 7) || '/' || page_id AS name, octet_length(encode(coalesce(html, ''))) AS length, sha256(coalesce(html, '')) AS hash FROM pages"


@query(_FILES_SQL)
def write_verified(spark, sf_dir):
    """Pages as stored files, each read again and compared."""
    return write_assets(_page_files(spark, sf_dir), _folder(spark, "files"))


@query(f"SELECT * FROM ({_FILES_SQL}) WHERE name LIKE 'asset/3/%'")
def replicate_files(spark, sf_dir):
    """A verified copy of the files that a filter names, then moved to another folder."""
    at, copy, last = (_folder(spark, x) for x in ("files", "copy", "moved"))
    written = write_assets(_page_files(spark, sf_dir), at)
    copy_assets(spark, at, copy, written.filter("name like 'asset/3/%'").select("name"))
    return move_assets(spark, copy, last)


@query("SELECT * FROM (VALUES ('metadata'), ('places')) t(name)")
def list_collections(spark, sf_dir):
    """Collections of a database after one of three was dropped."""
    at = _folder(spark, "database")
    for name in ("metadata", "places", "gone"):
        write_version(load(spark, sf_dir, "nation"), f"{at}/{name}", 0, "n_nationkey", 4)
    store.drop(spark, f"{at}/gone")
    return spark.createDataFrame([(n,) for n in store.collections(spark, at)], "name string")


@query(f"WITH {ASSETS} SELECT hash, count(*) AS n, min(asset_id) AS first_id FROM assets GROUP BY hash HAVING count(*) > 1")
def collisions_json(spark, sf_dir):
    """Repeated contents as a JSON report, read again."""
    at = _folder(spark, "report")
    found = assets(spark, sf_dir).groupBy("hash").agg(F.count("*").alias("n"), F.min("asset_id").alias("first_id")).filter("n > 1")
    found.write.json(at)
    return spark.read.schema(found.schema).json(at)


@query(f"WITH {ASSETS} SELECT asset_id, file_name FROM assets WHERE contains(file_name, '7') ORDER BY photo_date DESC, asset_id LIMIT 40")
def stream_view(spark, sf_dir):
    """A searched and sorted view that grows by batches: each batch is sorted alone, and the first entries come from all of them."""
    at = _folder(spark, "view")
    order = [F.desc("photo_date"), F.col("asset_id")]
    records = as_assets(_stream(spark, sf_dir, "orders")).filter(F.col("file_name").contains("7"))
    view_stream(records, at, f"{at}-state", order).awaitTermination()
    return spark.read.parquet(at).orderBy(*order).limit(40).select("asset_id", "file_name")


def _sides(spark, sf_dir):
    """Two collections of names and content hashes, with repeated contents."""
    o = assets(spark, sf_dir)
    return o.filter("content_type <> 'video/mp4'").select("file_name", "hash"), o.filter("size > 100000").select("file_name", "hash")


_SIDES = f"{ASSETS}, a AS (SELECT file_name, hash FROM assets WHERE content_type <> 'video/mp4'), b AS (SELECT file_name, hash FROM assets WHERE size > 100000)"


@query(f"""WITH {_SIDES},
    x AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY file_name) AS r FROM a),
    y AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY file_name) AS r FROM b)
    SELECT 'a' AS side, file_name, hash FROM x WHERE (hash, r) NOT IN (SELECT hash, r FROM y)
    UNION ALL SELECT 'b', file_name, hash FROM y WHERE (hash, r) NOT IN (SELECT hash, r FROM x)""")
def except_all_both(spark, sf_dir):
    return differences.unmatched(*_sides(spark, sf_dir), "file_name", "hash")


_CHANGED = "FROM local_ l FULL JOIN origin o ON l.key = o.key WHERE l.key IS NULL OR o.key IS NULL OR l.hash <> o.hash"


@query(f"WITH {SNAPSHOTS} SELECT coalesce(l.key, o.key) AS key, CASE WHEN o.key IS NULL THEN 'only_a' WHEN l.key IS NULL THEN 'only_b' ELSE 'modified' END AS status {_CHANGED}")
def compare_snapshots(spark, sf_dir):
    return differences.by_name(*snapshots(spark, sf_dir), "key", "hash")


@query(f"""WITH {_SIDES},
    x AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY file_name) AS r FROM a),
    y AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY file_name) AS r FROM b),
    ua AS (SELECT file_name FROM x WHERE (hash, r) NOT IN (SELECT hash, r FROM y)),
    ub AS (SELECT file_name FROM y WHERE (hash, r) NOT IN (SELECT hash, r FROM x))
    SELECT coalesce(ua.file_name, ub.file_name) AS file_name, CASE WHEN ub.file_name IS NULL THEN 'only_a' WHEN ua.file_name IS NULL THEN 'only_b' ELSE 'modified' END AS status
    FROM ua FULL JOIN ub ON ua.file_name = ub.file_name""")
def compare_contents(spark, sf_dir):
    return differences.by_content(*_sides(spark, sf_dir), "file_name", "hash")


@query(f"WITH {SNAPSHOTS} SELECT coalesce(l.key, o.key) AS key, CASE WHEN l.key IS NULL THEN 'prune' ELSE 'copy' END AS action {_CHANGED}")
def replicate_plan(spark, sf_dir):
    return differences.replicate_plan(*snapshots(spark, sf_dir), "key", "hash")


@query(f"WITH {SNAPSHOTS} SELECT o.key, o.status, o.ts FROM origin o LEFT JOIN local_ l ON l.key = o.key WHERE l.key IS NULL OR l.hash <> o.hash")
def sync_diff(spark, sf_dir):
    local, origin = snapshots(spark, sf_dir)
    return merging.changes(local, origin, "key", "hash").select("key", "status", "ts")


@query(f"""WITH {SNAPSHOTS},
    dead AS (SELECT key FROM base WHERE priority = '3-MEDIUM'),
    s AS (SELECT * FROM origin WHERE key IN (SELECT key FROM local_) OR key NOT IN (SELECT key FROM dead))
    SELECT coalesce(s.key, l.key) AS key,
           CASE WHEN s.key IS NULL THEN l.status WHEN l.key IS NULL THEN s.status WHEN s.ts > l.ts THEN s.status ELSE l.status END AS status,
           coalesce(l.priority, s.priority) AS priority, coalesce(l.price, s.price) AS price, least(s.ts, l.ts) AS ts
    FROM s FULL JOIN local_ l ON s.key = l.key""")
def sync_merge(spark, sf_dir):
    local, origin = snapshots(spark, sf_dir)
    dead = origin.filter("priority = '3-MEDIUM'").select("key")
    return merging.merge(origin, local, "key", FIELDS, tombstones=dead)


def _by_field(df, late):
    """Records as maps: the price is stamped where ``late`` holds, the priority is deleted for high ones of the origin."""
    names = F.array(F.lit("status"), F.lit("priority"), F.lit("price"))
    held = F.map_filter(F.map_from_arrays(names, F.array("status", "priority", F.col("price").cast("string"))), lambda k, v: (k != "priority") | ~F.col("gone"))
    times = F.map_filter(F.map_from_arrays(names, F.array(F.lit(None).cast("long"), F.when(F.col("gone"), F.col("ts") + 500), F.when(late, F.col("ts") + 90))), lambda k, v: v.isNotNull())
    return df.select("key", held.alias("fields"), times.alias("times"), "ts")


def _field_sides(spark, sf_dir):
    local, origin = snapshots(spark, sf_dir)
    return (_by_field(local.withColumn("gone", F.lit(False)), F.col("key") % 3 == 0),
            _by_field(origin.withColumn("gone", F.col("priority") == "2-HIGH").withColumn("price", F.col("price") + 1), F.col("key") % 2 == 0))


def _flat(df):
    get = lambda m, n: F.try_element_at(m, F.lit(n))
    return df.select("key", get("fields", "status").alias("status"), get("fields", "priority").alias("priority"), get("fields", "price").cast("long").alias("price"),
                     get("times", "status").alias("status_ts"), get("times", "priority").alias("priority_ts"), get("times", "price").alias("price_ts"), "ts")


_FIELDS_SQL = f"""{SNAPSHOTS},
    l AS (SELECT key, status, priority, price, ts, NULL::BIGINT AS priority_at, CASE WHEN key % 3 = 0 THEN ts + 90 END AS price_at FROM local_),
    o AS (SELECT key, status, CASE WHEN priority <> '2-HIGH' THEN priority END AS priority, price + 1 AS price, ts,
                 CASE WHEN priority = '2-HIGH' THEN ts + 500 END AS priority_at, CASE WHEN key % 2 = 0 THEN ts + 90 END AS price_at FROM origin),
    both_ AS (SELECT l.key, least(l.ts, o.ts) AS ts,
                     CASE WHEN o.ts > l.ts THEN o.status ELSE l.status END AS status, greatest(o.ts, l.ts) AS status_t,
                     l.priority, l.ts AS priority_t,
                     CASE WHEN coalesce(o.price_at, o.ts) > coalesce(l.price_at, l.ts) THEN o.price ELSE l.price END AS price, greatest(coalesce(o.price_at, o.ts), coalesce(l.price_at, l.ts)) AS price_t,
                     CASE WHEN o.priority IS NOT NULL AND o.ts > l.ts THEN o.ts ELSE l.ts END AS kept_t
              FROM l JOIN o ON l.key = o.key)
    SELECT key, status, priority, price, CASE WHEN status_t > ts THEN status_t END AS status_ts, CASE WHEN kept_t > ts THEN kept_t END AS priority_ts,
           CASE WHEN price_t > ts THEN price_t END AS price_ts, ts FROM both_
    UNION ALL SELECT key, status, priority, price, NULL, priority_at, price_at, ts FROM l WHERE key NOT IN (SELECT key FROM o)
    UNION ALL SELECT key, status, priority, price, NULL, priority_at, price_at, ts FROM o WHERE key NOT IN (SELECT key FROM l)"""


@query(f"WITH {_FIELDS_SQL}")
def merge_fields(spark, sf_dir):
    """Each field by its own time; a field that one side has deleted comes from the other."""
    local, origin = _field_sides(spark, sf_dir)
    return _flat(merging.merge_fields(origin, local, "key"))


_PUSHED_SQL = _FIELDS_SQL.replace("CASE WHEN coalesce(o.price_at, o.ts) > coalesce(l.price_at, l.ts) THEN o.price ELSE l.price END", "CASE WHEN coalesce(l.price_at, l.ts) > coalesce(o.price_at, o.ts) THEN l.price ELSE o.price END")


@query(f"""SELECT 'local' AS side, count(*) AS n, sum(price)::BIGINT AS price, sum(ts)::BIGINT AS ts, count(priority) AS with_priority FROM (WITH {_FIELDS_SQL})
    UNION ALL SELECT 'origin', count(*), sum(price)::BIGINT, sum(ts)::BIGINT, count(priority) FROM (WITH {_PUSHED_SQL})""")
def sync_two_ways(spark, sf_dir):
    """A pull and a push: both sides end with the same records, but that of two values of one time each keeps its own."""
    local, origin = _field_sides(spark, sf_dir)
    sides = zip(("local", "origin"), merging.synced(local, origin, "key"), strict=True)
    one, two = (_flat(df).agg(F.count("*").alias("n"), F.sum("price").alias("price"), F.sum("ts").alias("ts"), F.count("priority").alias("with_priority")).select(F.lit(side).alias("side"), "*") for side, df in sides)
    return one.unionByName(two)


@query("""SELECT event_id,
           CASE WHEN event_id % 5 = 0 THEN 100 END AS whole_ts,
           CASE WHEN event_id % 5 = 0 THEN 50 WHEN event_id % 2 = 0 THEN 100 ELSE 50 END AS a_ts,
           CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 200 ELSE 100 END AS b_ts
    FROM events""")
def update_metadata(spark, sf_dir):
    """Times by path after an update at time 100: changed paths are stamped, but not below a later time nor in a later record."""
    e = load(spark, sf_dir, "events").select("event_id")
    later, whole = F.col("event_id") % 3 == 0, F.col("event_id") % 5 == 0
    texts = lambda *pairs: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for p in pairs for x in p])
    times = texts(("a.x", F.lit(50).cast("long")), ("b", F.when(later, F.lit(200).cast("long")).otherwise(F.lit(10).cast("long"))))
    before = texts(("a.x", "old"), ("b.y", "old"), ("c", "same"))
    change = F.when(F.col("event_id") % 2 == 0, F.lit("new")).otherwise(F.lit("old"))
    changes = texts(("a.x", change), ("b.y", F.lit(None).cast("string")), ("c", "same"))
    done = merging.update_times(F.when(whole, F.lit(100)).otherwise(F.lit(5)), times, before, changes, F.lit(100).cast("long"))
    return e.select("event_id", F.when(whole, F.lit(100)).alias("whole_ts"), F.try_element_at(done, F.lit("a.x")).alias("a_ts"), F.when(~whole, F.greatest(F.try_element_at(done, F.lit("b")), F.coalesce(F.try_element_at(done, F.lit("b.y")), F.lit(0)))).alias("b_ts"))


@query(f"WITH {SNAPSHOTS} SELECT key, status FROM local_ UNION ALL SELECT key, status FROM origin WHERE key NOT IN (SELECT key FROM local_)")
def insert_new(spark, sf_dir):
    local, origin = (d.select("key", "status") for d in snapshots(spark, sf_dir))
    return edits.insert_new(local, origin, "key")


@query(f"WITH {SNAPSHOTS} SELECT coalesce(l.key, o.key) AS key, coalesce(o.status, l.status) AS status, l.priority FROM local_ l FULL JOIN origin o ON l.key = o.key")
def update_patch(spark, sf_dir):
    local, origin = snapshots(spark, sf_dir)
    return edits.patch(local.select("key", "status", "priority"), origin.select("key", "status"), "key", ["status"], upsert=True)


@query(f"WITH {SNAPSHOTS} SELECT key, status, price FROM origin UNION ALL SELECT key, status, price FROM local_ WHERE key NOT IN (SELECT key FROM origin)")
def upsert_replace(spark, sf_dir):
    local, origin = (d.select("key", "status", "price") for d in snapshots(spark, sf_dir))
    return edits.replace(local, origin, "key")


@query(f"WITH {SNAPSHOTS} SELECT key FROM local_ WHERE key NOT IN (SELECT key FROM origin)")
def delete_keys(spark, sf_dir):
    local, origin = snapshots(spark, sf_dir)
    return edits.delete(local, origin, "key").select("key")


@query("""WITH e AS (SELECT user_id, event_id, event_type,
        max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS last_error FROM events),
    p AS (SELECT user_id, event_type, min(event_id) AS first_at FROM e
          WHERE event_type <> 'error' AND event_type <> 'view' AND NOT (event_type = 'click' AND last_error IS NOT NULL AND event_id < last_error)
          GROUP BY user_id, event_type),
    l AS (SELECT user_id, string_agg(event_type, ',' ORDER BY first_at) AS labels FROM p GROUP BY user_id),
    v AS (SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY user_id)
    SELECT u.user_id, v.value AS score, coalesce(l.labels, '') AS labels
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN v ON v.user_id = u.user_id LEFT JOIN l ON l.user_id = u.user_id""")
def apply_ops(spark, sf_dir):
    """Users as records: a view sets the score, an error pulls the label ``click`` and any other event pushes its type."""
    e = load(spark, sf_dir, "events")
    return _shown(edits.apply_ops(users_of(e), ops_of(e), "user_id", ["score"], "labels"))


@query("WITH a AS (" + ORACLE_SQL["apply_ops"].replace("WITH e AS", "WITH RECURSIVE e AS", 1) + ") SELECT 'db' || (user_id % 3) AS database_id, user_id, score, labels FROM a")
def apply_ops_routed(spark, sf_dir):
    """The same log over three databases: each entry names its own."""
    e = load(spark, sf_dir, "events")
    named = lambda df: df.withColumn("database_id", F.concat(F.lit("db"), (F.col("user_id") % 3).cast("string")))
    log = named(ops_of(e)).withColumn("collection", F.lit("metadata"))
    done = edits.apply_routed(named(users_of(e)), log, "database_id", "collection", "metadata", "user_id", ["score"], "labels")
    return done.select("database_id", "user_id", "score", F.coalesce(F.array_join("labels", ","), F.lit("")).alias("labels"))


def ops_of(e):
    view, error = F.col("event_type") == "view", F.col("event_type") == "error"
    return e.select(
        "user_id", F.col("event_id").alias("seq"), F.when(view, "set").when(error, "pull").otherwise("push").alias("kind"),
        F.when(view, "score").otherwise("labels").alias("field"), F.when(view, F.col("value").cast("string")).when(error, "click").otherwise(F.col("event_type")).alias("value"))


def users_of(e):
    return e.select("user_id").distinct().select("user_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("array<string>").alias("labels"))


def _shown(users):
    return users.select("user_id", "score", F.coalesce(F.array_join("labels", ","), F.lit("")).alias("labels"))


def _stream(spark, sf_dir, table):
    """One of the driver's tables as a stream of files."""
    return spark.readStream.schema(load(spark, sf_dir, table).schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def _folder(spark, name):
    return f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {ASSETS} SELECT hash, min(asset_id) AS asset_id FROM assets GROUP BY hash")
def stream_import(spark, sf_dir):
    """Imports as a stream: of equal contents the first comes in."""
    table = _folder(spark, "imports")
    import_stream(as_assets(_stream(spark, sf_dir, "orders")), table, f"{table}-state", order="asset_id").awaitTermination()
    return spark.read.parquet(table).select("hash", "asset_id")


@query(ORACLE_SQL["apply_ops"])
def stream_changes(spark, sf_dir):
    """The edits of ``apply_ops`` as a stream over a versioned store."""
    at = _folder(spark, "users")
    write_version(users_of(load(spark, sf_dir, "events")), at, 0, "user_id")
    change_stream(ops_of(_stream(spark, sf_dir, "events")), at, f"{at}-state", "user_id", ["score"], "labels").awaitTermination()
    return _shown(read_version(spark, at).drop("shard"))


def _labelled(spark, sf_dir):
    return assets(spark, sf_dir).select("asset_id", "labels", F.lit("O").alias("v"))


@query(f"WITH {ASSETS}, l AS (SELECT asset_id, coalesce(labels, []) AS l FROM assets) SELECT asset_id, array_to_string(CASE WHEN list_contains(l, 'O') THEN l ELSE list_append(l, 'O') END, ',') AS labels FROM l")
def array_push(spark, sf_dir):
    return _labelled(spark, sf_dir).select("asset_id", F.array_join(pushed(F.col("labels"), F.lit("O")), ",").alias("labels"))


@query(f"WITH {ASSETS} SELECT asset_id, array_to_string(list_filter(labels, lambda x: x <> 'O'), ',') AS labels FROM assets")
def array_pull(spark, sf_dir):
    return _labelled(spark, sf_dir).select("asset_id", F.array_join(pulled(F.col("labels"), F.lit("O")), ",").alias("labels"))


@query(f"WITH {ASSETS}, l AS (SELECT asset_id, coalesce(labels, []) AS l FROM assets) SELECT asset_id, array_to_string(list_concat(l, list_filter(['O', 'new'], lambda x: NOT list_contains(l, x))), ',') AS labels FROM l")
def array_union(spark, sf_dir):
    keys = F.array_union(F.coalesce("labels", F.array().cast("array<string>")), F.array(F.lit("O"), F.lit("new")))
    return _labelled(spark, sf_dir).select("asset_id", F.array_join(keys, ",").alias("labels"))


@query("SELECT doc_id, CASE WHEN lang = source THEN lang ELSE lang || ',' || source END AS labels FROM documents")
def array_distinct(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(F.array_distinct(F.array("lang", "source", "lang", "source")), ",").alias("labels"))
