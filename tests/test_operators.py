import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from catalox.operators import checks, differences, digests, edits, index, listing, merging


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_numbered(spark):
    values = [(i, random.Random(i).randrange(50)) for i in range(500)]
    df = spark.createDataFrame(values, "id long, v long")
    got = {r.id: r.position for r in index.numbered(df, [F.col("v"), F.desc("id")]).collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(values, key=lambda x: (x[1], -x[0])))}
    assert index.numbered(df.limit(0), [F.col("v")]).count() == 0


def test_range_needs_a_bound(spark):
    df = spark.createDataFrame([(70,), (85,), (None,)], "score int")
    with pytest.raises(ValueError, match="bound"):
        index.find_by_range(df, "score")
    assert rows(index.find_by_range(df, "score", low=70, low_in=False), "score") == [(85,)]
    assert rows(index.find_by_range(df, "score", high=85), "score") == [(70,), (85,)]


def test_islands_and_neighbours(spark):
    groups = ["a", "a", "b", None, None, "a"]
    df = spark.createDataFrame(list(enumerate(groups)), "position long, g string").withColumn("id", F.col("position") + 100)
    assert sorted((r["from"], r.to, r.n) for r in listing.islands(df, ["g"]).collect()) == [(0, 1, 2), (2, 2, 1), (3, 4, 2), (5, 5, 1)]
    got = rows(listing.neighbours(df, "id", block=2), "id", "previous", "next")
    assert [(a, b if b is None else b, c) for a, b, c in got] == [(100 + i, 99 + i if i else None, 101 + i if i < 5 else None) for i in range(6)]
    assert rows(listing.select_range(df, "id", 104, 102), "id") == [(102,), (103,), (104,)]


def packed_by_hand(items, gallery=1200.0, high=200.0):
    lines, used = [], 0.0
    for key, group, aspect in items:
        if not lines or lines[-1][0] != group or used + high * aspect > gallery:
            lines.append((group, []))
            used = 0.0
        lines[-1][1].append((key, aspect))
        used += high * aspect + 4
    out = {}
    for i, (group, line) in enumerate(lines):
        last = i + 1 == len(lines) or lines[i + 1][0] != group
        tall = high if last else (gallery - 4 * (len(line) - 1)) / sum(a for _, a in line)
        out |= {k: (round(tall, 6), round(tall * a, 6)) for k, a in line}
    return out


def test_row_packing(spark):
    rng = random.Random(3)
    items = [(i, "ab"[i >= 40], rng.randrange(0, 900), rng.randrange(300, 900)) for i in range(70)]
    df = spark.createDataFrame(items, "id long, g string, width int, height int")
    got = {r.id: (round(r.row_height, 6), round(r.thumb_width, 6)) for r in listing.row_packing(df, "g", [F.col("id")], "id").collect()}
    assert got == packed_by_hand([(i, g, w / h if w else 1.0) for i, g, w, h in items])
    offsets = listing.row_offsets(listing.row_packing(df, "g", [F.col("id")], "id"), [F.col("group")]).orderBy("offset").collect()
    at = 0.0
    for r in offsets:
        assert r.offset == pytest.approx(at)
        at += r.height


def plain_root(leaves):
    """Root by definition: split at the largest power of two below the size."""
    if len(leaves) == 1:
        return leaves[0]
    cut = 1 << (len(leaves) - 1).bit_length() - 1
    return hashlib.sha256(plain_root(leaves[:cut]) + plain_root(leaves[cut:])).digest()


def shapes(n):
    """Perfect subtrees from the left, joined from the tallest: the definition of the root in words."""
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    peaks, at = [], 0
    for bit in reversed(range(n.bit_length())):
        if n >> bit & 1:
            peaks.append(plain_root(leaves[at : at + (1 << bit)]))
            at += 1 << bit
    root = peaks[0]
    for p in peaks[1:]:
        root = hashlib.sha256(root + p).digest()
    return [d.hex() for d in leaves], root.hex()


@pytest.mark.parametrize("n", range(1, 18))
def test_fold(n):
    leaves, root = shapes(n)
    assert digests.root_of([d for _, d in digests.fold([bytes.fromhex(x) for x in leaves])]).hex() == root


@pytest.mark.parametrize("n", [1, 4, 5, 17, 64, 75])
def test_merkle_root(spark, n):
    leaves, root = shapes(n)
    df = spark.createDataFrame(list(enumerate(leaves)), "k long, d string").orderBy(F.rand(1))
    assert digests.merkle_root(df, [F.col("k")], "d", fan=4) == root
    assert digests.shard_roots(df.withColumn("s", F.lit(3)), "s", "k", "d").first().root == root


def test_merkle_root_of_nothing(spark):
    assert digests.merkle_root(spark.createDataFrame([], "k long, d string"), [F.col("k")], "d") is None


def test_differences(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("x", "9"), ("y", "9")], "name string, hash string")
    b = spark.createDataFrame([("a", "1"), ("b", "4"), ("d", "5"), ("z", "9")], "name string, hash string")
    assert rows(differences.by_name(a, b, "name", "hash"), "name", "status") == [("b", "modified"), ("c", "only_a"), ("d", "only_b"), ("x", "only_a"), ("y", "only_a"), ("z", "only_b")]
    assert rows(differences.by_content(a, b, "name", "hash"), "name", "status") == [("b", "modified"), ("c", "only_a"), ("d", "only_b"), ("y", "only_a")]
    assert rows(differences.replicate_plan(a, b, "name", "hash"), "name", "action")[0] == ("b", "copy")
    r = spark.createDataFrame([(1, "p"), (2, "q")], "shard long, root string")
    assert differences.differing_shards(r, spark.createDataFrame([(1, "p"), (3, "q")], "shard long, root string")) == [2, 3]


def test_swapped_names_have_no_content_difference(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, hash string")
    b = spark.createDataFrame([("a", "2"), ("b", "1")], "name string, hash string")
    assert differences.by_content(a, b, "name", "hash").count() == 0
    assert differences.by_name(a, b, "name", "hash").count() == 2


MERGES = [  # a, b, meta of a, meta of b, merged
    ({"x": 1}, {"x": 2}, {"timestamp": 5}, {"timestamp": 3}, {"x": 1}),
    ({"x": 1}, {"x": 2}, {"timestamp": 3}, {"timestamp": 3}, {"x": 2}),
    ({}, {"x": 2}, {"timestamp": 9}, {"timestamp": 3}, {"x": 2}),
    ({"x": [1]}, {"x": [2, 3]}, {"timestamp": 9}, {"timestamp": 3}, {"x": [1]}),
    ({"p": {"q": 1, "r": 1}}, {"p": {"q": 2, "r": 2}}, {"timestamp": 1, "fields": {"p": {"fields": {"q": {"timestamp": 9}}}}}, {"timestamp": 3}, {"p": {"q": 1, "r": 2}}),
    ({"x": {"y": 1}}, {"x": 5}, {"timestamp": 1}, {"timestamp": 2}, {"x": 5}),
    ({"x": 1, "y": 1}, {"y": 2, "z": 2}, None, None, {"x": 1, "y": 2, "z": 2}),
]


@pytest.mark.parametrize("case", MERGES)
def test_merge_values(case):
    a, b, am, bm, want = case
    value, meta = merging.merge_values(a, b, am, bm)
    assert value == want
    again, _ = merging.merge_values(value, b, meta, bm)
    assert again == want


def test_merge_json(spark):
    schema = "key long, fields string, meta string"
    a = spark.createDataFrame([(1, '{"x": 1}', '{"timestamp": 5}'), (2, '{"x": 2}', "{}")], schema)
    b = spark.createDataFrame([(1, '{"x": 9}', '{"timestamp": 3}'), (3, '{"x": 3}', "{}")], schema)
    assert rows(merging.merge_json(a, b, "key"), "key", "fields") == [(1, '{"x": 1}'), (2, '{"x": 2}'), (3, '{"x": 3}')]


def test_merge_columns(spark):
    a = spark.createDataFrame([(1, "a", None, 9), (2, "b", "q", 1), (4, "d", "d", 1)], "key long, x string, y string, ts long")
    b = spark.createDataFrame([(1, "c", "p", 5), (2, "c", "r", 1), (3, "e", "e", 1)], "key long, x string, y string, ts long")
    dead = spark.createDataFrame([(4,), (1,)], "key long")
    assert rows(merging.merge(a, b, "key", ["x", "y"], tombstones=dead), "key", "x", "y", "ts") == [(1, "a", "p", 5), (2, "c", "r", 1), (3, "e", "e", 1)]


def test_apply_ops(spark):
    records = spark.createDataFrame([("r1", "n", ["a"]), ("r2", "m", None)], "id string, name string, labels array<string>")
    schema = "id string, seq int, kind string, field string, value string"
    log = [("r1", 1, "push", "labels", "b"), ("r1", 2, "push", "labels", "b"), ("r1", 3, "pull", "labels", "a"), ("r1", 4, "set", "name", "x"), ("r1", 5, "set", "name", "y"), ("r2", 6, "push", "labels", "z"), ("r3", 7, "set", "name", "new")]
    want = [("r1", "y", ["b"]), ("r2", "m", ["z"]), ("r3", "new", None)]
    for order in itertools.islice(itertools.permutations(log), 0, 5040, 2500):
        got = edits.apply_ops(records, spark.createDataFrame(list(order), schema), "id", ["name"], "labels")
        assert sorted(((r.id, r.name, r.labels) for r in got.collect()), key=str) == want
    with pytest.raises(ValueError, match="without a record"):
        edits.apply_ops(records, spark.createDataFrame([("no", 1, "push", "labels", "b")], schema), "id", ["name"], "labels")


def test_edits(spark):
    r = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    n = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert rows(edits.insert_new(r, n, "id"), "id", "v") == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(edits.replace(r, n, "id"), "id", "v") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(edits.patch(r, n, "id", ["v"]), "id", "v") == [(1, "a"), (2, "c")]
    assert rows(edits.delete(r, n, "id"), "id") == [(1,)]
    for f in (edits.insert_new, edits.delete):
        with pytest.raises(ValueError, match="present"):
            f(r, n, "id", strict=True)


def test_checks(spark):
    e = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", None, None)], "n string, size long, hash string")
    f = spark.createDataFrame([("a", 1, "y"), ("b", 2, "y"), ("e", 1, "x"), ("d", None, None)], "n string, size long, hash string")
    assert rows(checks.verify(e, f, "n"), "n", "status") == [("a", "unmodified"), ("b", "modified"), ("c", "removed"), ("d", "unmodified"), ("e", "new")]
    assert rows(checks.verify(e, f, "n", full=True), "n", "status")[0] == ("a", "modified")
    none = spark.createDataFrame([], "status string, size long")
    assert tuple(checks.import_summary(none, "status", "size").first()) == (0, 0, 0, 0, 0, 0)


def test_list_edits_like_a_fold(spark):
    """Random logs: the last-pull rule gives what applying one edit after another gives."""
    rng = random.Random(8)
    start = {f"r{i}": [rng.choice("abcd") for _ in range(rng.randrange(0, 4))] for i in range(20)}
    log = [(rng.choice(list(start)), i, rng.choice(["push", "pull"]), "labels", rng.choice("abcde")) for i in range(300)]
    want = {k: list(v) for k, v in start.items()}
    for k, _, kind, _, v in log:
        if kind == "push":
            want[k] += [] if v in want[k] else [v]
        else:
            want[k] = [x for x in want[k] if x != v]
    records = spark.createDataFrame([(k, "n", v) for k, v in start.items()], "id string, name string, labels array<string>")
    ops = spark.createDataFrame(log, "id string, seq int, kind string, field string, value string")
    assert {r.id: r.labels for r in edits.apply_ops(records, ops, "id", ["name"], "labels").collect()} == want


def test_merge_fields(spark):
    """Field by field: the later one, absent ones from the other side, ties from the target, and only times that are later than the record's."""
    schema = "k int, fields map<string,string>, times map<string,bigint>, ts bigint"
    one = spark.createDataFrame([(1, {"a": "1", "b": "1", "c": "1"}, {"a": 50, "d": 99}, 10), (2, {"x": "1"}, None, 5)], schema)
    two = spark.createDataFrame([(1, {"a": "2", "b": "2", "d": "2"}, {"c": 70, "b": 10}, 20), (3, None, None, None)], schema)
    got = {r.k: (r.fields, r.times, r.ts) for r in merging.merge_fields(one, two, "k").collect()}
    assert got[1] == ({"a": "1", "b": "2", "c": "1", "d": "2"}, {"a": 50, "d": 20}, 10)
    assert got[2] == ({"x": "1"}, None, 5) and got[3] == (None, None, None)


def test_kept_index(spark, tmp_path):
    """Pages of a kept index: only the leaf of a page is scanned; a rebuild replaces it and a dropped one is gone."""
    df = spark.range(1000).select("id", (F.col("id") * 7 % 100).alias("v"))
    order = [F.col("v"), F.col("id")]
    want = [r.id for r in df.orderBy(*order).collect()]
    index.build(df.limit(10), str(tmp_path), "by_v", order, 20, 3)
    index.build(df, str(tmp_path), "by_v", order, 20, 3)
    page = index.read_page(spark, str(tmp_path), "by_v", 11)
    assert [r.id for r in page.orderBy("position").collect()] == want[220:240] and page.first().total_pages == 50
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(leaf" in plan and "(leaf" in plan.split("PartitionFilters")[1]
    token, seen = None, []
    while True:
        part, token = index.pages(spark, str(tmp_path), "by_v", token, leaves=5)
        seen += [r.id for r in part.orderBy("position").collect()]
        if token is None:
            break
    assert seen == want
    assert index.names(spark, str(tmp_path)) == ["by_v"]
    index.drop(spark, str(tmp_path), "by_v")
    assert index.names(spark, str(tmp_path)) == []


def test_scan_of_a_kept_index(spark, tmp_path):
    """One read gives what the calls by token give; a call lists its own leaves only; nothing is found where there is nothing."""
    df = spark.range(1000).select("id", (F.col("id") * 7 % 100).alias("v"))
    at, order = str(tmp_path), [F.col("v"), F.col("id")]
    want = [r.id for r in df.orderBy(*order).collect()]
    index.build(df, at, "by_v", order, 20, 3)
    for leaves in (1, 5):
        token, seen, files = None, [], set()
        while True:
            part, following = index.pages(spark, at, "by_v", token, leaves)
            seen += [(r.id, r.position, token or 0) for r in part.orderBy("position").collect()]
            folders = {f.split("/")[-2] for f in part.inputFiles()}
            assert folders == {f"leaf={n}" for n in range(token or 0, min((token or 0) + leaves, 17))}
            files |= folders
            if (token := following) is None:
                break
        scanned = index.scan(spark, at, "by_v", leaves)
        assert [tuple(r) for r in scanned.select("id", "position", "token").collect()] == seen
        assert [r[0] for r in seen] == want and len(files) == 17
    assert index.pages(spark, at, "by_v", 17)[0].count() == index.read_page(spark, at, "by_v", 50).count() == index.read_page(spark, at, "by_v", -1).count() == 0
    index.build(df.limit(0), at, "none", order)
    part, token = index.pages(spark, at, "none")
    assert part.columns == index.scan(spark, at, "none").drop("token").columns and token is None
    assert part.count() == index.scan(spark, at, "none").count() == 0
    with pytest.raises(ValueError, match="no entries"):
        index.read_page(spark, at, "none", 0)


def test_edits_of_another_collection_raise(spark):
    records = spark.createDataFrame([("d", 1, None, [])], "db string, k int, score double, labels array<string>")
    ops = spark.createDataFrame([("d", "other", 1, 1, "set", "score", "2")], "db string, collection string, k int, seq int, kind string, field string, value string")
    with pytest.raises(ValueError, match="takes no edits"):
        edits.apply_routed(records, ops, "db", "collection", "metadata", "k", ["score"], "labels")


def test_stored_files_are_verified(spark, tmp_path):
    from catalox.sources import assets

    rows = spark.createDataFrame([("a/1", b"one"), ("a/2", None), ("b/c/3", b"three")], "name string, content binary")
    sent = assets.write_assets(rows, str(tmp_path / "x"))
    assert sorted((r.name, r.length) for r in sent.collect()) == [("a/1", 3), ("a/2", 0), ("b/c/3", 5)]
    with pytest.raises(ValueError, match="without bytes"):
        assets.move_assets(spark, str(tmp_path / "x"), str(tmp_path / "z"))
    (tmp_path / "x" / "a" / "2").unlink()
    assets.move_assets(spark, str(tmp_path / "x"), str(tmp_path / "y"))
    assert not (tmp_path / "x").exists() and (tmp_path / "y" / "b" / "c" / "3").read_bytes() == b"three"
    (tmp_path / "y" / "a" / "1").write_bytes(b"two")
    assert sorted(r.hash for r in assets.stored(spark, str(tmp_path / "y")).collect()) != sorted(r.hash for r in sent.collect())
