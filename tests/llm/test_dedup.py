import random
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import awkward, components, frame, lower, sha, words

from catalox.llm import line_dedup as lines
from catalox.llm.exact_dedup import directory, exact_dedup
from catalox.llm.near_dedup import near_dedup
from catalox.llm.substring_dedup import substring_dedup

SEEDS = [1, 2, 3]


def plain_substring(rows, window):
    first = {}
    for i, t in sorted(rows):
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone), gone)
    return out


@pytest.mark.parametrize("seed", SEEDS)
def test_substring(spark, seed):
    rows = awkward(seed)
    want = plain_substring(rows, 13)
    got = substring_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, removed, kept, gone = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept) == (n, removed, kept)
        assert {k for s in r.spans for k in range(s["from"], s["to"])} == gone


def test_substring_edges(spark):
    assert substring_dedup(frame(spark, [], extra=False)).count() == 0
    twice = [(5, "a b c d e f g h i j k l m n"), (5, "a b c d e f g h i j k l m n"), (2, "x a b c d e f g h i j k l m")]
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup(frame(spark, twice)).collect()) == [(2, 0), (5, 13), (5, 13)]


def test_substring_repeated_ids(spark):
    """Texts of one id are judged each by its own words, against smaller ids only; a task's rows are gathered in runs of any length."""
    p, q = (" ".join(f"{c}{i}" for i in range(20)) for c in "pq")
    got = substring_dedup(frame(spark, [(5, p), (5, "z y x w " * 5 + q), (5, f"{q} {q}"), (2, q), (9, p + " tail"), (9, "short")])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(2, 20, 0), (5, 20, 0), (5, 40, 20), (5, 40, 40), (9, 1, 0), (9, 21, 20)]


def test_substring_runs(spark):
    """Deciding within runs of any length changes nothing."""
    rows = awkward(5)
    want = plain_substring(rows, 13)
    for n in (1, 7, 1000):
        assert {r.doc_id: r.kept for r in substring_dedup(frame(spark, rows), run_rows=n).collect()} == {i: k for i, (_, _, k, _) in want.items()}


def plain_lines(rows, least):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    split = {i: (t or "").split("\n") for i, t in rows}
    df = Counter(k for ls in split.values() for k in {key(x) for x in ls})
    return {i: (len(ls), "\n".join(x for x in ls if not (key(x) and df[key(x)] >= least))) for i, ls in split.items()}


@pytest.mark.parametrize("seed", SEEDS)
def test_lines(spark, seed):
    rows = awkward(seed)
    want = plain_lines(rows, 10)
    got = lines.line_dedup(frame(spark, rows), shard_keys=20, carry=("lang", "drop")).collect()
    assert {r.doc_id: (r.n_lines, r.text) for r in got} == want and len(got) == len(rows)
    assert all((r.lang, r.drop) == (f"lang{r.doc_id % 3}", f"drop{r.doc_id % 3}") for r in got)
    assert lines.line_dedup(frame(spark, [], extra=False)).count() == 0


def test_lines_count_documents(spark):
    """Rows that repeat an id are one document: nine others and it make ten, its own rows alone do not."""
    rows = [(7, "again\nonly here")] * 12 + [(8, "ONLY here \nx")]
    got = lines.line_dedup(frame(spark, rows)).collect()
    assert len(got) == 13 and all(r.n_dropped == 0 for r in got)
    got = lines.line_dedup(frame(spark, [*rows, *((i, "again") for i in range(100, 109))])).collect()
    assert all((r.n_dropped, r.text) == (1, "only here") for r in got if r.doc_id == 7)
    long = [(i, "\n".join(f"{i} {k}" for k in range(20_000)) + "\nshared") for i in range(10)]
    assert all((r.n_lines, r.n_dropped) == (20_001, 1) for r in lines.line_dedup(frame(spark, long, extra=False)).collect())


def test_line_shards_split(spark):
    """Batches with more shards each time: the same counts as at once."""
    k = lines.line_keys(frame(spark, awkward(6), extra=False))
    read = lambda s: sorted(map(tuple, lines.counts(s).collect()))
    want = read(lines.apply_changes(lines.empty_state(spark), k, 1, 4))
    assert read(lines.insert_all(k, k.limit(0), 10, 3)) == want
    assert read(lines.split_shards(lines.apply_changes(lines.empty_state(spark), k, 1, 2), 16)) == want


def test_line_state_is_reversible(spark):
    """Documents in, others in and out again: counts and decisions are those of the first alone."""
    one, two = frame(spark, awkward(4), extra=False), frame(spark, [(i + 1000, t) for i, t in awkward(5)], extra=False)
    k1, k2 = lines.line_keys(one), lines.line_keys(two)
    before = lines.apply_changes(lines.empty_state(spark), k1, 1, 4)
    both = lines.apply_changes(before, k2, 1, 4)
    after = lines.apply_changes(both, k2, -1, 4)
    read = lambda s: sorted(map(tuple, lines.counts(s).collect()))
    assert read(after) == read(before) != read(both)
    for r in after.collect():
        f = lines.CuckooFilter.from_bytes(r["filter"])
        import numpy as np

        assert f.contains(np.array(r["lo"], np.int64)).all()
        assert int((f.table != 0).sum()) == len(r["lo"])
    with pytest.raises(Exception, match="never inserted"):
        lines.apply_changes(before, k2, -1, 4).collect()


def test_cuckoo_filter():
    import numpy as np

    keys = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 5000)
    f = lines.CuckooFilter.sized(5000)
    assert f.add(keys) and f.contains(keys).all()
    f.remove(keys[:2500])
    assert f.contains(keys[2500:]).all()
    assert f.contains(keys[:2500]).mean() < 0.01


def shingles(text, k):
    w = words(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain_near(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


@pytest.mark.parametrize("seed", SEEDS)
def test_near(spark, seed):
    rows = awkward(seed)
    got = near_dedup(frame(spark, rows), shingle=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_near(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


@pytest.mark.parametrize(("edits", "n"), [(1, 150), (3, 150), (5, 120)])
def test_near_on_borderline_groups(spark, edits, n, monkeypatch):
    """A large group whose members differ by about the threshold: links and non-links in the same lists, over several blocks."""
    import catalox.llm.near_dedup as near

    monkeypatch.setattr(near, "SET_MEMBERS", 16)
    rng = random.Random(edits)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(n):
        ws = list(base)
        for _ in range(rng.randrange(edits, edits + 3)):
            ws[rng.randrange(90)] = f"u{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    got = near_dedup(frame(spark, rows), shingle=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_near(rows, 4)


def test_near_edges(spark):
    assert near_dedup(frame(spark, [], extra=False)).count() == 0
    got = near_dedup(frame(spark, [(3, "a b c"), (3, "a b c"), (1, "A b C"), (7, None), (8, "")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (3, 1), (3, 1), (7, 7), (8, 8)]


def test_near_repeated_ids(spark):
    """An id with two texts links with the kin of both, so they are one component."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    got = near_dedup(frame(spark, [(5, a), (5, b), (9, a + " x"), (3, b + " y"), (4, "c d e f g"), (4, None)]), shingle=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(3, 38, 3, True), (4, 0, 4, True), (4, 2, 4, True), (5, 37, 3, False), (5, 37, 3, False), (9, 38, 3, False)]


def test_merging_finds_all_colliding_pairs():
    import numpy as np
    from catalox.llm.near_dedup import matches_for, merged

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1000, (6, 64))
    sig = np.where(rng.random((300, 64)) < rng.random((300, 1)) * 0.6, rng.integers(0, 50, (300, 64)), base[rng.integers(6, size=300)]).astype(np.uint32)
    for m, rows in ((20, 300), (36, 300), (64, 300), (36, 50), (36, 2), (36, 1)):
        want = {(i, j) for i in range(rows) for j in range(i + 1, rows) if (sig[i] == sig[j]).sum() >= m and (i + j) % 3}
        got = [p for a, b in merged(sig[:rows], m, lambda a, b: (a + b) % 3 > 0) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert set(got) == want and len(got) == len(want)
    assert matches_for(80) == 36 and matches_for(60) < 30 < matches_for(90)


@pytest.mark.parametrize("similarity", [60, 90])
def test_near_at_other_similarities(spark, similarity):
    rows = awkward(11, n=90)
    sets = {i: shingles(t, 4) for i, t in rows}
    ids = sorted(sets)
    links = [(x, y) for n, x in enumerate(ids) for y in ids[n + 1 :] if sets[x] and 100 * len(sets[x] & sets[y]) >= similarity * len(sets[x] | sets[y])]
    want = components(ids, links)
    assert {r.doc_id: r.component_id for r in near_dedup(frame(spark, rows), shingle=4, similarity=similarity).collect()} == want


def test_blocks_of_signatures(spark):
    """Splitting lists into blocks changes nothing."""
    from catalox.llm import near_dedup as near

    rows = awkward(9, n=120)
    base = near.signatures(frame(spark, rows, extra=False), 4, "doc_id", "text").filter("n > 0")
    reps = base.select(F.col("id").alias("rep"), "n", "sig", "mini")
    postings = near.prefix_postings(reps)
    sizes = postings.groupBy("key", "band").agg(F.count("*").alias("m"))
    lists = postings.join(sizes, ["key", "band"]).select("key", "band", "coord", "rep", "m")
    members = postings.select("rep", "low", "mask").distinct().withColumn("comp", F.col("rep")).withColumn("home", F.col("rep") % 7).join(reps.select("rep", "mini"), "rep")

    import numpy as np

    read = lambda df: Counter(tuple(sorted(p)) for r in df.collect() for p in np.frombuffer(r.pairs, np.int64).reshape(-1, 2).tolist())
    whole, cut = read(near.colliding(lists, members, 36)), read(near.colliding(lists, members, 36, block=5))
    assert whole == cut and whole and set(whole.values()) == {1}


@pytest.mark.parametrize("seed", SEEDS)
def test_exact(spark, seed):
    import re

    rows = awkward(seed)
    norm = {i: re.sub("[\x20\x09-\x0d]+", " ", t or "") for i, t in rows}
    first, size = {}, Counter(norm.values())
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    for options in ({}, {"capacity": 4, "owner_rows": 2}):
        got = exact_dedup(frame(spark, rows), **options).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == {i: (first[t], size[t], first[t] == i, sha(t)) for i, t in norm.items()}
        assert len(got) == len(rows)


def test_exact_edges(spark):
    assert exact_dedup(frame(spark, [], extra=False)).count() == 0
    got = exact_dedup(frame(spark, [(4, "a"), (4, "a"), (2, "b"), (9, "a")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(2, 2, 1, True), (4, 4, 3, True), (4, 4, 3, True), (9, 4, 3, False)]
    # An id that comes with two texts stays for one and goes for the other.
    for options in ({}, {"capacity": 1, "owner_rows": 1}):
        got = exact_dedup(frame(spark, [(1, "a"), (2, "a"), (3, "b"), (2, "b")]), **options).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 1, 2, True), (2, 1, 2, False), (2, 2, 2, True), (3, 2, 2, False)]


def test_directory_covers_all_keys_once(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"), F.lit(1).alias("weight"))
    for capacity in (100, 10_000):
        slots, depth = directory(keys, capacity)
        rows = slots.collect()
        assert sorted(r.slot & ((1 << 64) - 1) for r in rows) == list(range(1 << depth))
        held = Counter()
        bucket = {r.slot: r.bucket for r in rows}
        for r in keys.collect():
            held[bucket[(r.h & ((1 << 64) - 1)) >> (64 - depth)]] += 1
        assert max(held.values()) <= capacity
        # Two buckets whose keys would fit in one are not split.
        for b, d in {(r.bucket, r.depth) for r in rows if r.depth}:
            twin = [x for x in {(r.bucket, r.depth) for r in rows} if x[1] == d and x[0] >> (depth - d + 1) == b >> (depth - d + 1)]
            assert len(twin) < 2 or sum(held[x[0]] for x in twin) > capacity
