import hashlib
import math
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from conftest import SF
from helpers import awkward, frame, words

from catalox.llm import mixing, quality, warc
from catalox.llm.ann import nearest
from catalox.llm.packing import bucketed, default_tokenizer, pack, places, solve


# Mixing

def plain_fill(share, caps, weights):
    got, open_ = {}, dict(caps)
    while open_:
        level = share / sum(weights[k] for k in open_)
        full = [k for k in open_ if caps[k] <= level * weights[k]]
        if not full:
            return got | {k: level * weights[k] for k in open_}
        for k in full:
            got[k] = open_.pop(k)
            share -= got[k]
    return got


@pytest.mark.parametrize("epochs", [1, 3])
def test_mixing(spark, epochs):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src12", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, max_epochs=epochs, budget_share=0.8 * epochs).collect()
    leaves = Counter()
    for _, t, lang, source in rows:
        leaves[("core" if (source or "") in ("src0", "src1") else "tail", lang or "", source or "")] += len(words(t))
    leaves = {k: v * epochs for k, v in leaves.items() if v}
    total = lambda p: sum(v for k, v in leaves.items() if k[: len(p)] == p)
    level = {(): math.floor(total(()) / epochs * 0.8 * epochs)}
    for depth, weights in enumerate((mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, mixing.SOURCE_WEIGHTS), 1):
        parents = {k: [] for k in level if len(k) == depth - 1}
        for k in {x[:depth] for x in leaves}:
            parents[k[:-1]].append(k)
        for p, kids in parents.items():
            level |= plain_fill(level[p], {k: total(k) for k in kids}, {k: weights.get(k[-1], 1.0) for k in kids})
    taken = Counter()
    for r in got:
        taken[(r.domain, r.lang, r.source)] += r.taken
        assert 0 < r.taken <= r.tokens
    assert {k: math.floor(level[k] + 1e-6) for k in leaves if math.floor(level[k] + 1e-6)} == dict(taken)
    per_leaf = Counter((r.domain, r.lang, r.source) for r in got if r.taken < r.tokens)
    assert all(v <= 1 for v in per_leaf.values())
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)


def test_mixing_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, part long, cap string")
    assert mixing.mix(docs).count() == 0
    docs = spark.createDataFrame([(1, None, "en", "src0", 1), (None, "a b", "en", "src0", 1), (2, "a b c d", None, None, 1)], "doc_id long, text string, lang string, source string, part long")
    assert [(r.doc_id, r.taken) for r in mixing.mix(docs).collect()] == [(2, 3)]
    # Rows that repeat an id are drawn each; a very long text is cut where its leaf's part ends.
    docs = spark.createDataFrame([(1, "a b", "en", "src0"), (1, "a b", "en", "src0"), (2, "w " * 300_000, "en", "src0")], "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, budget_share=0.5).collect()
    assert sum(r.taken for r in got) == 150_002 and {r.epoch for r in got} == {0}


# Quality

def plain_kneser_ney(trusted):
    """Interpolated modified Kneser-Ney bigrams over all trusted words; any other word has what is left."""
    n, follow = Counter(), Counter()
    for t in trusted:
        for a, b in zip(["<s>", *words(t)], words(t), strict=False):
            n[a, b] += 1
    for _, b in n:
        follow[b] += 1

    def discounts(values):
        c = Counter(values)
        if not any(c[i] for i in (1, 2, 3, 4)):
            return [0.5] * 3
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + c[2] else 0.5
        d = [i - (i + 1) * y * c[i + 1] / c[i] if c[i] else y * i for i in (1, 2, 3)]
        return [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]

    d2, d1 = discounts(n.values()), discounts(follow.values())
    cut = lambda k, d: d[min(k, 3) - 1]
    types, words_ = sum(follow.values()), len(follow) + 1
    spare = sum(cut(k, d1) for k in follow.values()) / types
    low = lambda b: (follow[b] - cut(follow[b], d1)) / types + spare / words_ if follow[b] else spare / words_
    total, gamma = Counter(), Counter()
    for (a, _), k in n.items():
        total[a] += k
        gamma[a] += cut(k, d2)

    def p(a, b):
        if not total[a]:
            return low(b)
        own = (n[a, b] - cut(n[a, b], d2)) / total[a] if n[a, b] else 0.0
        return own + gamma[a] / total[a] * low(b)

    return p


def test_quality_against_plain_model(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    good = lambda k: " ".join(vocabulary[(a * a) % 40] for a in (rng.randrange(40) for _ in range(k)))
    rows = [(i, good(rng.randrange(5, 60)), "en") for i in range(200)] + [(500, " ".join(f"zz{i}" for i in range(50)), "en"), (501, None, "en"), (502, "  ", None), (503, "unseen tongue", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(150, 0, 0), (151, 1, 1)], "doc_id long, quality int, toxic int")
    small = {r.doc_id: r for r in quality.classify(docs.repartition(3), labels, block_words=200, shard_keys=10).collect()}
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows) and {i: (r.n_words, r.kept) for i, r in small.items()} == {i: (r.n_words, r.kept) for i, r in got.items()}
    assert all(small[i].perplexity == pytest.approx(r.perplexity) for i, r in got.items() if r.perplexity)
    folds = {r.id: r.h for r in spark.range(150).selectExpr("id", "pmod(xxhash64(id), 5) = 0 as h").collect()}
    text = {i: t for i, t, _ in rows}
    p = plain_kneser_ney([text[i] for i in range(150) if not folds[i]])
    nats = lambda t: sum(-math.log(p(a, b)) for a, b in zip(["<s>", *words(t)], words(t), strict=False))
    held = [i for i in range(150) if folds[i]]
    average = sum(nats(text[i]) for i in held) / sum(len(words(text[i])) for i in held)
    for i in [*range(0, 200, 7), 500]:
        w = len(words(text[i]))
        want = math.exp((nats(text[i]) + quality.PRIOR_WORDS * average) / (w + quality.PRIOR_WORDS))
        assert got[i].perplexity == pytest.approx(want, rel=1e-6)
    assert not got[500].kept and not got[501].kept and not got[502].kept and got[503].kept
    assert np.mean([got[i].kept for i in range(150, 200)]) > 0.95


def test_quality_knows_all_words_of_each_language(spark):
    """More words than one small table holds, and more languages than 32, each with a model of its own."""
    rng = random.Random(9)
    big = [f"w{i}" for i in range(9000)]
    rows = [(i, " ".join(big[i * 90 % 9000 : i * 90 % 9000 + 90]), "en") for i in range(800)]
    for k in range(40):
        own = [f"x{k}y{i}" for i in range(5)]
        rows += [(1000 + 100 * k + i, " ".join(rng.choice(own) for _ in range(5 + k % 3)), f"l{k}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert max(got[i].perplexity for i, _, x in rows if x == "en") < 4  # every next word is known from the one before
    # Five words of its own, so even a uniform model stays near 5; one that does not know them is beyond.
    assert max(r.perplexity for r in got.values() if r.lang != "en") < 12


def test_quality_held_out(spark):
    """On the documents whose labels say so: good ones stay, bad ones mostly go."""
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").collect()
    keep = lambda q: np.mean([r.kept for r in got if (r.quality == 1 and r.toxic == 0) == q])
    assert keep(True) > 0.97


def test_quality_rejects(spark):
    """Without a margin: of documents labelled bad or toxic outside the fold that sets the threshold, at least this share goes."""
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").filter(f"pmod(xxhash64(doc_id), {quality.FOLDS}) > 0").collect()
    junk = [r.kept for r in got if r.quality == 0 and r.toxic == 0]
    assert len(junk) > 20 and 1 - np.mean(junk) > 0.98


def test_quality_thresholds(spark):
    good = spark.createDataFrame([(x, float(i)) for x in ("en", "de") for i in range(1, 101)], "lang string, perplexity double")
    bad = spark.createDataFrame([("en", 50.0), ("en", 96.5), ("en", 200.0), ("fr", 1.0)], "lang string, perplexity double")
    assert dict(map(tuple, quality.thresholds(good, bad, 0.1).collect())) == {"en": 96.0, "de": 100.0}


def test_quality_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, n long, word string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "a b", "en"), (2, None, None), (None, "x", "en")], "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.kept) for r in quality.classify(some, labels).collect()) == [(1, True), (2, False)]


# WARC

def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    pages = [(1, "http://www.a.example.com/X?q=1", big), (2, "http://b.example.com/", big), (3, None, None), (4, "", "WARC/1.1\r\n\r\n\r\n"), (5, "http://a.example.com/x?q=1", big), (6, "bad\r\nurl", "x" * 999), (7, "http://[", "x" * 999), (8, "https://a.example.com:8080/z", "y" * 3000), (8, "u", "y" * 3000)]
    df = spark.createDataFrame([(*p, "clash") for p in pages] + [(None, "u", "x", "clash")], "page_id long, url string, html string, digest string").repartition(2)
    got = warc.capture_histories(df, path=str(tmp_path / "archives")).collect()
    assert len(got) == len(pages)
    for r in got:
        html = next(h for i, _, h in pages if i == r.page_id) or ""
        raw = html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 5) if r.page_id in (1, 2) else ("response", None))
    assert [(r.url_key, r.capture_time, r.page_id) for r in got] == sorted((r.url_key, r.capture_time, r.page_id) for r in got)
    assert {r.url_key for r in got if r.page_id in (1, 5)} == {"com,example,a)/x?q=1"}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.capture_histories(empty, path=str(tmp_path / "none")).count() == 0


def test_warc_large_ids_and_pages(spark, tmp_path):
    """Ids beyond any date, and archives that are cut by bytes as well as by records."""
    pages = [(i, f"http://h{i % 3}.example.com/", "x" * (i % 7 * 400)) for i in range(50)] + [(10**13 + i, "http://z.example.com/", "y" * 90_000 + str(i)) for i in range(5)] + [(-(10**15), "http://z.example.com/", "z"), (2**62, "http://z.example.com/", "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    at = warc.write_archives(df, str(tmp_path / "cut"), file_records=10, file_bytes=20_000)
    got = warc.merge_runs(warc.read_archives(spark, at)).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == sorted((i, len(h)) for i, _, h in pages)
    assert [(r.url_key, r.capture_time, r.page_id) for r in got] == sorted((r.url_key, r.capture_time, r.page_id) for r in got)
    assert {len(r.capture_time) for r in got} == {20}
    parts = warc.merge_runs(warc.read_archives(spark, at), range_entries=9).collect()  # many ranges, some runs in several
    assert [(r.url_key, r.capture_time, r.page_id) for r in parts] == [(r.url_key, r.capture_time, r.page_id) for r in got]
    held = Counter()
    for r in got:
        held[r.archive] += r.payload_bytes
    assert all(v <= 20_000 for v in held.values() if v < 90_000) and sum(v > 90_000 for v in held.values()) == 5


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(20), i, j) for j in range(rng.randrange(0, 30))) for i in range(k)]
    assert list(warc.loser_tree_merge([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


# Nearest neighbours

def plain_nearest(vectors, queries, k=10):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], np.float64)
    out = []
    for q, v in queries:
        d = np.sqrt(np.add.accumulate((x - np.array(v)) ** 2, axis=1)[:, -1])
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out += [(q, r + 1, int(ids[j]), float(d[j])) for r, j in enumerate(order)]
    return out


def test_nearest_recall(spark):
    df = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = plain_nearest(rows, [(i, v) for i, v in rows if i % 100 == 0])
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest(df, df.filter("vec_id % 100 = 0")).collect()}
    assert len(got) == len(want)
    true = {(q, i) for q, _, i, _ in want}
    assert len(true & {(q, i) for (q, _), (i, _) in got.items()}) / len(true) >= 0.9


def test_nearest_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []), (100, [1.0, 0.0]), (200, [0.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, list int, part int")
    got = nearest(df, df.filter("vec_id % 100 = 0")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got)] == [(0, 1, 1), (0, 2, 100), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    none = df.limit(0)
    assert nearest(none, none).count() == 0
    # The size is that of most usable vectors, whichever row comes first; an id may come several times.
    rows = [(0, [0.0]), (0, [9.0]), (0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [4.0, 3.0]), (2, [4.0, 3.0]), (0, [1.0, 2.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = nearest(df, df.filter("vec_id % 100 = 0").filter("get(embedding, 1) = 2.0")).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got)] == [(1, 1, 1.0), (2, 2, 10**0.5), (3, 2, 10**0.5)]


def test_nearest_probes_few_lists_of_gathered_vectors(spark):
    """Where vectors gather, a tenth of the lists is enough; and copies of one vector do not crowd out its neighbours."""
    from catalox.llm.ann import centroids, probes_for

    rng = np.random.default_rng(3)
    middle = rng.standard_normal((60, 16)) * 8
    x = middle[rng.integers(60, size=6000)] + rng.standard_normal((6000, 16))
    c = centroids(x, 77)
    assert probes_for(x, c, 10) <= 8
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000 + i, x[0].tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = plain_nearest(rows, [(i, v) for i, v in rows if i % 100 == 0])
    got = {(r.query_id, r.vec_id) for r in nearest(df, df.filter("vec_id % 100 = 0")).collect()}
    assert len(got) == len(want) and sum((q, i) in got for q, _, i, _ in want) / len(want) >= 0.9


# Packing

def check_packed(rows, got, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids[i]) // capacity)))
        for r in parts:
            assert r.start == r.piece * capacity and r.length == min(capacity, len(ids[i]) - r.start)
            assert r.ids_crc32 == zlib.crc32(ids[i][r.start : r.start + r.length].tobytes())
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [16, 128, 2048])
def test_packing(spark, capacity):
    rows = awkward(6, n=150)
    got = pack(frame(spark, rows), capacity=capacity).collect()
    used = check_packed(rows, got, capacity)
    least = sum(r.length for r in got) / capacity
    assert used <= math.ceil(least * 1.05) + 1


def test_packing_with_another_tokenizer(spark, tmp_path):
    """One that keeps capitals: whole texts are encoded, nothing is lower-cased before."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1, "A": 2, "b": 3}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.save(path := str(tmp_path / "cased.json"))
    got = pack(frame(spark, [(1, "A a b"), (2, "a a b"), (1, "b")]), tokenizer=path).collect()
    crc = lambda *ids: zlib.crc32(np.array([*ids, 0], "<u4").tobytes())
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in got) == sorted([(1, 4, crc(2, 1, 3)), (2, 4, crc(1, 1, 3)), (1, 2, crc(3))])


def test_rank_buckets():
    rows = places([(5, {10: 3, 7: 1}), (90, {10: 1}), (1, {7: 2, 10: 1})])
    slots, widths = bucketed(rows)
    assert {r[1:] for r in slots} == set(rows) and len(slots) <= 2 * len(rows)
    for size, width in widths:
        for rank in range(max(r[2] for r in rows if r[0] == size)):
            assert sum(r[1] == size and r[0] == rank // width and r[2] <= rank < r[3] for r in slots) == 1


def test_packing_edges(spark):
    assert pack(frame(spark, [], extra=False)).count() == 0
    assert [(r.length, r.offset) for r in pack(frame(spark, [(1, None)])).collect()] == [(1, 0)]


@pytest.mark.parametrize("seed", range(4))
def test_solve(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(np.minimum(2047, rng.lognormal(5.5, 1.2, 20_000).astype(int) + 1), return_counts=True), strict=True)}
    chosen = solve(histogram)
    got = Counter()
    for copies, held in chosen:
        assert copies > 0 and sum(k * a for k, a in held.items()) <= 2048
        for k, a in held.items():
            got[k] += copies * a
    assert dict(got) == histogram
    assert sum(c for c, _ in chosen) <= math.ceil(sum(k * n for k, n in histogram.items()) / 2048 * 1.01) + 1
    assert solve({}) == [] and solve({5: 0}) == []


def test_solve_without_full_sequences():
    """No combination of these lengths fills a sequence; best fit takes 110 sequences, 90 are enough."""
    histogram = {1038: 60, 555: 60, 531: 60, 459: 120}
    chosen = solve(histogram)
    got = Counter()
    for copies, held in chosen:
        assert copies > 0 and sum(k * a for k, a in held.items()) <= 2048
        for k, a in held.items():
            got[k] += copies * a
    assert dict(got) == histogram
    assert sum(copies for copies, _ in chosen) <= 92
