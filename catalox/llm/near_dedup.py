"""MinHash near-duplicates by a signature-coordinate inverted join.

Every distinct shingle set is posted under each pair of signature coordinate and
value. A pair of sets above the match threshold shares one of the rarest
coordinates of either, so only that prefix is joined, and a coordinate that no
other set holds is skipped. Inside a posting list the members first meet two
leaders, the smallest id and the most central one. Lists that then still span
several components merge their members' postings, block by block: a member's
rarest postings name its candidates, and each candidate is looked up in the long
ones only while it can still reach the threshold. Every pair, a leader's too, must
have the collisions of the match threshold; what passes is confirmed on full
shingle sets. Pairs inside lists stay packed by blocks of members, so no step has a
row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalox.llm.common import chunks, materialize, multipliers, scratch, split_words, spread
from catalox.llm.components import components

SHINGLE = 5
SIMILARITY = 80
#: Signature coordinates, and the chance at which a pair of just the similarity may miss the collisions it must have.
COORDINATES, MISS = 64, 5e-6
#: Members of a block whose signatures are compared with another's, and members and shingles of a block of sets.
BLOCK, SET_MEMBERS, SET_SHINGLES = 2048, 256, 1 << 18
#: Pairs that a task holds before it packs them.
HELD_PAIRS = 200_000
#: Rows whose pairs are counted together.
FEW = 96
#: Long postings that are looked up before candidates are dropped again.
SKIP = 8
#: Members one task compares with a leader.
MEMBERS = 256


def matches_for(similarity: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """Collisions that a pair of this similarity (percent) has but for a chance of ``miss``: 36 of 64 at 80."""
    s, below = similarity / 100, 0.0
    for n in range(coordinates + 1):
        below += comb(coordinates, n) * s**n * (1 - s) ** (coordinates - n)
        if below > miss:
            return max(1, n)
    return coordinates


def band_of(n, similarity: int):
    """Size bands: linked sets differ in size by at most 100 / ``similarity``, which reaches one band up or down."""
    return F.floor(F.log(n) / float(np.log(100.8 / similarity))).cast("int")


def _shingles(texts: pa.Array, k: int, mult: np.ndarray) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles; a shorter text is one shingle."""
    words, counts = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = words.dictionary_encode()
    w = np.array([xxhash.xxh64_intdigest(x) for x in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)[coded.indices.to_numpy()]
    run = lambda at, stop, size: spread(sum((w[at + j : stop - size + 1 + j] * mult[j] for j in range(size)), np.uint64(size)))
    full = run(0, len(w), k) if len(w) >= k else w[:0]
    out, at = [], 0
    for n in counts.tolist():
        out.append(w[:0] if not n else np.unique(full[at : at + n - k + 1] if n >= k else run(at, at + n, n)))
        at += n
    return out


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str, coordinates: int = COORDINATES, seed: int = 11) -> DataFrame:
    """Rows (id, n, hi, lo, sig, mini): set size, 128-bit set hash, keyed signature coordinates and their low 32 bits packed."""
    mult, a, b, tag = (multipliers(n, seed + i) for i, n in enumerate((k, coordinates, coordinates, coordinates)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            sets = _shingles(batch.column(1), k, mult)
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            hi = np.array([d >> 64 for d in digests], np.uint64).view(np.int64)
            lo = np.array([d & ((1 << 64) - 1) for d in digests], np.uint64).view(np.int64)
            sig = np.zeros((len(sets), coordinates), np.uint64)
            if len(full):
                h, at = np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(n[full])[:-1]])
                for i in range(coordinates):
                    sig[full, i] = np.minimum.reduceat(h * a[i] + b[i], at)
                sig = spread(sig + tag)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * coordinates + 1, coordinates, np.int32)), pa.array(sig.view(np.int64).ravel()))
            mini = pa.array([x.tobytes() for x in sig.astype(np.uint32)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(hi), pa.array(lo), flat, mini], names=["id", "n", "hi", "lo", "sig", "mini"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, n long, hi long, lo long, sig array<long>, mini binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")


def shingle_sets(docs: DataFrame, reps: DataFrame, k: int, id_col: str, text_col: str, seed: int = 11) -> DataFrame:
    """Rows (id, shingles): the whole set of each document in ``reps(id)`` as packed 64-bit hashes."""
    mult = multipliers(k, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            packed = [x.tobytes() for x in _shingles(batch.column(1), k, mult)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "shingles"])

    return _texts(docs, id_col, text_col).join(reps.hint("shuffle_hash"), "id", "left_semi").mapInArrow(run, "id long, shingles binary")


def prefix_postings(reps: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Rows (rep, n, key, coord, band, low, central, mask): the rarest shared coordinates of each set, in its size band and the next.

    A linked pair shares ``matches_for(similarity)`` coordinates, m of them, so with s
    shared coordinates it meets in one of the s - m + 1 rarest of each side. Coordinates that no other
    set holds need no posting. ``mask`` has the bits of a set's posted coordinates.
    """
    matches = matches_for(similarity)
    posted = reps.select("rep", "n", F.posexplode("sig").alias("coord", "key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    held = posted.join(shared, "key").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key", "coord"))).alias("keys"))
    central = F.aggregate("keys", F.lit(0.0), lambda s, x: s + F.log(x["df"].cast("double")))
    short = held.filter(F.size("keys") >= matches).select("rep", "n", central.alias("central"), F.expr(f"slice(keys, 1, size(keys) - {matches - 1})").alias("keys"))
    mask = F.aggregate("keys", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["coord"])))
    return short.select("rep", "n", "central", mask.alias("mask"), band_of("n", similarity).alias("low"), F.explode("keys").alias("x")).select(
        "rep", "n", F.col("x.key").alias("key"), F.col("x.coord").alias("coord"), F.explode(F.array("low", F.col("low") + 1)).alias("band"), "low", "central", "mask")


def leader_pairs(postings: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's members with its smallest id and with the most central one."""
    leaders = postings.groupBy("key", "band").agg(
        F.count("*").alias("m"), F.max("low").alias("top"), F.min("rep").alias("one"), F.max(F.struct("central", "rep")).alias("two")).filter("m > 1 and top = band")
    met = postings.select("key", "band", "rep").join(leaders, ["key", "band"]).select(F.explode(F.array("one", "two.rep")).alias("l"), "rep").filter("l <> rep")
    return met.select(F.least("l", "rep").alias("a"), F.greatest("l", "rep").alias("b")).distinct()


def enough_collisions(pairs: DataFrame, reps: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) whose signatures collide on ``matches`` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array((one == two).sum(1) >= matches))

    side = lambda name: reps.select(F.col("rep").alias(name), F.col("mini").alias(f"sig_{name}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _cells(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``keys`` columns, each whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        edges = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            part = batch.slice(a, b - a)
            if held and any(held[-1].column(i)[0] != part.column(i)[0] for i in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def merged(sig: np.ndarray, matches: int, fits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b), a < b, of rows of ``sig`` that agree in ``matches`` columns, by prefix and skip merging.

    Each column's values have postings, the sorted rows that hold them. Two rows
    that agree in m of n columns share one of the n - m + 1 rarest postings of
    either, so the merge of these names a row's candidates. ``fits(a, b)`` marks
    the pairs worth counting. The other postings are long: they are not merged but
    looked up for each candidate, and a candidate goes once what is left cannot
    bring it to m. Few rows have no long postings: their pairs are counted together.
    """
    rows, width = sig.shape
    if matches > width or rows < 2:
        return
    if rows <= FEW:
        a, b = np.triu_indices(rows, 1)
        keep = fits(a, b)
        a, b = a[keep], b[keep]
        keep = (sig[a] == sig[b]).sum(1) >= matches
        yield a[keep], b[keep]
        return
    order = np.argsort(sig, 0, kind="stable").astype(np.int32)
    low, high = np.empty((rows, width), np.int32), np.empty((rows, width), np.int32)
    for c in range(width):
        value = sig[order[:, c], c]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        size = np.diff(np.concatenate([first, [rows]]))
        low[order[:, c], c], high[order[:, c], c] = np.repeat(first, size), np.repeat(first + size, size)
    rare = np.argsort(high - low, 1, kind="stable")
    for i in range(rows - 1):
        short, long = rare[i, : width - matches + 1], rare[i, width - matches + 1 :]
        size = high[i, short] - low[i, short]
        if size.sum() > rows - i:  # postings as long as the rows: count along them all
            found = np.arange(i + 1, rows)
            found = found[fits(i, found)]
            count, long = np.zeros(len(found), np.int64), rare[i]
        else:
            lists = [order[low[i, c] : high[i, c], c] for c in short[size > 1]]
            if not lists:
                continue
            found, count = np.unique(np.concatenate([x[np.searchsorted(x, i, "right") :] for x in lists]), return_counts=True)
            keep = fits(i, found)
            found, count = found[keep], count[keep]
        for a in range(0, len(long), SKIP):
            if not len(found):
                break
            some = long[a : a + SKIP]
            count = count + (sig[np.ix_(found, some)] == sig[i, some]).sum(1)
            keep = count + max(0, len(long) - a - SKIP) >= matches
            found, count = found[keep], count[keep]
        found = found[count >= matches]
        if len(found):
            yield np.full(len(found), i), found


def colliding(lists: DataFrame, members: DataFrame, matches: int, block: int = BLOCK) -> DataFrame:
    """Rows (one, two, pairs): packed pairs of different components, by blocks of sets, that collide on ``matches`` coordinates.

    ``lists`` has (key, band, coord, rep, m) and ``members`` one row (rep, mini, comp,
    low, mask, home) per set. A pair is taken in the list of its first common
    posted coordinate and in the band of its larger set only.
    """
    sized = lists.withColumn("parts", F.ceil(F.col("m") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = sized.select("key", "band", "coord", "rep", "own", other).join(members, "rep").select(
        "key", "band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "coord", "rep", "comp", "low", "mask", "home", "mini")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches, 4):
            band, p, q, coord = (cell.column(i)[0].as_py() for i in (1, 2, 3, 5))
            own, rep, comp, low, home = (cell.column(i).to_numpy() for i in (4, 6, 7, 8, 10))
            mask = cell.column(9).to_numpy().view(np.uint64)
            sig = np.frombuffer(b"".join(cell.column(11).to_pylist()), np.uint32).reshape(len(rep), -1)
            bits = np.uint64(1) << np.arange(sig.shape[1], dtype=np.uint64)
            below = np.uint64((1 << coord) - 1)

            def fits(a, b: np.ndarray, own=own, comp=comp, low=low, band=band, apart=p != q) -> np.ndarray:
                fit = (comp[a] != comp[b]) & (np.maximum(low[a], low[b]) == band)
                return fit & (own[a] != own[b]) if apart else fit

            found, held = [], 0
            for a, b in merged(sig, matches, fits):
                own_pair = ((sig[a] == sig[b]) @ bits) & mask[a] & mask[b] & below == 0
                found.append(np.stack([a[own_pair], b[own_pair]]))
                held += int(own_pair.sum())
                if held >= HELD_PAIRS:
                    yield pack(rep, home, found)
                    found, held = [], 0
            if held:
                yield pack(rep, home, found)

    def pack(rep: np.ndarray, home: np.ndarray, found: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(found, 1)
        turn = home[a] > home[b]
        a, b = np.where(turn, b, a), np.where(turn, a, b)
        order = np.lexsort((home[b], home[a]))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], (home[a][1:] != home[a][:-1]) | (home[b][1:] != home[b][:-1])]))
        packed = [x.tobytes() for x in np.split(np.stack([rep[a], rep[b]], 1), first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(home[a][first]), pa.array(home[b][first]), pa.array(packed, pa.binary())], names=["one", "two", "pairs"])

    return dealt.repartition("key", "band", "p", "q").sortWithinPartitions("key", "band", "p", "q").mapInArrow(compare, "one long, two long, pairs binary")


def confirm_packed(packed: DataFrame, sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of ``packed(one, two, pairs)`` with 100 * intersection >= similarity * union on whole sets."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches, 2):
            ids = np.unique(np.frombuffer(b"".join(cell.column(2).to_pylist()), np.int64))
            one, two = (np.full(len(ids), cell.column(i)[0].as_py()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(ids)], names=["one", "two", "id"])

    needed = packed.repartition("one", "two").sortWithinPartitions("one", "two").mapInArrow(named, "one long, two long, id long")
    held = needed.join(sets, "id").select("one", "two", F.lit(0).alias("kind"), "id", F.col("shingles").alias("data"))
    asked = packed.select("one", "two", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("id"), F.col("pairs").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches, 2):
            kind, ids, data = cell.column(2).to_numpy(), cell.column(3).to_numpy(), cell.column(4)
            own = {int(i): np.frombuffer(data[j].as_py(), np.uint64) for j, i in enumerate(ids) if kind[j] == 0}
            pairs = np.unique(np.concatenate([np.frombuffer(data[j].as_py(), np.int64).reshape(-1, 2) for j in np.flatnonzero(kind)]), axis=0)
            # Shingles by number within the cell, so a set is a row of marks and its common shingles are sums over the others.
            place = {i: k for k, i in enumerate(own)}
            size = np.array([len(x) for x in own.values()], np.int64)
            words = np.unique(np.concatenate(list(own.values())), return_inverse=True)[1]
            end = np.cumsum(size)
            mark = np.zeros(int(words.max()) + 1, bool)
            a, b = [], []
            for x in np.unique(pairs[:, 0]):
                to = pairs[pairs[:, 0] == x, 1]
                i, j = place[int(x)], np.array([place[int(y)] for y in to])
                mine = words[end[i] - size[i] : end[i]]
                mark[mine] = True
                common = np.array([np.count_nonzero(mark[words[end[y] - size[y] : end[y]]]) for y in j])
                mark[mine] = False
                good = to[100 * common >= similarity * (size[i] + size[j] - common)]
                a += [int(x)] * len(good)
                b += good.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return held.union(asked).repartition("one", "two").sortWithinPartitions("one", "two", "kind").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, sets: DataFrame, similarity: int = SIMILARITY, members: int = MEMBERS) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= similarity * union on whole sets."""
    # Written first, so that the join below is free to split the partition of a leader of many members.
    splits = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / members).cast("int").alias("splits")), "near-splits")
    dealt = pairs.join(splits, "a").withColumn("part", F.pmod(F.hash("b"), "splits"))
    left = splits.select("a", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("part")).join(sets.withColumnRenamed("id", "a"), "a").select(
        "a", "part", F.lit(0).alias("role"), F.col("a").alias("b"), "shingles")
    right = dealt.join(sets.withColumnRenamed("id", "b"), "b").select("a", "part", F.lit(1).alias("role"), "b", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for x, role, y, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                own = np.frombuffer(raw, np.uint64)
                if role == 0:
                    lead = own
                    continue
                common = len(np.intersect1d(lead, own, assume_unique=True))
                if common and 100 * common >= similarity * (len(lead) + len(own) - common):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return left.union(right).repartition("a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, shingle: int, similarity: int, known: DataFrame | None = None) -> DataFrame:
    """Rows (id, n_shingles, component) of ``docs(id, text)``, whose equal ids have equal texts; ``known(a, b)`` are links besides those of the sets."""
    base = materialize(signatures(docs, shingle, "id", "text"), "near-signatures")
    classes = base.filter("n > 0").groupBy("hi", "lo", "n").agg(F.min("id").alias("rep"))
    classes = materialize(classes, "near-classes")
    reps = materialize(base.select("id", "sig", "mini", "hi", "lo").join(classes.withColumnRenamed("rep", "id"), ["id", "hi", "lo"]).select(F.col("id").alias("rep"), "n", "sig", "mini").dropDuplicates(["rep"]), "near-reps")
    member = base.select("id", "n", "hi", "lo").join(classes.select("hi", "lo", "rep"), ["hi", "lo"], "left")
    member = member.select("id", "n", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")).alias("rep"))
    matches = matches_for(similarity)
    postings = materialize(prefix_postings(reps, similarity), "near-postings")
    first = materialize(enough_collisions(leader_pairs(postings), reps, matches), "near-pairs")
    meet = postings.select(F.col("rep").alias("id")).distinct()
    sets = materialize(shingle_sets(docs, meet, shingle, "id", "text").dropDuplicates(["id"]), "near-sets")
    links = confirm(first, sets, similarity)
    if known is not None:
        side = lambda name: member.select(F.col("id").alias(name), F.col("rep").alias(f"rep_{name}"))
        links = links.union(known.join(side("a"), "a").join(side("b"), "b").select("rep_a", "rep_b"))
    links = materialize(links, "near-links")
    found = components(links)

    labelled = postings.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    mixed = labelled.groupBy("key", "band").agg(
        F.count("*").alias("m"), F.sum("n").alias("total"), F.max("low").alias("top"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y and top = band")
    lists = materialize(labelled.join(mixed.select("key", "band", "m", "total"), ["key", "band"]), "near-lists")
    largest = F.max(F.struct("m", "total", "key", "band")).alias("l")
    blocks = F.greatest(F.ceil(F.col("l.m") / SET_MEMBERS), F.ceil(F.col("l.total") / SET_SHINGLES))
    homes = lists.groupBy("rep", "comp", "low", "mask").agg(largest).select("rep", "comp", "low", "mask", F.xxhash64("l.key", "l.band", F.pmod(F.xxhash64("rep"), blocks)).alias("home"))
    members = homes.join(reps.select("rep", "mini"), "rep")
    packed = materialize(colliding(lists.select("key", "band", "coord", "rep", "m"), members, matches), "near-packed")
    more = materialize(confirm_packed(packed, sets, similarity), "near-links")
    if more.limit(1).count():
        found = components(links.union(more))

    return member.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component"))


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_shingles, component_id, kept``.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer than
    ``shingle`` words is one shingle; null, empty or blank texts have none and link
    with nothing. Documents link at a Jaccard similarity of ``similarity`` percent;
    a component's smallest id stays. Equal sets are one class and always link.
    Rows without an id are left out; rows that repeat an id are returned each, are
    one document and link with all that any of their texts links with. Texts of
    any length are read whole. An empty table gives an empty result. Other columns
    are ignored, whatever their names.
    """
    with scratch(docs.sparkSession):
        texts = _texts(docs, id_col, text_col)
        repeated = materialize(texts.groupBy("id").count().filter("count > 1").select("id"), "near-repeated")
        if not repeated.limit(1).count():
            found = _grouped(texts, shingle, similarity)
        else:  # a node for each text of a repeated id, all of them linked
            nodes = texts.join(repeated.withColumn("again", F.lit(True)), "id", "left").select("id", F.when(F.col("again"), F.xxhash64("id", "text")).otherwise(F.col("id")).alias("node"), "text")
            own = materialize(nodes.select("id", "node").distinct(), "near-nodes")
            first = own.join(repeated, "id", "left_semi").groupBy("id").agg(F.min("node").alias("a"))
            known = own.join(first, "id").filter("node <> a").select("a", F.col("node").alias("b"))
            found = _grouped(nodes.select(F.col("node").alias("id"), "text"), shingle, similarity, known).withColumnRenamed("id", "node")
            least = found.select("node", "component").distinct().join(own, "node").groupBy("component").agg(F.min("id").alias("least"))
            found = found.join(own, "node").join(least, "component").select("id", "n_shingles", F.col("least").alias("component"))
        return materialize(found.select(
            F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept")), "near-result", keep=True)
