"""Approximate nearest neighbours with an adaptive dimension scan inside inverted lists.

Vectors are rotated by a seeded orthogonal matrix, so any few leading dimensions
estimate a distance, and dealt to the list of their nearest centroid. A query
first scans its nearest list, which bounds the distance it still looks for, and
then probes further lists, as many as the sample of the centroids shows to be
needed. A cell, one part of a list with one block of its queries, reads the
rotated vectors in column blocks; after each block a hypothesis test drops the
pairs whose partial distance is too large for them to be among the nearest.
Distances returned are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalox.llm.common import materialize, scratch

#: Vectors, and numbers in them, that fit the centroids; every vector is indexed.
SAMPLE, SAMPLE_NUMBERS = 50_000, 6_000_000
#: Sampled vectors for each list at least; fewer would not place its centroid.
LIST_SAMPLE = 12
LLOYD_ROUNDS = 8
#: Sampled vectors whose neighbours in the sample set the number of lists that a query probes, and the share of those neighbours it must reach.
TRIALS, REACH = 500, 0.95
#: Vectors of a list part and queries of a block.
PART, QUERY_BLOCK = 4096, 256
#: Dimensions of a column block, and the test's width in standard errors of a partial distance.
COLUMNS, EPSILON = 16, 2.5
#: Share of pairs still alive below which they go on one by one.
SPARSE = 0.1


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _usable(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and vectors (as doubles) of the usable rows: not null, of this size, all numbers finite, not all zero."""
    size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dims)
    flat = vectors.take(pa.array(at)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), dims)  # a null number is NaN
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[good], x[good]


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances but for the rows' own squares."""
    return (c * c).sum(1) - 2 * x @ c.T


def centroids(sample: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Lloyd's rounds from seeded distinct rows of the sample."""
    distinct = np.unique(sample, axis=0)
    c = distinct[np.random.default_rng(seed).permutation(len(distinct))[:lists]].copy()
    for _ in range(LLOYD_ROUNDS):
        own = _ranked(sample, c, 1)[:, 0]
        n = np.bincount(own, minlength=len(c))
        total = np.stack([np.bincount(own, column, len(c)) for column in sample.T], 1)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
    return c


def _ranked(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of each row, nearest first."""
    out = np.zeros((len(x), k), np.int64)
    for a in range(0, len(x), 4096):
        d = _distances(x[a : a + 4096], c)
        out[a : a + 4096] = d.argmin(1)[:, None] if k == 1 else np.argsort(d, 1, kind="stable")[:, :k]
    return out


def probes_for(sample: np.ndarray, c: np.ndarray, k: int, trials: int = TRIALS, reach: float = REACH) -> int:
    """Lists that a query must probe to meet ``reach`` of its ``k`` nearest, measured inside the sample."""
    own = _ranked(sample, c, 1)[:, 0]
    asked = np.linspace(0, len(sample) - 1, min(trials, len(sample))).astype(int)
    ranks = []
    for q in asked:
        d = ((sample - sample[q]) ** 2).sum(1)
        d[q] = np.inf
        near = np.argpartition(d, min(k, len(d) - 1))[: min(k, len(d) - 1)]
        order = np.empty(len(c), np.int64)
        order[np.argsort(_distances(sample[q : q + 1], c)[0], kind="stable")] = np.arange(len(c))
        ranks.append(order[own[near]])
    ranks = np.sort(np.concatenate(ranks)) if ranks else np.zeros(0, np.int64)
    return int(ranks[min(len(ranks) - 1, int(np.ceil(reach * len(ranks))))]) + 1 if len(ranks) else len(c)


def scan(queries: np.ndarray, rotated: np.ndarray, limit: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that may be among the ``k`` nearest of rotated queries.

    ``limit`` is the square of a distance that each query has reached (infinity at
    first; then a first part of the candidates sets it). A pair goes once its partial
    square over d of D dimensions exceeds limit * d / D * (1 + EPSILON / sqrt(d))^2,
    and at D dimensions once it exceeds the limit itself.
    """
    n, dims = rotated.shape
    limit = limit.copy()
    open_ = np.flatnonzero(~np.isfinite(limit))
    if len(open_) and n > 4 * k:
        first = rotated[: 4 * k]
        d = (queries[open_] ** 2).sum(1)[:, None] + _distances(queries[open_], first)
        if own is not None:
            d[own[open_, : 4 * k]] = np.inf
        limit[open_] = np.partition(d, k - 1, 1)[:, k - 1]
    limit = limit * (1 + 1e-6) + 1e-9  # sums in another order than the exact ones
    part = np.zeros((len(queries), n))
    alive = np.ones((len(queries), n), bool)
    for d in range(0, dims, COLUMNS):
        q, x = queries[:, d : d + COLUMNS], rotated[:, d : d + COLUMNS]
        seen = min(d + COLUMNS, dims)
        most = limit * (seen / dims * (1 + EPSILON / np.sqrt(seen)) ** 2 if seen < dims else 1)
        if alive is not None:
            part += (q * q).sum(1)[:, None] + _distances(q, x)
            alive = part <= most[:, None]
            if alive.mean() < SPARSE or seen == dims:
                at, to = np.nonzero(alive)
                part, alive = part[at, to], None
            continue
        part = part + ((x[to] - q[at]) ** 2).sum(1)
        keep = part <= most[at]
        at, to, part = at[keep], to[keep], part[keep]
    return at, to


def exact_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` to those of ``y``, summed over the dimensions in order."""
    return np.sqrt(np.add.accumulate((x - y) ** 2, axis=1)[:, -1])


def _common_size(vectors: DataFrame) -> int:
    """The most frequent size of usable vectors; of equally frequent ones the smallest."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    sizes = vectors.filter(F.coalesce(finite, F.lit(False))).groupBy(F.size("embedding").alias("size")).count()
    most = sizes.orderBy(F.desc("count"), "size").first()
    return most["size"] if most else 0


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, reach: float = REACH, sample: int = SAMPLE, part: int = PART, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, nearest first.

    ``vectors`` and ``queries`` have ``vec_id`` and ``embedding``. A query's own id is
    no candidate. Equal distances rank by smaller ``vec_id``. Vectors that are null,
    empty, zero, of another size than most usable ones, or that hold a null or a
    number that is not finite take no part; rows without an id are left out, rows
    that repeat an id are candidates each. Where the vectors gather in lists a query
    probes few of them; where they have no structure it probes most. A query for
    which the probed lists hold fewer than ``k`` candidates goes on to all lists. An
    empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    vectors, queries = (t.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and size(embedding) > 0") for t in (vectors, queries))
    schema = "query_id long, rank int, vec_id long, score double"
    if not (dims := _common_size(vectors)):
        return spark.createDataFrame([], schema)
    n = vectors.count()
    want = min(sample, max(1000, SAMPLE_NUMBERS // dims))
    taken = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int(min(1.0, want / n) * (1 << 40))) if n > want else vectors
    x = _usable(taken.select("embedding").toArrow().column(0).combine_chunks(), dims)[1]
    if not len(x):  # a thin sample of mostly unusable rows
        x = _usable(vectors.limit(want).select("embedding").toArrow().column(0).combine_chunks(), dims)[1]
    turn = rotation(dims)
    c = centroids(x @ turn, max(1, min(int(np.sqrt(n)), len(x) // LIST_SAMPLE)))
    probes = probes_for(x @ turn, c, k, reach=reach)
    with scratch(spark):
        rows = materialize(_search(vectors, queries, dims, turn, c, probes, k, part, query_block), "ann-rows")
        # Queries that met too few candidates, as where lists are nearly empty, scan every list.
        if probes < len(c):
            met = rows.groupBy("query_id").count()
            short = queries.join(met.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").filter(F.coalesce("count", F.lit(0)) < min(k, n - 1)).select("vec_id", "embedding")
            short = materialize(short, "ann-short")
            if short.limit(1).count():
                more = _search(vectors, short, dims, turn, c, len(c), k, part, query_block)
                rows = rows.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(*rows.columns).union(more)
        return materialize(rows, "ann-result", keep=True)


def _search(vectors: DataFrame, queries: DataFrame, dims: int, turn: np.ndarray, c: np.ndarray, probes: int, k: int, part: int, query_block: int) -> DataFrame:
    def assign(k_lists: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, own = _usable(batch.column(1), dims)
                to = _ranked(own @ turn, c, k_lists)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(own) * k_lists + 1, k_lists, np.int32)), pa.array(to.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), flat, pa.array([r.tobytes() for r in own], pa.binary())], names=["vec_id", "lists", "raw"])

        return run

    schema = "vec_id long, lists array<int>, raw binary"
    indexed = materialize(vectors.mapInArrow(assign(1), schema).select("vec_id", F.col("lists")[0].alias("list"), "raw"), "ann-index")
    probed = materialize(queries.mapInArrow(assign(probes), schema), "ann-probes")
    near = materialize(_scanned(indexed, probed.select("vec_id", F.col("lists")[0].alias("list"), "raw", F.lit(float("inf")).alias("limit")), dims, turn, k, part, query_block), "ann-near")
    if probes == 1:
        return near
    reached = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.max(F.when(F.col("rank") == k, F.col("score") * F.col("score"))).alias("limit"))
    asked = probed.join(reached, "vec_id", "left").select("vec_id", F.explode(F.slice("lists", 2, probes)).alias("list"), "raw", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    far = _scanned(indexed, asked, dims, turn, k, part, query_block)
    return _best(near.select("query_id", "vec_id", "score").union(far.select("query_id", "vec_id", "score")), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scanned(indexed: DataFrame, asked: DataFrame, dims: int, turn: np.ndarray, k: int, part: int, query_block: int) -> DataFrame:
    """The ``k`` nearest of each query among the lists it asks for: a cell for each part of a list with each block of its queries."""
    shape = indexed.groupBy("list").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).join(
        asked.groupBy("list").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks")), "list")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    held = indexed.join(F.broadcast(shape), "list").select("list", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), every("blocks").alias("block"), "vec_id", "raw")  # as many rows as lists, which the sample bounds
    wanted = asked.join(F.broadcast(shape), "list").select("list", every("parts").alias("part"), F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "vec_id", "raw", "limit")

    def cell(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(have) or not len(want):
            return none
        ids, x = have["vec_id"].to_numpy(), _rows(have["raw"], dims)
        q_ids, q = want["vec_id"].to_numpy(), _rows(want["raw"], dims)
        at, to = scan(q @ turn, x @ turn, want["limit"].to_numpy(), k, q_ids[:, None] == ids)
        keep = ids[to] != q_ids[at]
        at, to = at[keep], to[keep]
        score = np.concatenate([exact_distance(x[to[a : a + 65_536]], q[at[a : a + 65_536]]) for a in range(0, len(at), 65_536)] or [np.zeros(0)])
        order = np.lexsort((ids[to], score, at))
        at, to, score = at[order], to[order], score[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        best = np.arange(len(at)) - np.repeat(first, np.diff(np.concatenate([first, [len(at)]]))) < k
        return pd.DataFrame({"query_id": q_ids[at[best]], "vec_id": ids[to[best]], "score": score[best]})

    key = ["list", "part", "block"]
    return _best(held.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInPandas(cell, "query_id long, vec_id long, score double"), k)


def _rows(raw: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(-1, dims)
