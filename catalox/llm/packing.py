"""Best-fit packing by a configuration linear program over the length histogram.

Only the histogram of piece lengths, at most ``capacity`` counts, reaches the
driver. Multiplicative weights price the lengths, a knapsack dynamic programme
finds the configurations of greatest price, and the fractional counts are rounded
down; the counts that rounding leaves go by best fit. Pieces then take their places by their rank within their length, so no token and no
piece passes through the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalox.llm.common import chunks, materialize
from catalox.llm.tokens import ChunkTokenizer

CAPACITY = 2048
#: Rows of one length that one task ranks.
RANK_ROWS = 500
#: Pricing rounds of the fractional phase, and configurations taken from each.
ROUNDS, TAKE = 150, 32
#: Exponent of the weights, the share of a length's missing cover that one step adds, and the least price of a configuration beside the best of its round.
ETA, STEP, NEAR = 1.0, 0.5, 0.995


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids and a closing 0, cut at ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer)
        for batch in chunks(batches, "text"):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), tok.encode(batch.column(1)), strict=True):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best price and last item for each room 0..capacity; items may repeat. ``lengths`` ascend."""
    best = np.zeros(capacity + 1)
    item = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room], item[room] = best[room - 1], -2
        if k := upto[room]:
            value = best[room - lengths[:k]] + price[:k]
            j = int(value.argmax())
            if value[j] > best[room]:
                best[room], item[room] = value[j], j
    return best, item


def _configuration(start: int, lengths: np.ndarray, item: np.ndarray, capacity: int) -> dict[int, int]:
    """Counts by index of the best configuration that holds item ``start``."""
    found, room = {start: 1}, capacity - int(lengths[start])
    while room > 0 and item[room] != -1:
        if item[room] == -2:
            room -= 1
            continue
        j = int(item[room])
        found[j] = found.get(j, 0) + 1
        room -= int(lengths[j])
    return found


def _priced(lengths: np.ndarray, price: np.ndarray, capacity: int, take: int) -> list[dict[int, int]]:
    """The ``take`` configurations of greatest price among the best ones that hold each length, as far as they come near the best of all."""
    best, item = _knapsack(lengths, price, capacity)
    value = price + best[capacity - lengths]
    return [_configuration(int(j), lengths, item, capacity) for j in np.argsort(-value, kind="stable")[:take] if value[j] >= NEAR * value.max()]


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, take: int = TAKE) -> list[tuple[int, dict[int, int]]]:
    """Configurations ``(copies, {length: count})`` that hold exactly the histogram's pieces."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    if not len(lengths):
        return []
    need = np.array([histogram[int(k)] for k in lengths], np.int64)
    base = lengths / capacity

    # Fractional phase: a weight falls as its length gets covered ahead of the rounds, so prices favour what lags.
    cover = np.zeros(len(lengths))
    amount: dict[tuple, float] = {}
    for done in range(rounds if len(lengths) > 1 else 0):
        price = base * np.exp(-ETA * (cover - (done + 1) / rounds).clip(-1, 1))
        for found in _priced(lengths, price, capacity, take):
            step = STEP * min(max(0.0, 1 - cover[j]) * need[j] / a for j, a in found.items())
            if step > 0:
                key = tuple(sorted(found.items()))
                amount[key] = amount.get(key, 0.0) + step
                for j, a in found.items():
                    cover[j] += a * step / need[j]

    # Rounding: whole copies of the fractional solution within what is left; the remainder goes by best fit.
    left = need.copy()
    chosen: list[tuple[int, dict[int, int]]] = []
    for key, x in sorted(amount.items(), key=lambda kv: (-kv[1], kv[0])):
        copies = int(min(x, *(left[j] // a for j, a in key)))
        if copies > 0:
            chosen.append((copies, {int(lengths[j]): a for j, a in key}))
            for j, a in key:
                left[j] -= copies * a
    chosen += _best_fit(lengths, left, capacity)
    plain = _best_fit(lengths, need, capacity)  # few lengths of small counts can lose more to rounding than the programme gains
    return min(chosen, plain, key=lambda found: sum(copies for copies, _ in found))


def _best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing on counts: equal bins move together, so the work follows kinds of bins, not pieces."""
    by_room: dict[int, list[list]] = {}  # room -> [[copies, {length: count}]]
    for i in range(len(lengths) - 1, -1, -1):
        size, rest = int(lengths[i]), int(left[i])
        while rest > 0:
            room = next((r for r in range(size, capacity) if by_room.get(r)), None)
            if room is None:
                fit = capacity // size
                for a, copies in ((fit, rest // fit), (rest % fit, 1)):
                    if a and copies:
                        by_room.setdefault(capacity - a * size, []).append([copies, {size: a}])
                rest = 0
                continue
            kind = by_room[room][-1]
            copies = min(kind[0], rest)
            held = dict(kind[1])
            held[size] = held.get(size, 0) + 1
            kind[0] -= copies
            if not kind[0]:
                by_room[room].pop()
            by_room.setdefault(room - size, []).append([copies, held])
            rest -= copies
    return [(copies, held) for kinds in by_room.values() for copies, held in kinds]


def places(chosen: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from_rank, to_rank, each, first_sequence, first_offset) that place the ranks of each length."""
    rows, used, sequence = [], {}, 0
    for copies, held in chosen:
        offset = 0
        for size, a in sorted(held.items(), reverse=True):
            at = used.get(size, 0)
            rows.append((size, at, at + copies * a, a, sequence, offset))
            used[size] = at + copies * a
            offset += a * size
        sequence += copies
    return rows


def bucketed(slots: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """The rows of :func:`places` by buckets of ranks, (bucket, *row), and (length, ranks of a bucket): as many buckets as a length has rows, so a piece meets a few rows only."""
    most, count = {}, {}
    for size, _, to, *_ in slots:
        most[size], count[size] = max(to, most.get(size, 0)), count.get(size, 0) + 1
    width = {size: -(-most[size] // count[size]) for size in most}
    return [(b, *row) for row in slots for b in range(row[1] // width[row[0]], (row[2] - 1) // width[row[0]] + 1)], sorted(width.items())


def ranked(found: DataFrame, rank_rows: int = RANK_ROWS) -> DataFrame:
    """``found`` with the rank of each piece within its length; a frequent length is ranked in parts of as many rows as it has parts."""
    counts = found.groupBy("length").agg(F.count("*").alias("n"))
    parts = counts.select("length", F.ceil(F.col("n") / F.greatest(F.lit(rank_rows), F.sqrt("n"))).alias("parts"))
    found = found.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), "parts")).drop("parts")  # lengths are at most the capacity
    sizes = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece"))
    return found.withColumn("own", own).join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own") - 1)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``. A null or empty text is the closing 0 alone. Only documents longer
    than ``capacity`` are cut. Rows without an id are left out; rows that repeat an
    id are packed each. An empty table gives an empty result. Equal lengths
    are placed by a hash of id and piece. Texts of any length are encoded whole. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    found = materialize(pieces(docs, tokenizer or default_tokenizer(), capacity, id_col, text_col), "packing-pieces")
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    whole = histogram.pop(capacity, 0)
    chosen = ([(whole, {capacity: 1})] if whole else []) + solve(histogram, capacity)
    rows, widths = bucketed(places(chosen))  # as many rows as configurations have lengths, twice at most
    slots = spark.createDataFrame(rows, "bucket long, length long, from_rank long, to_rank long, each long, first_sequence long, first_offset long")
    widths = spark.createDataFrame(widths, "length long, width long")  # lengths are at most the capacity
    at = F.col("rank") - F.col("from_rank")
    placed = ranked(found).join(F.broadcast(widths), "length").withColumn("bucket", F.floor(F.col("rank") / F.col("width")))
    return placed.join(slots, ["length", "bucket"]).filter("rank >= from_rank and rank < to_rank").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (at % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
