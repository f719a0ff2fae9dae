"""Substring deduplication by seeds and extension.

Seeds are winnowed anchors: of the ``SEED``-word grams of every window of
``WINDOW`` words the one of smallest hash, so equal windows have equal anchors.
Anchors are joined across documents. An anchor together with all windows that
chose it is extended both ways at once by the hash of the words those windows
span: where an earlier document holds the same span every window repeats. Anchors
that are shared with other surroundings are extended window by window to the
farthest repeat. Overlapping repeats unite into the maximal ones, and their words go.
Spans and windows are compared by their hash beside that of their anchor, 128 bits
in all. A task sends one row for what its documents share, so a passage that all
documents hold is as many rows as there are runs of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalox.llm.common import HashMemo, chunks, materialize, multipliers, split_words, spread, word_hashes

WINDOW = 13
SEED = 4
#: Anchors, or windows to compare, that a task gathers before it decides among them; what many of its documents share leaves as one row.
RUN_ROWS = 1 << 20
#: Low bits that hold a word's place in a chunk while windows choose their anchors.
PLACE_BITS = 28
#: Bits of a place in a document; those above tell the texts of a repeated id apart.
COPY_BITS = 40
#: Anchor states: all its windows repeat; its windows must be compared one by one.
REPEATS, COMPARE = 1, 2


class Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            ones = np.full(n, self.base, np.uint64), np.full(n, self.inverse, np.uint64)
            for x in ones:
                x[0] = 1
            self.up, self.down = (np.multiply.accumulate(x) for x in ones)
        return self.up[:n], self.down[:n]


class Grams:
    """Anchors and windows of a run of documents, as arrays over the words of all of them.

    Hashes of word runs come from prefix sums of the words' hashes times powers of
    an odd base, so each is one difference.
    """

    def __init__(self, texts: pa.Array, window: int, seed: int, memo: HashMemo, powers: Powers):
        words, counts = split_words(texts)
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        w = word_hashes(words, memo)
        doc = np.repeat(np.arange(len(texts)), counts)
        total = len(w) - window + 1
        if total <= 0:
            self.window_at = self.anchor_of = self.anchors = self.doc = np.zeros(0, np.int64)
            self.window_hash = self.anchor_hash = self.span_hash = np.zeros(0, np.uint64)
            return
        up, down = powers.upto(len(w) + 1)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up[:-1])])

        def run(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return (upto[high] - upto[low]) * down[low]

        self.window_at = np.flatnonzero(doc[:total] == doc[window - 1 :])
        # The least gram of each window and, of equal ones, the last: hash bits above, the place from the end below.
        place = np.arange(len(w) - seed + 1)
        grams = spread((upto[seed:] - upto[:-seed]) * down[: len(place)])
        least = (grams & np.uint64(~((1 << PLACE_BITS) - 1) & (1 << 64) - 1)) | ((1 << PLACE_BITS) - 1 - place).astype(np.uint64)
        width, have = window - seed + 1, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        chosen = ((1 << PLACE_BITS) - 1) - (least[self.window_at] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        # Windows that share an anchor follow one another; an anchor is named by its place.
        head = np.concatenate([[True], chosen[1:] != chosen[:-1]]) if len(chosen) else np.zeros(0, bool)
        first = np.flatnonzero(head)
        self.anchors, self.anchor_of = chosen[first], np.cumsum(head) - 1
        runs = np.diff(np.concatenate([first, [len(chosen)]]))
        self.doc = doc[self.anchors]
        self.anchor_hash = grams[self.anchors]
        self.window_hash = spread(run(self.window_at, self.window_at + window) + np.uint64(window))
        low = self.window_at[first]
        high = self.window_at[first + runs - 1] + window if len(first) else low
        self.span_hash = spread(run(low, high) + ((self.anchors - low).astype(np.uint64) << np.uint64(32)) + (high - low).astype(np.uint64))

    def ordinals(self) -> np.ndarray:
        """The number of each anchor within its document."""
        if not len(self.doc):
            return self.doc
        first = np.flatnonzero(np.concatenate([[True], self.doc[1:] != self.doc[:-1]]))
        return np.arange(len(self.doc)) - np.repeat(first, np.diff(np.concatenate([first, [len(self.doc)]])))


def _first_in_run(key: np.ndarray, seed: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (key, seed, id); for each row in that order the smallest id of its key and seed here, and whether they have several ids."""
    order = np.lexsort((ids, seed, key))
    k, x, i = key[order], seed[order], ids[order]
    head = np.concatenate([[True], (k[1:] != k[:-1]) | (x[1:] != x[:-1])])[: len(k)]
    group = np.cumsum(head) - 1
    least = i[head][group]
    most = i[np.concatenate([head[1:], [True]])[: len(k)]][group]
    return order, least, most > least


def _runs(parts: Iterator[tuple[np.ndarray, ...]], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of successive parts joined into runs of about ``most`` rows."""
    held: list[tuple[np.ndarray, ...]] = []
    for part in parts:
        held.append(part)
        if sum(len(x[0]) for x in held) >= most:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def seeds(docs: DataFrame, window: int, seed: int, mult: np.ndarray, run_rows: int = RUN_ROWS) -> DataFrame:
    """Rows (id, ordinal, anchor, span, state).

    Within a run of documents an anchor leaves as one row, that of its smallest
    id, for the join across runs. The other rows are decided here: they are
    shared, and they repeat if an earlier document of the run has their span.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        memo, powers = HashMemo(), Powers(int(mult[2]))
        for batch in chunks(batches, "text"):
            g = Grams(batch.column(1), window, seed, memo, powers)
            if len(g.anchors):
                yield batch.column(0).to_numpy()[g.doc], g.ordinals() + _copies(batch)[g.doc], g.anchor_hash, g.span_hash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ordinal, anchors, spans in _runs(found(batches), run_rows):
            state = np.zeros(len(ids), np.int8)
            order, least, several = _first_in_run(anchors, anchors, ids)
            shared_here = np.zeros(len(ids), bool)
            shared_here[order] = several
            state[order[ids[order] > least]] = COMPARE
            order, least, _ = _first_in_run(spans, anchors, ids)
            state[order[ids[order] > least]] = REPEATS
            state[(state == 0) & shared_here] = -COMPARE
            own = spread(ids.view(np.uint64) * mult[0] + ordinal.view(np.uint64) * mult[1])
            anchor = np.where(state > 0, own, anchors)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(ordinal), pa.array(anchor.view(np.int64)), pa.array(spans.view(np.int64)), pa.array(state)],
                names=["id", "ordinal", "anchor", "span", "state"])

    return docs.mapInArrow(run, "id long, ordinal long, anchor long, span long, state byte")


def _join_seeds(found: DataFrame) -> DataFrame:
    """Rows (id, ordinal, state) of the anchors that several documents hold. Decided rows pass alone under keys of their own."""
    every, same = Window.partitionBy("anchor"), Window.partitionBy("anchor", "span")
    joined = found.repartition("anchor").withColumn("same", F.min("id").over(same)).withColumn("least", F.min("id").over(every)).withColumn("most", F.max("id").over(every))
    state = (
        F.when(F.col("state") > 0, F.col("state"))
        .when(F.col("same") < F.col("id"), REPEATS)
        .when((F.col("least") < F.col("most")) | (F.col("state") < 0), COMPARE))
    return joined.select("id", "ordinal", state.cast("byte").alias("state")).filter("state is not null")


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", run_rows: int = RUN_ROWS) -> DataFrame:
    """Documents without repeated passages: ``id_col, n_words, n_removed, kept, spans``.

    Words are runs without ASCII white space, unchanged; a null or empty text has
    none. A word goes if a window of ``window`` words that covers it starts in a
    document of smaller id as well. ``spans`` lists the maximal repeats as word
    positions [from, to); ``kept`` joins the other words by one space. Of equal
    windows only those in the document of the smallest id stay, however often it
    holds them. Rows without an id are left out; rows that repeat an id are one
    document's, each judged by its own text. Texts of any length are read whole, one at least at a time. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    mult = multipliers(3, 23)
    texts = _texts(docs, id_col, text_col)
    shared = materialize(_join_seeds(seeds(texts, window, seed, mult, run_rows)), "substring-seeds", keep=True)
    states = shared.groupBy("id").agg(F.collect_list(F.struct("ordinal", "state")).alias("states"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        memo, powers = HashMemo(), Powers(int(mult[2]))
        for batch in chunks(batches, "text"):
            g = Grams(batch.column(1), window, seed, memo, powers)
            copies = _copies(batch)
            state = _states(g, batch.column(3), copies)[g.anchor_of] if len(g.anchors) else np.zeros(0, np.int8)
            doc = g.doc[g.anchor_of] if len(g.anchors) else g.doc
            at = np.flatnonzero(state == COMPARE)
            place = g.window_at[at] - g.starts[doc[at]]
            # Whole repeats leave as runs of windows that follow one another.
            whole = np.flatnonzero(state == REPEATS)
            apart = np.flatnonzero((np.diff(g.window_at[whole]) > window) | (np.diff(doc[whole]) > 0)) + 1
            edges = np.concatenate([[0], apart, [len(whole)]]) if len(whole) else np.zeros(1, np.int64)
            a, b = whole[edges[:-1]], whole[edges[1:] - 1]
            ids = batch.column(0).to_numpy()[np.concatenate([doc[at], doc[a]])]
            stop = np.concatenate([place + window, g.window_at[b] + window - g.starts[doc[b]]])
            place = np.concatenate([place, g.window_at[a] - g.starts[doc[a]]])
            none, copy = np.zeros(len(a), np.uint64), copies[np.concatenate([doc[at], doc[a]])]
            seed_of = g.anchor_hash[g.anchor_of[at]] if len(at) else np.zeros(0, np.uint64)
            yield ids, place + copy, stop + copy, np.concatenate([g.window_hash[at], none]), np.concatenate([seed_of, none]), np.arange(len(ids)) >= len(at)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, place, stop, key, seed_of, later in _runs(found(batches), run_rows):
            at = np.flatnonzero(~later)
            order, least, _ = _first_in_run(key[at], seed_of[at], ids[at])
            later[at[order[ids[at][order] > least]]] = True
            # Decided rows pass alone under keys of their own.
            key = np.where(later, spread(ids.view(np.uint64) * mult[0] + place.view(np.uint64) * mult[1]), key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(place), pa.array(stop), pa.array(key.view(np.int64)), pa.array(seed_of.view(np.int64)), pa.array(later)],
                names=["id", "place", "stop", "gram", "seed", "later"])

    grams = texts.join(states.hint("shuffle_hash"), "id", "left").mapInArrow(extend, "id long, place long, stop long, gram long, seed long, later boolean")
    first = F.min("id").over(Window.partitionBy("gram", "seed"))
    repeats = grams.withColumn("before", first).filter("later or before < id").groupBy("id").agg(F.collect_set(F.struct("place", "stop")).alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words, counts = split_words(batch.column(1))
            starts = np.concatenate([[0], np.cumsum(counts)])
            found = batch.column(3)
            own = np.repeat(np.arange(len(found)), pc.fill_null(pc.list_value_length(found), 0).to_numpy())
            place, stop = (x.to_numpy() - _copies(batch)[own] for x in found.flatten().flatten())
            mine = (place >= 0) & (place < 1 << COPY_BITS)
            place, stop = (starts[own[mine]] + x[mine] for x in (place, stop))
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, place, 1)
            np.add.at(edge, stop, -1)
            gone = np.cumsum(edge)[:-1] > 0
            upto = np.concatenate([[0], np.cumsum(~gone)])[starts]
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), words.filter(pa.array(~gone))), " ")
            # Runs of words that go, within each document.
            doc = np.repeat(np.arange(len(counts)), counts)
            here, same = np.concatenate([[False], gone, [False]]), np.concatenate([[-1], doc, [-1]])
            begin = np.flatnonzero(here[1:-1] & ~(here[:-2] & (same[:-2] == same[1:-1])))
            end = np.flatnonzero(here[1:-1] & ~(here[2:] & (same[2:] == same[1:-1]))) + 1
            spans = pa.StructArray.from_arrays([pa.array(x - starts[doc[begin]], pa.int64()) for x in (begin, end)], ["from", "to"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, starts).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(counts - np.diff(upto), pa.int64()), kept, spans], names=["id", "n_words", "n_removed", "kept", "spans"])

    final = texts.join(repeats.hint("shuffle_hash"), "id", "left").mapInArrow(
        cut, "id long, n_words long, n_removed long, kept string, spans array<struct<from: long, to: long>>")
    return final.withColumnRenamed("id", id_col)


def _states(g: Grams, column: pa.Array, copies: np.ndarray) -> np.ndarray:
    """The state of each anchor of the batch, 0 where the anchor is not shared; of two states of an anchor the lesser."""
    state = np.zeros(len(g.anchors), np.int8)
    own = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy())
    ordinal, found = column.flatten().flatten()
    ordinal = ordinal.to_numpy() - copies[own]
    mine = (ordinal >= 0) & (ordinal < 1 << COPY_BITS)
    at, found = np.searchsorted(g.doc, own[mine]) + ordinal[mine], found.to_numpy()[mine]
    order = np.argsort(-found, kind="stable")  # the least is written last
    state[at[order]] = found[order]
    return state


def _copies(batch: pa.RecordBatch) -> np.ndarray:
    """What the places of each row's text carry above ``COPY_BITS``."""
    return batch.column(2).to_numpy().astype(np.int64) << COPY_BITS


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, text, copy); the different texts of a repeated id are numbered."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    repeated = materialize(texts.groupBy("id").count().filter("count > 1").select("id", F.lit(True).alias("again")), "substring-repeated", keep=True)
    if not repeated.limit(1).count():
        return texts.withColumn("copy", F.lit(0))
    texts = texts.join(repeated, "id", "left")
    number = F.dense_rank().over(Window.partitionBy("id", F.coalesce("again", F.lit(False))).orderBy("text")) - 1
    return texts.filter("again is null").select("id", "text", F.lit(0).alias("copy")).union(texts.filter("again").select("id", "text", number.alias("copy")))


def substring_digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return result.select(id_col, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
