"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

The state is a table of shards. Each shard holds the exact number of documents of
each line key, sorted, and a cuckoo filter of the keys present. Documents come in
batches: inserting adds to the counts and deleting subtracts from them, so a
deletion undoes an insertion exactly. Within a shard the filter answers for keys
that were never seen, and only the others are looked up in the exact table. Shards
split as the state grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalox.llm.common import chunks, materialize, scratch

#: ASCII white space, as the line keys strip it.
STRIP = " \t\n\x0b\x0c\r"
#: Documents in which a key must occur for its lines to go.
MIN_DOCS = 10
#: Code points a key must have to count.
MIN_CHARS = 1
#: Distinct keys planned for one shard, and batches in which the documents are inserted.
SHARD_KEYS, BATCHES = 100_000, 2
#: Slots of a filter bucket, rounds of moves before a filter grows, and the load it is sized for.
SLOTS, ROUNDS, LOAD = 4, 200, 0.8

STATE = "shard int, shards int, hi array<long>, lo array<long>, docs array<long>, filter binary"


class CuckooFilter:
    """Partial-key cuckoo filter: 16-bit fingerprints, four slots a bucket, deletion supported; works on arrays of keys."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = len(table) - 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(np.zeros((1 << max(4, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * LOAD))))), SLOTS), np.uint16))

    @classmethod
    def of(cls, lo: np.ndarray) -> CuckooFilter:
        """A filter of these distinct keys, as large as it takes."""
        size = len(lo)
        while not (made := cls.sized(size)).add(lo):
            size = 2 * max(size, 1)
        return made

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def places(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each key; the buckets differ by a hash of the fingerprint."""
        u = lo.astype(np.int64).view(np.uint64)
        mark = ((u >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        one = (u & np.uint64(self.mask)).astype(np.int64)
        return mark, one, one ^ self._hop(mark)

    def _hop(self, mark: np.ndarray) -> np.ndarray:
        return ((mark.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(self.mask)).astype(np.int64)

    def contains(self, lo: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(lo)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(1)

    def _settle(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets; which of them found one."""
        order = np.argsort(at, kind="stable")
        bucket = at[order]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        nth = np.arange(len(bucket)) - np.repeat(first, np.diff(np.concatenate([first, [len(bucket)]])))
        free = self.table[bucket] == 0
        fits = nth < free.sum(1)
        # The nth newcomer of a bucket takes its nth free slot.
        slot = (free & (free.cumsum(1) == nth[:, None] + 1)).argmax(1)
        self.table[bucket[fits], slot[fits]] = mark[order[fits]]
        settled = np.zeros(len(mark), bool)
        settled[order[fits]] = True
        return settled

    def add(self, lo: np.ndarray) -> bool:
        """Insert distinct keys; False where rounds of moves found no room and the filter must grow."""
        if not len(lo):
            return True
        mark, one, two = self.places(lo)
        left = ~self._settle(mark, one)
        mark, at = mark[left], two[left]
        random = np.random.default_rng(7)
        for _ in range(ROUNDS):
            if not len(mark):
                return True
            left = ~self._settle(mark, at)
            mark, at = mark[left], at[left]
            if not len(mark):
                return True
            # One newcomer of each full bucket takes the place of a mark there, which moves to its other bucket.
            turn = np.unique(at, return_index=True)[1]
            slot = random.integers(SLOTS, size=len(turn))
            out = self.table[at[turn], slot]
            self.table[at[turn], slot] = mark[turn]
            mark[turn] = out
            at[turn] = at[turn] ^ self._hop(out)
        return False

    def _clear(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Take marks out of their buckets; which of them were there."""
        order = np.lexsort((mark, at))
        bucket, own = at[order], mark[order]
        first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (own[1:] != own[:-1])]))
        nth = np.arange(len(own)) - np.repeat(first, np.diff(np.concatenate([first, [len(own)]])))
        same = self.table[bucket] == own[:, None]
        hit = nth < same.sum(1)
        slot = (same & (same.cumsum(1) == nth[:, None] + 1)).argmax(1)
        self.table[bucket[hit], slot[hit]] = 0
        cleared = np.zeros(len(own), bool)
        cleared[order[hit]] = True
        return cleared

    def remove(self, lo: np.ndarray) -> None:
        """Take out one mark of each key; all of them are in."""
        if len(lo):
            mark, one, two = self.places(lo)
            left = ~self._clear(mark, one)
            if left.any():
                self._clear(mark[left], two[left])


def _line_hashes(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """For all lines of the texts in a row: document, and a row of ``table`` (hi, lo) or -1 where the key is too short; and the lines."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    n = pc.list_value_length(lines).to_numpy()
    flat = lines.flatten()
    keys = pc.ascii_lower(pc.ascii_trim(flat, characters=STRIP)).dictionary_encode()
    words = keys.dictionary
    digests = [xxhash.xxh3_128_intdigest(k) for k in words.cast(pa.binary()).to_pylist()]
    table = np.array([((d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)) for d in digests], np.int64).reshape(-1, 2)
    long = pc.utf8_length(words).to_numpy() >= min_chars
    code = keys.indices.to_numpy().astype(np.int64)
    return np.repeat(np.arange(len(texts)), n), np.where(long[code], code, -1) if len(code) else code, table, flat


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, hi, lo): the distinct 128-bit line keys of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            doc, code, table, _ = _line_hashes(batch.column(1), min_chars)
            pair = np.unique((doc * (len(table) + 1) + code)[code >= 0])
            doc, code = pair // (len(table) + 1), pair % (len(table) + 1)
            ids = batch.column(0).to_numpy()[doc]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, table[code, 0], table[code, 1])], names=["id", "hi", "lo"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, hi long, lo long")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")


def shards_for(keys: DataFrame, shard_keys: int = SHARD_KEYS) -> int:
    """Shards, a power of two, so that each is planned for at most ``shard_keys`` distinct keys."""
    return 1 << max(0, int(np.ceil(np.log2(max(1, keys.agg(F.approx_count_distinct("lo")).first()[0] or 0) / shard_keys))))


def empty_state(spark) -> DataFrame:
    return spark.createDataFrame([], STATE)


def split_shards(state: DataFrame, shards: int) -> DataFrame:
    """The state over ``shards`` shards, a multiple of those it has: each shard is split where it lies, by further bits of its keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for r in frame.itertuples(index=False):
                hi, lo, docs = (np.asarray(x, np.int64) for x in (r.hi, r.lo, r.docs))
                if r.shards >= shards:
                    yield pd.DataFrame([r])
                    continue
                to = hi & (shards - 1)
                for k in range(r.shard, shards, r.shards):
                    own = to == k
                    if own.any():
                        yield pd.DataFrame({"shard": [k], "shards": [shards], "hi": [hi[own]], "lo": [lo[own]], "docs": [docs[own]], "filter": [CuckooFilter.of(lo[own]).to_bytes()]})

    return state.mapInPandas(run, STATE)


def apply_changes(state: DataFrame, keys: DataFrame, sign: int, shards: int) -> DataFrame:
    """The state after inserting (``sign`` 1) or deleting (-1) documents with these line keys.

    Counts are summed before they move, so a key that every document holds is one
    row of its shard. Where the state has fewer than ``shards`` shards, a power of
    two, they split first. A deletion of a key that the state lacks, or of more
    documents than it has, raises.
    """
    change = keys.groupBy("hi", "lo").agg((F.count("*") * sign).alias("by")).withColumn("shard", F.col("hi").bitwiseAND(F.lit(shards - 1)).cast("int"))

    def update(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        hi, lo, docs = (np.array(old[c].iloc[0] if len(old) else [], np.int64) for c in ("hi", "lo", "docs"))
        cuckoo = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter.sized(len(new))
        n_hi, n_lo, by = (new[c].to_numpy(np.int64) for c in ("hi", "lo", "by"))
        # Only keys that the filter may hold are looked up; the exact table is sorted by lo and hi.
        asked = np.flatnonzero(cuckoo.contains(n_lo))
        at = _find(hi, lo, n_hi[asked], n_lo[asked])
        hit = np.full(len(n_lo), -1)
        hit[asked] = at
        fresh = hit < 0
        if sign < 0 and fresh.any():
            raise ValueError("a deletion names line keys that were never inserted")
        docs[hit[~fresh]] += by[~fresh]
        if (docs < 0).any():
            raise ValueError("a deletion names more documents than were inserted")
        gone = docs == 0
        cuckoo.remove(lo[gone])
        hi, lo, docs = (np.concatenate([a[~gone], b[fresh]]) for a, b in ((hi, n_hi), (lo, n_lo), (docs, by)))
        if not cuckoo.add(n_lo[fresh]):
            cuckoo = CuckooFilter.of(lo)
        order = np.lexsort((hi, lo))
        return pd.DataFrame({"shard": [int(key[0])], "shards": [shards], "hi": [hi[order]], "lo": [lo[order]], "docs": [docs[order]], "filter": [cuckoo.to_bytes()]})

    return split_shards(state, shards).groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(update, STATE)


def _find(hi: np.ndarray, lo: np.ndarray, want_hi: np.ndarray, want_lo: np.ndarray) -> np.ndarray:
    """Places of keys in a table sorted by (lo, hi), -1 for those it lacks."""
    at, stop = np.searchsorted(lo, want_lo, "left"), np.searchsorted(lo, want_lo, "right")
    found = np.full(len(want_lo), -1)
    live = np.flatnonzero(at < stop)
    while len(live):  # a second step only where 64 bits of two keys agree
        same = hi[at[live]] == want_hi[live]
        found[live[same]] = at[live[same]]
        live = live[~same]
        at[live] += 1
        live = live[at[live] < stop[live]]
    return found


def counts(state: DataFrame) -> DataFrame:
    """The exact reference-count table: rows (hi, lo, docs)."""
    return state.select(F.explode(F.arrays_zip("hi", "lo", "docs")).alias("x")).select("x.hi", "x.lo", "x.docs")


def surplus(keys: DataFrame, repeated: DataFrame) -> DataFrame:
    """Line keys that rows of the ids in ``repeated`` hold again: a row (id, hi, lo) for each time beyond the first."""
    again = keys.join(repeated.select("id"), "id", "left_semi").groupBy("id", "hi", "lo").agg(F.count("*").alias("n")).filter("n > 1")
    return again.select("id", "hi", "lo", F.explode(F.sequence(F.lit(2), F.col("n").cast("int")))).select("id", "hi", "lo")


def insert_all(keys: DataFrame, repeated: DataFrame, shard_keys: int = SHARD_KEYS, batches: int = BATCHES) -> DataFrame:
    """The state of all documents: inserted batch by batch, then what rows of ``repeated`` ids counted again is deleted."""
    shards, state = shards_for(keys, shard_keys), empty_state(keys.sparkSession)
    # The first batches plan for their own keys and the last one splits their shards.
    for b in range(batches):
        own = keys.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == b)
        state = materialize(apply_changes(state, own, 1, shards if b == batches - 1 else max(1, shards >> 1)), "line-state")
    again = materialize(surplus(keys, repeated), "line-surplus")
    return materialize(apply_changes(state, again, -1, shards), "line-state") if again.limit(1).count() else state


def drop_lines(docs: DataFrame, keys: DataFrame, state: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, text, n_lines, n_dropped) and the columns ``carry``: the documents without lines whose key ``min_docs`` documents hold."""
    frequent = materialize(counts(state).filter(F.col("docs") >= min_docs).select("hi", "lo"), "line-frequent")
    drops = keys.join(frequent, ["hi", "lo"], "left_semi").groupBy("id").agg(F.collect_set(F.struct("hi", "lo")).alias("drop"))
    drops = materialize(drops, "line-drops", keep=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts, drop = pc.fill_null(batch.column(1), ""), batch.column(2)
            n_lines = pc.add(pc.count_substring(texts, "\n"), 1).to_numpy().astype(np.int64)
            n_dropped = np.zeros(len(n_lines), np.int64)
            some = np.flatnonzero(drop.is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                doc, code, table, lines = _line_hashes(texts.take(pa.array(some)), min_chars)
                chosen = drop.take(pa.array(some))
                own = np.repeat(np.arange(len(some)), pc.list_value_length(chosen).to_numpy())
                hi, lo = (x.to_numpy() for x in chosen.flatten().flatten())
                row = {k: i for i, k in enumerate(map(tuple, table.tolist()))}
                named = np.array([row.get(k, -2) for k in zip(hi.tolist(), lo.tolist(), strict=True)], np.int64)
                width = len(table) + 2
                gone = np.isin(doc * width + code, own * width + named)
                n_dropped[some] = np.bincount(doc[gone], minlength=len(some))
                left = np.bincount(doc[~gone], minlength=len(some))
                kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32)), lines.filter(pa.array(~gone))), "\n")
                texts = pc.replace_with_mask(texts, pa.array(np.isin(np.arange(len(texts)), some)), kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), texts, pa.array(n_lines), pa.array(n_dropped), *batch.columns[3:]], names=["id", "text", "n_lines", "n_dropped", *slots])

    slots = [f"carried_{i}" for i in range(len(carry))]  # names that nothing here uses
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(x) for c, x in zip(carry, slots, strict=True))).filter("id is not null")
    marked = texts.join(drops.hint("shuffle_hash"), "id", "left").select("id", "text", "drop", *slots)
    schema = "id long, text string, n_lines long, n_dropped long" + "".join(f", {x} {docs.schema[c].dataType.simpleString()}" for c, x in zip(carry, slots, strict=True))
    return marked.mapInArrow(cut, schema).select("id", "text", "n_lines", "n_dropped", *(F.col(x).alias(c) for c, x in zip(carry, slots, strict=True)))


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), batches: int = BATCHES) -> DataFrame:
    """Documents without their frequent lines: ``id_col, text, n_lines, n_dropped`` and the columns ``carry``.

    A text is split at line feeds; null or empty text is one empty line. A line's
    key is the line stripped of ASCII white space with A-Z in lower case. Lines of
    keys with at least ``min_chars`` code points that ``min_docs`` documents hold
    go from every document; a key in just that many goes too. Rows without an id
    are left out; rows that repeat an id count as one document and each lose their
    own lines. Texts of any length are read whole, a document's lines in one batch. An
    empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    with scratch(docs.sparkSession):
        keys = materialize(line_keys(docs, min_chars, id_col, text_col), "line-keys")
        repeated = _texts(docs, id_col, text_col).groupBy("id").count().filter("count > 1")
        state = insert_all(keys, repeated, shard_keys, batches)
        found = drop_lines(docs, keys, state, min_docs, min_chars, id_col, text_col, carry)
    return found.select(F.col("id").alias(id_col), *found.columns[1:])


def line_digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return result.select(id_col, "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
