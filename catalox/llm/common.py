"""Shared helpers: batch-wise access to texts, words and hashes; tables in the shared folder come from ``sources.scratch``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from catalox.sources.scratch import drop_tables, materialize, scratch, shared_dir, tables_dir

__all__ = ["HashMemo", "chunks", "drop_tables", "hashes", "materialize", "multipliers", "scratch", "shared_dir", "split_words", "spread", "tables_dir", "word_hashes"]

#: One bytes chunk of text handled at a time inside a Python task.
CHUNK_BYTES = 4 << 20
#: Entries a worker's word memo may hold before it starts again.
MEMO_ENTRIES = 500_000


class HashMemo(dict):
    """64-bit hashes of byte strings, remembered while they fit."""

    def __missing__(self, key: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        value = self[key] = xxhash.xxh64_intdigest(key)
        return value


def hashes(parts: list[bytes], memo: HashMemo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, parts), np.uint64, len(parts))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs without ASCII white space of all texts in a row, and how many each text has; null has none."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, upto = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    real = pc.binary_length(words).to_numpy() > 0
    before = np.concatenate([[0], np.cumsum(real)])
    return (words if real.all() else words.filter(pa.array(real))), np.diff(before[upto])


def word_hashes(words: pa.Array, memo: HashMemo) -> np.ndarray:
    """64-bit hashes; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    return hashes(coded.dictionary.cast(pa.binary()).to_pylist(), memo)[coded.indices.to_numpy()]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``text``, one row at least; at the end Arrow's free memory goes back, as workers serve many tasks."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        size = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
        start = 0
        ends = np.cumsum(size)
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()


def spread(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit sums so that every bit depends on all of them (fixed multipliers of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd random 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
