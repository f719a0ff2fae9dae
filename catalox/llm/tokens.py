"""Token ids of whole texts, by white-space chunk with a bounded memo."""

from __future__ import annotations

import json
import string
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Chunks a worker remembers before it starts again.
MEMO_CHUNKS = 500_000
#: New chunks that go to the tokenizer in one text.
RUN = 4096
# Fixed value: how a lower-casing tokenizer with word ends splits texts, for which chunks are known to be apart.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: ASCII marks; an apostrophe may begin a part with letters.
MARKS = string.punctuation.replace("'", "")


class Ids:
    """Runs of ids in one array."""

    def __init__(self, pool: np.ndarray, size: np.ndarray):
        self.pool, self.size = pool, size
        self.start = np.cumsum(size) - size

    @classmethod
    def of(cls, parts: list[bytes]) -> Ids:
        return cls(np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these runs in a row, and where each run ends (from 0)."""
        size = self.size[at]
        end = np.concatenate([[0], np.cumsum(size)])
        return self.pool[np.repeat(self.start[at] - end[:-1], size) + np.arange(end[-1])], end


class ChunkTokenizer:
    """Ids of a text as little-endian unsigned 32-bit integers.

    The tokenizer's normaliser and splitter never join characters across ASCII
    white space, so a text's ids are those of its chunks in a row. Texts that hold
    the start of a special token are encoded whole. A word's last token bears the
    word-end suffix, so many new words are encoded as one text and told apart again.
    A tokenizer that does not lower-case or mark word ends encodes each text whole.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}
        about = json.loads(self.whole.to_str())
        steps = (about["normalizer"] or {}).get("normalizers", [about["normalizer"] or {}])
        #: Other tokenizers than lower-casing ones with word ends get whole texts.
        splits = (about["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_chunk = (
            any(x.get("type") == "Lowercase" for x in steps) and about["model"].get("end_of_word_suffix") == "</w>"
            and any(x.get("pattern") == {"Regex": PARTS} for x in splits))

    def _full(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _run(self, words: list[str]) -> list[bytes]:
        """Ids of words that are one part each."""
        ids = np.array(self.whole.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(words) or len(ids) != ends[-1] + 1:
            return self._full(words)
        stops = ((ends + 1) * 4).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *stops], stops)]  # noqa: B905

    def learn(self, cores: set[str]) -> None:
        need = cores.difference(self.memo)
        if len(self.memo) + len(need) > MEMO_CHUNKS:
            self.memo.clear()
            need = cores
        plain, words, rest = [], [], []
        for w in need:
            if w.isascii():
                (plain if w.isalpha() and w.islower() else rest).append(w)
            else:  # letters are one part; composition could bring in other characters
                (words if w.lower().isalpha() and unicodedata.is_normalized("NFC", w) else rest).append(w)
        model = self.whole.model  # a copy
        self.memo.update((w, array("I", [t.id for t in model.tokenize(w)]).tobytes()) for w in plain)
        for a in range(0, len(words), RUN):
            self.memo.update(zip(words[a : a + RUN], self._run(words[a : a + RUN]), strict=True))
        self.memo.update(zip(rest, self._full(rest), strict=True))

    def ids(self, words: pa.Array) -> Ids:
        """Ids of distinct chunks. Marks behind a letter or digit are a part of their own."""
        core = pc.ascii_rtrim(words, MARKS)
        core = pc.if_else(pc.match_substring_regex(core, r"[\p{L}\p{N}]$"), core, words)
        size = pc.subtract(pc.binary_length(words), pc.binary_length(core)).to_numpy()
        marked = np.flatnonzero(size)
        marks = [w[-n:] for w, n in zip(words.take(pa.array(marked)).to_pylist(), size[marked].tolist(), strict=True)]
        coded = core.dictionary_encode()
        cores = coded.dictionary.to_pylist()
        tails = {m: len(cores) + i for i, m in enumerate(dict.fromkeys(marks))}
        self.learn({*cores, *tails})
        parts = Ids.of([self.memo[w] for w in (*cores, *tails)] + [b""])
        pairs = np.full((len(words), 2), len(parts.size) - 1)
        pairs[:, 0] = coded.indices.to_numpy()
        pairs[marked, 1] = [tails[m] for m in marks]
        flat, end = parts.take(pairs.ravel())
        return Ids(flat, np.diff(end[::2]))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """``texts`` is an Arrow array of strings; null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_chunk:
            return self._full(texts.to_pylist())
        special = np.asarray(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False), bool)
        plain = pc.if_else(pa.array(special), "", texts)
        plain = pc.if_else(pc.string_is_ascii(plain), pc.ascii_lower(plain), plain)
        split = pc.ascii_split_whitespace(plain)
        upto = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        flat, end = self.ids(coded.dictionary).take(coded.indices.to_numpy())
        stops = end[upto]
        out = [flat[a:b].tobytes() for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
        for i, ids in zip(np.flatnonzero(special).tolist(), self._full(texts.filter(pa.array(special)).to_pylist()), strict=True):
            out[i] = ids
        return out
