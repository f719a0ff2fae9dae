"""Quality by the perplexity of an interpolated modified Kneser-Ney bigram model.

The model is counted on the trusted documents, one model per language, over all
their words. One trusted document in ``FOLDS`` is held out of the counts and sets the
thresholds. Texts are read once, into blocks of documents whose words are numbers
of the block's own vocabulary. Bigrams and words are known by hashes, with no
vocabulary anywhere. In one exchange a block sends each shard its bigrams with their
counts in its trusted documents; the shard sums them and tells all the counts back, and
names one block for each bigram. In a second exchange blocks send their words with what
the bigrams named to them add to a word, and the sums come back. The probability of a
word is put together in the block. Blocks and answers are stored in buckets by block, so they
are not moved again. A language's threshold is the quantile of its held-out good
documents' perplexity that loses a stated share of them, raised as far as that
keeps no further held-out bad document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalox.llm.common import chunks, materialize, multipliers, scratch, split_words, spread, tables_dir
from catalox.sources.scratch import delete

#: Trusted documents are dealt to so many folds by their id; the first is held out.
FOLDS = 5
#: Share of a language's held-out good documents that its threshold may lose to reject bad ones.
LOSS = 0.02
#: Words of average text that every document is taken to hold besides its own; steadies short texts.
PRIOR_WORDS = 20
#: Trusted ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Languages whose averages and thresholds may be broadcast.
BROADCAST_LANGUAGES = 10_000
#: Words of a block, one document at least; bigrams or words of all blocks planned for a shard.
BLOCK_WORDS, SHARD_KEYS = 2_000_000, 1_000_000
#: Bits of a word's number, and of a bigram's beside its shard's. A bigram that no trusted text holds passes for one that
#: does with a chance of the shard's trusted bigrams / 2^28, at any size: of 156,000 in a shard over 0.5 GB, one in 1,700.
WORD_BITS, PAIR_BITS = 40, 28
MULT = multipliers(3, 41)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents labelled good and not toxic; an id with any other label is left out."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).filter("good and id is not null").select("id")


def bad_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents that any label calls bad or toxic."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    return labels.filter(bad).select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct()


# Arrays as bytes: planes of bytes, so that what is small or alike packs well; sorted keys as differences.

def _pack(x: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()) if x.size else b""


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_codes(x: np.ndarray) -> bytes:
    """Ranks of words: what is above a byte, then the low bytes of frequent words and those of the others, each for itself."""
    high, low = x >> np.uint32(8), x.astype(np.uint8)
    packed = _pack(high, 9)
    return len(packed).to_bytes(8, "little") + packed + _pack(np.concatenate([low[high == 0], low[high > 0]]), 9)


def _unpack_codes(raw: bytes) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    high, low = _unpack(raw[8 : 8 + size], "<u4"), _unpack(raw[8 + size :], "u1").astype(np.uint32)
    out = high << np.uint32(8)
    often = high == 0
    out[often], out[~often] = low[: often.sum()], out[~often] | low[often.sum() :]
    return out


def _pack_keys(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, "<u8"), dtype=np.uint64)


def _cut(keys: np.ndarray, bits: int, total: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of the sorted keys of ``total`` bits, dealt to 2^bits shards by their leading bits."""
    shard = (keys >> np.uint64(total - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    first = np.flatnonzero(np.diff(shard, prepend=-1))
    for a, b in zip(first, [*first[1:], len(keys)], strict=False):
        yield int(shard[a]), int(a), int(b)


def _short(pairs: np.ndarray, bits: int) -> np.ndarray:
    """The ``PAIR_BITS`` bits of bigram keys that follow their shard's; their order stays."""
    return (pairs << np.uint64(bits)) >> np.uint64(64 - PAIR_BITS)


def _salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def _hashed(words: pa.Array) -> np.ndarray:
    """64-bit hashes; each distinct word is hashed once, and none is remembered."""
    coded = words.dictionary_encode()
    return np.array([xxhash.xxh64_intdigest(x) for x in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)[coded.indices.to_numpy()]


def _number(h: np.ndarray) -> np.ndarray:
    return spread(h) >> np.uint64(64 - WORD_BITS)


def _start(lang: str) -> np.uint64:
    """The number that stands before a text's first word."""
    return _number(np.array([_salt(lang)], np.uint64) * MULT[2])[0]


class Block:
    """Documents with their words as places in the block's vocabulary."""

    SCHEMA = "block long, langs array<string>, ids binary, lang binary, n binary, train binary, held binary, vocabulary binary, often binary, codes binary"

    def __init__(self, block: int, langs: list[str], ids: np.ndarray, lang: np.ndarray, n: np.ndarray, train: np.ndarray, held: np.ndarray, vocabulary: np.ndarray, codes: np.ndarray):
        self.block, self.langs, self.ids, self.lang, self.n, self.train, self.held, self.vocabulary, self.codes = block, langs, ids, lang, n, train, held, vocabulary, codes

    @classmethod
    def of(cls, block: int, parts: list[tuple]) -> Block:
        """From parts (ids, languages, word counts, train, held out, word numbers)."""
        names = [x for _, langs, *_ in parts for x in langs]
        langs = sorted(set(names))
        place = {x: i for i, x in enumerate(langs)}
        ids, n, train, held, words = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3, 4, 5))
        vocabulary, codes = np.unique(np.concatenate([words, [_start(x) for x in langs]]).astype(np.uint64), return_inverse=True)
        return cls(block, langs, ids, np.array([place[x] for x in names], np.uint32), n.astype(np.uint32), train, held, vocabulary, codes[: len(words)].astype(np.uint32))

    def row(self) -> tuple:
        """Codes are stored by frequency: words that come several times first, the others in order of number."""
        count = np.bincount(self.codes, minlength=len(self.vocabulary))
        often = np.flatnonzero(count > 1)
        often = often[np.argsort(-count[often], kind="stable")].astype(np.uint32)
        rank = np.empty(len(count), np.uint32)
        rank[self._order(often, len(count))] = np.arange(len(count), dtype=np.uint32)
        return (self.block, self.langs, _pack(self.ids.astype("<i8")), _pack(self.lang), _pack(self.n), _pack(self.train.astype("u1")), _pack(self.held.astype("u1")), _pack_keys(self.vocabulary), _pack(often), _pack_codes(rank[self.codes]))

    @staticmethod
    def _order(often: np.ndarray, size: int) -> np.ndarray:
        rest = np.ones(size, bool)
        rest[often] = False
        return np.concatenate([often, np.flatnonzero(rest).astype(np.uint32)])

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int) -> Block:
        raw = {name: batch.column(name)[i].as_py() for name in ("block", "langs", "ids", "lang", "n", "train", "held", "vocabulary", "often", "codes")}
        vocabulary = _unpack_keys(raw["vocabulary"])
        codes = cls._order(_unpack(raw["often"], "<u4"), len(vocabulary))[_unpack_codes(raw["codes"])]
        return cls(raw["block"], raw["langs"], _unpack(raw["ids"], "<i8"), *[_unpack(raw[x], k) for x, k in (("lang", "<u4"), ("n", "<u4"), ("train", "u1"), ("held", "u1"))], vocabulary, codes)

    def starts(self) -> np.ndarray:
        """The place of each language's start in the vocabulary."""
        return np.searchsorted(self.vocabulary, np.array([_start(x) for x in self.langs], np.uint64)).astype(np.uint32)

    def lang_of_words(self) -> np.ndarray:
        """The language of each word of the vocabulary; words of two languages have two numbers."""
        of = np.zeros(len(self.vocabulary), np.uint32)
        of[self.starts()] = np.arange(len(self.langs), dtype=np.uint32)
        of[self.codes] = np.repeat(self.lang, self.n)
        return of

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The key of each word with the one before it, and the place of that one in the vocabulary."""
        starts = self.starts()
        before = np.concatenate([[0], self.codes[:-1]]).astype(np.uint32) if len(self.codes) else self.codes
        first = np.cumsum(self.n.astype(np.int64)) - self.n
        before[first[self.n > 0]] = starts[self.lang[self.n > 0]]
        return spread(self.vocabulary[before] * MULT[0] + self.vocabulary[self.codes] * MULT[1]), before


def blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Blocks of ``docs(id, text, lang, train, held)``: about ``block_words`` words each, whole documents, from one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in chunks(batches, "text"):
            words, n = split_words(batch.column(1))
            langs = batch.column(2).to_pylist()
            salt = {x: _salt(x) for x in set(langs)}
            numbers = _number(_hashed(words) + np.repeat(np.array([salt[x] for x in langs], np.uint64), n)) if len(words) else np.zeros(0, np.uint64)
            flags = [batch.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (3, 4)]
            parts.append((batch.column(0).to_numpy(), langs, n, *flags, numbers))
            held += len(words)
            if held >= block_words:
                yield _rows([Block.of(number, parts).row()])
                parts, held, number = [], 0, number + 1
        if parts:
            yield _rows([Block.of(number, parts).row()])

    kinds = (pa.int64(), pa.list_(pa.string()), *[pa.binary()] * 8)
    names = [x.split()[0] for x in Block.SCHEMA.split(", ")]

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select("id", "text", "lang", "train", "held").mapInArrow(run, Block.SCHEMA)


@contextmanager
def _bucketed(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a table in buckets by ``block``, as many as a shuffle has partitions, for joins that leave it where it is."""
    spark = df.sparkSession
    name = f"catalox_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", f"{tables_dir(spark)}/{name}").option("compression", "none").bucketBy(parts, "block").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, f"{tables_dir(spark)}/{name}")


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that agree in ``keys``, which come together."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(row)
    if held:
        yield now, held


_SENT = "shard int, lang string, block long, keys binary, own binary, c1 long, c2 long, c3 long, c4 long"
_TOLD = "shard int, lang string, block long, found binary, c1 long, c2 long, c3 long, c4 long, types long, words long"
_NONE = (None,) * 4
#: Counts of a word: as a context; its bigrams of count 1, 2 and more as a context; the words it follows.
STATS = 5


def exchanged(sent: DataFrame, wide: int, name: bool) -> DataFrame:
    """What shards tell: for each row sent the sums over all rows of its shard and language, key by key.

    ``own`` holds ``wide`` numbers for each key. With ``name`` a number is doubled and
    one more in the row that speaks for the key. Rows (shard, lang, block -1) count the
    keys by their last number: how many have 1, 2, 3 or 4, the sum and how many have any.
    Rows of shard -1 only sum c1 to c4.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, lang), rows in _by_group(batches, ["shard", "lang"]):
            if shard < 0:
                yield _table([(-1, lang, -1, None, *[sum(r[c] for r in rows) for c in ("c1", "c2", "c3", "c4")], None, None)], _TOLD)
                continue
            keys = [_unpack_keys(r["keys"]) for r in rows]
            _, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            parts = np.concatenate([_unpack(r["own"], "<u8").reshape(wide, -1).T for r in rows])
            total = np.stack([np.bincount(place, parts[:, j], len(first)) for j in range(wide)], 1).astype(np.uint64)
            told = total[place]
            if name:
                told *= np.uint64(2)
                told[first[total[:, -1] > 0]] += np.uint64(1)
            at = np.cumsum([0, *map(len, keys)])
            last = total[:, -1]
            out = [(shard, lang, r["block"], _pack(told[a:b].T.ravel()), *_NONE, None, None) for r, a, b in zip(rows, at[:-1], at[1:], strict=True)]
            yield _table([*out, (shard, lang, -1, None, *[int((last == j).sum()) for j in (1, 2, 3, 4)], int(last.sum()), int((last > 0).sum()))], _TOLD)

    return sent.repartition("shard", "lang").sortWithinPartitions("shard", "lang", "block").mapInArrow(run, _TOLD)


def _per_block(told: DataFrame, name: str) -> DataFrame:
    return told.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("shard", "lang", "found")).alias(name))


def _found(batch: pa.RecordBatch, name: str, i: int, wide: int, lang: str = "") -> np.ndarray:
    """The numbers told to a block for its keys of a language, in order of key."""
    rows = sorted((x for x in batch.column(name)[i].as_py() or [] if x["lang"] == lang), key=lambda x: x["shard"])
    return np.concatenate([_unpack(x["found"], "<u8").reshape(wide, -1) for x in rows] or [np.zeros((wide, 0), np.uint64)], 1)


def send_pairs(held: DataFrame, bits: int) -> DataFrame:
    """The bigrams of each block, with their counts in its training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block.read(batch, i)
                keys, place = np.unique(b.pairs()[0], return_inverse=True)
                own = np.bincount(place, np.repeat(b.train, b.n), len(keys)).astype(np.uint64)
                short = _short(keys, bits)
                yield _table([(s, "", b.block, _pack_keys(short[x:y]), _pack(own[x:y]), *_NONE) for s, x, y in _cut(keys, bits, 64)], _SENT)

    return held.mapInArrow(run, _SENT)


def send_words(joined: DataFrame, bits: int) -> DataFrame:
    """The words of each block, with what the bigrams named to it add to their ``STATS``; and (shard -1) its bigrams by count.

    ``joined`` has the blocks and what they were told of their bigrams in ``pairs``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block.read(batch, i)
                keys, before = b.pairs()
                first = np.unique(keys, return_index=True)[1]
                told = _found(batch, "pairs", i, 1)[0]
                own = (told & np.uint64(1)) > 0
                at, count = first[own], (told[own] >> np.uint64(1)).astype(np.int64)
                a, w, size = before[at], b.codes[at], len(b.vocabulary)
                stats = np.stack([*[np.bincount(a, x, size) for x in (count, count == 1, count == 2, count > 2)], np.bincount(w, minlength=size)], 1).astype(np.uint64)
                of, rows = b.lang_of_words(), []
                for k, lang in enumerate(b.langs):
                    mine = of == k
                    words, own_stats, c = b.vocabulary[mine], stats[mine], count[of[w] == k]
                    rows += [(s, lang, b.block, _pack_keys(words[x:y]), _pack(own_stats[x:y].T.ravel()), *_NONE) for s, x, y in _cut(words, bits, WORD_BITS)]
                    rows.append((-1, lang, b.block, None, None, *[int((c == j).sum()) for j in (1, 2, 3, 4)]))
                yield _table(rows, _SENT)

    return joined.mapInArrow(run, _SENT)


def discounts(c1: int, c2: int, c3: int, c4: int) -> list[float]:
    """The modified Kneser-Ney discounts D1, D2, D3+ from counts of counts."""
    c = [c1, c2, c3, c4]
    if not any(c):
        return [0.5] * 3
    y = c1 / (c1 + 2 * c2) if c1 + c2 else 0.5
    d = [i - (i + 1) * y * c[i] / c[i - 1] if c[i - 1] else y * i for i in (1, 2, 3)]
    return [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]


def constants(told: DataFrame) -> dict[str, tuple]:
    """By language: discounts of bigrams, discounts of followed words, their number, the probability of a word that follows none, and the words.

    One row for each language with trusted text, of which the languages of the world bound the number.
    """
    counts = [f"c{i}" for i in (1, 2, 3, 4)]
    sums = told.filter("block < 0").groupBy("lang", (F.col("shard") < 0).alias("of_pairs")).agg(*[F.sum(c).alias(c) for c in (*counts, "types", "words")]).collect()
    pairs = {r["lang"]: discounts(*[r[c] for c in counts]) for r in sums if r["of_pairs"]}
    found = {}
    for r in sums:
        if r["of_pairs"] or not r["words"]:
            continue
        low = discounts(*[r[c] for c in counts])
        cut = low[0] * r["c1"] + low[1] * r["c2"] + low[2] * (r["words"] - r["c1"] - r["c2"])
        found[r["lang"]] = (np.array(pairs[r["lang"]]), np.array(low), r["types"], cut / r["types"] / (r["words"] + 1), r["words"])
    return found


def perplexities(joined: DataFrame, of: dict[str, tuple]) -> DataFrame:
    """Rows (id, lang, held_out, n, nats): each document's words and negative log-probability.

    ``joined`` has the blocks and what they were told, in ``pairs`` and ``words``.
    """
    schema = "id long, lang string, held_out boolean, n long, nats double"
    most = max((c[4] for c in of.values()), default=0)

    def cut(x: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x - np.where(x == 1, d[0], np.where(x == 2, d[1], d[2])), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block.read(batch, i)
                keys, before = b.pairs()
                count = (_found(batch, "pairs", i, 1)[0] >> np.uint64(1)).astype(np.float64)[np.unique(keys, return_inverse=True)[1]]
                cost, lang, of_word = np.empty(len(count)), np.repeat(b.lang, b.n), b.lang_of_words()
                for k, name in enumerate(b.langs):
                    mine = np.flatnonzero(lang == k)
                    if name not in of:
                        cost[mine] = np.log(most + 2.0)
                        continue
                    high, low, all_types, spare, _ = of[name]
                    own = of_word == k
                    at = np.cumsum(own) - 1
                    total, one, two, more, types = _found(batch, "words", i, STATS, name).astype(np.float64)
                    low_p = cut(types, low) / all_types + spare
                    weight = (high[0] * one + high[1] * two + high[2] * more) / np.maximum(total, 1)
                    a, p = at[before[mine]], low_p[at[b.codes[mine]]]
                    cost[mine] = -np.log(np.where(total[a] > 0, cut(count[mine], high) / np.maximum(total[a], 1) + weight[a] * p, p))
                upto = np.concatenate([[0.0], np.cumsum(cost)])
                end = np.cumsum(b.n.astype(np.int64))
                names = np.array(b.langs, object)[b.lang]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.ids, pa.int64()), pa.array(names, pa.string()), pa.array(b.held > 0), pa.array(b.n.astype(np.int64)), pa.array(upto[end] - upto[end - b.n])],
                    names=["id", "lang", "held_out", "n", "nats"])

    return joined.mapInArrow(run, schema)


def thresholds(good: DataFrame, bad: DataFrame, loss: float = LOSS) -> DataFrame:
    """Rows (lang, threshold) from held-out documents ``(lang, perplexity)`` of both kinds."""
    least = materialize(good.groupBy("lang").agg(F.percentile_approx("perplexity", 1 - loss, 100_000).alias("least")), "quality-least")
    beyond = bad.join(_small(least), "lang").filter("perplexity > least").groupBy("lang").agg(F.min("perplexity").alias("first_bad"))
    bounds = materialize(least.join(beyond, "lang", "left"), "quality-bounds")
    return good.join(_small(bounds), "lang").filter("first_bad is null or perplexity < first_bad").groupBy("lang").agg(F.max("perplexity").alias("threshold"))


def _small(by_lang: DataFrame) -> DataFrame:
    """A table of one row per language, broadcast up to ``BROADCAST_LANGUAGES`` rows."""
    return F.broadcast(by_lang) if by_lang.count() <= BROADCAST_LANGUAGES else by_lang


def classify(docs: DataFrame, labels: DataFrame, loss: float = LOSS, prior_words: int = PRIOR_WORDS, id_col: str = "doc_id", block_words: int = BLOCK_WORDS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per document: ``id_col, lang, n_words, perplexity, threshold, kept``.

    Words are runs without ASCII white space, unchanged. The perplexity takes each
    text to hold ``prior_words`` more words of its language's held-out average. A word
    that no trusted text of its language holds shares the rest of the probability. A
    document is kept up to its language's threshold, which loses at most about
    ``loss`` of the held-out good documents; where a language has none all its documents with words are
    kept (threshold null). A null, empty or blank text has no perplexity and is not
    kept. A null language is ''. A document at the threshold is kept. Rows without an
    id are left out; rows that repeat an id are scored each. Texts of any length are
    read whole, one at least in a block. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    with scratch(docs.sparkSession):
        base = docs.select(F.col(id_col).cast("long").alias("id"), "text", F.coalesce("lang", F.lit("")).alias("lang")).filter("id is not null")
        held_out = F.pmod(F.xxhash64("id"), F.lit(FOLDS)) == 0
        trusted = materialize(trusted_ids(labels).withColumn("held_out", held_out), "quality-trusted")
        side = F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted
        fold = F.col("held_out")
        marked = base.join(side, "id", "left").select("id", "text", "lang", F.coalesce(~fold, F.lit(False)).alias("train"), F.coalesce(fold, F.lit(False)).alias("held"))
        with _bucketed(blocks(marked, block_words)) as held:
            # Distinct bigrams of a block are planned as half of its words, distinct words as a tenth.
            size = held.agg(F.count("*")).first()[0] * block_words
            bits, word_bits = (int(size // (every * shard_keys)).bit_length() for every in (2, 10))
            with _bucketed(_per_block(exchanged(send_pairs(held, bits), 1, True), "pairs")) as pairs:
                joined = held.join(pairs, "block", "left")  # a block of empty texts has nothing to ask
                words = materialize(exchanged(send_words(joined, word_bits), STATS, False), "quality-words")
                scored = materialize(perplexities(joined.join(_per_block(words, "words"), "block", "left"), constants(words)), "quality-scores")

        known = scored.filter("held_out and n > 0")
        average = materialize(known.groupBy("lang").agg((F.sum("nats") / F.sum("n")).alias("average")), "quality-averages")
        rate = scored.join(_small(average), "lang", "left").withColumn(
            "perplexity", F.when(F.col("n") > 0, F.exp((F.col("nats") + prior_words * F.coalesce("average", F.col("nats") / F.col("n"))) / (F.col("n") + prior_words))))
        rate = materialize(rate, "quality-rates", keep=True)
        bad = materialize(bad_ids(labels).filter(held_out), "quality-bad")
        bad = rate.filter("n > 0").join(F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad, "id", "left_semi").select("lang", "perplexity")
        limits = materialize(thresholds(rate.filter("held_out and n > 0").select("lang", "perplexity"), bad, loss), "quality-limits", keep=True)
        return rate.join(_small(limits), "lang", "left").select(
            F.col("id").alias(id_col), "lang", F.col("n").alias("n_words"), "perplexity", "threshold",
            (F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).alias("kept"))
